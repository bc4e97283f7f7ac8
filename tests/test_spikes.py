import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import spikes as S


def walk(n=300, sd=0.01, seed=1):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sd, n)))


def spiked(x, **kw):
    tail = S.Tail(**kw)
    z, _, usable = S.judge(x, np.arange(len(x)) % 5, tail)
    return set(np.flatnonzero(z > S.cutoff(S.counted(z[usable]), tail.risk)))


def test_planted_cases():
    assert spiked(walk()) == set()
    x = walk()
    x[50] *= 1.6
    x[100:103] *= 0.5
    x[200:] *= 1.8  # a move that lasts
    x[250:254] *= 1.5  # four readings: longer than an excursion
    assert spiked(x) == {50, 100, 101, 102}


def test_missing_zero_short():
    x = walk()
    x[[20, 21]] = np.nan
    x[22] = 0.0
    x[23] *= 2
    assert spiked(x) == {23}
    assert spiked(np.array([])) == set() and spiked(np.array([1.0, 9.0])) == set()
    assert spiked(np.full(50, 3.0)) == set() and spiked(np.full(9, np.nan)) == set()


def test_stuck():
    x = np.array([1, 1, 1, 2, 2, np.nan, 2, 2, 2, 2, 3.0])
    same = S.judge(x, np.zeros(len(x)), S.Tail())[1]
    assert list(np.flatnonzero(same)) == [4, 6, 7, 8, 9]
    assert not S.stuck(np.array([2.0] * 5), 6).any()


def test_cutoff_keeps_its_risk():
    rng = np.random.default_rng(0)
    for shape in (0.0, 0.15):
        score = rng.exponential(1.0, 400_000) if not shape else (rng.uniform(size=400_000) ** -shape - 1) / shape
        clean = S.cutoff(S.counted(score), 1e-3)
        assert 4e-4 < (score > clean).mean() < 2e-3
        score[:4000] = 1e6  # a hundredth is implausible
        assert clean <= S.cutoff(S.counted(score), 1e-3) < 1.35 * clean
    assert S.cutoff(S.counted(np.zeros(50)), 1e-3) == np.inf and S.cutoff(S.counted(np.zeros(0)), 1e-3) == np.inf


def test_counts_of_sources_add_up():
    a, b = np.random.default_rng(1).exponential(2.0, (2, 500))
    assert (S.counted(a) + S.counted(b) == S.counted(np.concatenate([a, b]))).all()
    assert S.counted(np.array([0.5, 0.50001, np.inf, -3.0])).sum() == 4


def test_sources_that_hardly_move():
    x = np.full(100, 5.0)
    x[40] = 5.1
    assert S.standardised(S.excursion(np.log(x)))[40] == np.inf and not S.standardised(np.zeros(9)).any() and not len(S.standardised(np.zeros(0)))
    x[::9] *= 1.01  # more than a few move
    assert np.isfinite(S.standardised(S.excursion(np.log(x)))).all()


def test_flag(spark):
    x = walk(60)
    x[30] *= 3
    rows = [(k, "s", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(v), float(v) + 1) for k, v in enumerate(x)]
    rows += [(1000, "t", dt.date(2024, 1, 1), -4.0, None), (1001, None, dt.date(2024, 1, 1), float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, src string, d date, v double, high double").withColumn("field", F.lit("clash")).withColumn("_key", F.lit(1))
    got = {(r["id"], r["spike"], r["impossible"]) for r in S.flag(df, ["src"], "id", "d", {"v": S.Tail()}, {"v": (F.col("v") <= 0) | (F.col("high") < F.col("v"))}).collect()}
    assert got == {(30, True, False), (1000, False, True)}
    assert S.flag(df.limit(0), ["src"], "id", "d", {"v": S.Tail()}, {"v": F.col("v") <= 0}).count() == 0
    with pytest.raises(ValueError, match="risk"):
        S.Tail(risk=0.5)
