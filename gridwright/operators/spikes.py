"""Implausible readings per source: excursions beyond a fitted tail, stuck values, impossible values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.session import staged


#: Excursions above START scales of their source are exceedances, counted in BINS bins of WIDTH and one beyond; readings above KEEP scales are carried on.
START, WIDTH, BINS, KEEP = 0.5, 0.05, 130, 1.5
_RARE = 0.05


@dataclass(frozen=True)
class Tail:
    """How a field's excursions are judged.

    ``risk`` is the chance, per reading, that a usual excursion passes the cutoff; at most 0.001.
    """

    risk: float = 6e-6
    longest: int = 3
    stuck: int = 6

    def __post_init__(self) -> None:
        if not 0 < self.risk <= 1e-3:
            raise ValueError("risk must lie above 0 and not above 0.001")


def seasonal(x: np.ndarray, season: np.ndarray, width: int = 5, enough: int = 8) -> np.ndarray:
    """x less the median deviation of its season (a weekday) from the local level, where a season has enough readings."""
    off = x - local_level(x, width)
    out = x.copy()
    for s in np.unique(season):
        own = season == s
        if own.sum() >= enough:
            out[own] -= np.median(off[own])
    return out


def local_level(x: np.ndarray, width: int = 5) -> np.ndarray:
    """Median of the readings up to ``width`` before and after each, itself included; fewer at the ends."""
    n = len(x)
    if n <= 2 * width:
        return np.full(n, np.median(x)) if n else x
    out = np.empty(n)
    out[width : n - width] = np.median(np.lib.stride_tricks.sliding_window_view(x, 2 * width + 1), axis=1)
    for i in [*range(width), *range(n - width, n)]:
        out[i] = np.median(x[max(0, i - width) : i + width + 1])
    return out


def excursion(x: np.ndarray, longest: int = 3) -> np.ndarray:
    """How far each reading lies in an excursion of at most ``longest`` readings that is left again.

    For each stretch of up to ``longest`` readings around a reading: the least
    distance, to one side, of its members from both the reading before and the one
    after the stretch. The greatest of these counts, but no more than the distance
    from the local level. A lasting move to a new level has none; nor has a reading at an end of the series.
    """
    n = len(x)
    pad = np.full(longest + 1, np.nan)
    y = np.concatenate([pad, x, pad])
    at = lambda k: y[longest + 1 + k : longest + 1 + k + n]
    best = np.zeros(n)
    for length in range(1, longest + 1):
        for place in range(length):
            before, after = at(-place - 1), at(length - place)
            high, low = np.maximum(before, after), np.minimum(before, after)
            inside = [at(m - place) for m in range(length)]
            up, down = np.minimum.reduce(inside) - high, low - np.maximum.reduce(inside)
            best = np.fmax(best, np.maximum(up, down))
    return np.minimum(best, np.abs(x - local_level(x)))


def standardised(score: np.ndarray) -> np.ndarray:
    """Scores above their 70th percentile in scales of their source.

    The scale is the median of the excesses over that percentile, of which half its value in ln 2 is an exponential's
    mean, so that a few implausible readings can't move it. A source that hardly moves has its positive scores for excesses; if these are rarer than
    one in twenty, nothing is usual about them and they lie infinitely far out.
    """
    if not len(score):
        return score
    u, half = np.quantile(score, [0.7, 0.85])
    if half <= u:
        up = score[score > 0]
        if not len(up):
            return np.zeros(len(score))
        if len(up) < _RARE * len(score):
            return np.where(score > 0, np.inf, 0.0)
        u, half = 0.0, float(np.median(up))
    return (score - u) * np.log(2.0) / (half - u)


def counted(z: np.ndarray) -> np.ndarray:
    """How many scores are no exceedances, lie in each bin, and lie beyond; counts of many sources add up."""
    at = np.clip(np.floor((z - START) / WIDTH), -1, BINS).astype(np.int64) + 1
    return np.bincount(at, minlength=BINS + 2)


def cutoff(counts: np.ndarray, risk: float, seen: float = 0.9, spread: float = 0.1) -> float:
    """The level that a usual score passes with chance ``risk``: peaks over threshold with a generalised Pareto tail.

    ``counts`` are of all sources together: in scales of their own they share one tail. Scale and shape are those of greatest
    likelihood, the highest exceedances (all but a share ``seen``) counted only as such, so implausible readings
    don't shape the tail they are judged by. A normal prior of deviation ``spread`` on the shape keeps fits of few readings sane. No exceedances, no cutoff (infinity).
    """
    above, total = counts[1:].astype(float), float(counts.sum())
    n = above.sum()
    if n == 0:
        return float("inf")
    last = min(int(np.searchsorted(np.cumsum(above), seen * n)) + 1, BINS)
    inside, beyond = above[:last], n - above[:last].sum()
    edges = np.arange(last + 1) * WIDTH
    shape, scale = np.meshgrid(np.linspace(-0.3, 0.6, 181), np.exp(np.linspace(np.log(0.2), np.log(5.0), 161)), indexing="ij")
    shape = np.where(np.abs(shape) < 1e-6, 1e-6, shape)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        left = np.maximum(1 + shape[..., None] * edges / scale[..., None], 0.0) ** (-1 / shape[..., None])
        likely = (np.log(np.maximum(left[..., :-1] - left[..., 1:], 1e-300)) * inside).sum(-1) + beyond * np.log(np.maximum(left[..., -1], 1e-300)) - 0.5 * (shape / spread) ** 2
    best = np.unravel_index(int(np.argmax(likely)), likely.shape)
    k, s = shape[best], scale[best]
    return max(KEEP, float(START + s * (((n / total) / risk) ** k - 1) / k))


def stuck(x: np.ndarray, least: int) -> np.ndarray:
    """True for all but the first of each run of at least ``least`` equal readings."""
    n = len(x)
    if not n:
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    lengths = np.diff(np.append(starts, n))
    out = np.repeat(lengths >= least, lengths)
    out[starts] = False
    return out


def judge(values: np.ndarray, season: np.ndarray, tail: Tail) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, stuck, usable) of one source's readings in order; NaN is missing and skipped, values not above 0 are no part of the level."""
    z, same, usable = np.zeros(len(values)), np.zeros(len(values), bool), np.zeros(len(values), bool)
    there = np.flatnonzero(~np.isnan(values))
    same[there] = stuck(values[there], tail.stuck)
    at = there[(values[there] > 0) & np.isfinite(values[there])]
    if len(at) > 2:
        z[at] = standardised(excursion(seasonal(np.log(values[at]), season[at]), tail.longest))
        usable[at] = True
    return z, same, usable


def scored(readings: DataFrame, source: list[str], key: str, order: str, tails: dict[str, Tail], impossible: dict[str, Column]) -> DataFrame:
    """field, key, z, stuck, impossible of each reading that may be flagged, and per source and field one row of ``counts`` (key NULL)."""
    fields = list(tails)
    cols = [*[col(s).alias(f"_s{i}") for i, s in enumerate(source)], col(key).alias("_key"), F.datediff(col(order), F.lit("1970-01-05").cast("date")).alias("_day")]
    cols += [col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(fields)] + [F.coalesce(impossible[f], F.lit(False)).alias(f"_i{i}") for i, f in enumerate(fields)]
    rows = readings.select(*cols)
    kind = rows.schema["_key"].dataType.simpleString()

    def of(table: pa.Table) -> pa.Table:
        day = table.column("_day").to_numpy(zero_copy_only=False)
        ranks = np.argsort(day, kind="stable")
        season = np.mod(day[ranks], 7)
        keys, names, found, hists = [], [], [], []
        for i, f in enumerate(fields):
            values = table.column(f"_f{i}").to_numpy(zero_copy_only=False).astype(float)[ranks]
            wrong = table.column(f"_i{i}").to_numpy(zero_copy_only=False).astype(bool)[ranks] & ~np.isnan(values)
            z, same, usable = judge(values, season, tails[f])
            hit = np.flatnonzero((z > KEEP) | same | wrong)
            keys.append(ranks[hit])
            names += [f] * len(hit)
            found.append(np.stack([z[hit], same[hit], wrong[hit]]))
            hists.append(counted(z[usable]).tolist())
        found = np.concatenate(found, axis=1)
        n, k = len(names), len(fields)
        picked = table.column("_key").take(pa.array(np.concatenate([*keys, np.zeros(k, np.int64)]).astype(np.int64), mask=np.arange(n + k) >= n))
        flags = [pa.array(np.concatenate([found[j] > 0, np.zeros(k, bool)])) for j in (1, 2)]
        return pa.table({"field": pa.array(names + fields, pa.string()), "key": picked, "z": pa.array(np.concatenate([found[0], np.zeros(k)])), "stuck": flags[0], "impossible": flags[1], "counts": pa.array([None] * n + hists, pa.list_(pa.int64()))})

    return rows.groupBy(*[f"_s{i}" for i in range(len(source))]).applyInArrow(of, f"field string, key {kind}, z double, stuck boolean, impossible boolean, counts array<bigint>")


def flag(readings: DataFrame, source: list[str], key: str, order: str, tails: dict[str, Tail], impossible: dict[str, Column]) -> DataFrame:
    """(key, field, spike, stuck, impossible) of each reading with at least one of them.

    ``readings`` holds one row per source and ``order`` (a date), so a source's group is
    bounded by the days it covers, not by the rows delivered. ``impossible`` gives each
    field's rule as a boolean; NULL counts as false. Missing readings (NULL, NaN)
    are skipped. Empty input gives no rows. Every source is scored once, the scores that may matter are kept in the shared folder; a field's cutoff
    comes from the exceedances of all its sources, of which only the counts by bin reach the driver.
    """
    scores = staged(scored(readings, source, key, order, tails, impossible), "scores")
    held: dict[str, np.ndarray] = {f: np.zeros(BINS + 2, np.int64) for f in tails}
    bins = scores.where(F.col("counts").isNotNull()).select("field", F.posexplode("counts").alias("bin", "n")).groupBy("field", "bin").agg(F.sum("n").alias("n"))
    for r in bins.collect():  # fields x bins
        held[r["field"]][r["bin"]] = r["n"]
    spike = F.lit(False)
    for f, tail in tails.items():
        spike = F.when(F.col("field") == f, F.col("z") > cutoff(held[f], tail.risk)).otherwise(spike)
    out = scores.where(F.col("counts").isNull()).withColumn("spike", spike).where(F.col("spike") | F.col("stuck") | F.col("impossible"))
    return out.select(F.col("key").alias(key), "field", "spike", "stuck", "impossible")
