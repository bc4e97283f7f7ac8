import datetime as dt
import math

import numpy as np
import pytest

from gridwright.operators import panel as P
from gridwright.operators import recurrences as R
from gridwright.plans.compile import CompileError, evaluate
from gridwright.plans.dsl import parse

day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def grid(spark, **series):
    """Series as lists of days of rows of symbols A, B, ..."""
    first = next(iter(series.values()))
    rows = [(day(r), chr(65 + c), c, *(None if s[r][c] is None else float(s[r][c]) for s in series.values())) for r in range(len(first)) for c in range(len(first[0]))]
    return spark.createDataFrame(rows, "day date, symbol string, ord int, " + ", ".join(f"{n} double" for n in series))


def values(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["day"] - day(0)).days, {})[r["symbol"]] = None if r["v"] is None else round(r["v"], 6)
    return [[out[d][s] for s in sorted(out[d])] for d in sorted(out)]


def run(spark, text, industry=None, **series):
    return values(evaluate(grid(spark, **series), parse(text), industry))


def test_missing_values_compare_false(spark):
    x, y = [[1, None, 3]], [[2, 2, None]]
    assert run(spark, "x > y", x=x, y=y) == [[0, 0, 0]] and run(spark, "x < y", x=x, y=y) == [[1, 0, 0]]
    assert run(spark, "not (x > y)", x=x, y=y) == [[1, 1, 1]] and run(spark, "x + y", x=x, y=y) == [[3, None, None]]
    assert run(spark, "x / (y - 2)", x=x, y=y) == [[math.inf, None, None]]


def test_windows_count_rows(spark):
    x = [[1], [None], [3], [4]]
    assert run(spark, "sma(x, 2)", x=x) == [[1], [1], [3], [3.5]] and run(spark, "rolling_max(x, 2)", x=x) == [[None], [None], [None], [4]]
    assert run(spark, "std(x, 1)", x=x) == [[0], [None], [0], [0]] and run(spark, "sustain(x > 0, 2, 1)", x=x) == [[0], [1], [1], [1]]


def test_ties_and_quantiles(spark):
    x = [[2, 2, 1, None, 2]]
    assert run(spark, "is_largest(x, 2)", x=x) == [[1, 1, 0, 0, 0]] and run(spark, "is_smallest(x, 2)", x=x) == [[1, 0, 1, 0, 0]]
    assert run(spark, "rank(x, pct=false)", x=x) == [[3, 3, 1, None, 3]] and run(spark, "rank(x)", x=x) == [[0.75, 0.75, 0.25, None, 0.75]]
    assert run(spark, "bucket(x, 2)", x=x) == [[2, 2, 1, None, 2]] and run(spark, "zscore(x - x)", x=x) == [[0, 0, 0, None, 0]]
    assert run(spark, "normalize_row(x - x)", x=x) == [[0, 0, 0, None, 0]] and run(spark, "quantile_row(x, 0.5)", x=x) == [[2]]


def test_recurrences():
    x = np.array([10, 11, 10, 12, 13, 12.0])
    assert np.allclose(R.rsi(x, 3)[3:], [75, 81.818182, 58.064516], atol=1e-6) and np.isnan(R.rsi(x, 3)[:3]).all()
    e = R.ema(np.array([np.nan, 1, 2, 3, np.nan, 5]), 2)
    assert np.allclose(e[2:], [1.5, 2.5, 2.5, 4.166667], atol=1e-6)
    assert np.isnan(R.ema(np.array([1, np.nan, 2, 3]), 2)).all() and np.isnan(R.ema(np.array([]), 2)).all()
    up = np.arange(6.0)
    plus, minus = R.directional(up + 1, up, up + 0.5, 2)
    assert np.allclose(plus[2:], 66.666667) and np.allclose(minus[2:], 0) and np.allclose(R.adx(up + 1, up, up + 0.5, 2)[3:], 100)


def test_rotation(spark):
    entry = [[1, 1, 0], [1, 0, 1], [0, 0, 1], [0, 0, 0]]
    leave = [[0, 0, 0], [0, 0, 0], [1, 0, 0], [0, 0, 0]]
    # ties go to the later column; holders come before newcomers
    assert run(spark, "hold_until(e, x, 1)", e=entry, x=leave) == [[0, 1, 0], [0, 1, 0], [0, 1, 0], [0, 1, 0]]
    assert run(spark, "hold_until(e, x)", e=entry, x=leave) == [[1, 1, 0], [1, 1, 1], [0, 1, 1], [0, 1, 1]]


def test_sectors(spark):
    sec = spark.createDataFrame([("A", "s"), ("B", "s"), ("C", "t"), ("A", "s")], "symbol string, sector string")
    x = [[1, 3, 5, 7]]
    assert run(spark, "neutralize_industry(x)", sec, x=x) == [[-1, 1, 0, 0]] and run(spark, 'in_sector(x, "s")', sec, x=x) == [[1, 1, 0, 0]]
    assert run(spark, "cap_industry(x, 2)", sec, x=x) == [[0.5, 1.5, 2, 2]] and run(spark, 'groupby_category(x, "sum")', sec, x=x) == [[4, 5, 7]]
    assert run(spark, "industry_rank(x)", sec, x=x) == [[0.5, 1, 1, 1]] and run(spark, "neutralize_industry(x)", x=x) == [[None] * 4]


def test_neutralize(spark):
    x, y, z = [[1, 2, 3, 5]], [[1, 2, 3, 4]], [[1, 0, 1, 0]]
    a = np.column_stack([np.ones(4), y[0], z[0]])
    res = np.array(x[0]) - a @ np.linalg.lstsq(a, np.array(x[0], float), rcond=None)[0]
    assert np.allclose(run(spark, "neutralize(x, [y, z])", x=x, y=y, z=z), [res], atol=1e-5)
    assert run(spark, "neutralize(x, [y, y])", x=x, y=y) == [[None] * 4]


def test_errors(spark):
    for text in ("nope", "x > sma(1, 2)", "1 > 2", "rebalance(x)", 'rebalance(x, freq="D")', "sma(x, 0)", 'groupby_category(x, "max")', "obv(x, rebalance(x, freq=\"W\"))"):
        with pytest.raises(CompileError):
            run(spark, text, x=[[1.0]])


def test_axis_changes_align(spark):
    x = [[1], [2], [3], [4], [5], [6], [7], [8]]  # a Monday on
    assert run(spark, 'x - rebalance(x, freq="W")', x=x) == [[None]] * 6 + [[0], [0]]
    assert evaluate(grid(spark, x=x), parse("x + quantile_row(x, 0.5)")).count() == 0


def test_densify_as_of_wide(spark):
    cells = spark.createDataFrame([(day(0), "B", 1.0), (day(2), "A", 2.0)], "day date, symbol string, v double")
    dense = P.densify(cells)
    assert values(dense) == [[None, 1], [2, None]] and {r["symbol"]: r["ord"] for r in dense.collect()} == {"A": 0, "B": 1}
    facts = spark.createDataFrame([("A", day(-3), 1.0), ("A", day(1), 5.0), ("A", day(1), 4.0), ("A", None, 9.0)], "symbol string, seen date, f double")
    got = {((r["day"] - day(0)).days, r["symbol"]): r["f"] for r in P.as_of(dense, facts, "seen", ["f"]).collect()}
    assert got == {(0, "A"): 1, (2, "A"): 5, (0, "B"): None, (2, "B"): None}
    again = P.long(P.wide(dense, "v", ["B", "A"]), "v")
    assert sorted(map(tuple, again.collect()), key=str) == sorted([(day(0), "A", 1, None), (day(0), "B", 0, 1.0), (day(2), "A", 1, 2.0), (day(2), "B", 0, None)], key=str)
    assert P.densify(cells.limit(0)).count() == 0
