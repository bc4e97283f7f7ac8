import datetime as dt

import numpy as np
import pytest

from gridwright.plans.dsl import parse
from gridwright.portfolio import metrics, nav, research

NAN = float("nan")


def book(pos, px, cfg=None, hi=None, lo=None, op=None, vol=None, start=None):
    px = np.array(px, float)
    blank = np.full(px.shape, NAN)
    other = [blank if m is None else np.array(m, float) for m in (op, hi, lo, vol)]
    cfg = cfg or nav.Costs()
    out = nav.run_book(np.array(pos, float), px, *other, cfg, start)
    return out | {"trades": nav.trades_of(out, px, other[1], other[2], cfg)}


def test_drift_and_costs():
    assert np.allclose(book([[1, 1]] * 3, [[1, 1], [2, 1], [2, 2]])["equity"], [1, 1.5, 2])
    b = book([[1], [0]], [[10], [11]], nav.Costs(fee=0.01, tax=0.02))
    assert np.allclose(b["equity"], [0.99, 0.99 * 1.1 * 0.97]) and np.isclose(b["trades"][0][3], 0.99 * 1.1 * 0.97 - 1)
    assert np.allclose(book([[4, 0]], [[1, 1]], nav.Costs(position_limit=0.3))["exposure"], [0.3])
    assert np.isclose(book([[1]], [[1]], nav.Costs(fee=0.01), start=np.array([1.0]))["equity"][0], 1)


def test_missing_holds_and_gaps():
    assert np.allclose(book([[1], [NAN], [NAN]], [[10], [NAN], [20]])["equity"], [1, 1, 1])


def test_delisting():
    b = book([[0.5]] * 4, [[10], [10], [NAN], [NAN]], nav.Costs(delist_after=2, delist_haircut=0.4, fee=0.1))
    assert np.allclose(b["equity"], [0.95, 0.95, 0.95, 0.95 * 0.8]) and b["trades"][0][2] == 3 and np.isclose(b["trades"][0][7], 6)


def test_stops():
    cfg = nav.Costs(stops=nav.Stops(stop_loss=0.1))
    b = book([[1]] * 3, [[10], [8], [12]], cfg, hi=[[10], [10], [12]], lo=[[10], [7], [8]], op=[[10], [9.5], [8]])
    assert np.allclose(b["equity"], [1, 0.9, 0.9]) and np.isclose(b["trades"][0][7], 9)
    gap = book([[1]] * 2, [[10], [7]], cfg, hi=[[10], [8]], lo=[[10], [7]], op=[[10], [8]])
    assert np.allclose(gap["equity"], [1, 0.8])
    again = book([[1], [1], [0], [1], [1]], [[10], [8], [8], [8], [16]], nav.Costs(stops=nav.Stops(stop_loss=0.1, fill="close")))
    assert np.allclose(again["equity"], [1, 0.8, 0.8, 0.8, 1.6])
    trail = book([[1]] * 3, [[10], [14], [12]], nav.Costs(stops=nav.Stops(trail_stop=0.1)), hi=[[10], [15], [14]], lo=[[10], [10], [11]])
    assert np.allclose(trail["equity"], [1, 1.4, 1.4]) and trail["trades"][0][7] == pytest.approx(14)
    short = book([[-1]] * 2, [[10], [12]], cfg, hi=[[10], [12]], lo=[[10], [10]])
    assert np.allclose(short["equity"], [1, 0.9]) and short["trades"][0][8] == "short"
    take = book([[1]] * 2, [[10], [10]], nav.Costs(stops=nav.Stops(take_profit=0.2)), hi=[[10], [13]], lo=[[10], [10]])
    assert np.allclose(take["equity"], [1, 1.2])


def test_liquidity_and_impact():
    cfg = nav.Costs(capital=100, max_participation=0.1)
    assert np.allclose(book([[1]], [[1]], cfg, vol=[[200]])["exposure"], [0.2])
    cost = book([[1]], [[1]], nav.Costs(capital=100, impact=0.1), vol=[[400]])
    assert np.isclose(cost["equity"][0], 1 - 0.1 * 0.5)


def curve(spark, values):
    return spark.createDataFrame([("v", dt.date(2024, 1, 1) + dt.timedelta(days=30 * k), float(x)) for k, x in enumerate(values)], "variant string, day date, equity double")


def test_summary_and_periods(spark):
    m = metrics.summary(curve(spark, [1, 1.1, 0.99, 0.99, 1.2])).first()
    assert m["total_return"] == pytest.approx(0.2) and m["max_drawdown"] == pytest.approx(-0.1) and m["max_drawdown_duration"] == 2 and m["worst_day"] == pytest.approx(-0.1)
    one = metrics.summary(curve(spark, [1])).first()
    assert one["total_return"] == 0 and one["sharpe"] is None and one["cagr"] is None
    assert metrics.summary(curve(spark, []).limit(0)).count() == 0
    assert metrics.bootstrap(curve(spark, [1, 1.1, 0.9, 1.2]), 20).collect() == metrics.bootstrap(curve(spark, [1, 1.1, 0.9, 1.2]), 20).collect()


def test_research(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=r), s, c, float(10 + r + (r * 7 + c * 3) % 5)) for r in range(40) for c, s in enumerate("AB")]
    panel = spark.createDataFrame(rows, "day date, symbol string, ord int, close double")
    out, failed = research.sweep(panel, {"a": parse("close > sma(close, 3)"), "b": parse("close > 12"), "bad": parse("nope")}, nav.Costs())
    assert set(failed) == {"bad"} and {r["variant"] for r in research.board(out).collect()} == {"a", "b"}
    assert set(research.grid({"op": "Average", "of": {"op": "Data", "name": "x"}, "n": "$n"}, {"n": [1, 2]})) == {"n=1", "n=2"}
    shown = research.board(out, failed=failed).collect()
    assert [(r["variant"], r["ok"]) for r in shown][-1] == ("bad", False) and shown[-1]["error"] and shown[0]["ok"]


def bars(spark, values, names="ABCDEFGH"):
    """Closes as lists of days of rows of symbols."""
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=r), names[c], c, None if x is None else float(x)) for r, row in enumerate(values) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, "day date, symbol string, ord int, close double")


def test_walk_forward_windows():
    assert research.segments(list(range(10)), 3, 2) == [(0, 3, 5), (5, 8, 10)] and research.segments(list(range(9)), 3, 2)[-1] == (5, 8, 9)
    assert research.segments(list(range(3)), 3, 2) == []
    with pytest.raises(ValueError, match="at least one day"):
        research.segments([1], 0, 1)


def test_walk_forward_earns_over_its_seams(spark):
    # A rises by a tenth a day, B falls: the variant that holds A wins, and no return is lost where a window begins
    panel = bars(spark, [[1.1**k, 0.95**k] for k in range(14)], "AB")
    variants = {"a": parse("is_largest(close, 1)"), "b": parse("is_smallest(close, 1)")}
    w = research.walk_forward(panel, variants, nav.Costs(), 4, 3)
    assert [x["variant"] for x in w.windows] == ["a", "a"] and len(w.windows) == 2
    assert np.allclose([x["test_return"] for x in w.windows], [1.1**3 - 1] * 2)
    assert len(w.curve) == 6 and np.isclose(w.curve[-1][1], 1.1**6) and np.isclose(w.figures["total_return"], 1.1**5 - 1)
    # the last window may be short; a book carried over the seam pays no fee again
    short = research.walk_forward(bars(spark, [[1.1**k, 0.95**k] for k in range(12)], "AB"), variants, nav.Costs(fee=0.01), 4, 3)
    assert (short.windows[-1]["test_to"] - short.windows[-1]["test_from"]).days == 0 and np.isclose(short.curve[-1][1], 0.99 * 1.1**4)
    with pytest.raises(ValueError, match="too few"):
        research.walk_forward(panel, variants, nav.Costs(), 20, 3)


def test_factor_figures_keep_thin_days(spark):
    close = [[10, 10, 10, 10, 10], [11, 12, 13, 14, 15], [12, 13, None, None, None], [13, 12, 13, 14, 15], [14, 14, 14, 15, 16]]
    f = [[1, 2, 3, 4, 5], [5, 4, 3, 2, 1], [1, 2, None, None, None], [1, 2, 3, 4, 5], [1, 1, 1, 1, 1]]
    panel = bars(spark, close)
    days = research.factor_days(bars(spark, f).withColumnRenamed("close", "v"), panel)
    got = {r["bucket"]: (round(r["mean_return"], 6), r["n"]) for r in research.factor_report(days).collect()}
    fwd = lambda r, c: close[r + 1][c] / close[r][c] - 1
    # days 0 and 3 have five cells, days 1 and 2 two: their cells fall into buckets 0 and 2
    assert got[0] == (round(np.mean([fwd(0, 0), fwd(1, 1), fwd(2, 0), fwd(3, 0)]), 6), 4) and got[2][1] == 4 and got[4][1] == 2
    fig = research.factor_figures(days).first()
    assert fig["n_days"] == 4 and fig["top_turnover"] == 1.0 and fig["icir"] == pytest.approx(fig["mean_ic"] / fig["ic_deviation"])
    assert fig["long_short"] == pytest.approx(np.mean([fwd(0, 4), fwd(3, 4)]) - np.mean([fwd(0, 0), fwd(1, 1), fwd(2, 0), fwd(3, 0)]))
    assert research.factor_figures(days.limit(0)).first()["n_days"] == 0


def test_event_study_passes_over_infinite_returns(spark):
    panel = bars(spark, [[1], [0], [5], [10]])
    events = bars(spark, [[0], [1], [0], [0]]).withColumnRenamed("close", "v")
    got = {r["lag"]: r["mean_return"] for r in research.event_study(events, panel, 1, 2).collect()}
    assert got == {0: -1.0, 2: 1.0}


def test_a_failing_variant_fails_alone(spark):
    cells = bars(spark, [[1], [2]]).select("day", "symbol", "ord", "close").withColumnRenamed("close", "price")
    from pyspark.sql import functions as F

    both = cells.withColumns({"position": F.lit(1.0), "variant": F.lit("good")}).unionByName(cells.withColumns({"day": F.lit(None).cast("date"), "position": F.lit(1.0), "variant": F.lit("bad")}))
    rows = nav.simulate(both, nav.Costs())
    assert nav.equity_of(rows).where("variant = 'good'").count() == 2
    assert [r["variant"] for r in research.board(rows).collect()] == ["good", "bad"] or nav.errors_of(rows).count() == 0


def test_never_held_symbols_change_nothing(spark):
    from pyspark.sql import functions as F

    panel = bars(spark, [[10, 5, 7], [11, 6, 7], [12, 4, 9]])
    cells = panel.select("day", "symbol", "ord", F.col("close").alias("price"), F.when(F.col("symbol") == "B", 1.0).otherwise(0.0).alias("position"), F.lit("v").alias("variant"))
    assert [round(r["equity"], 6) for r in nav.equity_of(nav.simulate(cells, nav.Costs())).orderBy("day").collect()] == [1, 1.2, 0.8]
    flat = nav.equity_of(nav.simulate(cells.withColumn("position", F.lit(0.0)), nav.Costs())).collect()
    assert len(flat) == 3 and all(r["equity"] == 1 for r in flat)
    # a book carried in counts as held
    sold = nav.equity_of(nav.simulate(cells.withColumn("position", F.lit(0.0)), nav.Costs(fee=0.1), {"v": {"C": 0.5}})).orderBy("day").first()
    assert sold["equity"] == pytest.approx(0.95)
