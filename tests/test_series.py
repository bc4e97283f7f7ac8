import datetime as dt
import random

from pyspark.sql import functions as F

from gridwright.operators.series import counting, on_grid, trailing_totals

D0 = dt.date(2024, 1, 1)
day = lambda k: D0 + dt.timedelta(days=k)


def test_counting(spark):
    rows = [("a", 1, 5, 1.0), ("a", 1, 6, 2.0), ("a", 1, 6, 2.0), ("a", 1, None, 9.0), (None, 1, 1, 3.0), ("a", 2, 1, None)]
    df = spark.createDataFrame(rows, "k string, d int, at int, v double").withColumn("_b", F.lit("clash"))
    got = {tuple(r) for r in counting(df, ["k", "d"], ["at"], {"v": F.col("v")}).collect()}
    assert got == {("a", 1, 2.0), (None, 1, 3.0), ("a", 2, None)}


def test_grid_on_calendar(spark):
    rows = [("s", day(0), 1.0), ("s", day(2), None), ("s", day(5), 2.0), ("s", day(9), 3.0), ("t", day(1), None), (None, day(3), 4.0), ("s", None, 1.0)]
    df = spark.createDataFrame(rows, "src string, at date, v double").withColumn("status", F.lit("clash"))
    calendar = spark.createDataFrame([(day(k),) for k in (0, 1, 2, 3, 4, 7, 8, 9, 9)], "at date")
    got = {(r["src"], (r["at"] - D0).days): (r["v"], r["status"]) for r in on_grid(df, ["src"], "at", "v", calendar, max_gap=2).collect()}
    # day 5 is off the calendar: carried, but no period
    assert got == {("s", 0): (1.0, "observed"), ("s", 1): (1.0, "carried"), ("s", 2): (1.0, "carried"), ("s", 3): (None, "missing"), ("s", 4): (None, "missing"), ("s", 7): (2.0, "carried"), ("s", 8): (2.0, "carried"), ("s", 9): (3.0, "observed"), (None, 3): (4.0, "observed")}


def test_monthly_grid_and_empty(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1), 1.0), ("s", dt.date(2024, 4, 1), 2.0)], "src string, m date, v double")
    got = [(r["m"].month, r["status"]) for r in on_grid(df, ["src"], "m", "v", step="1 month", max_gap=1).orderBy("m").collect()]
    assert got == [(1, "observed"), (2, "carried"), (3, "missing"), (4, "observed")]
    assert on_grid(df.limit(0), ["src"], "m", "v").count() == 0


def test_trailing_totals_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(s, day(k), rnd.choice([None, rnd.uniform(-5, 5)])) for s in ("a", "b", None) for k in sorted(rnd.sample(range(90), 40))]
    df = spark.createDataFrame(rows, "s string, d date, v double").withColumn("first_day", F.lit("clash")).drop("first_day")
    spans = [(1, day(20), day(60), day(10)), (2, day(30), day(80), None), (3, day(200), day(210), day(190))]
    sp = spark.createDataFrame(spans, "run int, first_day date, last_day date, earliest date")
    widths = [1, 7, 11, 30]
    got = {(r["run"], r["s"], r["d"]): r for r in trailing_totals(df, ["s"], "d", "v", sp, "run", widths).collect()}
    want = {}
    for run, a, b, e in spans:
        for s in ("a", "b", None):
            own = {d: v for x, d, v in rows if x == s and v is not None}
            for k in range((b - a).days + 1):
                d = a + dt.timedelta(days=k)
                if min(own) <= d <= max(own):
                    sums = {w: [own[x] for i in range(w) if (x := d - dt.timedelta(days=i)) in own and (e is None or x >= e)] for w in widths}
                    if sums[30]:
                        want[run, s, d] = sums
    assert got.keys() == want.keys()
    for k, sums in want.items():
        for w, vals in sums.items():
            assert got[k][f"n_{w}"] == len(vals) and abs(got[k][f"sum_{w}"] - sum(vals)) < 1e-9
            assert (got[k][f"avg_{w}"] is None) == (not vals)
    assert trailing_totals(df.limit(0), ["s"], "d", "v", sp, "run", [7]).count() == 0
