import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridwright.operators import universe as U

D0 = dt.date(2024, 1, 1)
day = lambda k: D0 + dt.timedelta(days=k)


def undone(now, log, at):
    """Today's set with every change after a day undone, the newest first."""
    out = set(now)
    for d, a, r, _ in sorted(log, key=lambda c: (c[0], c[3]), reverse=True):
        if d <= at:
            break
        out.discard(a)
        if r:
            out.add(r)
    return out


def log_of(spark, log):
    df = spark.createDataFrame([("x", *c) for c in log] + [("x", None, "Q", None, 900), ("x", day(3), " ", "", 901)], "index string, day date, added string, removed string, no int").withColumn("symbol", F.lit("clash"))
    return U.steps(df, ["index"], "day", "added", "removed", "no")


def test_against_undoing_the_log(spark):
    rnd = random.Random(6)
    log = [(day(rnd.randrange(1, 30)), rnd.choice(["A", "B", "C", "D", None]), rnd.choice(["A", "B", "E", None, None]), k) for k in range(40)]
    log = [c for c in log if c[1] or c[2]]
    now = {"A", "E"}
    held = spark.createDataFrame([("x", s) for s in [*now, "A"]], "index string, symbol string")
    steps = log_of(spark, [*log, *log[:5]])
    for at in (0, 7, 15, 29, 40):
        assert {r["symbol"] for r in U.members_as_of(held, steps, ["index"], day(at)).collect()} == undone(now, log, day(at)), at
    ever = undone(now, log, day(5)) | {s for d, a, r, _ in log if day(5) <= d <= day(12) for s in (a, r) if s}
    assert {r["symbol"] for r in U.ever_members(held, steps, ["index"], day(5), day(12)).collect()} == ever
    calendar = spark.createDataFrame([(day(k),) for k in range(0, 33, 2)] * 2, "day date")
    columns = spark.createDataFrame([("x", s) for s in "ABCDEZ"], "index string, symbol string")
    got = {(r["day"], r["symbol"]): r["member"] for r in U.membership(held, steps, ["index"], calendar, columns).collect()}
    assert len(got) == 17 * 6
    for (d, s), v in got.items():
        assert v == float(s in undone(now, log, d)), (d, s)


def test_founding_members_in_the_log_and_empty(spark):
    steps = log_of(spark, [(day(1), "A", None, 1), (day(1), "B", None, 2), (day(5), "C", "A", 3)])
    now = U.current(steps, ["index"])
    assert {r["symbol"] for r in now.collect()} == {"B", "C"}
    assert {r["symbol"] for r in U.members_as_of(now, steps, ["index"], day(4)).collect()} == {"A", "B"}
    assert U.members_as_of(now, steps, ["index"], day(0)).count() == 0
    assert U.membership(now.limit(0), steps.limit(0), ["index"], spark.createDataFrame([], "day date"), now).count() == 0


def test_scoped(spark):
    panel = spark.createDataFrame([(day(k), s, i, 1.0) for k in range(2) for i, s in enumerate("ABC")], "day date, symbol string, ord int, close double")
    assert U.scoped(panel, None).count() == 6 and {r["symbol"] for r in U.scoped(panel, ["C", "A", "A"]).collect()} == {"A", "C"}
    with pytest.raises(ValueError, match="no such symbols: Q, X"):
        U.scoped(panel, ["X", "A", "Q"])
    with pytest.raises(ValueError, match="empty"):
        U.scoped(panel, [])
