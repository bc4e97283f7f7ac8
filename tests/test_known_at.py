import datetime as dt
import random

from pyspark.sql import functions as F

from gridwright.functions.columns import micros
from gridwright.operators import known_at as K

T0 = dt.datetime(2023, 1, 1)
VERSION = "sym string, rank int, at timestamp, value int, _level string"
EVENT = "id long, sym string, at timestamp, note string"


def run(spark, versions, events, **kw):
    v, e = spark.createDataFrame(versions, VERSION), spark.createDataFrame(events, EVENT)
    due = K.due_intervals(v, ["sym"], micros("at"), [F.col("rank")], ["value"], bucket_bits=36)
    return {r["id"]: r["value"] for r in K.known_at(e, "id", micros("at"), {"sym": F.col("sym")}, due, ["value"], **kw).collect()}


def brute(versions, events):
    out = {}
    for i, s, at, _ in events:
        if i is None or s is None or at is None:
            continue
        known = [(r, v) for vs, r, va, v, _ in versions if vs == s and r is not None and va is not None and va <= at]
        if known:
            out[i] = max(known)[1]
    return out


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    when = lambda: T0 + dt.timedelta(seconds=rnd.randrange(0, 40_000_000, 3600))
    versions = [(rnd.choice("abc") + "x", rnd.randrange(20), when(), k, "extra") for k in range(120)]
    versions += versions[:20]
    # a third of the events of one entity, and events exactly on a version's start
    events = [(k, "ax" if k % 3 else rnd.choice("abcd") + "x", when() if k % 4 else versions[k % 120][2], "n") for k in range(400)]
    assert run(spark, versions, events, salts=3, hot_share=0.2) == brute(versions, events)


def test_boundaries_nulls_ties_repeats(spark):
    second = dt.timedelta(seconds=1)
    versions = [("a", 1, T0, 10, ""), ("a", 2, T0 + second, 20, ""), ("a", 2, T0 + second, 25, ""), ("a", 0, T0 + 5 * second, 5, ""), ("a", None, T0, 99, ""), ("a", 9, None, 98, ""), (None, 9, T0, 97, "")]
    events = [(1, "a", T0 - dt.timedelta(microseconds=1), ""), (2, "a", T0, ""), (3, "a", T0 + second - dt.timedelta(microseconds=1), ""), (4, "a", T0 + second, ""), (5, "a", T0 + 9 * second, ""), (5, "a", T0 + 9 * second, ""), (6, None, T0, ""), (7, "a", None, ""), (None, "a", T0, ""), (8, "b", T0, "")]
    assert run(spark, versions, events) == {2: 10, 3: 10, 4: 25, 5: 25}


def test_empty(spark):
    assert run(spark, [], [(1, "a", T0, "")]) == {}
    assert run(spark, [("a", 1, T0, 1, "")], []) == {}


def test_nodes_cover(spark):
    rnd = random.Random(3)
    spans = [(a := rnd.randrange(-(1 << 57), 1 << 57), a + rnd.randrange(1, 1 << rnd.randrange(1, 58))) for _ in range(80)] + [(5, 6), (-8, 0), (-1, 1)]
    df = spark.createDataFrame(spans, "a long, b long").withColumn("l", K.level_of(F.col("a"), F.col("b"))).select("a", "b", "l", K.nodes(F.col("a"), F.col("b"), F.col("l")).alias("n"))
    for r in df.collect():
        assert r["n"][0] << r["l"] <= r["a"] and r["b"] <= (r["n"][-1] + 1) << r["l"]
        assert r["l"] % K.STRIDE == 0 and 1 << r["l"] <= r["b"] - r["a"] and len(r["n"]) <= 2**K.STRIDE + 1


def test_any_time(spark):
    old, late = dt.datetime(1700, 3, 1), dt.datetime(2900, 1, 1)
    versions = [("a", 1, old, 1, ""), ("a", 2, late, 2, "")]
    events = [(1, "a", old, ""), (2, "a", dt.datetime(1699, 1, 1), ""), (3, "a", dt.datetime(2500, 1, 1), ""), (4, "a", dt.datetime(9000, 1, 1), "")]
    assert run(spark, versions, events) == {1: 1, 3: 1, 4: 2}


def test_hot_in_versions_and_events(spark):
    versions = [("a", k, T0 + dt.timedelta(minutes=k), k, "") for k in range(300)] + [("b", 1, T0, 7, "")]
    events = [(k, "a" if k % 3 else "b", T0 + dt.timedelta(seconds=20 * k), "") for k in range(900)]
    assert run(spark, versions, events, salts=4, hot_share=0.1) == brute(versions, events)
