import random

from pyspark.sql import functions as F

from gridwright.operators import history as H


def versions(spark, rows):
    return spark.createDataFrame(rows, "entity string, at int, attributes array<string>")


def brute(rows):
    out = set()
    for e in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == e)
        for s in {x for r in own for x in r[2]}:
            start = None
            for _, at, held in own:
                if s in held and start is None:
                    start = at
                elif s not in held and start is not None:
                    out.add((e, s, start, at))
                    start = None
            if start is not None:
                out.add((e, s, start, 99991231))
    return out


def test_random_against_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(e, at, sorted({rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 6))})) for e in ("i", "j", "k") for at in range(1, 40)]
    for every in (1, 4, 16, 100):
        store = H.encode(versions(spark, rows), every)
        got = {tuple(r) for r in H.validity(store).select("entity", "attribute", "valid_from", "valid_to").collect()}
        assert got == brute(rows)
    store.write(str(tmp_path / "store"))
    again = H.Store.read(spark, str(tmp_path / "store"))
    for at in (1, 17, 39, 100):
        want = {(e, s) for e, a, held in rows if a == min(at, 39) for s in held}
        assert {tuple(r) for r in H.as_of(again, at).collect()} == want
    assert H.as_of(again, 0).count() == 0


def test_deliveries(spark):
    rows = [("i", 1, ["b", "a", "a", None], 5, 1), ("i", 1, ["z"], 4, 2), ("i", 1, [], 9, 3), ("i", 1, None, 9, 4), ("i", None, ["a"], 1, 5), (None, 1, ["a"], 1, 6), ("i", 1, ["b", "a", "a", None], 5, 1)]
    d = spark.createDataFrame(rows, "name string, day int, members array<string>, loaded int, id int").withColumn("at", F.lit("clash")).withColumn("entity", F.lit("clash"))
    got = [tuple(r) for r in H.full_versions(d, "name", "day", F.col("members"), ["loaded", "id"]).collect()]
    assert got == [("i", 1, ["a", "b"])]


def test_empty(spark):
    store = H.encode(versions(spark, []))
    assert H.validity(store).count() == 0
