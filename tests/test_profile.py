import random

import numpy as np
from pyspark.sql import functions as F

from gridwright.operators import profile as P


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, l int, x double, t string").withColumn("num", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("group", F.lit("clash"))


def counts(spark, rows, numbers=("x",), texts=("t",)):
    return P.cells(frame(spark, rows), "g", "l", list(numbers), list(texts))


def sets(rows, group, load):
    ok = lambda x: x[2] is not None and x[2] == x[2] and x[0] == group
    return [x[2] for x in rows if ok(x) and x[1] == load], [x[2] for x in rows if ok(x) and x[1] != load]


def test_quartiles_against_numpy(spark):
    rnd = random.Random(2)
    rows = [("g" if rnd.random() < 0.7 else None, rnd.choice([0, 1, 2, None]), rnd.choice([rnd.gauss(0, 1), rnd.gauss(1e6, 10), 3.0, 0.0, None, float("nan"), -1e-9]), None) for _ in range(600)]
    rows += [("one", 1, 5.0, None)]
    bins = P.histogram(counts(spark, rows, texts=()))
    for r in P.selected(frame(spark, rows), "g", "l", ["x"], bins).collect():
        own, rest = sets(rows, r["group"], r["load"])
        assert r["n"] == len(own) and np.isclose(r["median"], np.quantile(own, 0.5))
        if rest:
            assert np.isclose(r["q25"], np.quantile(rest, 0.25)) and np.isclose(r["q75"], np.quantile(rest, 0.75))
        else:
            assert r["q25"] is None and r["q75"] is None


def test_selected_for_some_cells_only(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("gh"), rnd.randrange(3), rnd.gauss(0, 1), None) for _ in range(200)]
    bins = P.histogram(counts(spark, rows, texts=()))
    only = spark.createDataFrame([("h", 1, "x")], "group string, load int, column_name string")
    got = P.selected(frame(spark, rows), "g", "l", ["x"], bins, only).collect()
    own, rest = sets(rows, "h", 1)
    assert len(got) == 1 and np.isclose(got[0]["median"], np.median(own)) and np.isclose(got[0]["q25"], np.quantile(rest, 0.25)) and np.isclose(got[0]["q75"], np.quantile(rest, 0.75))


def test_moments_and_bins_decide_only_what_is_so(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(40):
        for load in range(rnd.choice([1, 2, 4])):
            at, wide = rnd.choice([0, 0, 0, 1, 3, -50, 1e7]), rnd.choice([0, 0.2, 1, 1, 1])
            rows += [(f"g{g}", load, rnd.gauss(at, 1) * wide + at, None) for _ in range(rnd.choice([1, 2, 9, 40]))]
    values = counts(spark, rows, texts=())
    none = spark.createDataFrame([], "column_name string, low double, high double, pattern string")
    sure = {(r["group"], r["load"]) for r in P.described(values, none).where(P.surely_shifted()).collect()}
    shift = {(r["group"], r["load"]): r["shift"] for r in P.placed(P.histogram(values)).collect()}
    decided = 0
    for (g, load), s in shift.items():
        own, rest = sets(rows, g, load)
        m = np.quantile(own, 0.5)
        true = bool(rest) and bool(m < np.quantile(rest, 0.25) or m > np.quantile(rest, 0.75))
        assert s in (None, true) and ((g, load) not in sure or true)
        decided += s is not None
    assert sure and decided > 0.6 * len(shift)


def test_described(spark):
    rows = [("g", 1, 1.0, "ab"), ("g", 1, 3.0, "abc"), ("g", 1, None, None), ("g", 1, float("nan"), "ab\n"), ("g", 2, 1e300, "ab"), ("g", 2, -5.0, "ab"), ("g", 2, -5.0, "")]
    specs = spark.createDataFrame([("x", 0.0, 2.0, None), ("t", None, None, "^[a-z]{2}$"), ("x", 0.0, 2.0, None)], "column_name string, low double, high double, pattern string")
    got = {(r["load"], r["column_name"]): r for r in P.described(counts(spark, rows), specs).collect()}
    x1, x2, t1, t2 = got[1, "x"], got[2, "x"], got[1, "t"], got[2, "t"]
    assert (x1["n_rows"], x1["n_missing"], x1["n_out_of_range"], x1["p0"], x1["p1"], x1["p2"]) == (4, 2, 1, 2, 4.0, 10.0)
    assert (x2["n_infinite"], x2["n_out_of_range"], x2["mean"]) == (0, 3, 1e300 / 3)
    assert (t1["n_off_pattern"], t1["n_missing"]) == (2, 1) and t2["n_off_pattern"] == 1
    assert np.isclose(x2["deviation"], np.std([1.0, 0.0, 0.0]) * 1e300)
    n = {(r["load"], r["column_name"]): r["n_distinct"] for r in P.distincts(counts(spark, rows)).collect()}
    assert n == {(1, "x"): 2, (2, "x"): 2, (1, "t"): 3, (2, "t"): 2}


def test_values_of_any_size_count_in_means_and_shifts(spark):
    loads = {1: [0.1, 0.2, 1e15, 0.4], 2: [0.3, -2e18, 0.1, 5.0], 3: [2.5e12] * 5, None: [0.2, 0.1, 0.4], 5: [3e13 + k for k in range(6)], 6: [1e-9, 3e-9, -2e-300, 0.0], 7: [2.0**40 - 1, 2.0**40 + 1], 8: [-1.5, -1.25, 1.75]}
    rows = [("g", k, x, None) for k, own in loads.items() for x in own] + [("still", k, 7e14, None) for k in (1, 1, 2)]
    specs = spark.createDataFrame([], "column_name string, low double, high double, pattern string")
    got = {(r["group"], r["load"]): r for r in P.described(counts(spark, rows, texts=()), specs).collect()}
    assert len(got) == len(loads) + 2
    for k, own in loads.items():
        r, rest = got["g", k], [x for j, xs in loads.items() if j != k for x in xs]
        assert np.isclose(r["mean"], np.mean(own), rtol=1e-12) and np.isclose(r["deviation"], np.std(own), rtol=1e-9 if k != 7 else 1e-3)
        assert np.isclose(r["std_diff"], (np.mean(own) - np.mean(rest)) / np.sqrt((np.var(own) + np.var(rest)) / 2), rtol=1e-9)
    assert got["still", 1]["deviation"] == 0 and got["still", 1]["std_diff"] is None and got["still", 2]["mean"] == 7e14


def test_empty(spark):
    bins = P.histogram(counts(spark, []))
    assert P.selected(frame(spark, []), "g", "l", ["x"], bins).count() == 0 and P.placed(bins).count() == 0
    assert P.described(counts(spark, []), spark.createDataFrame([], "column_name string, low double, high double, pattern string")).count() == 0
