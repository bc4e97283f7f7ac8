import datetime as dt
import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.operators import audit
from gridwright.sources import files, landed
from gridwright.streaming import bars


def test_series_forms_and_bad_cells(spark, tmp_path):
    with gzip.open(tmp_path / "AAA.csv.gz", "wt") as f:
        f.write("day,close,volume\n2024-01-01,1.5,10\n20240102,NaN,\n2024-01-03,x,7\nbroken\n")
    (tmp_path / "AAA.csv").write_text("2024-01-01,99,99\n")
    (tmp_path / "BBB.csv").write_text("2024-01-01,2,3\n")
    pd.DataFrame({"day": [20240105], "close": [4]}).to_parquet(tmp_path / "CCC.parquet")
    got = {(r["symbol"], str(r["day"])): (r["close"], r["volume"]) for r in files.read_series(spark, str(tmp_path), ["close", "volume"]).collect()}
    assert got == {("AAA", "2024-01-01"): (1.5, 10), ("AAA", "2024-01-02"): (None, None), ("AAA", "2024-01-03"): (None, 7), ("BBB", "2024-01-01"): (2, 3), ("CCC", "2024-01-05"): (4, None)}
    assert files.symbols_in(spark, str(tmp_path)) == ["AAA", "BBB", "CCC"] and files.symbols_in(spark, str(tmp_path / "none")) == []
    assert files.read_series(spark, str(tmp_path / "none"), ["close"]).count() == 0
    assert [files.sniff(spark, str(tmp_path / n)) for n in ("AAA.csv.gz", "CCC.parquet", "BBB.csv")] == ["gzip", "parquet", "csv"]


def test_append_resume_universe(spark, tmp_path):
    old = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "symbol string, day int, v double")
    new = spark.createDataFrame([("A", 2, None), ("B", 1, 3.0)], "symbol string, day int, v double")
    assert {tuple(r) for r in files.append_days(old, new).collect()} == {("A", 1, 1.0), ("A", 2, None), ("B", 1, 3.0)}
    assert [r[0] for r in files.not_yet(new.select("symbol"), old).collect()] == ["B"]
    (tmp_path / "u.csv").write_text('symbol,sector,market_cap\n aa ,Tech,5\nAA,,x\nbb,"  ",7\n,Tech,1\n')
    assert {tuple(r) for r in files.read_universe(spark, str(tmp_path / "u.csv")).collect()} == {("AA", "Tech", 5.0), ("BB", None, 7.0)}


def test_landed(spark):
    objects = [{"date": "2024-01-02", "open": 10, "high": 12, "low": 8, "close": 10, "adjClose": 5, "volume": 7}, {"date": "bad"}, {"date": "2024-01-03 00:00", "close": "4", "adjOpen": 3}]
    raw = spark.createDataFrame([("A", json.dumps(objects)), ("B", "broken"), ("C", None)], "s string, b string")
    got = {(r["symbol"], str(r["day"])): (r["adj_open"], r["adj_high"], r["adj_close"], r["volume"]) for r in landed.daily_objects(raw, "s", "b").collect()}
    assert got == {("A", "2024-01-02"): (5, 6, 5, 7), ("A", "2024-01-03"): (3, None, 4, None)}
    arrays = spark.createDataFrame([("A", json.dumps({"t": [1704153600], "o": [1.0], "h": [2.0], "l": [0.5], "c": [1.5], "v": [9.0]}))], "s string, b string")
    assert tuple(landed.column_arrays(arrays, "s", "b").first()) == ("A", dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 9.0)
    t = spark.createDataFrame([("Strong Buy", "1.5B"), ("2", "10"), ("??", "x")], "r string, c string")
    assert [tuple(r) for r in t.select(landed.rating(F.col("r")), landed.market_cap(F.col("c"))).collect()] == [(5.0, 1.5e9), (2.0, 10.0), (None, None)]
    f = spark.createDataFrame([(1.0, 2.0, 0.0, None, 3.0, 4.0, 5.0, 6.0)], "net_income double, equity double, revenue double, liabilities double, debt double, gross_profit double, receivables double, assets double")
    r = landed.ratios(f).first()
    assert r["roe"] == 0.5 and r["net_margin"] is None and r["debt_to_equity"] == 1.5


def test_audits(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), "A", 0, 1.0 if k in (0, 9) else None) for k in range(10)] + [(dt.date(2024, 1, 1), "B", 1, 2.0), (dt.date(2024, 1, 2), "B", 1, 5.0)]
    p = spark.createDataFrame(rows, "day date, symbol string, ord int, close double")
    assert [r["rows"] for r in audit.calendar_gaps(p).collect()] == [8] and [r["symbol"] for r in audit.adjustment(p).collect()] == ["B"]
    assert {tuple(r) for r in audit.coverage(p, spark.createDataFrame([("A",), ("C",)], "symbol string")).collect()} == {("C", "missing"), ("B", "extra")}
    got = {r["check"]: r["status"] for r in audit.statuses(p, p.select("symbol"), ["close"]).collect()}
    assert got == {"coverage": "ok", "calendar_gaps": "warn", "adjustment": "warn", "survivorship": "ok", "density": "ok"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + k % 3, k % 24), "ab"[k % 2], float(k)) for k in range(60)] + [(None, "a", 1.0), (dt.datetime(2024, 1, 1), None, 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = bars.drained(bars.tumbling_bars(stream, "ts", "k", "v"), str(tmp_path / "b"), "complete")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, bars.tumbling_bars(df, "ts", "k", "v").collect()))
    out = bars.drained(bars.smoothed(stream.where("ts IS NOT NULL AND k IS NOT NULL"), "k", "ts", "v", 3), str(tmp_path / "e"))
    assert out.count() == 60 and out.where("ema IS NULL").count() == 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"], capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr[-500:]


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "op17_sma"])
def test_queries_on_the_smallest_tables(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
