import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridwright import cli
from gridwright.portfolio import metrics, nav
from gridwright.plans import dsl
from gridwright.sources import files, landed


def tree(tmp_path):
    for folder in ("prices", "fundamentals", "panels"):
        (tmp_path / folder).mkdir()
    for s, base in (("AA", 10), ("BB", 20)):
        lines = [f"2024-01-{k:02d},{base + k},{base + k + 1},{base + k - 1},{base + k},{100 * k}" for k in range(1, 21) if s == "AA" or k != 5]
        (tmp_path / "prices" / f"{s}.csv").write_text("\n".join(lines))
    pe = ["1.5" if c == "pe" else "" for c in files.FACTORS]
    (tmp_path / "fundamentals" / "AA.csv").write_text("2024-01-03," + ",".join(pe))
    (tmp_path / "panels" / "in_top.csv").write_text("day,AA,BB,ZZ\n20240102,1,0,1\n20240103,1,1,1")
    return str(tmp_path)


def test_series_come_from_where_they_are(spark, tmp_path):
    root = tree(tmp_path)
    got = files.load(spark, root, ["close", "pe", "in_top", "nowhere"], "2024-01-02", "2024-01-06")
    assert got.columns == ["day", "symbol", "ord", "close", "pe", "in_top"]
    rows = {(r["day"].day, r["symbol"]): r for r in got.collect()}
    assert len(rows) == 10 and rows[5, "BB"]["close"] is None and rows[3, "AA"]["pe"] == 1.5 and rows[3, "BB"]["in_top"] == 1.0 and rows[6, "AA"]["close"] == 16.0
    one = files.load(spark, root, ["close"], symbols=["BB"])
    assert {r["symbol"] for r in one.collect()} == {"BB"}
    with pytest.raises(ValueError, match="no price files: QQ"):
        files.load(spark, root, ["close"], symbols=["BB", "QQ"])
    assert files.load(spark, root, ["nowhere"]).count() == 0


def test_rebuild(spark, tmp_path):
    root = tree(tmp_path)
    made = files.rebuild(spark, root)
    assert made["close"] == 20 and made["pe"] == 1 and len(made) == 5 + len(files.FACTORS)
    back = files.read_wide(spark, f"{root}/panels/close.csv.gz", "close")
    assert back.where("close IS NOT NULL").count() == 39 and back.where("symbol = 'BB' AND day = '2024-01-05'").first()["close"] is None


def test_front_matter_acts(tmp_path, capsys, spark):
    f = tmp_path / "s.txt"
    f.write_text("# words\n#! name: held\n#! universe: 20240102..20240110\n#! symbols: aa\n#! index: top\n#! price-key: open\n#! config: {\"fee\": 0.01}\nclose > 0")
    (tmp_path / "t").mkdir()
    assert cli.main(["run", str(f), "--tree", tree(tmp_path / "t")]) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert doc["variant"] == "held" and len(doc["equity"]) == 9 and doc["equity"][0]["equity"] == pytest.approx(0.99)
    front = dsl.settings("#! universe: ..20240110\n#! require: [pe, roe]\nclose")
    assert (front.first, front.last, front.require, front.price_key) == (None, "20240110", ("pe", "roe"), "close")
    for wrong in ("#! universe: all\nclose", "#! config: [1]\nclose", "#! price-key: pe\nclose", "#! name:\nclose", "close\n#! name: x"):
        with pytest.raises(ValueError):
            dsl.settings(wrong)


def test_costs_from_an_object():
    assert nav.costs({"fee": 0.1, "stops": {"stop_loss": 0.2}}) == nav.Costs(fee=0.1, stops=nav.Stops(stop_loss=0.2)) and nav.costs({}) == nav.Costs()
    with pytest.raises(ValueError, match="unknown settings: fees, stops.x"):
        nav.costs({"fees": 1, "stops": {"x": 1}})


def test_statements_by_period(spark):
    first = [{"date": "2023-12-31", "rev": "10", "fillingDate": "2024-02-01", "x": None}, {"date": "2022-12-31", "rev": 8}, {"rev": 1}]
    second = [{"date": "2023-12-31", "rev": 99, "x": 5, "acc": "2024-03-01 10:00"}, {"date": "2021-12-31", "net": 3}]
    raw = spark.createDataFrame([("A", 2, json.dumps(second)), ("A", 1, json.dumps(first)), ("A", 3, "broken"), ("B", 1, None)], "sym string, no int, body string")
    merged = landed.by_period(raw, "sym", "no", "body", ["fillingDate", "acc"])
    rows = {r["period_end"].year: r for r in landed.growths(landed.named(merged, {"rev": ["revenue", "rev"], "x": ["x"], "net": ["net"]}), ["rev"]).collect()}
    assert set(rows) == {2021, 2022, 2023}
    assert rows[2023]["rev"] == 10 and rows[2023]["x"] == 5 and rows[2023]["visible"] == dt.date(2024, 2, 1) and not rows[2023]["fell_back"]
    assert rows[2022]["visible"] == dt.date(2022, 12, 31) and rows[2022]["fell_back"] and rows[2023]["rev_growth"] == pytest.approx(0.25)
    assert rows[2022]["rev_growth"] is None and rows[2021]["net"] == 3


def test_names(spark):
    t = spark.createDataFrame([("aapl",), ("VOD.lse",), (" brk-b.us ",), ("a.b.to",), ("",), (".US",), ("X.",), (None,)], "s string")
    assert [None if r[0] is None else tuple(r[0]) for r in t.select(landed.ticker(F.col("s"))).collect()] == [("AAPL", "AAPL.US"), ("VOD", "VOD.LSE"), ("BRK-B", "BRK-B.US"), ("A.B", "A.B.TO"), None, None, None, None]
    s = spark.createDataFrame([("# all\nAAPL, msft.us\n\nvod.lse # note, x\naapl",), ("",)], "s string")
    assert [r[0] for r in s.select(landed.symbols_list(F.col("s"))).collect()] == [["AAPL", "MSFT", "VOD"], []]
    x = spark.createDataFrame([('[{"concept":"us-gaap_Assets","value":5},{"concept":"ifrs:assets","value":7},{"concept":"Net_Income","value":"N/A"},{"value":1}]',), ("broken",), (None,)], "j string")
    assert [r[0] for r in x.select(landed.statement(F.col("j"))).collect()][0] == {"assets": 5.0}


def test_report_series(spark):
    def frame(rows, schema):
        return spark.createDataFrame([(dt.date(2023, 12, 30) + dt.timedelta(days=k), *r) for k, r in enumerate(rows)], schema)

    eq = frame([("v", 1.0), ("v", 1.1), ("v", 1.0), ("v", 1.3)], "day date, variant string, equity double").select("variant", "day", "equity")
    bench = frame([(10.0,), (11.0,), (None,), (12.0,)], "day date, level double")
    assert metrics.share_beating(eq, bench).first()["share_beating"] == 1.0
    table = {r["year"]: r for r in metrics.year_table(eq, bench).collect()}
    assert table[2024]["strategy"] == pytest.approx(1.3 / 1.1 - 1) and table[2024]["benchmark"] == pytest.approx(12 / 11 - 1)
    grid = {r["year"]: r for r in metrics.month_grid(eq).collect()}
    assert grid[2023]["m12"] == pytest.approx(0.1) and grid[2023]["m1"] is None and grid[2024]["total"] == grid[2024]["m1"]
    c = metrics.rolling_correlation(eq, frame([(2.0,), (2.2,), (2.0,), (2.6,)], "day date, level double"), 2).orderBy("day").collect()
    assert [r["correlation"] for r in c][:2] == [None, None] and c[3]["correlation"] == pytest.approx(1.0)
    panel = spark.createDataFrame([(dt.date(2024, 1, 1 + k), s, i, None if x is None else float(x)) for k, row in enumerate([(1, 2), (2, 2), (None, 4), (9, 4)]) for i, (s, x) in enumerate(zip("AB", row, strict=True))], "day date, symbol string, ord int, close double")
    assert [round(r["level"], 6) for r in metrics.equal_weight(panel).orderBy("day").collect()] == [1, 1.5, 3, 3]
