import datetime as dt
import json

from gridwright import cli
from gridwright.plans.catalog import within
from gridwright.plans.dsl import parse, show


def test_files(tmp_path, capsys):
    f = tmp_path / "s.txt"
    f.write_text("#! name: a\nlet x = y\nsma( close,5 )")
    assert cli.main(["fmt", str(f)]) == 0 and capsys.readouterr().out == "#! name: a\nsma(close, 5)\n"
    assert cli.main(["lint", str(f)]) == 1 and "x is never used" in capsys.readouterr().out
    e = tmp_path / "e.json"
    e.write_text(json.dumps({"format": 1, "source": "close >"}))
    assert cli.main(["check", str(e)]) == 1
    assert cli.main(["schema"]) == 0 and '"Average"' in capsys.readouterr().out
    assert show(within(parse("close"), "in_x")) == "close * (in_x >= 0.5)"


def test_runs(spark, tmp_path, capsys):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=r), s, float(10 + r + (r * 7 + c * 3) % 5), 1.0) for r in range(30) for c, s in enumerate("AB")]
    spark.createDataFrame(rows, "day date, symbol string, close double, unread double").write.parquet(str(tmp_path / "p"))
    f, t = tmp_path / "s.txt", tmp_path / "t.json"
    f.write_text("close > sma(close, 3)")
    t.write_text(json.dumps({"op": "Rise", "of": {"op": "Data", "name": "close"}, "n": "$n"}))
    panel = ["--panel", str(tmp_path / "p")]
    assert cli.main(["run", str(f), *panel]) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert len(doc["equity"]) == 30 and doc["metrics"]["total_return"] is not None and doc["trades"]
    for verb in ("lookahead", "factor", "event", "audit"):
        assert cli.main([verb, *([] if verb == "audit" else [str(f)]), *panel]) == 0
    assert cli.main(["grid", str(t), "--params", '{"n": [1, 2]}', *panel]) == 0
    capsys.readouterr()
    assert cli.main(["walkforward", str(t), "--params", '{"n": [1]}', "--train", "9", "--test", "5", *panel]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert len(lines) == 3 and lines[0]["test_from"] and "total_return" in lines[-1]  # two windows and the figures of the chained tests
