"""python -m gridwright.cli VERB ...: work with strategy files and run them over a panel.

fmt FILE | lint FILE | check ENVELOPE.json | schema | new NAME
run FILE | lookahead FILE | factor FILE | event FILE | audit   --panel PATH [--sectors PATH] [--from DAY] [--to DAY] [--fee F] [--tax T] [--out DIR]
grid TEMPLATE.json --params '{"n": [5, 10]}' | walkforward TEMPLATE.json --params ... --train N --test N   --panel PATH ...

A panel is a Parquet table with day, symbol and a column per series; only the columns a strategy names are read. Instead of it --tree names a
folder of series files (prices/, fundamentals/, panels/). A strategy's front matter sets window, symbols, index, traded series and costs; options go before it.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from gridwright.plans import catalog, dsl


def _panel(spark, args, names, front=None):
    from gridwright.operators.panel import between, densify
    from gridwright.operators.universe import scoped
    from gridwright.sources import files

    front = front or dsl.Front()
    first, last = args.first or front.first, args.last or front.last
    day = lambda d: f"{d[:4]}-{d[4:6]}-{d[6:]}" if d and d.isdigit() else d
    wanted = list(dict.fromkeys([*names, *front.require]))
    usual = ["close", "open", "high", "low", "volume"]
    if args.tree:
        panel = files.load(spark, args.tree, list(dict.fromkeys([*wanted, *usual])), day(first), day(last), front.symbols)
    else:
        raw = spark.read.parquet(args.panel)
        have = [c for c in dict.fromkeys([*wanted, *usual]) if c in raw.columns]
        panel = densify(scoped(between(raw.select("day", "symbol", *have), day(first), day(last)), front.symbols))
    missing = [n for n in wanted if n not in panel.columns]
    if missing:
        raise SystemExit(f"the panel has no series {', '.join(missing)}")
    return panel


def _expression(path: str) -> tuple[catalog.Node, dsl.Front]:
    """A strategy file's expression, held to its index if it names one, and what its front matter asks for."""
    text = Path(path).read_text()
    doc = json.loads(text) if text.lstrip().startswith("{") else None
    if doc is None:
        front = dsl.settings(text)
        made = dsl.parse(text)
        return (catalog.within(made, f"in_{front.index}") if front.index else made), front
    if "op" in doc:
        return catalog.from_json(doc), dsl.Front()
    wrong = dsl.check_envelope(doc)
    if wrong:
        raise SystemExit("\n".join(wrong))
    front = dsl.settings(doc.get("source", ""))
    return (catalog.from_json(doc["spec"]) if "spec" in doc else dsl.parse(doc["source"])), replace(front, config=doc.get("config") or front.config)


def _shown(df, out: str | None) -> None:
    if out:
        df.write.mode("overwrite").json(out, ignoreNullFields=False)
    else:
        for row in df.toJSON().toLocalIterator():
            print(row)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("verb", choices=["fmt", "lint", "check", "schema", "new", "run", "grid", "lookahead", "walkforward", "factor", "event", "audit"])
    p.add_argument("file", nargs="?")
    for name in ("panel", "tree", "sectors", "out", "params"):
        p.add_argument(f"--{name}")
    p.add_argument("--from", dest="first")
    p.add_argument("--to", dest="last")
    for name, default in (("fee", 0.0), ("tax", 0.0)):
        p.add_argument(f"--{name}", type=float, default=default)
    for name, default in (("train", 252), ("test", 63), ("before", 5), ("after", 10), ("buckets", 5)):
        p.add_argument(f"--{name}", type=int, default=default)
    args = p.parse_args(argv)
    if args.verb == "schema":
        print(json.dumps(catalog.schema(), indent=1))
        return 0
    if args.verb == "new":
        print(f"#! name: {args.file or 'strategy'}\n\nlet mean = sma(close, 20)\nis_largest(pct_change(close, 20), 10) and close > mean")
        return 0
    if args.verb in ("fmt", "lint", "check"):
        text = Path(args.file).read_text()
        try:
            if args.verb == "fmt":
                print(dsl.formatted(text), end="")
                return 0
            found = dsl.lint(text) if args.verb == "lint" else dsl.check_envelope(json.loads(text))
        except ValueError as e:
            found = [str(e)]
        print("\n".join(found) or "ok")
        return int(bool(found))

    from pyspark.sql import SparkSession

    from gridwright.operators import audit
    from gridwright.plans.compile import evaluate
    from gridwright.portfolio import nav, report, research

    spark = SparkSession.builder.getOrCreate()
    sectors = spark.read.parquet(args.sectors) if args.sectors else None
    cfg = nav.Costs(fee=args.fee, tax=args.tax)
    if args.verb == "audit":
        panel = _panel(spark, args, ["close"])
        _shown(audit.statuses(panel, sectors if sectors is not None else panel.select("symbol").distinct(), ["close"]), args.out)
        return 0
    if args.verb in ("grid", "walkforward"):
        variants = research.grid(json.loads(Path(args.file).read_text()), json.loads(args.params or "{}"))
        panel = _panel(spark, args, list(dict.fromkeys(s for v in variants.values() for s in catalog.series_of(v))))
        if args.verb == "grid":
            rows, failed = research.sweep(panel, variants, cfg, sectors)
            _shown(research.board(rows, failed=failed), args.out)
        else:
            walk = research.walk_forward(panel, variants, cfg, args.train, args.test)
            for w in [*walk.windows, walk.figures]:
                print(json.dumps(w, default=str))
        return 0
    expression, front = _expression(args.file)
    panel = _panel(spark, args, catalog.series_of(expression), front)
    given = {k: v for k, v in (("fee", args.fee), ("tax", args.tax)) if v}
    cfg = nav.costs(front.config | given)
    if args.verb == "run":
        _shown(report.report(nav.simulate(research.positions(panel, expression, front.name or "run", sectors, front.price_key), cfg)), args.out)
    elif args.verb == "lookahead":
        _shown(research.lookahead(panel, expression, cfg), args.out)
    elif args.verb == "factor":
        days = research.factor_days(evaluate(panel, expression, sectors), panel)
        _shown(research.factor_report(days, args.buckets) if args.out else research.factor_figures(days, args.buckets).crossJoin(research.factor_report(days, args.buckets)), args.out)
    else:
        _shown(research.event_study(evaluate(panel, expression, sectors), panel, args.before, args.after), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
