"""Research runs: many variants side by side, factor and event studies, walk-forward and lookahead checks."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import ratio
from gridwright.operators.panel import AXES, align
from gridwright.plans.catalog import Node, from_json, max_lookback
from gridwright.plans.compile import CompileError, Compiler
from gridwright.plans.dsl import substitute
from gridwright.portfolio import metrics, nav

PRICES = {"close": "price", "open": "open", "high": "high", "low": "low", "volume": "volume"}


def _traded(panel: DataFrame, price: str) -> list[Column]:
    """The series a simulation reads, under its names; ``price`` is the one that is traded."""
    have = {k: v for k, v in PRICES.items() if v != "price" and k in panel.columns}
    return [F.col(price).alias("price"), *[F.col(c).alias(n) for c, n in have.items()]]


def cells_of(panel: DataFrame, variants: dict[str, Node], industry: DataFrame | None = None, price: str = "close", together: int = 64) -> tuple[DataFrame, dict[str, str]]:
    """The variants' positions on the price grid, ready to simulate, and the variants that don't compile with their errors.

    Up to ``together`` variants are columns of one plan: it reads and sorts the panel once, and what they share is computed once.
    """
    names, parts, failed = list(variants), [], {}
    for at in range(0, len(names), together):
        compiler = Compiler(panel, industry)
        grids: dict[int, tuple] = {}
        for name in names[at : at + together]:
            try:
                ref = compiler.eval(variants[name])
            except CompileError as e:
                failed[name] = str(e)
                continue
            grids.setdefault(id(ref.grid), (ref.grid, []))[1].append((name, ref))
        for g, own in grids.values():
            books = F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), r.c.cast("double").alias("position")) for n, r in own]))
            if g is compiler.base:
                parts.append(g.df.select(*AXES, *_traded(panel, price), books))
            else:  # days off this grid hold
                priced = panel.select(*AXES, *_traded(panel, price), F.explode(F.array(*[F.lit(n) for n, _ in own])).alias("variant"))
                parts.append(priced.join(g.df.select("day", "symbol", books), ["day", "symbol", "variant"], "left"))
    if not parts:
        raise ValueError(f"no variant compiles: {failed}")
    return reduce(DataFrame.unionByName, parts), failed


def positions(panel: DataFrame, expression: Node, variant: str, industry: DataFrame | None = None, price: str = "close") -> DataFrame:
    """One strategy's cells; that it doesn't compile is an error."""
    return cells_of(panel, {variant: expression}, industry, price)[0]


def grid(template: dict, params: dict[str, list]) -> dict[str, Node]:
    """Every combination of the parameters (names in order), put into the template's "$name" places."""
    names = sorted(params)
    return {",".join(f"{n}={v}" for n, v in zip(names, values, strict=True)): from_json(substitute(template, dict(zip(names, values, strict=True)))) for values in itertools.product(*(params[n] for n in names))}


def sweep(panel: DataFrame, variants: dict[str, Node], cfg: nav.Costs, industry: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Simulated rows of all variants, which run in parallel, and the variants that don't compile with their errors."""
    cells, failed = cells_of(panel, variants, industry)
    return nav.simulate(cells, cfg), failed


def board(rows: DataFrame, by: str = "sharpe", top: int | None = None, failed: dict[str, str] | None = None) -> DataFrame:
    """Variants ranked by a figure, the best first; missing figures after them, and last the variants that failed (ok false), with their errors."""
    figures = metrics.summary(nav.equity_of(rows)).withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
    bad = nav.errors_of(rows)
    if failed:
        bad = bad.unionByName(rows.sparkSession.createDataFrame(sorted(failed.items()), "variant string, error string"))
    out = figures.unionByName(bad.withColumn("ok", F.lit(False)), allowMissingColumns=True)
    out = out.orderBy(F.col("ok").desc(), F.col(by).desc_nulls_last(), "variant")
    return out if top is None else out.limit(top)


def lookahead(panel: DataFrame, expression: Node, cfg: nav.Costs, shifts: tuple[int, ...] = (1, 2, 3, 5, 10, 21)) -> DataFrame:
    """The strategy traded 0 and more days late: variant, lag, total_return, sharpe. A result that dies of one day's lag used the future.

    The expression is evaluated once; its lags are variants of one simulation.
    """
    w = Window.partitionBy("symbol").orderBy("day")
    cells = positions(panel, expression, "0").drop("variant")
    late = [F.struct(F.lit(str(k)).alias("variant"), (F.lag("position", k).over(w) if k else F.col("position")).alias("position")) for k in dict.fromkeys((0, *shifts))]
    both = cells.withColumn("_late", F.array(*late)).select(*[c for c in cells.columns if c != "position"], F.inline("_late"))
    return metrics.summary(nav.equity_of(nav.simulate(both, cfg))).select("variant", F.col("variant").cast("int").alias("lag"), "total_return", "sharpe")


def segments(days: list, train: int, test: int) -> list[tuple[int, int, int]]:
    """(first of training, first of test, end of test) as places in ``days``; each begins where the one before ended its test, the last may be shorter."""
    if train < 1 or test < 1:
        raise ValueError("train and test must be at least one day")
    out, at = [], 0
    while at + train < len(days):
        end = min(at + train + test, len(days))
        out.append((at, at + train, end))
        at = end
    return out


@dataclass(frozen=True)
class Walk:
    """windows: one row each; curve: (day, equity) of the tests chained; figures: of that curve."""

    windows: list[dict]
    curve: list[tuple]
    figures: dict


def walk_forward(panel: DataFrame, variants: dict[str, Node], cfg: nav.Costs, train: int, test: int, by: str = "sharpe", warmup: int | None = None) -> Walk:
    """Per window the variant that did best in training, then its result in the following test days, chained over all windows.

    Signals warm up on ``warmup`` rows before (the longest lookback, if None), the book doesn't: training starts from nothing on its first day; a test starts on the
    last training day, so that its first day earns a return, with the book the last test ended with. Equal figures go to the later variant; variants without a
    figure are out. The variants of a window run in parallel; windows follow each other. A window's curve and book reach the driver: as many rows as it has days and holdings.
    """
    days = [r[0] for r in panel.select("day").distinct().orderBy("day").collect()]  # a calendar
    if len(days) < train + 1:
        raise ValueError(f"{len(days)} days are too few to train on {train}")
    warm = max(max_lookback(v) for v in variants.values()) if warmup is None else warmup
    place = F.create_map(*[F.lit(x) for i, v in enumerate(variants) for x in (v, i)])
    book: dict[str, float] | None = None
    windows, curve, scale = [], [], 1.0

    def run(names: list[str], warm_from: int, first: int, end: int, start: dict | None) -> DataFrame:
        part = panel.where(F.col("day").between(days[max(0, warm_from - warm)], days[end - 1]))
        cells, _ = cells_of(part, {n: variants[n] for n in names})
        return nav.simulate(cells.where(F.col("day") >= F.lit(days[first])), cfg, start)

    for a, b, end in segments(days, train, test):
        scored = metrics.summary(nav.equity_of(run(list(variants), a, a, b, None))).where(F.col(by).isNotNull())
        best = scored.orderBy(F.col(by).desc(), place[F.col("variant")].desc()).select("variant", F.col(by).alias("figure")).first()
        if best is None:
            raise ValueError(f"no variant has a figure in training from {days[a]} to {days[b - 1]}")
        name = best["variant"]
        got = run([name], b, b - 1, end, None if book is None else {name: book}).where("kind <> 'trade'").collect()
        if any(r["kind"] == "error" for r in got):
            raise RuntimeError(next(r["side"] for r in got if r["kind"] == "error"))
        own = sorted((r["day"], r["value"]) for r in got if r["kind"] == "equity")
        book = {r["symbol"]: r["value"] for r in got if r["kind"] == "weight"}
        windows.append({"train_from": days[a], "train_to": days[b - 1], "test_from": days[b], "test_to": days[end - 1], "variant": name, "in_sample": best["figure"], "test_return": own[-1][1] - 1.0})
        curve += [(d, scale * e) for d, e in own if d >= days[b]]
        scale = curve[-1][1]
    chained = panel.sparkSession.createDataFrame([("walk", d, float(e)) for d, e in curve], "variant string, day date, equity double")
    figures = metrics.summary(chained).select("total_return", "cagr", "sharpe", "max_drawdown").first().asDict()
    return Walk(windows, curve, figures)


def forward_returns(panel: DataFrame, n: int, price: str = "close") -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    p = F.col(price)
    return panel.select(*AXES, ratio(F.lead(p, n).over(w) - p, p).alias("fwd"))


def factor_days(factor: DataFrame, panel: DataFrame, n: int = 1) -> DataFrame:
    """day, symbol, ord, f, fwd, rf, rr, m, next_day: cells with both a factor value and a forward return, their average ranks and number per day, and the grid's next day."""
    both = align(factor.select(*AXES, F.col("v").alias("f")), forward_returns(panel, n))
    both = both.withColumn("next_day", F.lead("day").over(Window.partitionBy("symbol").orderBy("day")))
    both = both.where(F.col("fwd").isNotNull() & (F.abs("fwd") < float("inf")) & (F.abs("f") < float("inf")))
    day = Window.partitionBy("day")
    rank = lambda c: F.rank().over(day.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("day", c)) - 1) / 2
    return both.withColumns({"rf": rank("f"), "rr": rank("fwd"), "m": F.count(F.lit(1)).over(day)})


def information(days: DataFrame) -> DataFrame:
    """day, ic: the rank correlation of each day with two or more cells; 0 where a side is constant."""
    ic = F.covar_pop("rf", "rr") / F.nullif(F.stddev_pop("rf") * F.stddev_pop("rr"), F.lit(0.0))
    return days.where("m >= 2").groupBy("day").agg(F.coalesce(ic, F.lit(0.0)).alias("ic"))


def _bucketed(days: DataFrame, buckets: int) -> DataFrame:
    """The cells of days with two or more, with their bucket by factor, 0 the lowest; ties go to the earlier column. Thin days leave buckets empty."""
    place = F.row_number().over(Window.partitionBy("day").orderBy("f", "ord")) - 1
    return days.where("m >= 2").withColumn("bucket", F.floor(place * buckets / F.col("m")).cast("int"))


def factor_report(days: DataFrame, buckets: int = 5) -> DataFrame:
    """bucket, mean return over all its cells, cells."""
    return _bucketed(days, buckets).groupBy("bucket").agg(F.avg("fwd").alias("mean_return"), F.count(F.lit(1)).alias("n"))


def factor_figures(days: DataFrame, buckets: int = 5) -> DataFrame:
    """One row: n_days, mean_ic, ic_deviation (sample), icir, long_short (highest less lowest bucket) and top_turnover.

    Turnover is the mean share of the top bucket that isn't in it on the grid's next day, over days whose top bucket isn't empty and whose
    next day has two or more cells. Figures without days to take them from are NULL.
    """
    ic = information(days).agg(F.count(F.lit(1)).alias("n_days"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_deviation"))
    cells = _bucketed(days, buckets)
    ends = cells.agg((F.avg(F.when(F.col("bucket") == buckets - 1, F.col("fwd"))) - F.avg(F.when(F.col("bucket") == 0, F.col("fwd")))).alias("long_short"))
    top = cells.where(F.col("bucket") == buckets - 1).select("day", "symbol", "next_day")
    known = days.where("m >= 2").select(F.col("day").alias("next_day")).distinct()
    after = top.select(F.col("day").alias("next_day"), "symbol", F.lit(1).alias("_stays"))
    left = top.join(known, "next_day").join(after, ["next_day", "symbol"], "left").groupBy("day").agg(F.avg(F.when(F.col("_stays").isNull(), 1.0).otherwise(0.0)).alias("_left"))
    out = ic.crossJoin(ends).crossJoin(left.agg(F.avg("_left").alias("top_turnover")))  # three single rows
    return out.withColumn("icir", F.when(F.col("ic_deviation") > 0, F.col("mean_ic") / F.col("ic_deviation")))


def event_study(events: DataFrame, panel: DataFrame, before: int, after: int, price: str = "close") -> DataFrame:
    """lag, mean_return, cumulative, event_count: the average return around cells whose event value ``v`` is exactly 1.

    Events meet the rows around them by an equi-join on (symbol, row number); lags off the grid are left out.
    """
    w = Window.partitionBy("symbol").orderBy("day")
    p = F.col(price)
    rows = panel.select("symbol", "day", F.row_number().over(w).alias("rn"), ratio(p - F.lag(p).over(w), F.lag(p).over(w)).alias("ret"))
    hit = events.where(F.col("v") == 1.0).select("symbol", "day").join(rows.select("symbol", "day", "rn"), ["symbol", "day"])
    near = hit.select("symbol", "rn", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("lag")).select("symbol", "lag", (F.col("rn") + F.col("lag")).alias("rn"))
    out = near.join(rows, ["symbol", "rn"]).where(F.abs("ret") < float("inf")).groupBy("lag").agg(F.avg("ret").alias("mean_return"), F.count(F.lit(1)).alias("event_count"))
    return out.withColumn("cumulative", F.sum("mean_return").over(Window.orderBy("lag")))
