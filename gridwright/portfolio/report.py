"""Reports: one nested document per variant, made by joins of its figures and series, and written as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.portfolio import metrics, nav


def _series(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """variant and an ordered array of the other columns. Bounded by the days or trades of one variant."""
    cols = [c for c in df.columns if c != "variant"]
    first = [c for c in order if c in cols]
    return df.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct(*first, *[c for c in cols if c not in first]))).alias(name))


def live_segment(equity: DataFrame, start: str) -> DataFrame:
    """The figures of the part of each curve on or after ``start``."""
    return metrics.summary(equity.where(F.col("day") >= F.lit(start).cast("date")))


def report(rows: DataFrame, live_start: str | None = None) -> DataFrame:
    """variant, metrics, trade_metrics, exposure, equity, drawdowns, monthly, yearly, trades, weights (and live): missing parts are NULL."""
    equity, trades = nav.equity_of(rows), nav.trade_list(rows)
    one = lambda df, name: df.select("variant", F.struct(*[c for c in df.columns if c != "variant"]).alias(name))
    parts = [
        one(metrics.summary(equity), "metrics"),
        one(metrics.trade_summary(trades), "trade_metrics"),
        one(metrics.exposure_summary(equity), "exposure"),
        _series(metrics.returns(equity), "equity", ["day"]),
        _series(metrics.drawdown_episodes(equity), "drawdowns", ["depth"]),
        _series(metrics.per_period(equity, "month"), "monthly", ["period"]),
        _series(metrics.per_period(equity, "year"), "yearly", ["period"]),
        _series(trades, "trades", ["entry_day", "symbol"]),
        _series(nav.book_of(rows), "weights", ["symbol"]),
    ]
    if live_start is not None:
        parts.append(one(live_segment(equity, live_start), "live"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "variant", "left")
    return out


def write(made: DataFrame, path: str) -> None:
    """JSON lines, a variant each; missing numbers are null."""
    made.write.mode("overwrite").json(path, ignoreNullFields=False)
