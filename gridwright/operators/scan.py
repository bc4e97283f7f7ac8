"""Running aggregates over keys of any size, and the keys that are hot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], aggs: dict[str, tuple[Callable[[Column], Column], Column, Callable[[Column, Column], Column]]], exclusive: bool = False) -> DataFrame:
    """Running aggregates along an order, without one task per key.

    ``bucket`` must not fall along the order; it cuts a key into pieces that are
    scanned apart. The pieces' totals, one row each, are scanned per key and
    added to the rows. ``aggs`` names each result by (aggregate, input, how to
    combine an earlier total with a running value). With ``exclusive`` the
    row itself isn't part of its value. Rows with a NULL key form a key of
    their own; NULL inputs are passed over as the aggregate does.
    """
    named = [col(k) for k in keys]
    frame = (Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    within = Window.partitionBy(*named, col(bucket)).orderBy(*order).rowsBetween(*frame)
    before = Window.partitionBy(*named).orderBy(col(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*named, col(bucket)).agg(*[f(v).alias(f"_t_{n}") for n, (f, v, _) in aggs.items()])
    totals = totals.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], col(bucket).alias("_b"), *[f(F.col(f"_t_{n}")).over(before).alias(f"_t_{n}") for n, (f, _, _) in aggs.items()])
    on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [col(bucket).eqNullSafe(F.col("_b"))]
    out = df.withColumns({f"_r_{n}": f(v).over(within) for n, (f, v, _) in aggs.items()}).join(totals.hint("merge"), on, "left")
    return out.select(*[col(c) for c in df.columns], *[both(F.col(f"_t_{n}"), F.col(f"_r_{n}")).alias(n) for n, (_, _, both) in aggs.items()])


def hot(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """_h0, _h1, ..., _n: the values of ``keys`` that hold at least ``share`` of the rows, and how many: at most 1/share of them, so they may be broadcast."""
    counts = df.groupBy(*[col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    least = df.agg((F.count(F.lit(1)) * share).alias("_least"))
    return counts.where(F.col("_n") >= least.scalar()).dropna("any")
