"""Panels: dense (day, symbol) grids of named series, in long form.

A panel is a DataFrame with the columns day, symbol, ord (the symbol's place,
which settles ties) and one nullable double per series. Missing is NULL, never NaN. Windows count
grid rows, so a panel is made dense before anything rolls over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col, present
from gridwright.session import staged

AXES = ["day", "symbol", "ord"]


def to_panel(df: DataFrame, day: Column, symbol: Column, series: dict[str, Column], grain: str = "day") -> DataFrame:
    """A fact table as a dense panel: ``series`` are aggregates per (day, symbol); ``grain`` 'month' dates rows by month ends.

    The facts are read once: their cells, far smaller, are kept in the shared folder, from which calendar, symbols and grid are made.
    """
    at = F.last_day(day.cast("date")) if grain == "month" else day.cast("date")
    cells = df.select("*", at.alias("_day"), symbol.cast("string").alias("_symbol")).where(F.col("_day").isNotNull() & F.col("_symbol").isNotNull())
    return densify(staged(cells.groupBy(F.col("_day").alias("day"), F.col("_symbol").alias("symbol")).agg(*[present(v).alias(n) for n, v in series.items()]), "cells"))


def densify(cells: DataFrame) -> DataFrame:
    """Every day of any cell for every symbol: the days, as one array, go to each symbol's row and come out again."""
    series = [c for c in cells.columns if c not in AXES]
    days = cells.agg(F.array_sort(F.collect_set("day")).alias("_days"))  # the calendar: bounded by days, not by rows
    symbols = cells.select("symbol").distinct().withColumn("ord", F.row_number().over(Window.orderBy("symbol")) - 1)  # a row per symbol
    grid = symbols.select("symbol", "ord", F.explode(days.scalar()).alias("day"))
    return grid.join(cells.select("day", "symbol", *[col(s) for s in series]), ["day", "symbol"], "left").select(*AXES, *[col(s) for s in series])


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two panels on one grid: the union of their days, the symbols in both in a's order; absent cells are NULL.

    Series names must differ. Neither side is broadcast by hand; the grid comes from days and symbols alone.
    """
    sa, sb = ([c for c in p.columns if c not in AXES] for p in (a, b))
    days = a.select("day").union(b.select("day")).agg(F.array_sort(F.collect_set("day")).alias("d"))
    both = a.select("symbol", "ord").distinct().join(b.select("symbol").distinct(), "symbol", "left_semi")
    grid = both.select("symbol", "ord", F.explode(days.scalar()).alias("day"))
    out = grid.join(a.select("day", "symbol", *[col(c) for c in sa]), ["day", "symbol"], "left")
    return out.join(b.select("day", "symbol", *[col(c) for c in sb]), ["day", "symbol"], "left").select(*AXES, *[col(c) for c in [*sa, *sb]])


def on_grid_of(panel: DataFrame, other: DataFrame) -> DataFrame:
    """``other``'s series on ``panel``'s grid: a left equi-join, absent cells NULL."""
    names = [c for c in other.columns if c not in AXES]
    return panel.join(other.select("day", "symbol", *[col(c) for c in names]), ["day", "symbol"], "left")


def between(panel: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """An inclusive slice of days; NULL bounds are open. The filter reaches the scan."""
    out = panel
    if first is not None:
        out = out.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        out = out.where(F.col("day") <= F.lit(last).cast("date"))
    return out


def filled(panel: DataFrame, series: list[str]) -> DataFrame:
    """Each series' last known value carried down its symbol's days."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns({s: F.last(col(s), ignorenulls=True).over(w) for s in series})


def as_of(panel: DataFrame, facts: DataFrame, visible: str, series: list[str]) -> DataFrame:
    """Facts (symbol, ``visible`` day, series) joined backward: each cell gets the latest values visible on or before its day.

    One union and one window instead of a range join; facts of one day and symbol keep the greatest.
    """
    best = facts.where(col(visible).isNotNull()).groupBy("symbol", col(visible).cast("date").alias("day")).agg(F.max(F.struct(*[col(s).alias(s) for s in series])).alias("_fact"))
    rows = panel.withColumn("_cell", F.lit(1)).withColumn("_fact", F.lit(None).cast(best.schema["_fact"].dataType))
    rest = [c for c in panel.columns if c not in ("day", "symbol")]
    add = best.select("day", "symbol", *[F.lit(None).cast(panel.schema[c].dataType).alias(c) for c in rest], F.lit(0).alias("_cell"), "_fact")
    w = Window.partitionBy("symbol").orderBy("day", "_cell").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("day", "symbol", *rest, "_cell", "_fact").unionByName(add).withColumn("_seen", F.last("_fact", ignorenulls=True).over(w)).where("_cell = 1")
    return out.select("day", "symbol", *rest, *[F.col(f"_seen.`{s}`").alias(s) for s in series])


def wide(panel: DataFrame, series: str, symbols: list[str]) -> DataFrame:
    """day and a column per symbol."""
    return panel.groupBy("day").pivot("symbol", symbols).agg(F.first(col(series)))


def long(table: DataFrame, series: str) -> DataFrame:
    """A wide table (day and a column per symbol) as a panel; symbols keep their column order."""
    names = [c for c in table.columns if c != "day"]
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    out = table.select(col("day").cast("date").alias("day"), *[present(col(n).cast("double")).alias(n) for n in names]).unpivot("day", names, "symbol", series)
    return out.select("day", "symbol", F.element_at(order, F.col("symbol")).alias("ord"), col(series))
