"""Index universes from change logs, and panels held to the symbols asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col

#: day, symbol, added, seq: one step per symbol a change names
STEP = ["day", "symbol", "added", "seq"]


def steps(log: DataFrame, keys: list[str], day: str, added: str, removed: str, seq: str) -> DataFrame:
    """*keys, day, symbol, added (boolean), seq: what a change log says of single symbols. Changes without a day, and blank symbols, say nothing.

    A change that adds and removes at once takes its removal back last, so that a symbol it both adds and removes was a member before.
    """
    one = lambda c, flag: log.select(*[col(k) for k in keys], col(day).alias("day"), F.nullif(F.trim(col(c)), F.lit("")).alias("symbol"), F.lit(flag).alias("added"), F.struct(col(seq).alias("no"), F.lit(flag).alias("late")).alias("seq"))
    return one(added, True).unionByName(one(removed, False)).where(F.col("day").isNotNull() & F.col("symbol").isNotNull())


def current(changes: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, symbol: who is a member after the whole log, where founding members are in it."""
    last = changes.groupBy(*[col(k) for k in keys], "symbol").agg(F.max_by("added", F.struct("day", "seq")).alias("_in"))
    return last.where("_in").drop("_in")


def members_as_of(now: DataFrame, changes: DataFrame, keys: list[str], day) -> DataFrame:
    """*keys, symbol: the members at the end of a day: today's set with every later change undone, the newest first.

    What a symbol's first later change did decides: added, it wasn't a member yet; removed, it still was. Without one it is as today.
    """
    named = [col(k) for k in keys]
    later = changes.where(F.col("day") > F.lit(day)).groupBy(*named, "symbol").agg(F.min_by("added", F.struct("day", "seq")).alias("_came"))
    both = now.select(*named, "symbol").distinct().withColumn("_now", F.lit(True)).join(later, [*keys, "symbol"], "full")
    return both.where(F.coalesce(~F.col("_came"), F.col("_now"), F.lit(False))).select(*named, "symbol")


def ever_members(now: DataFrame, changes: DataFrame, keys: list[str], first, last) -> DataFrame:
    """*keys, symbol: all that were members at some time from ``first`` to ``last``: those at ``first`` and those that came or went since."""
    touched = changes.where(F.col("day").between(F.lit(first), F.lit(last))).select(*[col(k) for k in keys], "symbol")
    return members_as_of(now, changes, keys, first).unionByName(touched).distinct()


def membership(now: DataFrame, changes: DataFrame, keys: list[str], calendar: DataFrame, columns: DataFrame) -> DataFrame:
    """*keys, day, symbol, member (1.0 or 0.0): the membership of ``columns`` (*keys, symbol) on each ``calendar`` day, changes of the day included.

    A symbol's days and changes are gone through once from the last to the first; its group is bounded by the calendar and its own changes.
    """
    named = [col(k) for k in keys]
    cells = columns.select(*named, "symbol").distinct().crossJoin(calendar.select("day").distinct())  # the grid asked for
    held = now.select(*named, "symbol").distinct().withColumn("_now", F.lit(1.0))
    rows = cells.select(*named, "symbol", "day", F.lit(True).alias("_cell"), F.lit(None).cast("boolean").alias("added"), F.lit(None).cast(changes.schema["seq"].dataType).alias("seq"))
    rows = rows.unionByName(changes.select(*named, "symbol", "day", F.lit(False).alias("_cell"), "added", "seq"))
    back = Window.partitionBy(*named, "symbol").orderBy(F.col("day").desc(), F.col("_cell").desc(), F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_came", F.last("added", ignorenulls=True).over(back)).where("_cell").join(held, [*keys, "symbol"], "left")
    return seen.select(*named, "day", "symbol", F.coalesce(F.when(F.col("_came"), 0.0).when(~F.col("_came"), 1.0), F.col("_now"), F.lit(0.0)).alias("member"))


def scoped(panel: DataFrame, symbols: list[str] | None) -> DataFrame:
    """The panel of the symbols asked for (all if None). One that isn't there is an error, as a smaller universe changes every comparison across it."""
    if symbols is None:
        return panel
    if not symbols:
        raise ValueError("the list of symbols is empty; leave it out to take all")
    wanted = panel.sparkSession.createDataFrame([(s,) for s in sorted(set(symbols))], "symbol string")
    missing = [r["symbol"] for r in wanted.join(panel.select("symbol").distinct(), "symbol", "left_anti").orderBy("symbol").collect()]
    if missing:
        raise ValueError(f"no such symbols: {', '.join(missing)}")
    return panel.join(wanted, "symbol", "left_semi").select(*panel.columns)
