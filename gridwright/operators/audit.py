"""Audits of a panel before it is trusted: one DataFrame per check, and a status table of them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col


def coverage(panel: DataFrame, expected: DataFrame) -> DataFrame:
    """symbol, problem: expected symbols the panel lacks ('missing') and panel symbols nobody expects ('extra')."""
    have, want = panel.select("symbol").distinct(), expected.select("symbol").distinct()
    return want.join(have, "symbol", "left_anti").select("symbol", F.lit("missing").alias("problem")).unionByName(have.join(want, "symbol", "left_anti").select("symbol", F.lit("extra").alias("problem")))


def calendar_gaps(panel: DataFrame, series: str = "close", least: int = 5) -> DataFrame:
    """symbol, gap_from, gap_to, rows: stretches of at least ``least`` grid rows without a value inside a symbol's life."""
    w = Window.partitionBy("symbol").orderBy("day")
    seen = panel.withColumn("_rn", F.row_number().over(w)).where(col(series).isNotNull())
    step = seen.withColumns({"_p": F.lag("_rn").over(w), "gap_from": F.lag("day").over(w)})
    return step.where(F.col("_rn") - F.col("_p") > least).select("symbol", "gap_from", F.col("day").alias("gap_to"), (F.col("_rn") - F.col("_p") - 1).alias("rows"))


def adjustment(panel: DataFrame, series: str = "close", limit: float = 0.5) -> DataFrame:
    """symbol, day, ret: moves beyond ``limit`` between successive values, as an unadjusted split leaves them."""
    w = Window.partitionBy("symbol").orderBy("day")
    seen = panel.where(col(series).isNotNull()).withColumn("_p", F.lag(col(series)).over(w))
    return seen.withColumn("ret", col(series) / F.nullif("_p", F.lit(0.0)) - 1.0).where(F.abs("ret") > limit).select("symbol", "day", "ret")


def survivorship(panel: DataFrame, series: str = "close") -> DataFrame:
    """n_symbols, n_ended, share: how many symbols end before the panel does. None at all is the mark of a surviving-only universe."""
    life = panel.where(col(series).isNotNull()).groupBy("symbol").agg(F.max("day").alias("last_day"))
    end = panel.agg(F.max("day")).scalar()
    return life.agg(F.count(F.lit(1)).alias("n_symbols"), F.count(F.when(F.col("last_day") < end, 1)).alias("n_ended")).withColumn("share", F.col("n_ended") / F.nullif("n_symbols", F.lit(0)))


def density(panel: DataFrame, series: list[str]) -> DataFrame:
    """series, n_cells, n_missing, share, and whether it is missing throughout."""
    counts = panel.agg(F.count(F.lit(1)).alias("n_cells"), *[F.count(col(s)).alias(s) for s in series])
    out = counts.unpivot("n_cells", series, "series", "n_there")
    return out.select("series", "n_cells", (F.col("n_cells") - F.col("n_there")).alias("n_missing"), (1 - F.col("n_there") / F.nullif("n_cells", F.lit(0))).alias("share"), (F.col("n_there") == 0).cast("int").alias("all_missing"))


def filing_lag(facts: DataFrame, visible: str) -> DataFrame:
    """n_filings, n_month_end, share: facts dated on month ends are period ends, not days of publication, if they are over half."""
    day = col(visible).cast("date")
    return facts.where(day.isNotNull()).agg(F.count(F.lit(1)).alias("n_filings"), F.count(F.when(day == F.last_day(day), 1)).alias("n_month_end")).withColumn("share", F.col("n_month_end") / F.nullif("n_filings", F.lit(0)))


def membership(panel: DataFrame, series: str) -> DataFrame:
    """day, members: how many symbols are exactly 1 each day."""
    return panel.groupBy("day").agg(F.count(F.when(col(series) == 1.0, 1)).alias("members"))


def statuses(panel: DataFrame, expected: DataFrame, series: list[str], price: str = "close") -> DataFrame:
    """check, status, found: 'ok', 'warn' or 'fail' (for missing symbols and series missing throughout)."""
    graded = {
        "coverage": (coverage(panel, expected).where("problem = 'missing'"), "fail"),
        "calendar_gaps": (calendar_gaps(panel, price), "warn"),
        "adjustment": (adjustment(panel, price), "warn"),
        "survivorship": (survivorship(panel, price).where("n_ended = 0"), "warn"),
        "density": (density(panel, series).where("all_missing = 1"), "fail"),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("check"), F.when(F.col("found") > 0, bad).otherwise("ok").alias("status"), "found") for name, (df, bad) in graded.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def cohort_percentile(facts: DataFrame, cohort: str, value: str, least: int = 5) -> DataFrame:
    """facts with pctile: the midrank of positive values in their cohort, 0 to 100; NULL in cohorts under ``least``."""
    v = F.when(col(value) > 0, col(value))
    f = facts.withColumn("_v", v)
    w = Window.partitionBy(col(cohort))
    below = F.rank().over(w.orderBy(F.col("_v").asc_nulls_last())) - 1
    same = F.count(F.lit(1)).over(Window.partitionBy(col(cohort), "_v"))
    n = F.count("_v").over(w)
    return f.withColumn("pctile", F.when(F.col("_v").isNotNull() & (n >= least), (below + same / 2) / n * 100)).drop("_v")
