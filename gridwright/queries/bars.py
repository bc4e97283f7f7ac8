"""Panels over the fact tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators.panel import to_panel
from gridwright.session import table

UNIT = "l_extendedprice / l_quantity"
SERIES = {
    "open": f"min_by({UNIT}, l_orderkey * 10 + l_linenumber)",
    "high": f"max({UNIT})",
    "low": f"min({UNIT})",
    "close": "sum(l_extendedprice) / sum(l_quantity)",
    "volume": "sum(l_quantity)",
}
LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def brands(spark: SparkSession, d: str, grain: str = "day") -> DataFrame:
    """Prices and volume per part brand: the join is on the smaller side's key, broadcast by its size if small."""
    lines = table(spark, d, "lineitem").select(*LINES)
    facts = lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return to_panel(facts, F.col("l_shipdate"), F.col("p_brand"), {k: F.expr(v) for k, v in SERIES.items()}, grain)


def nations(spark: SparkSession, d: str, grain: str = "day") -> DataFrame:
    lines = table(spark, d, "lineitem").select(*LINES)
    supply = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return to_panel(lines.join(supply, F.col("l_suppkey") == F.col("s_suppkey")), F.col("l_shipdate"), F.col("n_name"), {k: F.expr(v) for k, v in SERIES.items()}, grain)


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """symbol, sector: nations and their regions."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


def panel_sql(kind: str = "brands", grain: str = "day") -> str:
    """CTEs ending in b: day, symbol, ord, the series, and rn, the row's number within its symbol."""
    day = "cast(l_shipdate AS date)" if grain == "day" else "last_day(cast(l_shipdate AS date))"
    name, joined = ("p_brand", "JOIN part ON l_partkey = p_partkey") if kind == "brands" else ("n_name", "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
    return f"""r0 AS (SELECT {day} AS day, {name} AS symbol, arg_min({UNIT}, l_orderkey * 10 + l_linenumber) AS open, max({UNIT}) AS high, min({UNIT}) AS low, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
 FROM lineitem {joined} GROUP BY ALL),
b AS (SELECT d.day, s.symbol, s.ord, r0.open, r0.high, r0.low, r0.close, r0.volume, row_number() OVER (PARTITION BY s.symbol ORDER BY d.day) AS rn
 FROM (SELECT DISTINCT day FROM r0) d CROSS JOIN (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS ord FROM (SELECT DISTINCT symbol FROM r0)) s LEFT JOIN r0 ON r0.day = d.day AND r0.symbol = s.symbol)"""
