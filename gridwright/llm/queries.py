"""The queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.leaks import leaks
from gridwright.llm.packing import pack_documents
from gridwright.llm.sentences import sentences
from gridwright.session import table


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "containers"), "container_kind", "capacity_tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: containers used, tokens in them, the least number of containers those tokens need, and the share of room left over."""
    kinds = table(spark, d, "containers").select("container_kind", "capacity_tokens").distinct()
    used = p8_packed(spark, d).groupBy("container_kind").agg(F.max("container_id").alias("last"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))
    n = (F.col("last") + 1).alias("n_containers")
    return used.join(kinds, "container_kind").select("container_kind", n, "n_pieces", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), (1 - F.col("n_tokens") / ((F.col("last") + 1) * F.col("capacity_tokens"))).alias("left_over"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    return {"p8_packed": p8_packed, "p8_report": p8_report, "p9_found": p9_found, "p10_found": p10_found}


def oracle_sql() -> dict:
    return {}
