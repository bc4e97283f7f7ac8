"""History of changing entity attributes, kept as checkpoints and patches.

``encode`` turns successive full versions of an entity's attribute set into a
*checkpoint* (the full version) at every k-th version and a *patch* for each
attribute that came or went at any other. ``validity`` folds the patches of each
stretch forward from its checkpoint into periods and joins periods that meet
where one stretch hands over to the next. ``as_of`` rebuilds single versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import FOREVER, col


@dataclass(frozen=True)
class Store:
    """versions: entity, ord, at, next_at; checkpoints: entity, stretch, at, next_stretch_at, attributes;
    patches: entity, stretch, at, attribute, present."""

    versions: DataFrame
    checkpoints: DataFrame
    patches: DataFrame

    def write(self, folder: str) -> None:
        for name in ("versions", "checkpoints", "patches"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Store:
        return Store(*(spark.read.parquet(f"{folder}/{name}") for name in ("versions", "checkpoints", "patches")))


def full_versions(deliveries: DataFrame, entity: str, at: str, attributes, precedence: list[str]) -> DataFrame:
    """(entity, at, attributes): of several deliveries for one entity and time the one of greatest precedence with
    a non-empty set. ``attributes`` is an array expression; its NULLs, repeats and order are dropped. Deliveries
    without entity or time, and NULL or empty sets, say nothing."""
    clean = F.array_sort(F.array_distinct(F.filter(attributes, lambda x: x.isNotNull())))
    d = deliveries.select(col(entity).alias("entity"), col(at).alias("at"), F.struct(*[col(c).alias(f"p{i}") for i, c in enumerate(precedence)], clean.alias("attributes")).alias("_d"))
    d = d.where(F.col("entity").isNotNull() & F.col("at").isNotNull() & (F.size("_d.attributes") > 0))
    return d.groupBy("entity", "at").agg(F.max("_d").alias("_d")).select("entity", "at", "_d.attributes")


def encode(versions: DataFrame, every: int = 16) -> Store:
    """Full versions (entity, at, attributes) as a store with a checkpoint at every ``every``-th version.

    The versions' order is found over their dates alone; each version meets
    its predecessor by an equi-join, so no entity's lists come together in a task.
    """
    order = Window.partitionBy("entity").orderBy("at")
    dates = versions.select("entity", "at").withColumns({"ord": F.row_number().over(order) - 1, "next_at": F.lead("at").over(order)})
    dates = dates.withColumn("stretch", F.floor(F.col("ord") / every).cast("int"))
    # the next checkpoint's date, from the checkpoints alone
    heads = dates.where(F.col("ord") % every == 0).select("entity", "stretch", F.lead("at").over(order).alias("next_stretch_at"))
    handover = dates.join(heads, ["entity", "stretch"])
    full = versions.join(handover, ["entity", "at"])
    checkpoints = full.where(F.col("ord") % every == 0).select("entity", "stretch", "at", "next_stretch_at", "attributes")
    earlier = full.select("entity", (F.col("ord") + 1).alias("ord"), F.col("attributes").alias("_old"))
    both = full.where(F.col("ord") % every != 0).join(earlier, ["entity", "ord"])
    patch = F.concat(
        F.transform(F.array_except("attributes", "_old"), lambda x: F.struct(x.alias("attribute"), F.lit(True).alias("present"))),
        F.transform(F.array_except("_old", "attributes"), lambda x: F.struct(x.alias("attribute"), F.lit(False).alias("present"))),
    )
    patches = both.select("entity", "stretch", "at", F.inline(patch))
    return Store(dates.select("entity", "ord", "at", "next_at"), checkpoints, patches)


def validity(store: Store, forever: int = FOREVER) -> DataFrame:
    """(entity, attribute, valid_from, valid_to): one row for each longest stretch of versions that hold the attribute.

    ``valid_to`` is the time of the next version without it, ``forever`` if there is none.
    """
    start = store.checkpoints.select("entity", "stretch", F.explode("attributes").alias("attribute"), F.struct("at", F.lit(True).alias("present")).alias("_p"))
    # the patches of one stretch and attribute: at most as many as versions in a stretch
    events = start.unionByName(store.patches.select("entity", "stretch", "attribute", F.struct("at", "present").alias("_p")))
    folded = events.groupBy("entity", "stretch", "attribute").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    ends = store.checkpoints.select("entity", "stretch", F.col("next_stretch_at").alias("_end"))
    folded = folded.join(ends, ["entity", "stretch"])
    opened = F.filter(F.transform("_p", lambda x, i: F.struct(x.at.alias("at"), x.present.alias("present"), F.get(F.col("_p"), i + 1).at.alias("until"))), lambda x: x.present)
    periods = folded.select("entity", "attribute", "_end", F.inline(opened)).select("entity", "attribute", F.col("at").alias("_from"), F.coalesce("until", "_end", F.lit(forever)).alias("_to"))
    # periods that meet at a handover are one
    order = Window.partitionBy("entity", "attribute").orderBy("_from")
    new = F.coalesce(F.lag("_to").over(order) != F.col("_from"), F.lit(True))
    run = periods.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(order))
    return run.groupBy("entity", "attribute", "_run").agg(F.min("_from").alias("valid_from"), F.max("_to").alias("valid_to")).drop("_run")


def as_of(store: Store, at: int) -> DataFrame:
    """(entity, attribute) held at a time: each entity's nearest checkpoint with the patches up to then folded in."""
    near = store.checkpoints.where(F.col("at") <= at).where(F.col("next_stretch_at").isNull() | (F.col("next_stretch_at") > at))
    start = near.select("entity", F.explode("attributes").alias("attribute"), F.struct("at", F.lit(True).alias("present")).alias("_p"))
    later = store.patches.where(F.col("at") <= at).join(near.select("entity", "stretch"), ["entity", "stretch"]).select("entity", "attribute", F.struct("at", "present").alias("_p"))
    return start.unionByName(later).groupBy("entity", "attribute").agg(F.max("_p").alias("_p")).where("_p.present").select("entity", "attribute")
