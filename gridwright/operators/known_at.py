"""Attributes as known at event time.

A version of an entity's attributes is *known* from ``max(start of its filing
day, time of loading)``. Among the versions known at a time the one with the
greatest precedence is *due*. ``due_intervals`` turns versions into disjoint
half-open intervals in which they are due; ``known_at`` covers each interval with
dyadic time nodes that suit its length, lets every event look up the nodes that enclose it, on
the levels its entity has, by an equi-join, and keeps exact half-open matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.operators.scan import hot, running

#: Later than any time, in microseconds.
ALWAYS = 1 << 62
#: Only every so manieth dyadic level is used: fewer keys an event, at most 2**STRIDE + 1 nodes an interval.
STRIDE = 3


def due_intervals(versions: DataFrame, entity: list[str], known_from: Column, precedence: list[Column], payload: list[str], bucket_bits: int = 43) -> DataFrame:
    """Disjoint intervals [_from, _to) in microseconds in which a version is due.

    A version never becomes due if a better one was known no later. Versions
    whose time or one of whose precedences is NULL are passed over; repeated rows
    count once. Ties in precedence keep the row whose payload is greatest, so
    the result doesn't depend on the order of the rows. An entity may hold any
    share of the rows: it is scanned in pieces of 2**bucket_bits microseconds.
    """
    v = versions.select(*[col(e).alias(e) for e in entity], known_from.alias("_from"), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(precedence)], *[col(c).alias(f"v{i}") for i, c in enumerate(payload)]).alias("_best"))
    v = v.where(F.col("_from").isNotNull())
    for i in range(len(precedence)):
        v = v.where(F.col(f"_best.p{i}").isNotNull())
    # one row per entity and time; also removes repeated rows before the shuffle
    v = v.groupBy(*[col(e) for e in entity], "_from").agg(F.max("_best").alias("_best"))
    v = v.withColumn("_bucket", F.shiftright("_from", bucket_bits))
    larger = lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a)
    v = running(v, entity, "_bucket", [F.col("_from")], {"_before": (F.max, F.col("_best"), lambda a, b: F.when(b.isNull(), a).otherwise(larger(a, b)))}, exclusive=True)
    v = v.where(F.col("_before").isNull() | (F.col("_best") > F.col("_before"))).drop("_before")
    # the next change of an entity: within the piece, else the first of a later piece
    v = running(v.withColumn("_bucket", -F.col("_bucket")), entity, "_bucket", [F.col("_from").desc()], {"_to": (F.min, F.col("_from"), lambda a, b: F.coalesce(b, a))}, exclusive=True)
    return v.select(*[col(e) for e in entity], "_from", F.coalesce("_to", F.lit(ALWAYS)).alias("_to"), *[F.col(f"_best.v{i}").alias(c) for i, c in enumerate(payload)])


def level_of(start: Column, end: Column, stride: int = STRIDE) -> Column:
    """The greatest multiple of ``stride`` whose dyadic nodes, 2**level long, are no longer than [start, end)."""
    return (F.floor(F.floor(F.log2((end - start).cast("double"))) / stride) * stride).cast("int")


def nodes(start: Column, end: Column, level: Column) -> Column:
    """The numbers of a level's dyadic nodes that cover [start, end)."""
    return F.sequence(_node(start, level), _node(end - 1, level))


def _node(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def known_at(events: DataFrame, event_key: str, time: Column, entity: dict[str, Column], intervals: DataFrame, payload: list[str], salts: int = 16, hot_share: float = 0.01) -> DataFrame:
    """(event_key, *payload) of the interval of its entity that holds each event.

    ``entity`` maps the intervals' entity columns to expressions over the
    events. ``intervals`` is read three times. Events with a NULL key, time or entity, and events that no interval
    holds, have no row. Repeated events (same key) come out once if their time
    and entity agree; of others the row with the latest interval wins. Any time is allowed.

    Intervals are cut to the time the events span and covered with nodes of one level each, so an event has as many keys
    as its entity has levels, and meets few intervals besides its own: those next to it at the ends of its node. The events of entities above ``hot_share`` of all events
    are spread over at most ``salts`` keys, to which only those entities' nodes are copied, never to more copies than they have events.
    """
    names = list(entity)
    width = range(len(names))
    e = events.select(col(event_key).alias("_event"), time.alias("_at"), *[x.alias(f"_e{k}") for k, x in enumerate(entity.values())]).dropna("any")
    span = e.agg(F.struct(F.min("_at").alias("low"), F.max("_at").alias("high")).alias("_span")).scalar()
    h = hot(e, [f"_e{k}" for k in width], hot_share)
    i = intervals.select(*[col(n).alias(f"_i{k}") for k, n in enumerate(names)], "_from", "_to", *[col(c).alias(f"_p{k}") for k, c in enumerate(payload)])
    i = i.withColumns({"_a": F.greatest("_from", span.getField("low")), "_z": F.least("_to", span.getField("high") + 1)}).where(F.col("_a") < F.col("_z")).withColumn("_lvl", level_of(F.col("_a"), F.col("_z")))
    # one row an entity: its levels, at most 63 / STRIDE, and over how many keys its events are spread
    by = i.groupBy(*[f"_i{k}" for k in width]).agg(F.collect_set("_lvl").alias("_levels"), F.count(F.lit(1)).alias("_count"))
    by = by.join(F.broadcast(h), [F.col(f"_i{k}") == F.col(f"_h{k}") for k in width], "left")
    by = by.withColumn("_salts", F.coalesce(F.least(F.lit(salts), F.ceil(F.col("_n") / F.col("_count"))), F.lit(1)).cast("int"))
    of = by.withColumn("_s", F.explode(F.sequence(F.lit(0), F.when(F.col("_n").isNotNull(), salts - 1).otherwise(0))))
    e = e.join(F.broadcast(h), [F.col(f"_e{k}") == F.col(f"_h{k}") for k in width], "left")
    e = e.withColumn("_salt", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("_event"), F.lit(salts))).otherwise(0).cast("int")).drop("_n", *[f"_h{k}" for k in width])
    # the rows a join meets are multiplied after Spark has sized them, so both joins are told to sort
    e = e.join(of.drop("_n", *[f"_h{k}" for k in width]).hint("merge"), [F.col(f"_e{k}") == F.col(f"_i{k}") for k in width] + [F.col("_salt") == F.col("_s")])
    e = e.select("_event", "_at", *[f"_e{k}" for k in width], F.pmod(F.col("_salt"), F.col("_salts")).alias("_salt"), F.explode("_levels").alias("_level")).withColumn("_node", _node(F.col("_at"), F.col("_level")))
    spread = by.where(F.col("_salts") > 1).select(*[F.col(f"_h{k}") for k in width], "_salts")
    i = i.join(F.broadcast(spread), [F.col(f"_i{k}") == F.col(f"_h{k}") for k in width], "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    i = i.withColumn("_nd", F.explode(nodes(F.col("_a"), F.col("_z"), F.col("_lvl"))))
    i = i.select(*[f"_i{k}" for k in width], "_from", "_to", "_lvl", "_nd", "_s", *[f"_p{k}" for k in range(len(payload))])
    on = [F.col(f"_e{k}") == F.col(f"_i{k}") for k in width] + [F.col("_level") == F.col("_lvl"), F.col("_node") == F.col("_nd"), F.col("_salt") == F.col("_s")]
    met = e.join(i.hint("merge"), on).where((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to")))
    won = met.groupBy("_event").agg(F.max(F.struct("_from", *[f"_p{k}" for k in range(len(payload))])).alias("_w"))
    return won.select(F.col("_event").alias(event_key), *[F.col(f"_w._p{k}").alias(c) for k, c in enumerate(payload)])
