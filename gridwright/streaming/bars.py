"""Event streams as bars, and state carried per key, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridwright.functions.columns import col


def tumbling_bars(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """key, start, open, high, low, close, n of each window; the same plan on a table and on a stream.

    On a stream, rows later than ``late`` behind the greatest time seen are dropped and their windows' state is freed. Open and close go by time, then value.
    """
    e = events.where(col(time).isNotNull() & col(key).isNotNull() & col(value).isNotNull())
    e = e.withColumn(time, col(time).cast("timestamp"))  # watermarks need instants
    if events.isStreaming:
        e = e.withWatermark(time, late)
    order = F.struct(col(time), col(value))
    out = e.groupBy(F.window(col(time), width), col(key).alias("key")).agg(F.min_by(col(value), order).alias("open"), F.max(col(value)).alias("high"), F.min(col(value)).alias("low"), F.max_by(col(value), order).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select("key", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def smoothed(bars: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """key, order, value, ema: an exponential mean carried from batch to batch in a state of two numbers per key.

    It starts at a key's first value. Within a batch rows are taken in order; rows that arrive later than a newer one are smoothed on arrival.
    """
    k = 2.0 / (n + 1.0)
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, seen = state.get if state.exists else (0.0, 0)
        for frame in frames:
            frame = frame.sort_values([order, value])
            out = []
            for x in frame[value]:
                now = float(x) if not seen else now + k * (float(x) - now)
                seen = 1
                out.append(now)
            yield pd.DataFrame({key: keys[0], order: frame[order].to_numpy(), value: frame[value].to_numpy(), "ema": out})
        state.update((now, seen))

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, ema double"
    return bars.where(col(value).isNotNull()).groupBy(key).applyInPandasWithState(step, schema, "now double, seen int", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything a stream over a finite source yields, written to a table under ``folder`` with its checkpoint, and read again."""
    spark: SparkSession = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
