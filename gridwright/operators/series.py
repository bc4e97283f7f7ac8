"""Deduplicated series of readings, regular grids and trailing totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col


def counting(df: DataFrame, keys: list[str], precedence: list[str], values: dict[str, Column]) -> DataFrame:
    """Of several rows of one key the one of greatest precedence (NULL is least): keys and values.

    Aggregates before the shuffle; repeated rows and the order of delivery change nothing.
    Remaining ties keep the row whose values are greatest. NULL keys are kept as a key.
    """
    best = F.max(F.struct(*[col(p).alias(f"p{i}") for i, p in enumerate(precedence)], *[v.alias(f"v{i}") for i, v in enumerate(values.values())])).alias("_b")
    return df.groupBy(*[col(k).alias(k) for k in keys]).agg(best).select(*[col(k) for k in keys], *[F.col(f"_b.v{i}").alias(n) for i, n in enumerate(values)])


def on_grid(readings: DataFrame, source: list[str], period: str, value: str, calendar: DataFrame | None = None, step: str = "1 day", max_gap: int = 5) -> DataFrame:
    """A regular series per source: source, period, value, status, age.

    ``readings`` has at most one value per source and period (a bucket
    aggregate); NULL values are no readings. The grid of a source runs from its
    first to its last reading over ``calendar`` (one column named as
    ``period``), or in steps of ``step``. status is 'observed', 'carried' (the
    last value, at most ``max_gap`` periods old) or 'missing' (value NULL). Readings
    off the calendar bound the grid and are carried, but are no period of it.
    Sources without a reading have no row. The state of a source is
    bounded by the number of its periods, not by the rows delivered.
    """
    keys = [col(s) for s in source]
    seen = readings.where(col(value).isNotNull() & col(period).isNotNull()).select(*keys, col(period).alias("_period"), col(value).alias("_value"))
    span = seen.groupBy(*keys).agg(F.min("_period").alias("_first"), F.max("_period").alias("_last"))
    grid = span.select(*keys, F.explode(F.sequence("_first", "_last", F.expr(f"interval {step}"))).alias("_period"))
    if calendar is not None:
        grid = grid.join(calendar.select(col(period).alias("_period")).distinct(), "_period")
    grid = grid.select(*[k.alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_period").alias("_gp"))
    same = [k.eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)] + [F.col("_gp") == F.col("_period")]
    full = grid.join(seen, same, "full" if calendar is not None else "left")
    full = full.select(*[F.coalesce(F.col(f"_g{i}"), k).alias(f"_s{i}") for i, k in enumerate(keys)], F.coalesce("_gp", "_period").alias("_at"), F.col("_gp").isNotNull().alias("_in"), "_value")
    order = Window.partitionBy(*[F.col(f"_s{i}") for i in range(len(keys))]).orderBy("_at")
    number = F.sum(F.col("_in").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumn("_no", number)
    last = F.last(F.when(F.col("_value").isNotNull(), F.struct("_no", "_value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumn("_last", last).where("_in")
    age = F.col("_no") - F.col("_last._no")
    status = F.when(F.col("_value").isNotNull(), "observed").when(age <= max_gap, "carried").otherwise("missing")
    return full.select(*[F.col(f"_s{i}").alias(s) for i, s in enumerate(source)], F.col("_at").alias(period), F.when(age <= max_gap, F.col("_last._value")).alias(value), status.alias("status"), age.cast("int").alias("age"))


def trailing_totals(readings: DataFrame, source: list[str], day: str, value: str, spans: DataFrame, span: str, windows: list[int]) -> DataFrame:
    """Totals over trailing calendar days: span, *source, day, and sum_w, n_w, avg_w for each window w.

    ``readings`` has at most one row per source and day (NULL values are no
    readings). ``spans`` has the columns ``span`` (a key), first_day, last_day and
    earliest: of each span all days from first_day to last_day come out on which
    the source lies between its first and last reading and the longest window
    holds a reading; only readings dated ``earliest`` or later are used. Windows hold the day itself. A window
    without readings has sum 0, n 0 and a NULL average.

    The sums come from binary doubling: over a dense day array per span and
    source, blocks of 1, 2, 4, ... days are made of two shifted blocks of half the
    length, and each window is put together from the blocks of its binary
    digits. Arrays are bounded by the span's days.
    """
    keys = [col(s) for s in source]
    reach = max(windows)
    seen = readings.where(col(value).isNotNull() & col(day).isNotNull()).select(*keys, col(day).alias("_day"), col(value).cast("double").alias("_v"))
    life = seen.groupBy(*keys).agg(F.min("_day").alias("_born"), F.max("_day").alias("_died"))
    life = life.select(*[k.alias(f"_l{i}") for i, k in enumerate(keys)], "_born", "_died")
    start = F.date_sub("first_day", reach - 1)
    days = spans.select(col(span).alias("_span"), "first_day", "last_day", start.alias("_start"), F.explode(F.sequence(F.greatest(start, F.coalesce("earliest", start)), F.col("last_day"))).alias("_day"))
    met = seen.join(days, "_day").groupBy("_span", "first_day", "last_day", "_start", *keys).agg(F.array_sort(F.collect_list(F.struct(F.datediff("_day", "_start").alias("o"), F.col("_v").alias("v")))).alias("_x"))
    size = F.datediff("last_day", "_start") + 1

    def dense(of, fill) -> Column:
        nil = F.lit(fill)
        runs = F.transform("_x", lambda x, i: F.concat(F.array(of(x)), F.array_repeat(nil, F.coalesce(F.get(F.col("_x"), i + 1).o, size) - x.o - 1)))
        return F.concat(F.array_repeat(nil, F.get(F.col("_x"), F.lit(0)).o), F.flatten(runs))

    def shifted(name: str, by: int, nil: Column) -> Column:
        return F.slice(F.concat(F.array_repeat(nil, by), F.col(name)), F.lit(1), size)

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    kinds = {"s": (lambda x: x.v, 0.0), "n": (lambda x: F.lit(1), 0)}
    out = met
    for kind, (of, fill) in kinds.items():
        out = out.withColumn(f"_{kind}1", dense(of, fill))
    width = 1
    while width * 2 <= reach:
        out = out.withColumns({f"_{k}{width * 2}": add(F.col(f"_{k}{width}"), shifted(f"_{k}{width}", width, F.lit(fill))) for k, (_, fill) in kinds.items()})
        width *= 2
    for w in windows:
        done = 0
        for b in (1 << i for i in reversed(range(w.bit_length()))):
            if w & b:
                out = out.withColumns({f"_{k}w{w}": add(F.col(f"_{k}w{w}"), shifted(f"_{k}{b}", done, F.lit(fill))) if done else F.col(f"_{k}{b}") for k, (_, fill) in kinds.items()})
                done += b
    rows = F.arrays_zip(F.sequence(F.col("_start"), F.col("last_day")).alias("_d"), *[F.col(f"_{k}w{w}") for w in windows for k in kinds])
    names = ["_d", *[f"_{k}w{w}" for w in windows for k in kinds]]
    out = out.select("_span", "first_day", *keys, F.explode(rows).alias("_row")).select("_span", "first_day", *keys, *[F.col("_row").getField(n if n != "_d" else "_d").alias(n) for n in names]).where(F.col("_d") >= F.col("first_day"))
    out = out.join(life, [k.eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)]).where(F.col("_d").between(F.col("_born"), F.col("_died")) & (F.col(f"_nw{reach}") > 0))
    cols = []
    for w in windows:
        cols += [F.col(f"_sw{w}").alias(f"sum_{w}"), F.col(f"_nw{w}").cast("long").alias(f"n_{w}"), F.when(F.col(f"_nw{w}") > 0, F.col(f"_sw{w}") / F.col(f"_nw{w}")).alias(f"avg_{w}")]
    return out.select(F.col("_span").alias(span), *keys, F.col("_d").alias(day), *cols)
