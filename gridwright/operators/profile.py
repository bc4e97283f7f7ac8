"""Column-level data-quality profiles per group and load.

Counts, ranges, violations and power sums are merged before the shuffle, one row per group, load, column and *limb*. A limb holds
the values of eight neighbouring binary exponents as whole numbers of one unit, so the sums of values and of their
squares are sums of whole numbers: exact for every finite double, merged by adding, and "all other loads" is the total less the own
sums. They give means, deviations and the standardised differences between loads, which settle plain shifts. Where a median
lies among the quartiles of other loads is told by histograms; only the few cells that these leave open are
selected from the values themselves (``selected``), so no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.session import staged

KEYS = ["group", "load", "column_name"]
WHOLE = ["group", "column_name"]
SALTS = 16
_HALF = 30  # bits of the lower half of a whole number
_SUMS = ["h", "l", "hh", "hl", "ll"]


def _number(c: str) -> str:
    """SQL for a column as a double, NaN as NULL."""
    c = "`" + c.replace("`", "``") + "`"
    return f"CASE WHEN NOT isnan(CAST({c} AS double)) THEN CAST({c} AS double) END"


def _text(c: str) -> str:
    return "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cells(df: DataFrame, group: str, load: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """group, load, column_name, num, txt: one row per row and column; missing (NULL, NaN) has num and txt NULL."""
    made = [f"named_struct('column_name', {_text(c)}, 'num', {_number(c)}, 'txt', CAST(NULL AS string))" for c in numbers]
    made += ["named_struct('column_name', {}, 'num', CAST(NULL AS double), 'txt', CAST(`{}` AS string))".format(_text(c), c.replace("`", "``")) for c in texts]
    return df.select(col(group).alias("group"), col(load).alias("load"), F.expr(f"inline(array({', '.join(made)}))"))


def distincts(values: DataFrame) -> DataFrame:
    """group, load, column_name, n_distinct: how many different values there are, missing ones left out."""
    there = F.col("num").isNotNull() | F.col("txt").isNotNull()
    return values.groupBy(*KEYS, "num", "txt").agg(F.lit(1).alias("_one")).groupBy(*KEYS).agg(F.count(F.when(there, 1)).alias("n_distinct"))


def _scaled(x: Column, bits: Column) -> Column:
    """x * 2**bits, exactly, in two steps as one may leave the doubles."""
    half = F.floor(bits / 2)
    return x * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (bits - half).cast("double"))


def described(values: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per group, load and column: rows, missing, least and greatest value, violations, moments.

    ``specs`` (column_name, low, high, pattern; NULL bounds and patterns forbid nothing)
    has a row per column and is joined as a dimension. Values of any finite size, however large or small, count in
    ``mean``, ``deviation``, ``std_diff``, and in the exact power sums behind them (p0, p1, p2 are those as doubles); infinities count in n_infinite alone.
    Standardised difference ``std_diff`` is the mean's distance from that of the group's other loads in pooled deviations; NULL where undefined.
    other_n, other_mean, other_deviation are of all other loads. NULL groups and loads are groups and loads of their own.
    """
    s = specs.groupBy("column_name").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("pattern").alias("pattern"))
    finite = F.abs("num") < float("inf")
    size = F.when(finite & (F.col("num") != 0), F.abs("num"))
    # one bit to spare: a logarithm may round up
    unit = F.coalesce((F.floor((F.floor(F.log2(size)) - 1) / 8) * 8 - 52).cast("int"), F.when(finite, -1140), F.lit(9999))
    c = values.withColumn("_unit", unit).withColumn("_m", F.when(size.isNotNull(), _scaled(F.col("num"), -F.col("_unit")).cast("long")).when(finite, F.lit(0).cast("long")))
    c = c.withColumns({"_h": F.shiftright("_m", _HALF), "_l": F.col("_m").bitwiseAND(F.lit((1 << _HALF) - 1))})
    there = F.col("num").isNotNull() | F.col("txt").isNotNull()
    c = c.join(s, "column_name", "left")
    counts = {
        "n_rows": F.lit(1),
        "n_missing": F.when(~there, 1),
        "n_out_of_range": F.when((F.col("num") < F.col("low")) | (F.col("num") > F.col("high")), 1),
        "n_off_pattern": F.when(~F.regexp("txt", F.concat(F.lit("^(?:"), F.regexp_replace("pattern", r"^\^|\$$", ""), F.lit(r")\z"))), 1),
        "n": F.col("_m"),
    }
    # within a task sums of halves of at most 31 bits are longs, which no task has the rows to overflow; decimals add up the tasks
    products = {"h": "_h", "l": "_l", "hh": "_h * _h", "hl": "_h * _l", "ll": "_l * _l"}
    halves = [F.expr(f"sum({x})").alias(f"_{n}0") for n, x in products.items() if len(n) == 1]
    halves += [F.expr(e).alias(f"_{n}{k}") for n, x in products.items() if len(n) == 2 for k, e in ((0, f"sum(({x}) & 2147483647)"), (1, f"sum(shiftright({x}, 31))"))]
    ends = [F.min("num").alias("least"), F.max("num").alias("greatest")]
    c = c.withColumn("_task", F.spark_partition_id()).groupBy(*KEYS, "_unit", "_task").agg(*[F.count(v).alias(n) for n, v in counts.items()], *ends, *halves)
    whole = lambda n: F.sum(F.col(n).cast("decimal(20,0)"))
    total = lambda n: whole(f"_{n}0") if len(n) == 1 else (whole(f"_{n}1") * F.lit(1 << 31).cast("decimal(11,0)") + whole(f"_{n}0")).cast("decimal(38,0)")
    limbs = c.groupBy(*KEYS, "_unit").agg(*[F.sum(n).alias(n) for n in counts], F.min("least").alias("least"), F.max("greatest").alias("greatest"), *[total(n).alias(n) for n in products])
    limbs = staged(limbs, "limbs")  # read three times
    own = limbs.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in ("n_rows", "n_missing", "n_out_of_range", "n_off_pattern")], F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    # each load beside the limbs of all loads of its group and column, at most 260
    total = limbs.where(F.col("n") > 0).groupBy(*WHOLE, "_unit").agg(*[F.sum(x).alias(f"_t_{x}") for x in ["n", *_SUMS]])
    beside = own.select(*KEYS).join(_renamed(total, WHOLE), _same(WHOLE)).drop(*["_r_" + k for k in WHOLE])
    beside = beside.join(_renamed(limbs.select(*KEYS, "_unit", "n", *_SUMS), [*KEYS, "_unit"]), _same([*KEYS, "_unit"]), "left")
    zero = F.lit(0).cast("decimal(38,0)")
    sums = beside.select(*KEYS, F.col("_unit").alias("unit"), F.coalesce("n", F.lit(0)).alias("a_n"), *[F.coalesce(F.col(x).cast("decimal(38,0)"), zero).alias(f"a_{x}") for x in _SUMS], F.col("_t_n").alias("b_n"), *[F.col(f"_t_{x}").cast("decimal(38,0)").alias(f"b_{x}") for x in _SUMS])
    sums = sums.withColumns({f"b_{x}": F.col(f"b_{x}") - F.col(f"a_{x}") for x in ["n", *_SUMS]})
    moments = _limb(_limb(sums, "a"), "b")
    powers = [F.coalesce(F.sum(_power(k)), F.lit(0.0)).alias(f"p{k}") for k in (1, 2)]
    moments = moments.groupBy(*KEYS).agg(*[F.collect_list(f"{p}_m").alias(f"_{p}") for p in "ab"], *powers)
    out = own.join(_renamed(moments, KEYS), _same(KEYS), "left").drop(*["_r_" + k for k in KEYS])
    out = out.withColumns({"_a": _merged("_a"), "_b": _merged("_b")})
    pooled = F.hypot("_a.dev", "_b.dev") / F.sqrt(F.lit(2.0))
    mean, dev = (lambda m: F.when(F.col(f"{m}.n") > 0, F.col(f"{m}.mean"))), (lambda m: F.when(F.col(f"{m}.n") > 0, F.col(f"{m}.dev")))
    return out.select(
        *KEYS, "n_rows", "n_missing", "n_out_of_range", "n_off_pattern", "least", "greatest",
        (F.col("n_rows") - F.col("n_missing") - F.col("_a.n").cast("long")).alias("n_infinite"),
        F.col("_a.n").cast("long").alias("p0"), F.coalesce("p1", F.lit(0.0)).alias("p1"), F.coalesce("p2", F.lit(0.0)).alias("p2"), mean("_a").alias("mean"), dev("_a").alias("deviation"),
        F.col("_b.n").cast("long").alias("other_n"), mean("_b").alias("other_mean"), dev("_b").alias("other_deviation"),
        ((mean("_a") - mean("_b")) / F.nullif(pooled, F.lit(0.0))).alias("std_diff"),
    )


def _renamed(t: DataFrame, keys: list[str]) -> DataFrame:
    """``t`` with its keys under other names, for a join that takes NULL for a key."""
    return t.select(*[F.col(k).alias("_r_" + k) for k in keys], *[c for c in t.columns if c not in keys])


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys]


def _power(k: int) -> Column:
    """A load's part of a limb: its sum of values (k 1) or of squares (k 2) as a double."""
    d, u = (lambda name: F.col(f"a_{name}").cast("double")), F.col("unit")
    if k == 1:
        return _scaled(d("h") * float(1 << _HALF) + d("l"), u)
    return _scaled(_scaled(d("hh") * float(1 << 2 * _HALF) + d("hl") * float(1 << _HALF + 1) + d("ll"), u), u)


def _limb(df: DataFrame, p: str) -> DataFrame:
    """``df`` with ``{p}_m``: count, mean and deviation of a limb's values from its exact sums, NULL if it has none.

    They are taken around a whole number near the mean, so close values don't cancel.
    """
    big = lambda v: v.cast("decimal(38,0)")
    of = {x: F.col(f"{p}_{x}") for x in _SUMS}
    n, real = F.col("_n").cast("decimal(20,0)"), F.col("_n").cast("double")
    df = df.withColumn("_n", F.when(F.col(f"{p}_n") > 0, F.col(f"{p}_n"))).withColumn("_first", big(of["h"] * F.lit(1 << _HALF).cast("decimal(11,0)") + of["l"]))
    df = df.withColumn("_c", (F.col("_first").cast("double") / real).cast("long"))
    df = df.withColumns({"_ch": F.shiftright("_c", _HALF).cast("decimal(20,0)"), "_cl": F.col("_c").bitwiseAND(F.lit((1 << _HALF) - 1)).cast("decimal(20,0)")})
    ch, cl = F.col("_ch"), F.col("_cl")
    df = df.withColumns({
        "_off": (F.col("_first") - big(n * F.col("_c").cast("decimal(20,0)"))).cast("double") / real,
        "_s1": big(of["hh"] - big(ch * of["h"]) * 2 + big(big(ch * ch) * n)),
        "_s2": big(of["hl"] - big(ch * of["l"]) - big(cl * of["h"]) + big(big(ch * cl) * n)),
        "_s3": big(of["ll"] - big(cl * of["l"]) * 2 + big(big(cl * cl) * n)),
    })
    exact = big(big(F.when(F.abs("_s1") < 1e15, F.col("_s1")) * F.lit(1 << 2 * _HALF).cast("decimal(20,0)")) + big(F.when(F.abs("_s2") < 1e27, F.col("_s2")) * F.lit(1 << _HALF + 1).cast("decimal(11,0)")) + F.col("_s3"))
    rough = F.col("_s1").cast("double") * float(1 << 2 * _HALF) + F.col("_s2").cast("double") * float(1 << _HALF + 1) + F.col("_s3").cast("double")
    df = df.withColumn("_var", F.coalesce(exact.cast("double"), rough) / real - F.col("_off") * F.col("_off"))
    made = F.struct(real.alias("n"), _scaled(F.col("_c").cast("double") + F.col("_off"), F.col("unit")).alias("mean"), _scaled(F.sqrt(F.greatest("_var", F.lit(0.0))), F.col("unit")).alias("dev"))
    return df.withColumn(f"{p}_m", F.when(F.col("_n").isNotNull(), made))


def _merged(moments: str) -> Column:
    """Count, mean and deviation of all limbs together."""
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("dev"))

    def both(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        dev = F.hypot(F.hypot(a["dev"] * F.sqrt(a["n"] / n), b["dev"] * F.sqrt(b["n"] / n)), apart * (F.sqrt(a["n"] * b["n"]) / n))
        return F.struct(n.alias("n"), (a["mean"] + apart * (b["n"] / n)).alias("mean"), dev.alias("dev"))

    return F.aggregate(F.coalesce(moments, F.array().cast("array<struct<n:double,mean:double,dev:double>>")), none, lambda acc, x: F.when(acc["n"] == 0, x).otherwise(both(acc, x)))


def surely_shifted() -> Column:
    """Over the columns of ``described``: whether mean and deviation alone put the median outside the quartiles of the other loads.

    A median lies within one deviation of its mean; a value that at least a share p of the values reach or pass lies no farther
    than sqrt((1 - p) / p) deviations beyond the mean (Cantelli).
    """
    n = F.nullif("other_n", F.lit(0))
    share = F.lit(0.25) * (n - 1) / n
    reach = F.sqrt((1 - share) / F.nullif(share, F.lit(0.0))) * F.col("other_deviation") + F.col("deviation")
    slack = 1e-9 * (F.abs("mean") + F.abs("other_mean") + F.col("deviation") + F.col("other_deviation"))
    return F.coalesce((n > 1) & (F.abs(F.col("mean") - F.col("other_mean")) > reach + slack) & (F.col("n_infinite") == 0), F.lit(False))


def _bin(v: str) -> str:
    """SQL for a whole number that doesn't fall as v rises: 8 bins an octave on either side of 0."""
    return f"CAST(signum({v}) * floor(log2(1D + least(abs({v}), 1e300D) * 1048576D) * 8) AS bigint)"


def histogram(values: DataFrame) -> DataFrame:
    """group, load, column_name, _bin, _own: how many values lie in each bin."""
    return values.where(F.col("num").isNotNull()).groupBy(*KEYS, F.expr(_bin("num")).alias("_bin")).agg(F.count(F.lit(1)).alias("_own"))


def placed(bins: DataFrame) -> DataFrame:
    """group, load, column_name, n, shift: whether a load's median lies outside the quartiles of the group's other loads; NULL where bins leave it open.

    The bins of the two middle values and the numbers of other loads' values below and up to them decide it where
    no quartile lies in those bins. A cell without other values has no shift.
    """
    own = Window.partitionBy(*KEYS).orderBy("_bin")
    whole = Window.partitionBy(*WHOLE)  # a group's bins, whose number the rows don't change
    rising = whole.orderBy("_bin")
    t = bins.withColumns({"_upto": F.sum("_own").over(rising.rangeBetween(Window.unboundedPreceding, 0)), "_under": F.coalesce(F.sum("_own").over(rising.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_own").over(whole)})
    t = t.withColumns({"_cum": F.sum("_own").over(own), "n": F.sum("_own").over(Window.partitionBy(*KEYS))})
    holds = lambda r: (F.col("_cum") - F.col("_own") <= r) & (r < F.col("_cum"))
    low, high = holds(F.floor((F.col("n") - 1) / 2)), holds(F.ceil((F.col("n") - 1) / 2))
    t = t.groupBy(*KEYS).agg(
        F.max("n").alias("n"), F.max("_total").alias("_total"),
        F.max(F.when(low, F.col("_under") - (F.col("_cum") - F.col("_own")))).alias("_less"),
        F.max(F.when(high, F.col("_upto") - F.col("_cum"))).alias("_most"),
    )
    last = F.col("_total") - F.col("n") - 1
    q1, q3 = last * 0.25, last * 0.75
    below, above = F.col("_most") <= F.floor(q1), F.col("_less") > F.ceil(q3)
    inside = (F.col("_less") > F.ceil(q1)) & (F.col("_most") <= F.floor(q3))
    return t.select(*KEYS, "n", F.when(last < 0, False).when(below | above, True).when(inside, False).alias("shift"))


def selected(df: DataFrame, group: str, load: str, numbers: list[str], bins: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """group, load, column_name, n, median, q25, q75: the load's own median, and the quartiles of all other loads of its group.

    Exact, with linear interpolation; NULL where a set is empty. ``bins`` (``histogram``) tells in which bin each wanted order statistic
    lies; only those bins' values are taken from the rows and ordered. ``only`` (KEYS) restricts the cells for which they are wanted.
    """
    if only is not None:  # the bins of other groups and columns matter to none of them
        bins = bins.join(_renamed(only.select(*WHOLE).distinct(), WHOLE), _same(WHOLE), "left_semi")
    own, total = bins, bins.groupBy(*WHOLE, "_bin").agg(F.sum("_own").alias("_all"))
    loads = own.groupBy(*KEYS).agg(F.sum("_own").alias("n"))
    sizes = loads.withColumn("_others", F.sum("n").over(Window.partitionBy(*WHOLE)) - F.col("n"))
    if only is not None:
        sizes = sizes.join(_renamed(only.select(*KEYS), KEYS), _same(KEYS), "left_semi")
    # the bins of a group and column, beside each of its loads: summaries, whose number the rows don't change
    table = sizes.join(_renamed(total, WHOLE), _same(WHOLE)).drop(*["_r_" + k for k in WHOLE])
    table = table.join(_renamed(own, [*KEYS, "_bin"]), _same([*KEYS, "_bin"]), "left").drop(*["_r_" + k for k in [*KEYS, "_bin"]]).withColumn("_own", F.coalesce("_own", F.lit(0)))
    upto = Window.partitionBy(*KEYS).orderBy("_bin")
    table = table.withColumns({"_c_own": F.sum("_own").over(upto), "_c_oth": F.sum(F.col("_all") - F.col("_own")).over(upto)})

    def wanted(name: str, q: float, size: str, cum: str, here: Column, others: bool) -> list[Column]:
        at = (F.col(size) - 1) * F.lit(q)
        ranks = [F.floor(at), F.ceil(at)]
        return [F.struct(F.lit(f"{name}{i}").alias("what"), F.lit(others).alias("others"), (r - (F.col(cum) - here)).alias("rank"), ((F.col(size) > 0) & (r >= F.col(cum) - here) & (r < F.col(cum))).alias("hit"), (at - F.floor(at)).alias("part")) for i, r in enumerate(ranks)]

    other_here = F.col("_all") - F.col("_own")
    want = [*wanted("median", 0.5, "n", "_c_own", F.col("_own"), False), *wanted("q25", 0.25, "_others", "_c_oth", other_here, True), *wanted("q75", 0.75, "_others", "_c_oth", other_here, True)]
    targets = table.select(*KEYS, "_bin", F.inline(F.array(*want))).where("hit")
    # the bins wanted of each column, one row a group, copied to the salts over which its rows are spread
    sought = targets.groupBy("group").agg(*[F.expr(f"collect_set(CASE WHEN column_name = {_text(c)} THEN _bin END)").alias(f"_w{i}") for i, c in enumerate(numbers)])
    sought = sought.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("group", "_g")
    rows = df.select(col(group).alias("group"), col(load).alias("load"), *[F.expr(_number(c)).alias(f"_v{i}") for i, c in enumerate(numbers)])
    # any salt is right, as what is sought is at all of them; a partition's number is known to no other expression, so no constraints are inferred from it
    rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    rows = rows.join(sought, F.col("group").eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_s")))
    found = [f"CASE WHEN array_contains(_w{i}, {_bin(f'_v{i}')}) THEN named_struct('column_name', {_text(c)}, '_bin', {_bin(f'_v{i}')}, 'num', _v{i}) END" for i, c in enumerate(numbers)]
    v = rows.selectExpr("group", "load", f"inline(array_compact(array({', '.join(found)})))").groupBy(*KEYS, "_bin", "num").agg(F.count(F.lit(1)).alias("n"))
    cand = v.select(F.col("group").alias("_r_group"), F.col("column_name").alias("_r_column_name"), F.col("_bin").alias("_r__bin"), F.col("load").alias("_load"), "num", "n")
    met = targets.join(cand, _same([*WHOLE, "_bin"])).where(F.col("others") == ~F.col("load").eqNullSafe(F.col("_load")))
    met = met.groupBy(*KEYS, "what", "rank", "part", "num").agg(F.sum("n").alias("n"))
    met = met.withColumn("_c", F.sum("n").over(Window.partitionBy(*KEYS, "what").orderBy("num")))
    hit = met.where((F.col("_c") > F.col("rank")) & (F.col("_c") - F.col("n") <= F.col("rank")))
    pick = lambda w: F.max(F.when(F.col("what") == w, F.col("num")))
    part = lambda w: F.max(F.when(F.col("what") == w, F.col("part")))
    between = lambda a, b, p: F.when(a == b, a).otherwise(a + (b - a) * p)  # noqa: E731 - infinities have no difference
    value = lambda w: between(pick(f"{w}0"), pick(f"{w}1"), part(f"{w}0")).alias(w)
    out = _renamed(hit.groupBy(*KEYS).agg(value("median"), value("q25"), value("q75")), KEYS)
    return sizes.drop("_others").join(out, _same(KEYS), "left").drop(*["_r_" + k for k in KEYS])
