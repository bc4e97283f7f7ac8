"""Files in and out: price and fundamental series per symbol, wide panels, the universe; plain, gzip or Parquet.

Paths go through Hadoop file systems, so file:// and s3a:// work alike; reading is a scan with a
given schema, never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.columns import col, present
from gridwright.operators.panel import between, densify, long, wide
from gridwright.session import staged

PRICES = ["adj_open", "adj_high", "adj_low", "adj_close", "volume"]
FACTORS = ["pe", "ps", "pb", "roe", "net_margin", "debt_to_equity", "market_cap", "gross_margin", "receivables_turnover", "debt_to_assets", "revenue", "revenue_growth", "eps_growth", "operating_income_growth", "net_income_growth", "gross_profit_growth", "report_event"]
#: the order in which forms of one series are preferred
FORMS = (".csv.gz", ".parquet", ".csv")


def to_day(c):
    """A day given as YYYY-MM-DD, YYYYMMDD (text or number) or a date; NULL if it is none."""
    text = F.trim(c.cast("string"))
    return F.to_date(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def _files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """stem -> its file names in a folder; nothing if there is no folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[str]] = {}
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        form = next((f for f in FORMS if name.endswith(f)), None)
        if form:
            out.setdefault(name[: -len(form)], []).append(name)
    return out


def symbols_in(spark: SparkSession, folder: str) -> list[str]:
    """The stems of a folder's series files."""
    return sorted(_files(spark, folder))


def read_series(spark: SparkSession, folder: str, columns: list[str], symbols: list[str] | None = None) -> DataFrame:
    """symbol, day and ``columns`` of per-symbol files; per symbol the preferred form is read.

    A header is optional: lines whose first field is no day are skipped. Empty cells, NaN and cells that aren't numbers are NULL; of
    repeated days of a symbol the last line in the file counts. Without files the result is empty.
    """
    found = _files(spark, folder)
    chosen = {s: next(f"{s}{form}" for form in FORMS if f"{s}{form}" in names) for s, names in found.items() if symbols is None or s in symbols}
    text = [f"{folder}/{n}" for n in chosen.values() if not n.endswith(".parquet")]
    binary = [f"{folder}/{n}" for n in chosen.values() if n.endswith(".parquet")]
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"%20", " "), r"(\.csv\.gz|\.csv|\.parquet)$", "")
    parts = []
    if text:
        schema = ", ".join(["day string", *[f"`{c}` string" for c in columns]])
        raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("header", "false").csv(text)
        parts.append(raw.select(stem.alias("symbol"), to_day(F.col("day")).alias("day"), *[present(F.trim(col(c)).try_cast("double")).alias(c) for c in columns]))
    if binary:
        raw = spark.read.parquet(*binary)
        parts.append(raw.select(stem.alias("symbol"), to_day(F.col("day")).alias("day"), *[(present(col(c).cast("double")) if c in raw.columns else F.lit(None).cast("double")).alias(c) for c in columns]))
    if not parts:
        return spark.createDataFrame([], ", ".join(["symbol string", "day date", *[f"`{c}` double" for c in columns]]))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # ties keep the greatest values, so that the result doesn't depend on how files are split
    last = F.max(F.struct(*[col(c) for c in columns])).alias("_r")
    return out.where(F.col("day").isNotNull()).groupBy("symbol", "day").agg(last).select("symbol", "day", *[F.col("_r").getField(c).alias(c) for c in columns])


def write_series(df: DataFrame, folder: str, columns: list[str]) -> None:
    """One gzip CSV of a symbol's days in order per symbol partition; existing data of the folder is replaced."""
    out = df.select("symbol", "day", *[col(c) for c in columns]).repartition("symbol").sortWithinPartitions("symbol", "day")
    out.write.mode("overwrite").partitionBy("symbol").option("compression", "gzip").option("header", "true").csv(folder)


def read_partitioned(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """What ``write_series`` wrote."""
    schema = ", ".join(["day date", *[f"`{c}` double" for c in columns], "symbol string"])
    raw = spark.read.schema(schema).option("header", "true").csv(folder)
    return raw.select("symbol", "day", *[present(c).alias(c) for c in columns])


def append_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; where both have a symbol's day the new row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in ("symbol", "day")]
    return both.groupBy("symbol", "day").agg(F.max(F.struct("_new", *[col(c) for c in rest])).alias("_r")).select("symbol", "day", *[F.col("_r").getField(c).alias(c) for c in rest])


def not_yet(symbols: DataFrame, done: DataFrame) -> DataFrame:
    """The symbols a resumed run still has to fetch."""
    return symbols.join(done.select("symbol").distinct(), "symbol", "left_anti")


def write_wide(panel: DataFrame, series: str, path: str, symbols: list[str]) -> None:
    """A gzip CSV with day and a column per symbol; empty cells are missing."""
    wide(panel, series, symbols).orderBy("day").coalesce(1).write.mode("overwrite").option("compression", "gzip").option("header", "true").csv(path)


def read_wide(spark: SparkSession, path: str, series: str) -> DataFrame:
    """A wide CSV or Parquet as a panel; the header gives the symbols, in any order."""
    jvm = spark.sparkContext._jvm
    binary = path.endswith(".parquet") or any(n.getPath().getName().endswith(".parquet") for n in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jvm.org.apache.hadoop.fs.Path(path)))
    raw = spark.read.parquet(path) if binary else spark.read.option("header", "true").csv(path)
    return long(raw.select(to_day(F.col("day")).alias("day"), *[col(c).try_cast("double").alias(c) for c in raw.columns if c != "day"]), series)


#: the columns of price files by the names expressions use
OHLCV = {"open": "adj_open", "high": "adj_high", "low": "adj_low", "close": "adj_close", "volume": "volume"}


def load(spark: SparkSession, root: str, names: list[str], first: str | None = None, last: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """The dense panel of the series ``names`` of a data tree: panels/NAME (wide) if there is one, else a column of prices/ or fundamentals/ (by symbol).

    Symbols are those with a price file, or of these the ones asked for; one without a file is an error. Names that the tree doesn't hold are left out, for the
    compiler to report. ``first`` and ``last`` are days, inclusive; the slice is taken before anything is joined.
    """
    have = symbols_in(spark, f"{root}/prices")
    if symbols is not None:
        missing = sorted(set(symbols) - set(have))
        if missing or not symbols:
            raise ValueError(f"no price files: {', '.join(missing)}" if missing else "the list of symbols is empty; leave it out to take all")
    chosen = sorted(set(have if symbols is None else symbols))
    panels = _files(spark, f"{root}/panels")
    wide_ones = [n for n in dict.fromkeys(names) if n in panels]
    by_file = {"prices": {n: OHLCV[n] for n in names if n in OHLCV and n not in wide_ones}, "fundamentals": {n: n for n in names if n in FACTORS and n not in OHLCV and n not in wide_ones}}
    parts = []
    for folder, series in by_file.items():
        if series:
            raw = between(read_series(spark, f"{root}/{folder}", PRICES if folder == "prices" else FACTORS, chosen), first, last)
            parts.append(raw.select("day", "symbol", *[col(c).alias(n) for n, c in series.items()]))
    for n in wide_ones:
        form = next(f for f in FORMS if f"{n}{f}" in panels[n])
        own = between(read_wide(spark, f"{root}/panels/{n}{form}", n), first, last).select("day", "symbol", n)
        parts.append(own.where(F.col("symbol").isin(chosen)))
    if not parts:
        return spark.createDataFrame([], "day date, symbol string, ord int")
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.join(p, ["day", "symbol"], "full")
    return densify(cells)


def rebuild(spark: SparkSession, root: str) -> dict[str, int]:
    """panels/NAME for each column of the files by symbol: rows are the union of all days. Returns the days of each. Files are read once; panels are replaced."""
    out = {}
    chosen = symbols_in(spark, f"{root}/prices")
    for folder, columns in (("prices", {v: k for k, v in OHLCV.items()}), ("fundamentals", {n: n for n in FACTORS})):
        rows = staged(read_series(spark, f"{root}/{folder}", list(columns), chosen), folder)
        days = rows.select("day").distinct().count()
        for c, name in columns.items():
            write_wide(rows, c, f"{root}/panels/{name}.csv.gz", chosen)
            out[name] = days
    return out


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """symbol, sector, market_cap: one row per symbol, its greatest row; blank sectors are NULL."""
    raw = spark.read.schema("symbol string, sector string, market_cap string").option("header", "true").csv(path)
    clean = raw.select(F.upper(F.trim("symbol")).alias("symbol"), F.when(F.trim("sector") != "", F.trim("sector")).alias("sector"), F.col("market_cap").try_cast("double").alias("market_cap"))
    return clean.where(F.col("symbol") != "").groupBy("symbol").agg(F.max("sector").alias("sector"), F.max("market_cap").alias("market_cap"))


def sniff(spark: SparkSession, path: str) -> str:
    """'gzip', 'parquet' or 'csv' by a file's first bytes, whatever its name."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4).alias("h")).first()
    h = bytes(head["h"]) if head else b""
    return "gzip" if h[:2] == b"\x1f\x8b" else "parquet" if h == b"PAR1" else "csv"
