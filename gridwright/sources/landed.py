"""Landed vendor responses (JSON texts) as price rows, ratings and ratios. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col, present
from gridwright.sources.files import to_day

ROW = ["symbol", "day", "adj_open", "adj_high", "adj_low", "adj_close", "volume"]


def _number(j: Column, *names: str) -> Column:
    """The first of several names that holds a number."""
    return present(F.coalesce(*[F.get_json_object(j, f"$.{n}").try_cast("double") for n in names]))


def daily_objects(raw: DataFrame, symbol: str, body: str) -> DataFrame:
    """Arrays of daily objects. Adjusted fields are taken where given; otherwise open, high and low are scaled by adjusted close over close."""
    j = F.explode(F.from_json(col(body), "array<string>"))
    one = raw.select(col(symbol).alias("symbol"), j.alias("_j"))
    close = _number(F.col("_j"), "close", "4. close")
    adj = F.coalesce(_number(F.col("_j"), "adjClose", "adj_close", "adjusted_close"), close)
    scale = adj / F.nullif(close, F.lit(0.0))
    part = lambda given, plain: F.coalesce(_number(F.col("_j"), given), _number(F.col("_j"), plain) * scale)
    day = to_day(F.substring(F.coalesce(F.get_json_object("_j", "$.date"), F.get_json_object("_j", "$.day")), 1, 10))
    out = one.select("symbol", day.alias("day"), part("adjOpen", "open").alias("adj_open"), part("adjHigh", "high").alias("adj_high"), part("adjLow", "low").alias("adj_low"), adj.alias("adj_close"), _number(F.col("_j"), "volume", "adjVolume").alias("volume"))
    return out.where(F.col("day").isNotNull()).groupBy("symbol", "day").agg(F.max(F.struct(*ROW[2:])).alias("_r")).select("symbol", "day", "_r.*")


def column_arrays(raw: DataFrame, symbol: str, body: str) -> DataFrame:
    """Objects of parallel arrays t (seconds since 1970), o, h, l, c, v."""
    arrays = F.from_json(col(body), "t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>")
    z = raw.select(col(symbol).alias("symbol"), arrays.alias("_a")).select("symbol", F.explode(F.arrays_zip("_a.t", "_a.o", "_a.h", "_a.l", "_a.c", "_a.v")).alias("z"))
    out = z.select("symbol", F.to_date(F.timestamp_seconds("z.t")).alias("day"), *[F.col(f"z.{k}").alias(n) for k, n in zip("ohlcv", ROW[2:], strict=True)])
    return out.where(F.col("day").isNotNull()).groupBy("symbol", "day").agg(F.max(F.struct(*ROW[2:])).alias("_r")).select("symbol", "day", "_r.*")


def rating(text: Column) -> Column:
    """Ratings in words on a scale of 1 (strong sell) to 5 (strong buy); numbers pass; others are NULL. The words are fixed values."""
    t = F.lower(F.trim(text))
    words = F.when(t == "strong buy", 5.0).when(t.isin("buy", "outperform", "overweight"), 4.0).when(t.isin("hold", "neutral", "market perform"), 3.0).when(t.isin("sell", "underperform", "underweight"), 2.0).when(t == "strong sell", 1.0)
    return F.coalesce(words, t.try_cast("double"))


def consensus(strong_buy: Column, buy: Column, hold: Column, sell: Column, strong_sell: Column) -> Column:
    """The mean rating of counted votes; NULL without votes."""
    votes = [F.coalesce(c, F.lit(0)) for c in (strong_sell, sell, hold, buy, strong_buy)]
    total = sum(votes[1:], votes[0])
    points = sum((v * (i + 1) for i, v in enumerate(votes[1:], 1)), votes[0])
    return points / F.nullif(total, F.lit(0))


def market_cap(text: Column) -> Column:
    """Amounts with a suffix k, m, b or t."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9.]+)\s*([kmbt]?)$", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9.]+)\s*([kmbt]?)$", 2)
    return number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "t", 1e12).otherwise(1.0)


def ratios(f: DataFrame) -> DataFrame:
    """Fundamental ratios of reported amounts; divisions by 0 are NULL."""
    over = lambda a, b: F.try_divide(col(a), col(b))
    return f.withColumns({"roe": over("net_income", "equity"), "net_margin": over("net_income", "revenue"), "debt_to_equity": F.try_divide(F.coalesce(col("liabilities"), col("debt")), col("equity")), "gross_margin": over("gross_profit", "revenue"), "receivables_turnover": over("revenue", "receivables"), "debt_to_assets": F.try_divide(F.coalesce(col("liabilities"), col("debt")), col("assets"))})


def redacted(url: Column) -> Column:
    """A URL with its tokens hidden."""
    return F.regexp_replace(url, r"(?i)((?:api_?key|token|apikey)=)[^&\s]+", "$1***")


def screened(listing: DataFrame, kinds: list[str], floor: float) -> DataFrame:
    """Listings of the kinds asked for (any case) whose market cap is unknown or at least ``floor``."""
    return listing.where(F.upper("kind").isin([k.upper() for k in kinds])).where(F.col("market_cap").isNull() | (F.col("market_cap") >= floor))


def by_period(bodies: DataFrame, symbol: str, order: str, body: str, filed: list[str], period: str = "date") -> DataFrame:
    """symbol, period_end, visible, fell_back, fields (map of texts): statements of several responses merged by fiscal period.

    Responses are JSON arrays of objects; of one field and period the first response (by ``order``, then place) that has a value counts, so later ones only fill
    gaps, and a period in any of them is in the result. ``visible`` is the first of the ``filed`` fields that is a day, else the period's end (fell_back). Objects without a period are passed over.
    """
    one = bodies.select(col(symbol).alias("symbol"), col(order).alias("_no"), F.posexplode(F.from_json(col(body), "array<string>")).alias("_at", "_j"))
    one = one.withColumn("_m", F.from_json("_j", "map<string,string>")).withColumn("period_end", to_day(F.substring(F.try_element_at("_m", F.lit(period)), 1, 10)))
    cells = one.where(F.col("period_end").isNotNull()).select("symbol", "period_end", "_no", "_at", F.explode("_m").alias("_k", "_v")).where(F.col("_v").isNotNull())
    first = cells.groupBy("symbol", "period_end", "_k").agg(F.min_by("_v", F.struct("_no", "_at")).alias("_v"))
    out = first.groupBy("symbol", "period_end").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("fields"))
    day = F.coalesce(*[to_day(F.substring(F.try_element_at("fields", F.lit(f)), 1, 10)) for f in filed], F.lit(None).cast("date"))
    return out.select("symbol", "period_end", F.coalesce(day, F.col("period_end")).alias("visible"), day.isNull().alias("fell_back"), "fields")


def named(statements: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """``by_period``'s rows with a double per name: the first of its aliases that holds a number."""
    value = lambda names: present(F.coalesce(*[F.try_element_at("fields", F.lit(n)).try_cast("double") for n in names]))
    return statements.select(*[c for c in statements.columns if c != "fields"], *[value(names).alias(n) for n, names in fields.items()])


def yoy(now: Column, before: Column) -> Column:
    """Growth over the period before; NULL unless both are finite and the earlier one isn't 0."""
    ok = (F.abs(now) < float("inf")) & (F.abs(before) < float("inf")) & (before != 0)
    return F.when(ok, now / F.nullif(before, F.lit(0.0)) - 1.0)


def growths(statements: DataFrame, names: list[str]) -> DataFrame:
    """With a column ``{name}_growth`` each: growth over the symbol's period a year before (10 to 14 months), NULL where there is none."""
    w = Window.partitionBy("symbol").orderBy("period_end")
    near = F.months_between("period_end", F.lag("period_end").over(w)).between(10, 14)
    return statements.withColumns({f"{n}_growth": F.when(near, yoy(col(n), F.lag(col(n)).over(w))) for n in names})


def ticker(raw: Column, exchange: str = "US") -> Column:
    """A struct (symbol, code): ``AAPL`` and ``aapl.us`` are AAPL and AAPL.US. The last point parts the exchange; NULL if a part is blank."""
    s = F.trim(raw)
    dotted = s.contains(".")
    name = F.upper(F.trim(F.when(dotted, F.regexp_replace(s, r"\.[^.]*$", "")).otherwise(s)))
    place = F.upper(F.trim(F.when(dotted, F.element_at(F.split(s, r"\."), -1)).otherwise(F.lit(exchange))))
    return F.when((name != "") & (place != ""), F.struct(name.alias("symbol"), F.concat(name, F.lit("."), place).alias("code")))


def symbols_list(text: Column, exchange: str = "US") -> Column:
    """The symbols of a list, parted by commas, blanks and line ends; # starts a comment. The first of equal ones stays, in order."""
    bare = F.regexp_replace(text, r"#[^\n]*", " ")
    found = F.transform(F.split(bare, r"[,\s]+"), lambda x: ticker(x, exchange)["symbol"])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def concept(name: Column) -> Column:
    """The tail of a qualified reporting concept in lower case: us-gaap_Assets and us-gaap:Assets are assets."""
    return F.lower(F.element_at(F.split(name, "[_:]"), -1))


def statement(items: Column) -> Column:
    """A JSON array of {concept, value} as a map from concept tails to numbers; the first of equal tails with a number counts."""
    rows = F.transform(F.from_json(items, "array<struct<concept:string,value:string>>"), lambda x: F.struct(concept(x["concept"]).alias("key"), x["value"].try_cast("double").alias("value")))
    sound = F.filter(rows, lambda x: x["key"].isNotNull() & x["value"].isNotNull())
    names = F.array_distinct(F.transform(sound, lambda x: x["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(F.filter(sound, lambda x: x["key"] == k), F.lit(0))["value"]))
