"""The queries of the general training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import both_from, micros, packed, present, tidy, unpacked
from gridwright.operators import drift, history, known_at, profile, spikes
from gridwright.operators.series import counting, on_grid, trailing_totals
from gridwright.session import staged, table

BARS = ["symbol", "exchange", "day"]


# 1 ---------------------------------------------------------------------------------------------------------------


def _picks_known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    picks = table(spark, d, "picks").select("pick_id", F.upper(F.trim("index_name")).alias("index_name"), tidy("symbol").alias("symbol"), "picked_at")
    snaps = table(spark, d, "symbol_snapshots").withColumn("symbol", tidy("symbol"))
    due = known_at.due_intervals(snaps.where(F.col("symbol").isNotNull()), ["symbol"], both_from(micros(unpacked("report_asof")), micros("loaded_at")), [F.col("report_asof"), F.col("loaded_at")], ["snapshot_id"])
    snapshot = known_at.known_at(picks, "pick_id", micros("picked_at"), {"symbol": F.col("symbol")}, staged(due, "due"), ["snapshot_id"])
    log = table(spark, d, "index_changes")
    change = lambda who, held: log.select("change_id", F.upper(F.trim("index_name")).alias("index_name"), tidy(who).alias("symbol"), "change_date", "recorded_at", F.lit(held).alias("is_member"))
    changes = change("removed", 0).unionByName(change("added", 1)).where(F.col("symbol").isNotNull() & F.col("index_name").isNotNull())
    held = known_at.due_intervals(changes, ["symbol", "index_name"], both_from(micros(unpacked("change_date")), micros("recorded_at")), [F.col("change_date"), F.col("recorded_at"), F.col("change_id")], ["is_member"])
    member = known_at.known_at(picks, "pick_id", micros("picked_at"), {"symbol": F.col("symbol"), "index_name": F.col("index_name")}, staged(held, "held"), ["is_member"])
    return snapshot, member


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    snapshot, member = _picks_known(spark, d)
    return snapshot.join(member, "pick_id", "left").select("pick_id", "snapshot_id", F.coalesce("is_member", F.lit(0)).cast("int").alias("is_member"))


P1_SQL = """
WITH p AS (SELECT DISTINCT pick_id, upper(trim(index_name)) AS index_name, upper(trim(symbol)) AS symbol, picked_at, cast(strftime(picked_at, '%Y%m%d') AS int) AS d FROM picks WHERE picked_at IS NOT NULL),
s AS (SELECT p.pick_id, x.snapshot_id, row_number() OVER (PARTITION BY p.pick_id ORDER BY x.report_asof DESC, x.loaded_at DESC, x.snapshot_id DESC) AS rn
 FROM p JOIN symbol_snapshots x ON upper(trim(x.symbol)) = p.symbol AND x.report_asof <> 0 AND x.report_asof <= p.d AND x.loaded_at <= p.picked_at),
c AS (SELECT change_id, upper(trim(index_name)) AS index_name, upper(trim(added)) AS symbol, change_date, recorded_at, 1 AS held FROM index_changes UNION ALL
 SELECT change_id, upper(trim(index_name)), upper(trim(removed)), change_date, recorded_at, 0 FROM index_changes),
m AS (SELECT p.pick_id, c.held, row_number() OVER (PARTITION BY p.pick_id ORDER BY c.change_date DESC, c.recorded_at DESC, c.change_id DESC, c.held DESC) AS rn
 FROM p JOIN c ON c.symbol = p.symbol AND c.index_name = p.index_name AND c.change_date <> 0 AND c.change_date <= p.d AND c.recorded_at <= p.picked_at)
SELECT s.pick_id, s.snapshot_id, cast(coalesce(m.held, 0) AS int) AS is_member FROM s LEFT JOIN m ON m.pick_id = s.pick_id AND m.rn = 1 WHERE s.rn = 1
"""


# 2 ---------------------------------------------------------------------------------------------------------------


def _member_store(spark: SparkSession, d: str) -> history.Store:
    lists = table(spark, d, "index_snapshots")
    members = F.transform("members", lambda x: F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")))
    full = history.full_versions(lists, "index_name", "snapshot_date", F.filter(members, lambda x: x != ""), ["loaded_at", "delivery_id"])
    return history.encode(staged(full, "versions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    held = history.validity(_member_store(spark, d))
    return held.select(F.col("entity").alias("index_name"), F.col("attribute").alias("symbol"), "valid_from", "valid_to")


P2_SQL = """
WITH l AS (SELECT * FROM (SELECT index_name, snapshot_date, list_distinct(list_filter(list_transform(members, lambda x: upper(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS members,
  row_number() OVER (PARTITION BY index_name, snapshot_date ORDER BY loaded_at DESC, delivery_id DESC) AS rn
 FROM index_snapshots WHERE snapshot_date IS NOT NULL AND len(list_filter(members, lambda x: x IS NOT NULL AND trim(x) <> '')) > 0) WHERE rn = 1),
n AS (SELECT index_name, snapshot_date, members, row_number() OVER (PARTITION BY index_name ORDER BY snapshot_date) AS ord, lead(snapshot_date) OVER (PARTITION BY index_name ORDER BY snapshot_date) AS next_date FROM l),
e AS (SELECT index_name, snapshot_date, ord, next_date, unnest(members) AS symbol FROM n),
g AS (SELECT *, ord - row_number() OVER (PARTITION BY index_name, symbol ORDER BY ord) AS run FROM e)
SELECT index_name, symbol, cast(min(snapshot_date) AS int) AS valid_from, cast(coalesce(arg_max(next_date, ord), max(CASE WHEN next_date IS NULL THEN 99991231 END)) AS int) AS valid_to
FROM (SELECT * REPLACE (coalesce(next_date, 99991231) AS next_date) FROM g) GROUP BY index_name, symbol, run
"""


# 4 ---------------------------------------------------------------------------------------------------------------


def closes(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "prices").select(*BARS, "loaded_at", "bar_id", "adj_close")
    return counting(bars, BARS, ["loaded_at", "bar_id"], {"adj_close": present("adj_close")})


def _close_grid(spark: SparkSession, d: str) -> DataFrame:
    return on_grid(closes(spark, d), ["symbol", "exchange"], "day", "adj_close", table(spark, d, "trading_days").select("day"))


def _pe_grid(spark: SparkSession, d: str) -> DataFrame:
    pe = table(spark, d, "fundamentals").select("symbol", "day", present("pe").alias("pe")).where(F.col("pe").isNotNull() & F.col("day").isNotNull())
    # the last reading of a month stands for it
    monthly = pe.groupBy("symbol", F.trunc("day", "month").alias("month")).agg(F.max(F.struct("day", "pe")).alias("_b")).select("symbol", "month", "_b.pe")
    return on_grid(monthly, ["symbol"], "month", "pe", step="1 month", max_gap=3)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    close = _close_grid(spark, d).where(F.col("status") != "observed").select(F.lit("adj_close").alias("metric"), "symbol", "exchange", packed("day").alias("period"))
    pe = _pe_grid(spark, d).where(F.col("status") != "observed").select(F.lit("pe").alias("metric"), "symbol", F.lit("").alias("exchange"), (F.year("month") * 100 + F.month("month")).cast("int").alias("period"))
    return close.unionByName(pe)


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    close = _close_grid(spark, d).select(F.lit("adj_close").alias("metric"), "symbol", "exchange", packed("day").alias("period"), F.col("adj_close").alias("value"), "status")
    pe = _pe_grid(spark, d).select(F.lit("pe").alias("metric"), "symbol", F.lit("").alias("exchange"), (F.year("month") * 100 + F.month("month")).cast("int").alias("period"), F.col("pe").alias("value"), "status")
    return close.unionByName(pe)


BARS_SQL = """
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, exchange, day ORDER BY loaded_at DESC, bar_id DESC) AS rn FROM prices) WHERE rn = 1),
c AS (SELECT symbol, exchange, cast(day AS date) AS day, adj_close AS v FROM b WHERE adj_close IS NOT NULL AND NOT isnan(adj_close))
"""
P4_CELLS_SQL = f"""
WITH {BARS_SQL},
s AS (SELECT symbol, exchange, min(day) AS f, max(day) AS l FROM c GROUP BY ALL),
g AS (SELECT s.symbol, s.exchange, cast(t.day AS date) AS day FROM s JOIN (SELECT DISTINCT day FROM trading_days) t ON t.day BETWEEN s.f AND s.l),
e AS (SELECT symbol, date_trunc('month', cast(day AS date)) AS m, arg_max(pe, (cast(day AS date), pe)) AS v FROM fundamentals WHERE pe IS NOT NULL AND NOT isnan(pe) AND day IS NOT NULL GROUP BY ALL),
r AS (SELECT symbol, min(m) AS f, max(m) AS l FROM e GROUP BY ALL),
h AS (SELECT symbol, unnest(generate_series(cast(f AS timestamp), cast(l AS timestamp), INTERVAL 1 MONTH)) AS m FROM r)
"""
P4_SQL = P4_CELLS_SQL + """
SELECT 'adj_close' AS metric, symbol, exchange, cast(strftime(day, '%Y%m%d') AS int) AS period FROM g ANTI JOIN c USING (symbol, exchange, day) UNION ALL
SELECT 'pe', symbol, '', cast(strftime(m, '%Y%m') AS int) FROM h ANTI JOIN (SELECT symbol, cast(m AS timestamp) AS m FROM e) USING (symbol, m)
"""


P4_GRID_SQL = P4_CELLS_SQL + """,
u AS (SELECT symbol, exchange, day, 1 AS g, v FROM g LEFT JOIN c USING (symbol, exchange, day) UNION ALL SELECT symbol, exchange, day, 0, v FROM c ANTI JOIN g USING (symbol, exchange, day)
 UNION ALL SELECT symbol, NULL, cast(m AS date), 1, v FROM h LEFT JOIN (SELECT symbol, cast(m AS timestamp) AS m, v FROM e) USING (symbol, m)),
n AS (SELECT *, sum(g) OVER (PARTITION BY symbol, exchange ORDER BY day ROWS UNBOUNDED PRECEDING) AS no FROM u),
z AS (SELECT *, no - last_value(CASE WHEN v IS NOT NULL THEN no END IGNORE NULLS) OVER w AS age, last_value(v IGNORE NULLS) OVER w AS lv, CASE WHEN exchange IS NULL THEN 3 ELSE 5 END AS gap FROM n WINDOW w AS (PARTITION BY symbol, exchange ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT CASE WHEN exchange IS NULL THEN 'pe' ELSE 'adj_close' END AS metric, symbol, coalesce(exchange, '') AS exchange, cast(CASE WHEN exchange IS NULL THEN strftime(day, '%Y%m') ELSE strftime(day, '%Y%m%d') END AS int) AS period,
 CASE WHEN age <= gap THEN lv END AS value, CASE WHEN v IS NOT NULL THEN 'observed' WHEN age <= gap THEN 'carried' ELSE 'missing' END AS status FROM z WHERE g = 1
"""


# 6 ---------------------------------------------------------------------------------------------------------------


def _run_averages(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "walkforward_params").select("run_id", unpacked("from_day").alias("first_day"), unpacked("to_day").alias("last_day"), F.coalesce("warmup_days", F.lit(30)).alias("_w")).distinct()
    runs = runs.select("run_id", "first_day", "last_day", F.expr("date_sub(first_day, _w)").alias("earliest"))
    return trailing_totals(closes(spark, d), ["symbol", "exchange"], "day", "adj_close", runs, "run_id", [7, 30])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    off = F.abs(F.col("avg_7") - F.col("avg_30")) > 0.1 * F.abs("avg_30")
    silent = (F.col("n_7") == 0) & (F.col("n_30") > 0)
    return _run_averages(spark, d).where(off | silent).select("run_id", "symbol", "exchange", packed("day").alias("day"))


def p6_averages(spark: SparkSession, d: str) -> DataFrame:
    return _run_averages(spark, d).select("run_id", "symbol", "exchange", packed("day").alias("day"), "n_7", "n_30", F.round("sum_7", 4).alias("sum_7"), F.round("sum_30", 4).alias("sum_30"))


P6_AVG_SQL = f"""
WITH {BARS_SQL},
s AS (SELECT symbol, exchange, min(day) AS f, max(day) AS l FROM c GROUP BY ALL),
r AS (SELECT DISTINCT run_id, cast(strptime(cast(from_day AS varchar), '%Y%m%d') AS date) AS f, cast(strptime(cast(to_day AS varchar), '%Y%m%d') AS date) AS t, coalesce(warmup_days, 30) AS w FROM walkforward_params),
k AS (SELECT run_id, f, t, w, cast(unnest(generate_series(cast(f AS timestamp), cast(t AS timestamp), INTERVAL 1 DAY)) AS date) AS day FROM r),
g AS (SELECT k.run_id, s.symbol, s.exchange, k.day, k.f - cast(k.w AS int) AS earliest FROM s JOIN k ON k.day BETWEEN s.f AND s.l),
a AS (SELECT g.run_id, g.symbol, g.exchange, g.day, count(CASE WHEN c.day > g.day - 7 THEN 1 END) AS n_7, count(c.v) AS n_30, avg(CASE WHEN c.day > g.day - 7 THEN c.v END) AS avg_7, avg(c.v) AS avg_30, sum(CASE WHEN c.day > g.day - 7 THEN c.v END) AS sum_7, sum(c.v) AS sum_30
 FROM g LEFT JOIN c ON c.symbol = g.symbol AND c.exchange = g.exchange AND c.day <= g.day AND c.day > g.day - 30 AND c.day >= g.earliest GROUP BY ALL)
"""
P6_SQL = P6_AVG_SQL + """
SELECT run_id, symbol, exchange, cast(strftime(day, '%Y%m%d') AS int) AS day FROM a WHERE abs(avg_7 - avg_30) > 0.1 * abs(avg_30) OR (n_7 = 0 AND n_30 > 0)
"""
P6_ALL_SQL = P6_AVG_SQL + """
SELECT run_id, symbol, exchange, cast(strftime(day, '%Y%m%d') AS int) AS day, n_7, n_30, round(coalesce(sum_7, 0), 4) AS sum_7, round(sum_30, 4) AS sum_30 FROM a WHERE n_30 > 0
"""


# 3 ---------------------------------------------------------------------------------------------------------------

FACTORS = ["pe", "ps", "pb", "roe", "net_margin", "debt_to_equity", "market_cap", "gross_margin", "receivables_turnover", "debt_to_assets", "revenue", "revenue_growth", "eps_growth", "operating_income_growth", "net_income_growth", "gross_profit_growth"]


DATED = [*FACTORS, "report_event", "day"]


def _fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fundamentals").withColumn("day", packed("day"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    f = _fundamentals(spark, d)
    described = profile.described(profile.cells(f, "feed", "load_no", [*FACTORS, "report_event"], ["fiscal_period", "symbol"]), table(spark, d, "field_specs"))
    described = staged(described.withColumn("_sure", profile.surely_shifted()), "described")
    bins = staged(profile.histogram(profile.cells(f, "feed", "load_no", FACTORS, [])), "bins")
    place = staged(profile.placed(bins), "places")
    # open: neither the moments nor the bins tell
    sure = described.where("_sure").select(*profile.KEYS)
    left = place.where("shift IS NULL").join(sure, profile.KEYS, "left_anti")
    exact = profile.selected(f, "feed", "load_no", FACTORS, bins, left).select(*profile.KEYS, ((F.col("median") < F.col("q25")) | (F.col("median") > F.col("q75"))).alias("_exact"))
    symbols = profile.distincts(profile.cells(f, "feed", "load_no", [], ["symbol"]))
    day = unpacked("day")
    filing = f.where(F.col("report_event") == 1.0).groupBy(F.col("feed").alias("group"), F.col("load_no").alias("load")).agg(F.count(F.lit(1)).alias("_filings"), F.count(F.when(day == F.last_day(day), 1)).alias("_at_end")).withColumn("column_name", F.lit("report_event"))
    p = described
    for t in (place.select(*profile.KEYS, "shift"), exact, symbols, filing):
        p = p.join(t, profile.KEYS, "left")
    loads = Window.partitionBy("group", "column_name")
    c, factor = F.col("column_name"), F.col("column_name").isin(FACTORS)
    valued = F.col("n_rows") - F.col("n_missing")
    share = F.col("n_missing") / F.col("n_rows")
    p = p.withColumns({"_share": F.percentile(share, 0.5).over(loads), "_distinct": F.percentile("n_distinct", 0.5).over(loads)})
    rules = {
        "empty": (c != "symbol") & (valued == 0),
        "null_rate": (c != "symbol") & (share > F.col("_share") + 0.25),
        "range": (factor | (c == "report_event")) & (F.col("n_out_of_range") > 0),
        "pattern": (c == "fiscal_period") & (F.col("n_off_pattern") > 0),
        "constant": factor & (valued >= 10) & (F.col("least") == F.col("greatest")),
        "shift": factor & (valued >= 10) & (F.col("_sure") | F.coalesce("shift", "_exact", F.lit(False))),
        "month_end": (F.col("_filings") >= 4) & (F.col("_at_end") * 2 > F.col("_filings")),
        "file_count": (c == "symbol") & (F.col("n_distinct") < F.col("_distinct") / 2),
    }
    hits = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return p.select(F.col("group").alias("feed"), F.col("load").alias("load_no"), "column_name", F.explode(hits).alias("check_name"))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    values = profile.cells(_fundamentals(spark, d), "feed", "load_no", DATED, ["fiscal_period", "symbol"])
    p = profile.described(values, table(spark, d, "field_specs")).join(profile.distincts(values), profile.KEYS)
    return p.select(F.col("group").alias("feed"), F.col("load").alias("load_no"), "column_name", "n_rows", "n_missing", "n_distinct", "least", "greatest", "n_out_of_range", "n_off_pattern", F.round("std_diff", 4).alias("std_diff"))


_LONG = " UNION ALL ".join(f"SELECT feed, load_no, '{c}' AS column_name, CASE WHEN NOT isnan({c}) THEN {c} END AS v, NULL AS t FROM fundamentals" for c in [*FACTORS, "report_event"]) + " UNION ALL SELECT feed, load_no, 'day', cast(strftime(cast(day AS date), '%Y%m%d') AS double), NULL FROM fundamentals"
P3_LONG_SQL = f"""
WITH l AS ({_LONG} UNION ALL SELECT feed, load_no, 'fiscal_period', NULL, fiscal_period FROM fundamentals UNION ALL SELECT feed, load_no, 'symbol', NULL, symbol FROM fundamentals),
p AS (SELECT l.feed, l.load_no, l.column_name, count(*) AS n_rows, count(*) - count(v) - count(t) AS n_missing, count(DISTINCT v) + count(DISTINCT t) AS n_distinct, min(v) AS least, max(v) AS greatest,
 count(CASE WHEN v < s.low OR v > s.high THEN 1 END) AS n_out_of_range, count(CASE WHEN t IS NOT NULL AND NOT regexp_full_match(t, s.pattern) THEN 1 END) AS n_off_pattern,
 quantile_cont(v, 0.5) AS med, avg(v) AS mean, var_pop(v) AS var
 FROM l LEFT JOIN field_specs s ON s.column_name = l.column_name GROUP BY l.feed, l.load_no, l.column_name)
"""
P3_SQL = P3_LONG_SQL + f""",
o AS (SELECT p.feed, p.load_no, p.column_name, quantile_cont(l.v, 0.25) AS q25, quantile_cont(l.v, 0.75) AS q75 FROM p JOIN l ON l.feed = p.feed AND l.column_name = p.column_name AND l.load_no <> p.load_no WHERE p.column_name IN {tuple(FACTORS)} GROUP BY ALL),
m AS (SELECT feed, load_no, count(*) AS n, count(CASE WHEN cast(day AS date) = last_day(cast(day AS date)) THEN 1 END) AS e FROM fundamentals WHERE report_event = 1.0 GROUP BY ALL),
w AS (SELECT *, n_missing::double / n_rows AS share, quantile_cont(n_missing::double / n_rows, 0.5) OVER (PARTITION BY feed, column_name) AS med_share, quantile_cont(n_distinct::double, 0.5) OVER (PARTITION BY feed, column_name) AS med_distinct, n_rows - n_missing AS valued, column_name IN {tuple(FACTORS)} AS factor FROM p)
SELECT feed, load_no, column_name, 'empty' AS check_name FROM w WHERE column_name NOT IN ('symbol', 'day') AND valued = 0
UNION ALL SELECT feed, load_no, column_name, 'null_rate' FROM w WHERE column_name NOT IN ('symbol', 'day') AND share > med_share + 0.25
UNION ALL SELECT feed, load_no, column_name, 'range' FROM w WHERE (factor OR column_name = 'report_event') AND n_out_of_range > 0
UNION ALL SELECT feed, load_no, column_name, 'pattern' FROM w WHERE column_name = 'fiscal_period' AND n_off_pattern > 0
UNION ALL SELECT feed, load_no, column_name, 'constant' FROM w WHERE factor AND valued >= 10 AND n_distinct = 1
UNION ALL SELECT feed, load_no, column_name, 'shift' FROM w JOIN o USING (feed, load_no, column_name) WHERE factor AND valued >= 10 AND (med < q25 OR med > q75)
UNION ALL SELECT feed, load_no, 'report_event', 'month_end' FROM m WHERE n >= 4 AND e * 2 > n
UNION ALL SELECT feed, load_no, column_name, 'file_count' FROM w WHERE column_name = 'symbol' AND n_distinct < med_distinct / 2
"""

P3_PROFILE_SQL = P3_LONG_SQL + """,
k AS (SELECT feed, column_name, x.load_no, avg(o.v) AS mean_o, var_pop(o.v) AS var_o FROM (SELECT DISTINCT feed, load_no FROM fundamentals) x JOIN l o USING (feed) WHERE o.load_no <> x.load_no GROUP BY ALL)
SELECT p.feed, p.load_no, p.column_name, n_rows, n_missing, n_distinct, least, greatest, n_out_of_range, n_off_pattern,
 round((mean - mean_o) / nullif(sqrt((var + var_o) / 2), 0), 4) AS std_diff FROM p LEFT JOIN k ON k.feed = p.feed AND k.load_no = p.load_no AND k.column_name = p.column_name
"""


# 5 ---------------------------------------------------------------------------------------------------------------


def _flags(spark: SparkSession, d: str) -> DataFrame:
    values = ["bar_id", "adj_open", "adj_high", "adj_low", "adj_close", "volume"]
    bars = table(spark, d, "prices").select(*BARS, "loaded_at", *values)
    bars = counting(bars, BARS, ["loaded_at", "bar_id"], {v: F.col(v) if v == "bar_id" else present(v) for v in values})
    impossible = {"adj_close": F.col("adj_close") <= 0, "volume": F.col("volume") < 0, "adj_high": F.col("adj_high") < F.greatest("adj_open", "adj_low", "adj_close")}
    price = spikes.Tail(risk=6e-6)
    # busy days are no wrong readings: a smaller risk
    tails = {"adj_close": price, "volume": spikes.Tail(risk=3e-8), "adj_high": price}
    return spikes.flag(bars, ["symbol", "exchange"], "bar_id", "day", tails, impossible)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("bar_id").distinct()


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    """The readings that are stuck or impossible, by field: the part that SQL can state."""
    return _flags(spark, d).where(F.col("stuck") | F.col("impossible")).select("bar_id", "field", F.col("stuck").cast("int").alias("stuck"), F.col("impossible").cast("int").alias("impossible"))


def _stuck_sql(f: str, wrong: str) -> str:
    return f"""SELECT b.bar_id, '{f}' AS field, cast(coalesce(s.stuck, 0) AS int) AS stuck, cast(coalesce({wrong}, false) AS int) AS impossible FROM b LEFT JOIN (
  SELECT bar_id, CASE WHEN count(*) OVER (PARTITION BY symbol, exchange, run) >= 6 AND row_number() OVER (PARTITION BY symbol, exchange, run ORDER BY day) > 1 THEN 1 ELSE 0 END AS stuck
  FROM (SELECT *, sum(CASE WHEN x = before THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, exchange ORDER BY day) AS run
   FROM (SELECT *, lag(x) OVER (PARTITION BY symbol, exchange ORDER BY day) AS before FROM (SELECT symbol, exchange, day, bar_id, {f} AS x FROM b WHERE {f} IS NOT NULL)))) s USING (bar_id)
  WHERE s.stuck = 1 OR {wrong}"""


P5_RULES_SQL = f"""
WITH b AS (SELECT symbol, exchange, day, bar_id, {", ".join(f"CASE WHEN NOT isnan({f}) THEN {f} END AS {f}" for f in ("adj_open", "adj_high", "adj_low", "adj_close", "volume"))}
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol, exchange, day ORDER BY loaded_at DESC, bar_id DESC) AS rn FROM prices) WHERE rn = 1)
{_stuck_sql("adj_close", "adj_close <= 0")} UNION ALL {_stuck_sql("volume", "volume < 0")} UNION ALL {_stuck_sql("adj_high", "adj_high < greatest(adj_open, adj_low, adj_close)")}
"""


# 7 ---------------------------------------------------------------------------------------------------------------

# names and types where they are known; every other field of the files is a column, too
PRICE_ROW = {"symbol": "string", "day": "date", "adj_open": "double", "adj_high": "double", "adj_low": "double", "adj_close": "double", "volume": "double"}
FUNDAMENTAL_ROW = {"symbol": "string", "day": "date", "pe": "double", "ps": "double", "pb": "double", "roe": "double", "net_margin": "double", "debt_to_equity": "double", "market_cap": "double", "revenue": "double", "report_event": "boolean"}


def _file_fields(spark: SparkSession, d: str) -> DataFrame:
    return staged(drift.signatures(table(spark, d, "raw_files")), "fields")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    fields = _file_fields(spark, d)
    changes = staged(drift.scripts(fields), "changes")
    out = drift.settled(changes, drift.alias_classes(fields, changes)).where(F.col("change_kind") != "carried")
    return out.select("file_id", "change_kind", "old_field", "new_field")


def _unified(spark: SparkSession, d: str, kind: str, row: dict[str, str]) -> DataFrame:
    fields = _file_fields(spark, d)
    classes = drift.alias_classes(fields, drift.scripts(fields)).get(kind, {})
    keep = ["feed", "file_no", "line_no"]
    named, types = drift.columns(fields, kind, classes, row, keep)
    return drift.unified(table(spark, d, "raw_files"), kind, named, types, keep)


def p7_prices(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d, "prices", PRICE_ROW)


def p7_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d, "fundamentals", FUNDAMENTAL_ROW)


def queries() -> dict:
    return {"p7_found": p7_found, "p7_prices": p7_prices, "p7_fundamentals": p7_fundamentals, "p3_found": p3_found, "p3_profile": p3_profile, "p5_found": p5_found, "p5_rules": p5_rules, "p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p4_grid": p4_grid, "p6_found": p6_found, "p6_averages": p6_averages}


def oracle_sql() -> dict:
    return {"p3_found": P3_SQL, "p3_profile": P3_PROFILE_SQL, "p5_rules": P5_RULES_SQL, "p1_found": P1_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p4_grid": P4_GRID_SQL, "p6_found": P6_SQL, "p6_averages": P6_ALL_SQL}
