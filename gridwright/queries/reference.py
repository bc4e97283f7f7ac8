"""Queries of joins, portfolios, metrics, research, audits, sources and streams, with SQL where it can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.columns import packed, tidy, unpacked
from gridwright.operators import audit, universe
from gridwright.operators.panel import align, as_of, filled, on_grid_of
from gridwright.plans.compile import evaluate
from gridwright.plans.dsl import parse
from gridwright.portfolio import metrics, nav, research
from gridwright.queries.bars import brands, nations, panel_sql, sectors
from gridwright.queries.expressions import PART, lag, mean, unit
from gridwright.session import shared_folder, table
from gridwright.sources import files
from gridwright.streaming import bars as stream

OFF = 2e-8
R = lambda c: F.round((c if not isinstance(c, str) else F.col(c)) + OFF, 6)
SMA = "close > sma(close, 5)"
D = "cast(strftime(day, '%Y%m%d') AS int) AS day"


def rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    """Days as numbers and doubles rounded, for comparison."""
    out = []
    for name, kind in df.dtypes:
        out.append((packed(name) if kind == "date" else R(name) if kind == "double" else F.col(name)).alias(name))
    return df.select(*out) if not keep else df.select(*out).select(*keep)


# joins ------------------------------------------------------------------------------------------------------------


def join_align(spark: SparkSession, d: str) -> DataFrame:
    """Brands by month against brands by day: days united, symbols intersected."""
    a = brands(spark, d, "month").select("day", "symbol", "ord", F.col("close").alias("month_close"))
    return rounded(align(a, brands(spark, d).select("day", "symbol", "ord", "close")), ["day", "symbol", "month_close", "close"])


JOIN_ALIGN = f"""WITH {panel_sql(grain='month').replace('r0', 'm0').replace('b AS', 'm AS', 1)}, {panel_sql()},
dd AS (SELECT day FROM m UNION SELECT day FROM b), ss AS (SELECT DISTINCT symbol FROM m)
SELECT cast(strftime(dd.day, '%Y%m%d') AS int) AS day, ss.symbol, round(m.close + {OFF}, 6) AS month_close, round(b.close + {OFF}, 6) AS close
FROM dd CROSS JOIN ss LEFT JOIN m ON m.day = dd.day AND m.symbol = ss.symbol LEFT JOIN b ON b.day = dd.day AND b.symbol = ss.symbol"""


def _filings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dated facts of the customer's nation: the last order's total of each day."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("visible"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return facts.groupBy("symbol", "visible").agg(F.max_by("o_totalprice", "o_orderkey").alias("fact"))


def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    out = as_of(nations(spark, d).select("day", "symbol", "ord"), _filings(spark, d), "visible", ["fact"])
    return out.select(packed("day").alias("day"), "symbol", "fact")


JOIN_AS_OF = f"""WITH {panel_sql('nations')},
f AS (SELECT n_name AS symbol, cast(o_orderdate AS date) AS visible, arg_max(o_totalprice, o_orderkey) AS fact FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT {D}, b.symbol, f.fact FROM b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.day >= f.visible"""


def join_reindex(spark: SparkSession, d: str) -> DataFrame:
    out = on_grid_of(brands(spark, d).select("day", "symbol", "ord"), brands(spark, d, "month").select("day", "symbol", F.col("close").alias("month_close")))
    return rounded(filled(out, ["month_close"]), ["day", "symbol", "month_close"])


JOIN_REINDEX = f"""WITH {panel_sql(grain='month').replace('r0', 'm0').replace('b AS', 'm AS', 1)}, {panel_sql()}
SELECT cast(strftime(b.day, '%Y%m%d') AS int) AS day, b.symbol, round(last_value(m.close IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.day ROWS UNBOUNDED PRECEDING) + {OFF}, 6) AS month_close
FROM b LEFT JOIN m ON m.day = b.day AND m.symbol = b.symbol"""


# portfolios -------------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, d: str, text: str = SMA) -> DataFrame:
    return research.positions(brands(spark, d), parse(text), "v")


def nav_buy_hold(spark: SparkSession, d: str) -> DataFrame:
    """Equal weights bought on the first day and left to drift, free of cost; the equity's leading digits."""
    cells = brands(spark, d).select("day", "symbol", "ord", F.col("close").alias("price"), F.lit(1.0).alias("position"), F.lit("v").alias("variant"))
    return nav.equity_of(nav.simulate(cells, nav.Costs())).select(packed("day").alias("day"), F.round(F.col("equity") / F.pow(F.lit(10.0), F.floor(F.log10("equity"))) + OFF, 6).alias("equity"), R("exposure").alias("exposure"))


NAV_BUY_HOLD = f"""WITH {panel_sql()}, g AS (SELECT day, symbol, coalesce(close / nullif({lag()}, 0), 1) AS f FROM b),
c AS (SELECT day, symbol, exp(sum(ln(f)) OVER ({PART} ROWS UNBOUNDED PRECEDING)) AS v FROM g)
SELECT {D}, round(avg(v) / pow(10.0, floor(log10(avg(v)))) + {OFF}, 6) AS equity, round(1.0 + {OFF}, 6) AS exposure FROM c GROUP BY day"""


def nav_sql(cells: str, fee: float = 0.0, tax: float = 0.0, limit: float = 1.0) -> str:
    """CTEs after ``s`` (variant, seg, day, symbol, ord, raw, close), which ``cells`` holds: n (variant, seg, r, day, equity), simulated day by day over lists.

    A segment starts from the book of the one before.
    """
    cost = lambda old: f"{fee} * list_sum(list_transform(list_zip(target, {old}), lambda z: abs(z[1] - z[2]))) + {tax} * list_sum(list_transform(list_zip(target, {old}), lambda z: greatest(z[2] - z[1], 0)))"
    return f"""{cells},
c AS (SELECT variant, seg, day, ord, raw, coalesce(close / nullif(lag(close) OVER (PARTITION BY variant, seg, symbol ORDER BY day), 0) - 1, 0) AS ret FROM s),
l AS (SELECT variant, seg, day, row_number() OVER (PARTITION BY variant ORDER BY seg, day) AS r, list(raw ORDER BY ord) AS raw, list(ret ORDER BY ord) AS ret FROM c GROUP BY variant, seg, day),
t AS (SELECT *, list_transform(raw, lambda x: least(x / greatest(list_sum(list_transform(raw, lambda y: abs(y))), 1), {limit})) AS target, raw IS DISTINCT FROM lag(raw) OVER (PARTITION BY variant ORDER BY r) AS change, lag(seg) OVER (PARTITION BY variant ORDER BY r) IS DISTINCT FROM seg AS fresh FROM l),
n AS (SELECT variant, seg, r, day, 1 - ({cost("list_transform(target, lambda x: 0.0)")}) AS equity, target AS held FROM t WHERE r = 1
 UNION ALL SELECT variant, seg, r, day, CASE WHEN fresh THEN 1 - ({cost("h")}) WHEN change THEN e1 * (1 - ({cost("drift")})) ELSE e1 END, CASE WHEN fresh OR change THEN target ELSE drift END
 FROM (SELECT *, list_transform(list_zip(h, ret), lambda z: z[1] * (1 + z[2]) / (1 + g)) AS drift, e0 * (1 + g) AS e1 FROM (SELECT t.*, n.equity AS e0, n.held AS h, list_dot_product(n.held, t.ret) AS g FROM n JOIN t ON t.variant = n.variant AND t.r = n.r + 1)))"""


FIGURES = f"""f AS (SELECT variant, any_value(z) / any_value(a) - 1 AS total_return, avg(ret) / greatest(stddev_samp(ret), 1e-6) * sqrt(252) AS sharpe, min(dd) AS max_drawdown
 FROM (SELECT variant, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd, first_value(equity) OVER w AS a, last_value(equity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM n WINDOW w AS (PARTITION BY variant ORDER BY day)) GROUP BY variant)"""


def nav_costs(spark: SparkSession, d: str) -> DataFrame:
    """A trend rule with fees and taxes."""
    return rounded(nav.equity_of(nav.simulate(_cells(spark, d), nav.Costs(fee=0.001, tax=0.002))), ["day", "equity", "exposure"])


NAV_COSTS = f"""WITH RECURSIVE {nav_sql(f"{panel_sql()}, s AS (SELECT 'v' AS variant, 0 AS seg, day, symbol, ord, {unit(f'close > {mean(5)}')} AS raw, close FROM b)", 0.001, 0.002)}
SELECT {D.replace('day,', 'n.day,')}, round(n.equity + {OFF}, 6) AS equity, round(list_sum(t.target) + {OFF}, 6) AS exposure FROM n JOIN t USING (variant, r)"""


def nav_strategy(spark: SparkSession, d: str) -> DataFrame:
    """A rotation with costs, limits, stops and delisting."""
    cfg = nav.Costs(fee=0.001, tax=0.002, slippage=0.0005, position_limit=0.2, delist_after=3, delist_haircut=0.5, stops=nav.Stops(stop_loss=0.1, take_profit=0.3, trail_stop=0.15))
    return rounded(nav.equity_of(nav.simulate(_cells(spark, d, "is_largest(pct_change(close, 3), 5)"), cfg)), ["day", "equity", "exposure"])


def nav_trades(spark: SparkSession, d: str) -> DataFrame:
    t = nav.trade_list(nav.simulate(_cells(spark, d), nav.Costs(fee=0.001, tax=0.002)))
    return rounded(t, ["symbol", "entry_day", "exit_day", "ret", "period", "worst", "best", "side"])


NAV_TRADES = f"""WITH {panel_sql()}, h0 AS (SELECT *, coalesce(close > {mean(5)}, false) AS held FROM b), h AS (SELECT *, coalesce({lag('held')}, false) AS was FROM h0),
g AS (SELECT *, sum(CASE WHEN held AND NOT was THEN 1 ELSE 0 END) OVER ({PART}) AS run, lead(day) OVER ({PART}) AS nday, lead(close) OVER ({PART}) AS nclose, lead(high) OVER ({PART}) AS nhigh, lead(low) OVER ({PART}) AS nlow FROM h),
i AS (SELECT symbol, run, min(day) AS a, arg_min(close, day) AS ep, count(*) AS n, arg_max(nday, day) AS nd, arg_max(coalesce(nclose, -1), day) AS nc, max(high) AS hh, min(low) AS ll, arg_max(coalesce(nhigh, -1), day) AS nh, arg_max(coalesce(nlow, -1), day) AS nl, max(day) AS z FROM g WHERE held GROUP BY symbol, run),
e AS (SELECT max(day) AS e FROM b)
SELECT symbol, cast(strftime(a, '%Y%m%d') AS int) AS entry_day, CASE WHEN z < e THEN cast(strftime(nd, '%Y%m%d') AS int) END AS exit_day,
 round(CASE WHEN z < e THEN CASE WHEN nc < 0 THEN 1 ELSE nc / ep END * 0.999 * 0.997 ELSE c.close / ep END - 1 + {OFF}, 6) AS ret, cast(CASE WHEN z < e THEN n ELSE n - 1 END AS int) AS period,
 round(least(ll, CASE WHEN z < e AND nl >= 0 THEN nl ELSE ll END) / ep - 1 + {OFF}, 6) AS worst, round(greatest(hh, CASE WHEN z < e THEN nh ELSE hh END) / ep - 1 + {OFF}, 6) AS best, 'long' AS side
FROM i CROSS JOIN e LEFT JOIN b c USING (symbol) WHERE c.day = z"""


# metrics: every brand's daily close as a curve -----------------------------------------------------------------


def _curves(spark: SparkSession, d: str) -> DataFrame:
    return brands(spark, d).where("close IS NOT NULL").select(F.col("symbol").alias("variant"), "day", F.col("close").alias("equity"))


CURVES = f"WITH {panel_sql()}, q AS (SELECT symbol AS variant, day, close AS equity FROM b WHERE close IS NOT NULL), r AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER (PARTITION BY variant ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q WINDOW w AS (PARTITION BY variant ORDER BY day))"


def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.summary(_curves(spark, d)), ["variant", "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "avg_drawdown", "ulcer_index", "max_drawdown_duration", "calmar", "best_day", "worst_day", "skew", "kurtosis", "var_95", "cvar_95"])


METRICS_SUMMARY = f"""{CURVES},
u AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY variant ORDER BY day) AS up FROM r), l AS (SELECT variant, max(n) AS n FROM (SELECT variant, up, count(*) AS n FROM u WHERE dd < 0 GROUP BY ALL) GROUP BY variant),
v AS (SELECT variant, quantile_cont(ret, 0.05) AS v, avg(ret) AS mu, stddev_pop(ret) AS s FROM r GROUP BY variant), c AS (SELECT variant, avg(ret) AS c FROM r JOIN v USING (variant) WHERE ret <= v GROUP BY variant),
k AS (SELECT variant, avg(pow(ret - mu, 3)) / pow(any_value(s), 3) AS skew FROM r JOIN v USING (variant) GROUP BY variant),
t AS (SELECT variant, arg_max(equity, day) / arg_min(equity, day) - 1 AS tr, date_diff('day', min(day), max(day)) * 86400.0 / 31557600 AS y, stddev_samp(ret) AS sd, avg(ret) AS m, stddev_samp(least(ret, 0)) AS ds, min(dd) AS mdd, avg(dd) AS add_, sqrt(avg(dd * dd)) AS ui, max(ret) AS b, min(ret) AS w, kurtosis_pop(ret) AS ku FROM r GROUP BY variant)
SELECT variant, round(tr + {OFF}, 6) AS total_return, round(pow(1 + tr, 1 / y) - 1 + {OFF}, 6) AS cagr, round(sd * sqrt(252) + {OFF}, 6) AS volatility, round(m / greatest(sd, 1e-6) * sqrt(252) + {OFF}, 6) AS sharpe, round(m / greatest(ds, 1e-6) * sqrt(252) + {OFF}, 6) AS sortino,
 round(mdd + {OFF}, 6) AS max_drawdown, round(add_ + {OFF}, 6) AS avg_drawdown, round(ui + {OFF}, 6) AS ulcer_index, coalesce(n, 0) AS max_drawdown_duration, round((pow(1 + tr, 1 / y) - 1) / abs(mdd) + {OFF}, 6) AS calmar, round(b + {OFF}, 6) AS best_day, round(w + {OFF}, 6) AS worst_day,
 round(skew + {OFF}, 6) AS skew, round(ku + {OFF}, 6) AS kurtosis, round(v + {OFF}, 6) AS var_95, round(c + {OFF}, 6) AS cvar_95 FROM t LEFT JOIN l USING (variant) JOIN v USING (variant) JOIN c USING (variant) JOIN k USING (variant)"""


def metrics_yearly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_period(_curves(spark, d), "year"), ["variant", "period", "ret"])


METRICS_YEARLY = f"""{CURVES}, p AS (SELECT variant, date_trunc('year', day) AS period, arg_max(equity, day) AS z, arg_min(equity, day) AS a FROM q GROUP BY ALL)
SELECT variant, cast(strftime(period, '%Y%m%d') AS int) AS period, round(z / coalesce(lag(z) OVER (PARTITION BY variant ORDER BY period), a) - 1 + {OFF}, 6) AS ret FROM p"""


def metrics_trailing(spark: SparkSession, d: str) -> DataFrame:
    c = _curves(spark, d)
    parts = [metrics.trailing(c, y).select("variant", F.lit(n).alias("span"), R("ret").alias("ret")) for n, y in (("ytd", None), ("one_year", 1), ("three_year", 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


METRICS_TRAILING = f"""{CURVES}, e AS (SELECT variant, max(day) AS e, arg_max(equity, day) AS n FROM q GROUP BY variant),
a AS (SELECT variant, n, 'ytd' AS span, cast(date_trunc('year', e) AS date) - 1 AS t FROM e UNION ALL SELECT variant, n, 'one_year', cast(e - INTERVAL 12 MONTH AS date) FROM e UNION ALL SELECT variant, n, 'three_year', cast(e - INTERVAL 36 MONTH AS date) FROM e)
SELECT a.variant, span, round(any_value(n) / arg_max(equity, day) - 1 + {OFF}, 6) AS ret FROM a JOIN q ON q.variant = a.variant AND q.day <= t GROUP BY a.variant, span"""


def metrics_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.rolling(_curves(spark, d)), [])


_W = "OVER (PARTITION BY variant ORDER BY day ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
METRICS_ROLLING = f"""{CURVES} SELECT variant, {D}, round(CASE WHEN count(ret) {_W} = 252 THEN stddev_samp(ret) {_W} * sqrt(252) END + {OFF}, 6) AS rolling_volatility,
 round(CASE WHEN count(ret) {_W} = 252 THEN avg(ret) {_W} / greatest(stddev_samp(ret) {_W}, 1e-6) * sqrt(252) END + {OFF}, 6) AS rolling_sharpe FROM r"""


def metrics_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.drawdown_episodes(_curves(spark, d)), ["variant", "first_day", "last_day", "depth", "length"])


METRICS_DRAWDOWNS = f"""{CURVES}, u AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY variant ORDER BY day) AS up FROM r),
e AS (SELECT variant, min(day) AS a, max(day) AS z, min(dd) AS depth, count(*) AS length FROM u WHERE dd < 0 GROUP BY variant, up)
SELECT variant, cast(strftime(a, '%Y%m%d') AS int) AS first_day, cast(strftime(z, '%Y%m%d') AS int) AS last_day, round(depth + {OFF}, 6) AS depth, length FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY depth, a) AS p FROM e) WHERE p <= 5"""


def metrics_against(spark: SparkSession, d: str) -> DataFrame:
    bench = _curves(spark, d).groupBy("day").agg(F.avg("equity").alias("level"))
    return rounded(metrics.against(_curves(spark, d), bench), [])


METRICS_AGAINST = f"""{CURVES}, m AS (SELECT day, avg(equity) AS level FROM q GROUP BY day), p AS (SELECT variant, day, equity / lag(equity) OVER w - 1 AS r, level / lag(level) OVER w - 1 AS m, level FROM q JOIN m USING (day) WINDOW w AS (PARTITION BY variant ORDER BY day)),
s AS (SELECT variant, covar_samp(r, m) / var_samp(m) AS beta, avg(r) AS ar, avg(m) AS am, stddev_samp(r - m) AS te FROM p WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY variant), t AS (SELECT variant, arg_max(level, day) / arg_min(level, day) - 1 AS br FROM p GROUP BY variant)
SELECT variant, round(beta + {OFF}, 6) AS beta, round((ar - beta * am) * 252 + {OFF}, 6) AS alpha, round(te * sqrt(252) + {OFF}, 6) AS tracking_error, round((ar - am) / te * sqrt(252) + {OFF}, 6) AS information_ratio, round(br + {OFF}, 6) AS benchmark_return FROM s JOIN t USING (variant)"""


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return _curves(spark, d).groupBy("day").agg(F.avg("equity").alias("level"))


def metrics_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.rolling_correlation(_curves(spark, d), _bench(spark, d)), [])


_BESIDE = f"{CURVES}, m AS (SELECT day, avg(equity) AS level FROM q GROUP BY day), p AS (SELECT variant, day, equity, level, row_number() OVER w AS no, equity / lag(equity) OVER w - 1 AS r, level / lag(level) OVER w - 1 AS m FROM q JOIN m USING (day) WINDOW w AS (PARTITION BY variant ORDER BY day))"
METRICS_CORRELATION = f"{_BESIDE} SELECT variant, {D}, round(CASE WHEN no > 252 THEN corr(r, m) {_W} END + {OFF}, 6) AS correlation FROM p"


def metrics_beating(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.share_beating(_curves(spark, d), _bench(spark, d)), [])


METRICS_BEATING = f"{_BESIDE} SELECT variant, round(avg(CASE WHEN equity * l >= level * e THEN 1.0 ELSE 0 END) + {OFF}, 6) AS share_beating FROM (SELECT *, first_value(equity) OVER w AS e, first_value(level) OVER w AS l FROM p WINDOW w AS (PARTITION BY variant ORDER BY day)) GROUP BY variant"


def metrics_month_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.month_grid(_curves(spark, d)), [])


def _periods(unit_: str) -> str:
    return f"(SELECT variant, period, z / coalesce(lag(z) OVER (PARTITION BY variant ORDER BY period), a) - 1 AS ret FROM (SELECT variant, date_trunc('{unit_}', day) AS period, arg_max(equity, day) AS z, arg_min(equity, day) AS a FROM q GROUP BY ALL))"


METRICS_MONTH_GRID = f"{CURVES}, g AS {_periods('month')}, y AS {_periods('year')} SELECT g.variant, cast(year(g.period) AS int) AS year, " + ", ".join(f"round(max(CASE WHEN month(g.period) = {k} THEN g.ret END) + {OFF}, 6) AS m{k}" for k in range(1, 13)) + f", round(any_value(y.ret) + {OFF}, 6) AS total FROM g JOIN y ON y.variant = g.variant AND year(y.period) = year(g.period) GROUP BY g.variant, year(g.period)"


def metrics_year_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.year_table(_curves(spark, d), _bench(spark, d)), [])


METRICS_YEAR_TABLE = f"{CURVES}, y AS {_periods('year')}, z AS {_periods('year').replace('FROM q', 'FROM (SELECT 0 AS variant, day, avg(equity) AS equity FROM q GROUP BY day)')} SELECT y.variant, cast(year(y.period) AS int) AS year, round(y.ret + {OFF}, 6) AS strategy, round(z.ret + {OFF}, 6) AS benchmark, round(y.ret - z.ret + {OFF}, 6) AS excess FROM y LEFT JOIN z ON z.period = y.period"


def metrics_equal_weight(spark: SparkSession, d: str) -> DataFrame:
    """The logarithm of the curve of all brands, rebalanced each period; by month, as years of days leave the doubles."""
    return metrics.equal_weight(brands(spark, d, "month")).select(packed("day").alias("day"), R(F.log("level")).alias("log_level"))


METRICS_EQUAL_WEIGHT = f"WITH {panel_sql(grain='month')}, m AS (SELECT day, coalesce(avg(close / p - 1), 0) AS m FROM (SELECT day, close, CASE WHEN {lag()} > 0 THEN {lag()} END AS p FROM b) GROUP BY day) SELECT {D}, round(sum(ln(1 + m)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) + {OFF}, 6) AS log_level FROM m"


def metrics_trades(spark: SparkSession, d: str) -> DataFrame:
    t = nav.trade_list(nav.simulate(_cells(spark, d), nav.Costs()))
    return rounded(metrics.trade_summary(t), ["variant", "num_trades", "win_rate", "profit_factor", "expectancy", "avg_holding_period", "avg_win", "avg_loss", "payoff_ratio", "best_trade", "worst_trade", "max_consecutive_losses"])


METRICS_TRADES = f"""WITH {panel_sql()}, h0 AS (SELECT *, coalesce(close > {mean(5)}, false) AS held FROM b), h AS (SELECT *, coalesce({lag('held')}, false) AS was FROM h0),
g AS (SELECT *, sum(CASE WHEN held AND NOT was THEN 1 ELSE 0 END) OVER ({PART}) AS run, lead(day) OVER ({PART}) AS nday, lead(close) OVER ({PART}) AS nclose FROM h),
i AS (SELECT symbol, min(day) AS a, arg_min(close, day) AS ep, count(*) AS n, max(nday) AS z, arg_max(coalesce(nclose, -1), day) AS nc, count(*) - count(nday) AS open FROM g WHERE held GROUP BY symbol, run),
t AS (SELECT symbol, a, z, n, CASE WHEN nc < 0 THEN 1 ELSE nc / ep END - 1 AS ret FROM i WHERE open = 0),
o AS (SELECT *, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) OVER (ORDER BY z, symbol, a) AS w FROM t), l AS (SELECT max(n) AS n FROM (SELECT w, count(*) AS n FROM o WHERE ret < 0 GROUP BY w))
SELECT 'v' AS variant, count(*) AS num_trades, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) + {OFF}, 6) AS win_rate, round(sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END) + {OFF}, 6) AS profit_factor, round(avg(ret) + {OFF}, 6) AS expectancy, round(avg(t.n) + {OFF}, 6) AS avg_holding_period,
 round(avg(CASE WHEN ret > 0 THEN ret END) + {OFF}, 6) AS avg_win, round(avg(CASE WHEN ret < 0 THEN ret END) + {OFF}, 6) AS avg_loss, round(avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret < 0 THEN ret END) + {OFF}, 6) AS payoff_ratio, round(max(ret) + {OFF}, 6) AS best_trade, round(min(ret) + {OFF}, 6) AS worst_trade, any_value(l.n) AS max_consecutive_losses FROM t CROSS JOIN l"""


def metrics_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bootstrap(_curves(spark, d), 50), [])


# research ---------------------------------------------------------------------------------------------------------


SPANS = [20, 60, 120]


def research_sweep(spark: SparkSession, d: str) -> DataFrame:
    template = {"op": "Gt", "l": {"op": "Data", "name": "close"}, "r": {"op": "Average", "of": {"op": "Data", "name": "close"}, "n": "$n"}}
    rows, _ = research.sweep(brands(spark, d), research.grid(template, {"n": SPANS}), nav.Costs(fee=0.001, position_limit=0.01))
    return rounded(research.board(rows), ["variant", "total_return", "sharpe", "max_drawdown"])


_SWEPT = ", s AS (" + " UNION ALL ".join(f"SELECT 'n={n}' AS variant, 0 AS seg, day, symbol, ord, {unit(f'close > {mean(n)}')} AS raw, close FROM b" for n in SPANS) + ")"
RESEARCH_SWEEP = f"WITH RECURSIVE {nav_sql(panel_sql() + _SWEPT, 0.001, limit=0.01)}, {FIGURES} SELECT variant, round(total_return + {OFF}, 6) AS total_return, round(sharpe + {OFF}, 6) AS sharpe, round(max_drawdown + {OFF}, 6) AS max_drawdown FROM f"


def research_lookahead(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.lookahead(brands(spark, d), parse(SMA), nav.Costs(position_limit=0.001)), ["lag", "total_return", "sharpe"])


_LAGGED = f", q AS (SELECT *, {unit(f'close > {mean(5)}')} AS p FROM b), s AS (" + " UNION ALL ".join(f"SELECT {k} AS variant, 0 AS seg, day, symbol, ord, coalesce(lag(p, {k}) OVER ({PART}), 0) AS raw, close FROM q" for k in (0, 1, 2, 3, 5, 10, 21)) + ")"
RESEARCH_LOOKAHEAD = f"WITH RECURSIVE {nav_sql(panel_sql() + _LAGGED, limit=0.001)}, {FIGURES} SELECT cast(variant AS int) AS lag, round(total_return + {OFF}, 6) AS total_return, round(sharpe + {OFF}, 6) AS sharpe FROM f"

TRAIN, TEST, WALKED = 504, 252, [20, 60]


def _walk(spark: SparkSession, d: str) -> research.Walk:
    return research.walk_forward(brands(spark, d), {f"n={n}": parse(f"close > sma(close, {n})") for n in WALKED}, nav.Costs(fee=0.001), TRAIN, TEST)


def research_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """The windows of a walk-forward run, the last one short."""
    rows = [(w["train_from"], w["test_from"], w["test_to"], w["variant"], float(w["in_sample"]), float(w["test_return"])) for w in _walk(spark, d).windows]
    return rounded(spark.createDataFrame(rows, "train_from date, test_from date, test_to date, variant string, in_sample double, test_return double"), [])


def research_walk_curve(spark: SparkSession, d: str) -> DataFrame:
    """The chained out-of-sample curve."""
    return rounded(spark.createDataFrame([(x, float(e)) for x, e in _walk(spark, d).curve], "day date, equity double"), [])


_TRAINED = f""", k AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS rn FROM (SELECT DISTINCT day FROM b)), e AS (SELECT max(rn) AS e FROM k),
w AS (SELECT i, i * {TRAIN + TEST} AS a, i * {TRAIN + TEST} + {TRAIN} AS t, least(i * {TRAIN + TEST} + {TRAIN + TEST} - 1, e) AS z FROM e, range(100) r(i) WHERE i * {TRAIN + TEST} + {TRAIN} <= e),
g AS (SELECT b.day, b.symbol, b.ord, b.close, k.rn, p.n, CASE p.n {" ".join(f"WHEN {n} THEN {unit(f'close > {mean(n)}')}" for n in WALKED)} END AS raw FROM b JOIN k USING (day) CROSS JOIN (SELECT unnest({WALKED}) AS n) p)""".replace("PARTITION BY symbol ORDER BY day", "PARTITION BY b.symbol, p.n ORDER BY b.day")
_CHOSEN = f"SELECT i, cast(n AS int) AS n, sharpe FROM (SELECT w.i, split_part(f.variant, '|', 2) AS n, f.sharpe, row_number() OVER (PARTITION BY w.i ORDER BY f.sharpe DESC, cast(split_part(f.variant, '|', 2) AS int) DESC) AS p FROM w JOIN f ON split_part(f.variant, '|', 1) = w.i::varchar WHERE f.sharpe IS NOT NULL) WHERE p = 1"
_WALKED = f"""WITH RECURSIVE ch AS (WITH RECURSIVE {nav_sql(panel_sql() + _TRAINED + ", s AS (SELECT w.i || '|' || g.n AS variant, 0 AS seg, g.day, g.symbol, g.ord, g.raw, g.close FROM g JOIN w ON g.rn BETWEEN w.a AND w.t - 1)", 0.001)}, {FIGURES} {_CHOSEN}),
{nav_sql(panel_sql() + _TRAINED + ", s AS (SELECT 'walk' AS variant, w.i AS seg, g.day, g.symbol, g.ord, g.raw, g.close FROM g JOIN ch ON ch.n = g.n JOIN w ON w.i = ch.i AND g.rn BETWEEN w.t - 1 AND w.z)", 0.001)},
y AS (SELECT seg, arg_max(equity, r) AS last FROM n GROUP BY seg)"""
RESEARCH_WALK_FORWARD = _WALKED + f""" SELECT cast(strftime(ka.day, '%Y%m%d') AS int) AS train_from, cast(strftime(kt.day, '%Y%m%d') AS int) AS test_from, cast(strftime(kz.day, '%Y%m%d') AS int) AS test_to, 'n=' || ch.n AS variant, round(ch.sharpe + {OFF}, 6) AS in_sample, round(y.last - 1 + {OFF}, 6) AS test_return
FROM w JOIN ch USING (i) JOIN y ON y.seg = w.i JOIN k ka ON ka.rn = w.a JOIN k kt ON kt.rn = w.t JOIN k kz ON kz.rn = w.z"""
RESEARCH_WALK_CURVE = _WALKED + f""", o AS (SELECT n.*, row_number() OVER (PARTITION BY seg ORDER BY r) AS p FROM n)
SELECT {D.replace('day,', 'o.day,')}, round(o.equity * coalesce((SELECT product(y.last) FROM y WHERE y.seg < o.seg), 1) + {OFF}, 6) AS equity FROM o WHERE p > 1"""


def _factor(spark: SparkSession, d: str) -> DataFrame:
    panel = brands(spark, d)
    return research.factor_days(evaluate(panel, parse("volume")), panel)


FACTOR = f"""WITH {panel_sql()}, f AS (SELECT day, symbol, ord, volume AS f, lead(close) OVER ({PART}) / close - 1 AS fwd FROM b), v AS (SELECT * FROM f WHERE f IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY f) + (count(*) OVER (PARTITION BY day, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY day ORDER BY fwd) + (count(*) OVER (PARTITION BY day, fwd) - 1) / 2.0 AS rr, count(*) OVER (PARTITION BY day) AS m FROM v)"""


def research_ic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.information(_factor(spark, d)), [])


RESEARCH_IC = f"{FACTOR} SELECT {D}, round(coalesce(covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0), 0) + {OFF}, 6) AS ic FROM k WHERE m >= 2 GROUP BY day"


def research_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.factor_report(_factor(spark, d)), [])


RESEARCH_BUCKETS = f"{FACTOR} SELECT cast(floor(p * 5 / m) AS int) AS bucket, round(avg(fwd) + {OFF}, 6) AS mean_return, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY f, ord) - 1 AS p FROM k WHERE m >= 2) GROUP BY 1"


def research_factor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(research.factor_figures(_factor(spark, d)), [])


RESEARCH_FACTOR = f"""{FACTOR}, i AS (SELECT day, coalesce(covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0), 0) AS ic FROM k WHERE m >= 2 GROUP BY day),
u AS (SELECT *, cast(floor(p * 5 / m) AS int) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY f, ord) - 1 AS p FROM k WHERE m >= 2)),
e AS (SELECT avg(CASE WHEN bucket = 4 THEN fwd END) - avg(CASE WHEN bucket = 0 THEN fwd END) AS ls FROM u),
g AS (SELECT day, lead(day) OVER (ORDER BY day) AS nx FROM (SELECT DISTINCT day FROM b)), o AS (SELECT day, symbol FROM u WHERE bucket = 4),
z AS (SELECT o.day, avg(CASE WHEN q.symbol IS NULL THEN 1.0 ELSE 0 END) AS gone FROM o JOIN g ON g.day = o.day JOIN (SELECT day FROM i) j ON j.day = g.nx LEFT JOIN o q ON q.day = g.nx AND q.symbol = o.symbol GROUP BY o.day)
SELECT (SELECT count(*) FROM i) AS n_days, (SELECT round(avg(ic) + {OFF}, 6) FROM i) AS mean_ic, (SELECT round(stddev_samp(ic) + {OFF}, 6) FROM i) AS ic_deviation, (SELECT round(avg(ic) / stddev_samp(ic) + {OFF}, 6) FROM i) AS icir, (SELECT round(ls + {OFF}, 6) FROM e) AS long_short, (SELECT round(avg(gone) + {OFF}, 6) FROM z) AS top_turnover"""


def research_events(spark: SparkSession, d: str) -> DataFrame:
    panel = brands(spark, d)
    return rounded(research.event_study(evaluate(panel, parse(f"is_entry({SMA})")), panel, 3, 5), [])


RESEARCH_EVENTS = f"""WITH {panel_sql()}, x AS (SELECT *, {unit(f'close > {mean(5)}')} AS c, close / {lag()} - 1 AS ret FROM b), e AS (SELECT symbol, rn FROM (SELECT symbol, rn, c, {lag('c')} AS p FROM x) WHERE c = 1 AND coalesce(p, 0) = 0),
l AS (SELECT l.lag, x.ret FROM e CROSS JOIN (SELECT unnest(generate_series(-3, 5)) AS lag) l JOIN x ON x.symbol = e.symbol AND x.rn = e.rn + l.lag WHERE x.ret IS NOT NULL), a AS (SELECT lag, avg(ret) AS m, count(*) AS n FROM l GROUP BY lag)
SELECT cast(lag AS int) AS lag, round(m + {OFF}, 6) AS mean_return, n AS event_count, round(sum(m) OVER (ORDER BY lag) + {OFF}, 6) AS cumulative FROM a"""


# audits -----------------------------------------------------------------------------------------------------------


def audit_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.calendar_gaps(brands(spark, d)), [])


AUDIT_GAPS = f"""WITH {panel_sql()}, s AS (SELECT symbol, day, rn, lag(rn) OVER ({PART}) AS p, lag(day) OVER ({PART}) AS f FROM b WHERE close IS NOT NULL)
SELECT symbol, cast(strftime(f, '%Y%m%d') AS int) AS gap_from, cast(strftime(day, '%Y%m%d') AS int) AS gap_to, rn - p - 1 AS rows FROM s WHERE rn - p > 5"""


def audit_adjustment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.adjustment(brands(spark, d)), [])


AUDIT_ADJUSTMENT = f"WITH {panel_sql()} SELECT symbol, {D}, round(ret + {OFF}, 6) AS ret FROM (SELECT symbol, day, close / nullif({lag()}, 0) - 1 AS ret FROM b WHERE close IS NOT NULL) WHERE abs(ret) > 0.5"


def audit_survivorship(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.survivorship(brands(spark, d)), [])


AUDIT_SURVIVORSHIP = f"WITH {panel_sql()}, l AS (SELECT symbol, max(CASE WHEN close IS NOT NULL THEN day END) AS z FROM b GROUP BY symbol) SELECT count(z) AS n_symbols, count(CASE WHEN z < (SELECT max(day) FROM b) THEN 1 END) AS n_ended, round(count(CASE WHEN z < (SELECT max(day) FROM b) THEN 1 END) / count(z) + {OFF}, 6) AS share FROM l"


def audit_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.density(brands(spark, d), ["open", "close", "volume"]), [])


AUDIT_DENSITY = f"WITH {panel_sql()} " + " UNION ALL ".join(f"SELECT '{s}' AS series, count(*) AS n_cells, count(*) - count({s}) AS n_missing, round(1 - count({s}) / count(*) + {OFF}, 6) AS share, cast(count({s}) = 0 AS int) AS all_missing FROM b" for s in ("open", "close", "volume"))


def audit_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Nations with shipments against all nations."""
    lines = table(spark, d, "lineitem").select("l_suppkey").distinct().join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    have = lines.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"))
    return audit.coverage(have, sectors(spark, d))


AUDIT_COVERAGE = "SELECT n_name AS symbol, 'missing' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)"


def audit_filing_lag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.filing_lag(_filings(spark, d), "visible"), [])


AUDIT_FILING_LAG = f"WITH f AS (SELECT DISTINCT c_nationkey, cast(o_orderdate AS date) AS v FROM orders JOIN customer ON o_custkey = c_custkey) SELECT count(*) AS n_filings, count(CASE WHEN v = last_day(v) THEN 1 END) AS n_month_end, round(count(CASE WHEN v = last_day(v) THEN 1 END) / count(*) + {OFF}, 6) AS share FROM f"


def audit_membership(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.membership(evaluate(brands(spark, d), parse("is_largest(volume, 5)")), "v"), [])


AUDIT_MEMBERSHIP = f"WITH {panel_sql()} SELECT {D}, least(count(volume), 5) AS members FROM b GROUP BY day"


def audit_statuses(spark: SparkSession, d: str) -> DataFrame:
    return audit.statuses(nations(spark, d), sectors(spark, d), ["close", "volume"])


AUDIT_STATUSES = f"""WITH {panel_sql('nations')}, v AS (SELECT *, lag(close) OVER ({PART}) AS p, rn - lag(rn) OVER ({PART}) AS step FROM b WHERE close IS NOT NULL),
c AS (SELECT 'coverage' AS "check", 'fail' AS bad, (SELECT count(*) FROM nation WHERE n_name NOT IN (SELECT symbol FROM b)) AS found UNION ALL SELECT 'calendar_gaps', 'warn', (SELECT count(*) FROM v WHERE step > 5)
 UNION ALL SELECT 'adjustment', 'warn', (SELECT count(*) FROM v WHERE abs(close / nullif(p, 0) - 1) > 0.5) UNION ALL SELECT 'survivorship', 'warn', (SELECT cast(count(*) = 0 AS int) FROM (SELECT max(day) AS z FROM v GROUP BY symbol) WHERE z < (SELECT max(day) FROM b))
 UNION ALL SELECT 'density', 'fail', (SELECT cast(count(close) = 0 AS int) + cast(count(volume) = 0 AS int) FROM b))
SELECT "check", CASE WHEN found > 0 THEN bad ELSE 'ok' END AS status, found FROM c"""


def cohort_percentile(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return audit.cohort_percentile(parts, "p_brand", "p_retailprice").select("p_partkey", R("pctile").alias("pctile"))


COHORT = f"SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + count(*) OVER (PARTITION BY p_brand, p_retailprice) / 2.0) / count(*) OVER (PARTITION BY p_brand) * 100 + {OFF}, 6) AS pctile FROM part"


# universes --------------------------------------------------------------------------------------------------------

AS_OF, SINCE = "2023-06-30", "2023-03-01"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "index_changes").select("change_id", F.upper(F.trim("index_name")).alias("index_name"), unpacked("change_date").alias("day"), tidy("added").alias("added"), tidy("removed").alias("removed"))
    return universe.steps(log.distinct(), ["index_name"], "day", "added", "removed", "change_id")


STEPS = """WITH c AS (SELECT DISTINCT change_id, upper(trim(index_name)) AS index_name, nullif(upper(trim(added)), '') AS a, nullif(upper(trim(removed)), '') AS r, cast(try_strptime(cast(change_date AS varchar), '%Y%m%d') AS date) AS day FROM index_changes),
s AS (SELECT index_name, day, a AS symbol, true AS came, change_id * 2 + 1 AS k FROM c WHERE day IS NOT NULL AND a IS NOT NULL UNION ALL SELECT index_name, day, r, false, change_id * 2 FROM c WHERE day IS NOT NULL AND r IS NOT NULL),
t AS (SELECT index_name, symbol, arg_max(came, (day, k)) AS now FROM s GROUP BY ALL)"""


def _asof_sql(day: str) -> str:
    return f"SELECT t.index_name, t.symbol FROM t LEFT JOIN (SELECT index_name, symbol, arg_min(came, (day, k)) AS came FROM s WHERE day > DATE '{day}' GROUP BY ALL) f USING (index_name, symbol) WHERE coalesce(NOT f.came, t.now)"


def universe_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The members of every index at the end of a day, found by undoing later changes."""
    s = _steps(spark, d)
    return universe.members_as_of(universe.current(s, ["index_name"]), s, ["index_name"], AS_OF)


def universe_ever(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    return universe.ever_members(universe.current(s, ["index_name"]), s, ["index_name"], SINCE, AS_OF)


def universe_panel(spark: SparkSession, d: str) -> DataFrame:
    """Who was a member of which index on each trading day, among all that ever were."""
    s = _steps(spark, d)
    out = universe.membership(universe.current(s, ["index_name"]), s, ["index_name"], table(spark, d, "trading_days"), s)
    return rounded(out, ["index_name", "day", "symbol", "member"])


UNIVERSE_PANEL = f"""{STEPS}, g AS (SELECT t.index_name, t.symbol, t.now, cast(y.day AS date) AS day FROM t CROSS JOIN (SELECT DISTINCT day FROM trading_days) y)
SELECT g.index_name, {D.replace('day,', 'g.day,')}, g.symbol, round(CASE WHEN coalesce(NOT arg_min(s.came, (s.day, s.k)), any_value(g.now)) THEN 1.0 ELSE 0.0 END + {OFF}, 6) AS member
FROM g LEFT JOIN s ON s.index_name = g.index_name AND s.symbol = g.symbol AND s.day > g.day GROUP BY g.index_name, g.day, g.symbol"""


# sources and streams ----------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def source_wide(spark: SparkSession, d: str) -> DataFrame:
    """A panel written as a wide gzip CSV and read again."""
    panel, path = brands(spark, d, "month"), _folder(spark, "wide")
    files.write_wide(panel, "close", path, [r[0] for r in panel.select("symbol").distinct().orderBy("symbol").collect()])
    return rounded(files.read_wide(spark, path, "close"), ["day", "symbol", "close"])


SOURCE_WIDE = f"WITH {panel_sql(grain='month')} SELECT {D}, symbol, round(close + {OFF}, 6) AS close FROM b"


def source_series(spark: SparkSession, d: str) -> DataFrame:
    """Series written as gzip CSV by symbol and read again."""
    path = _folder(spark, "series")
    files.write_series(brands(spark, d, "month").where("close IS NOT NULL"), path, ["open", "high", "low", "close", "volume"])
    return rounded(files.read_partitioned(spark, path, ["open", "high", "low", "close", "volume"]), ["day", "symbol", "open", "close", "volume"])


SOURCE_SERIES = f"WITH {panel_sql(grain='month')} SELECT {D}, symbol, round(open + {OFF}, 6) AS open, round(close + {OFF}, 6) AS close, round(volume + {OFF}, 6) AS volume FROM b WHERE close IS NOT NULL"


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet")


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of event values per type, from a stream over the events."""
    out = stream.drained(stream.tumbling_bars(_events(spark, d), "ts", "event_type", "value"), _folder(spark, "bars"), "complete")
    return out.select("key", packed("start").alias("day"), "open", "high", "low", "close", "n")


STREAM_BARS = "SELECT event_type AS key, cast(strftime(ts, '%Y%m%d') AS int) AS day, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL"


def stream_ema(spark: SparkSession, d: str) -> DataFrame:
    """A smoothed value per event type, its state carried through the stream: the last value of each."""
    out = stream.drained(stream.smoothed(_events(spark, d).select("event_type", "ts", "value"), "event_type", "ts", "value", 9), _folder(spark, "ema"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), R(F.max_by("ema", F.struct("ts", "value"))).alias("ema"))


STREAM_EMA = f"""WITH RECURSIVE e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS rn FROM events),
s AS (SELECT event_type, rn, value AS v FROM e WHERE rn = 1 UNION ALL SELECT s.event_type, e.rn, s.v + 0.2 * (e.value - s.v) FROM s JOIN e ON e.event_type = s.event_type AND e.rn = s.rn + 1)
SELECT event_type, count(*) AS n, round(arg_max(v, rn) + {OFF}, 6) AS ema FROM s GROUP BY event_type"""


def queries() -> dict:
    made = [join_align, join_as_of, join_reindex, nav_buy_hold, nav_costs, nav_strategy, nav_trades, metrics_summary, metrics_yearly, metrics_trailing, metrics_rolling, metrics_drawdowns, metrics_against, metrics_trades, metrics_correlation, metrics_beating, metrics_month_grid, metrics_year_table, metrics_equal_weight, metrics_bootstrap, research_sweep, research_lookahead, research_walk_forward, research_walk_curve, research_ic, research_buckets, research_factor, research_events, audit_gaps, audit_adjustment, audit_survivorship, audit_density, audit_coverage, audit_filing_lag, audit_membership, audit_statuses, cohort_percentile, universe_as_of, universe_ever, universe_panel, source_wide, source_series, stream_bars, stream_ema]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict:
    return {"join_align": JOIN_ALIGN, "join_as_of": JOIN_AS_OF, "join_reindex": JOIN_REINDEX, "nav_buy_hold": NAV_BUY_HOLD, "nav_trades": NAV_TRADES, "nav_costs": NAV_COSTS, "research_sweep": RESEARCH_SWEEP, "research_lookahead": RESEARCH_LOOKAHEAD, "research_walk_forward": RESEARCH_WALK_FORWARD, "research_walk_curve": RESEARCH_WALK_CURVE, "research_factor": RESEARCH_FACTOR, "audit_statuses": AUDIT_STATUSES, "metrics_summary": METRICS_SUMMARY, "metrics_yearly": METRICS_YEARLY, "metrics_trailing": METRICS_TRAILING, "metrics_rolling": METRICS_ROLLING, "metrics_drawdowns": METRICS_DRAWDOWNS, "metrics_against": METRICS_AGAINST, "metrics_trades": METRICS_TRADES, "metrics_correlation": METRICS_CORRELATION, "metrics_beating": METRICS_BEATING, "metrics_month_grid": METRICS_MONTH_GRID, "metrics_year_table": METRICS_YEAR_TABLE, "metrics_equal_weight": METRICS_EQUAL_WEIGHT, "universe_as_of": f"{STEPS} {_asof_sql(AS_OF)}", "universe_ever": f"{STEPS} {_asof_sql(SINCE)} UNION SELECT index_name, symbol FROM s WHERE day BETWEEN DATE '{SINCE}' AND DATE '{AS_OF}'", "universe_panel": UNIVERSE_PANEL, "research_ic": RESEARCH_IC, "research_buckets": RESEARCH_BUCKETS, "research_events": RESEARCH_EVENTS, "audit_gaps": AUDIT_GAPS, "audit_adjustment": AUDIT_ADJUSTMENT, "audit_survivorship": AUDIT_SURVIVORSHIP, "audit_density": AUDIT_DENSITY, "audit_coverage": AUDIT_COVERAGE, "audit_filing_lag": AUDIT_FILING_LAG, "audit_membership": AUDIT_MEMBERSHIP, "cohort_percentile": COHORT, "source_wide": SOURCE_WIDE, "source_series": SOURCE_SERIES, "stream_bars": STREAM_BARS, "stream_ema": STREAM_EMA}
