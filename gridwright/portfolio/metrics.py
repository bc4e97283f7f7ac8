"""Metrics and report series of equity curves and trades, per variant."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import ratio

YEAR_SECONDS = 31_557_600.0
DAYS = 252.0


def along() -> Window:
    return Window.partitionBy("variant").orderBy("day")


def returns(equity: DataFrame) -> DataFrame:
    """variant, day, equity, ret: simple returns, NULL on the first day; and dd, the distance below the running peak."""
    peak = F.max("equity").over(along().rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("equity").over(along())
    return equity.withColumns({"ret": ratio(F.col("equity") - before, before), "dd": F.col("equity") / F.nullif(peak, F.lit(0.0)) - 1.0})


def summary(equity: DataFrame) -> DataFrame:
    """One row per variant: return, risk, drawdown and distribution figures. Undefined figures are NULL."""
    r = returns(equity)
    under = (F.col("dd") < 0).cast("int")
    r = r.withColumn("_up", F.sum(1 - under).over(along()))
    runs = r.where("dd < 0").groupBy("variant", "_up").agg(F.count(F.lit(1)).alias("_len")).groupBy("variant").agg(F.max("_len").alias("max_drawdown_duration"))
    risk = F.greatest(F.stddev_samp("ret"), F.lit(1e-6))
    below = F.greatest(F.stddev_samp(F.least("ret", F.lit(0.0))), F.lit(1e-6))
    tail = F.percentile("ret", 0.05)
    out = r.groupBy("variant").agg(
        (F.max_by("equity", "day") / F.min_by("equity", "day") - 1.0).alias("total_return"),
        (F.datediff(F.max("day"), F.min("day")) * 86400.0 / YEAR_SECONDS).alias("years"),
        (F.stddev_samp("ret") * float(np.sqrt(DAYS))).alias("volatility"),
        (F.avg("ret") / risk * float(np.sqrt(DAYS))).alias("sharpe"),
        (F.avg("ret") / below * float(np.sqrt(DAYS))).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
        F.avg("dd").alias("avg_drawdown"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"),
        F.max("ret").alias("best_day"),
        F.min("ret").alias("worst_day"),
        F.skewness("ret").alias("skew"),
        F.kurtosis("ret").alias("kurtosis"),
        tail.alias("var_95"),
    )
    cut = r.join(out.select("variant", "var_95"), "variant").where(F.col("ret") <= F.col("var_95")).groupBy("variant").agg(F.avg("ret").alias("cvar_95"))
    out = out.join(runs, "variant", "left").join(cut, "variant", "left")
    grown = F.when((F.col("years") > 0) & (F.col("total_return") > -1), F.pow(1.0 + F.col("total_return"), 1.0 / F.nullif(F.col("years"), F.lit(0.0))) - 1.0)
    deep = F.abs("max_drawdown")
    out = out.withColumn("cagr", grown).withColumns({"calmar": ratio(F.col("cagr"), deep), "recovery_factor": ratio(F.col("total_return"), deep)})
    return out.withColumn("max_drawdown_duration", F.coalesce("max_drawdown_duration", F.lit(0)))


def per_period(equity: DataFrame, period: str) -> DataFrame:
    """variant, period (its first day), ret: chained off the close of the period before (the first off its own first value)."""
    last = equity.groupBy("variant", F.trunc("day", period).alias("period")).agg(F.max_by("equity", "day").alias("_last"), F.min_by("equity", "day").alias("_first"))
    before = F.coalesce(F.lag("_last").over(Window.partitionBy("variant").orderBy("period")), F.col("_first"))
    return last.select("variant", "period", (F.col("_last") / before - 1.0).alias("ret"))


def trailing(equity: DataFrame, years: int | None) -> DataFrame:
    """variant, ret since the last point on or before the last day less ``years``; None means since the year began."""
    end = equity.groupBy("variant").agg(F.max("day").alias("_end"), F.max_by("equity", "day").alias("_now"))
    anchor = F.date_sub(F.trunc("_end", "year"), 1) if years is None else F.add_months("_end", -12 * years)
    met = equity.join(end, "variant").where(F.col("day") <= anchor)
    return met.groupBy("variant").agg((F.first("_now") / F.max_by("equity", "day") - 1.0).alias("ret"))


def rolling(equity: DataFrame, window: int = 252) -> DataFrame:
    """variant, day, rolling_volatility, rolling_sharpe over ``window`` returns."""
    w = along().rowsBetween(1 - window, 0)
    n = F.count("ret").over(w)
    sd, mean = F.stddev_samp("ret").over(w), F.avg("ret").over(w)
    root = float(np.sqrt(DAYS))
    return returns(equity).select("variant", "day", F.when(n == window, sd * root).alias("rolling_volatility"), F.when(n == window, mean / F.greatest(sd, F.lit(1e-6)) * root).alias("rolling_sharpe"))


def drawdown_episodes(equity: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` deepest stretches below a peak per variant: first day, trough, last day, depth, length."""
    r = returns(equity).withColumn("_up", F.sum((F.col("dd") >= 0).cast("int")).over(along()))
    runs = r.where("dd < 0").groupBy("variant", "_up").agg(F.min("day").alias("first_day"), F.min_by("day", "dd").alias("trough_day"), F.max("day").alias("last_day"), F.min("dd").alias("depth"), F.count(F.lit(1)).alias("length"))
    place = F.row_number().over(Window.partitionBy("variant").orderBy("depth", "first_day"))
    return runs.withColumn("_p", place).where(F.col("_p") <= top).drop("_p", "_up")


def against(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta, alpha, tracking error and the like against a benchmark (day, level), read backward onto each variant's days."""
    b = benchmark.groupBy("day").agg(F.max("level").alias("level")).where(F.col("level").isNotNull())
    rows = equity.select("variant", "day", "equity", F.lit(1).alias("_own"), F.lit(None).cast("double").alias("level"))
    add = equity.select("variant").distinct().select("variant", b.agg(F.array_sort(F.collect_list(F.struct("day", "level")))).scalar().alias("_b")).select("variant", F.inline("_b")).select("variant", "day", F.lit(None).cast("double").alias("equity"), F.lit(0).alias("_own"), "level")
    w = Window.partitionBy("variant").orderBy("day", "_own").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(add).withColumn("level", F.last("level", ignorenulls=True).over(w)).where("_own = 1")
    before = lambda c: F.lag(c).over(along())
    pair = both.withColumns({"r": F.col("equity") / before("equity") - 1.0, "m": F.col("level") / before("level") - 1.0})
    ok = pair.where("r IS NOT NULL AND m IS NOT NULL")
    beta = F.covar_samp("r", "m") / F.nullif(F.var_samp("m"), F.lit(0.0))
    te = F.stddev_samp(F.col("r") - F.col("m"))
    out = ok.groupBy("variant").agg(beta.alias("beta"), ((F.avg("r") - beta * F.avg("m")) * DAYS).alias("alpha"), (te * float(np.sqrt(DAYS))).alias("tracking_error"), (F.avg(F.col("r") - F.col("m")) / F.nullif(te, F.lit(0.0)) * float(np.sqrt(DAYS))).alias("information_ratio"))
    whole = both.where("level IS NOT NULL").groupBy("variant").agg((F.max_by("level", "day") / F.min_by("level", "day") - 1.0).alias("benchmark_return"))
    return out.join(whole, "variant")


def equal_weight(panel: DataFrame, series: str = "close") -> DataFrame:
    """day, level: all symbols of a panel equally weighted and rebalanced daily, from 1; only symbols with a positive value the day before and one today count."""
    before = F.lag(series).over(Window.partitionBy("symbol").orderBy("day"))
    moves = panel.withColumn("_m", F.when(before > 0, F.col(series) / F.nullif(before, F.lit(0.0)) - 1.0))
    daily = moves.groupBy("day").agg(F.coalesce(F.avg("_m"), F.lit(0.0)).alias("_m"))
    # a row a day; a loss of everything leaves 0 for good
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(F.when(F.col("_m") > -1, F.log1p("_m")).otherwise(0.0)).over(upto))
    return daily.select("day", F.when(F.min("_m").over(upto) > -1, grown).otherwise(0.0).alias("level"))


def _beside(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """variant, day, equity, level: each variant's days with the benchmark's level of the same day, NULL where it has none."""
    b = benchmark.groupBy("day").agg(F.max("level").alias("level"))
    return equity.select("variant", "day", "equity").join(b, "day", "left")


def rolling_correlation(equity: DataFrame, benchmark: DataFrame, window: int = 252) -> DataFrame:
    """variant, day, correlation of daily returns with the benchmark's over ``window`` days, where at least nine tenths of them have both; else NULL."""
    before = lambda c: F.lag(c).over(along())
    r = lambda c: F.col(c) / F.nullif(before(c), F.lit(0.0)) - 1.0
    both = _beside(equity, benchmark).withColumns({"_r": r("equity"), "_m": r("level"), "_no": F.row_number().over(along())})
    ok = F.col("_r").isNotNull() & F.col("_m").isNotNull()
    w = along().rowsBetween(1 - window, 0)
    x, y = F.when(ok, F.col("_r")), F.when(ok, F.col("_m"))
    spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    value = F.covar_pop(x, y).over(w) / F.nullif(spread, F.lit(0.0))
    return both.select("variant", "day", F.when((F.col("_no") > window) & (F.count(x).over(w) >= 0.9 * window), value).alias("correlation"))


def share_beating(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """variant, share of days on which the curve lies at or above the benchmark, both rebased to their first common day."""
    both = _beside(equity, benchmark).where("equity IS NOT NULL AND level IS NOT NULL")
    start = both.groupBy("variant").agg(F.min_by("equity", "day").alias("_e"), F.min_by("level", "day").alias("_l"))
    won = F.col("equity") * F.col("_l") >= F.col("level") * F.col("_e")
    return both.join(start, "variant").groupBy("variant").agg(F.avg(won.cast("double")).alias("share_beating"))


def month_grid(equity: DataFrame) -> DataFrame:
    """variant, year, m1 to m12 and total: returns by month and year."""
    months = per_period(equity, "month").select("variant", F.year("period").alias("year"), F.month("period").alias("_m"), "ret")
    grid = months.groupBy("variant", "year").agg(*[F.max(F.when(F.col("_m") == k, F.col("ret"))).alias(f"m{k}") for k in range(1, 13)])
    return grid.join(per_period(equity, "year").select("variant", F.year("period").alias("year"), F.col("ret").alias("total")), ["variant", "year"])


def year_table(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """variant, year, strategy, benchmark, excess: yearly returns beside the benchmark's; NULL where that has none."""
    own = per_period(equity, "year").select("variant", F.year("period").alias("year"), F.col("ret").alias("strategy"))
    level = benchmark.where(F.col("level").isNotNull()).select(F.lit("").alias("variant"), "day", F.col("level").alias("equity"))
    other = per_period(level, "year").select(F.year("period").alias("year"), F.col("ret").alias("benchmark"))
    return own.join(other, "year", "left").select("variant", "year", "strategy", "benchmark", (F.col("strategy") - F.col("benchmark")).alias("excess"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """One row per variant over closed trades; profit factor is infinite without losses."""
    t = trades.where(F.col("exit_day").isNotNull())
    win, lose = F.col("ret") > 0, F.col("ret") < 0
    order = Window.partitionBy("variant").orderBy("exit_day", "symbol", "entry_day")
    runs = t.withColumn("_w", F.sum(F.when(lose, 0).otherwise(1)).over(order)).where(lose).groupBy("variant", "_w").agg(F.count(F.lit(1)).alias("_n")).groupBy("variant").agg(F.max("_n").alias("max_consecutive_losses"))

    def share(a: Column, b: Column) -> Column:
        return ratio(a, b)

    out = t.groupBy("variant").agg(
        F.count(F.lit(1)).alias("num_trades"),
        F.avg(win.cast("double")).alias("win_rate"),
        share(F.coalesce(F.sum(F.when(win, F.col("ret"))), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(lose, F.col("ret"))), F.lit(0.0)))).alias("profit_factor"),
        F.avg("ret").alias("expectancy"),
        F.avg("period").alias("avg_holding_period"),
        F.avg(F.when(win, F.col("ret"))).alias("avg_win"),
        F.avg(F.when(lose, F.col("ret"))).alias("avg_loss"),
        F.max("ret").alias("best_trade"),
        F.min("ret").alias("worst_trade"),
    )
    return out.withColumn("payoff_ratio", F.col("avg_win") / F.abs(F.nullif("avg_loss", F.lit(0.0)))).join(runs, "variant", "left").fillna(0, ["max_consecutive_losses"])


def exposure_summary(equity: DataFrame) -> DataFrame:
    return equity.groupBy("variant").agg(F.avg((F.col("exposure") > 0).cast("double")).alias("time_in_market"), F.avg("exposure").alias("avg_exposure"))


def histogram(trades: DataFrame, width: float = 0.05) -> DataFrame:
    return trades.where(F.col("exit_day").isNotNull()).groupBy("variant", (F.floor(F.col("ret") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bootstrap(equity: DataFrame, samples: int, block: int = 0, seed: int = 0x00C17A05) -> DataFrame:
    """variant, figure, p05, p50, p95 of Sharpe, growth and drawdown over circular block resamples of the returns.

    ``block`` 0 takes the root of the number of returns. One stream of a counter-based generator per variant, drawn in order, so runs repeat.
    """
    r = returns(equity).where("ret IS NOT NULL").groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("day", "ret"))).alias("_r"))
    r = r.select("variant", F.transform("_r", lambda x: x.ret).alias("rets"))

    def draw(batches):
        for batch in batches:
            rows = []
            for variant, rets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(rets)
                n = len(x)
                size = block or max(1, int(np.sqrt(n)))
                state = np.uint64(seed)
                figures = []
                for _ in range(samples):
                    picked = []
                    while len(picked) < n:
                        state, word = _split_mix(state)
                        begin = int(word % np.uint64(n))
                        picked.extend((begin + k) % n for k in range(min(size, n - len(picked))))
                    y = x[picked]
                    curve = np.concatenate([[1.0], np.cumprod(1.0 + y)])
                    sd = max(y.std(ddof=1) if n > 1 else 0.0, 1e-6)
                    figures.append((y.mean() / sd * np.sqrt(DAYS), curve[-1] ** (DAYS / n) - 1.0, (curve / np.maximum.accumulate(curve) - 1.0).min()))
                for name, column in zip(("sharpe", "cagr", "max_drawdown"), np.sort(np.array(figures), axis=0).T, strict=True):
                    at = [column[min(samples - 1, max(0, int(np.ceil(q * samples)) - 1))] for q in (0.05, 0.5, 0.95)]
                    rows.append((variant, name, *map(float, at)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.float64()) for i, c in enumerate(cols)], names=["variant", "figure", "p05", "p50", "p95"])

    return r.mapInArrow(draw, "variant string, figure string, p05 double, p50 double, p95 double")


def _split_mix(state: np.uint64) -> tuple[np.uint64, np.uint64]:
    """The next state and word of the public SplitMix64 generator (fixed constants)."""
    with np.errstate(over="ignore"):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return state, z ^ (z >> np.uint64(31))
