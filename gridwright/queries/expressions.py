"""One query for every expression tag, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.columns import packed
from gridwright.plans.compile import evaluate
from gridwright.plans.dsl import parse
from gridwright.queries.bars import brands, nations, panel_sql, sectors

#: added before rounding on both sides: the engines round exact halves differently
OFF = 2e-8
PART = "PARTITION BY symbol ORDER BY day"


def over(n: int) -> str:
    return f"OVER ({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(f: str, n: int, x: str = "close") -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {f}({x}) {over(n)} END"


def mean(n: int, x: str = "close") -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {max(n // 2, 1)} THEN avg({x}) {over(n)} END"


def lag(x: str = "close", n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({PART})"


def unit(x: str) -> str:
    return f"CASE WHEN coalesce({x}, false) THEN 1.0 ELSE 0.0 END"


def ranked(x: str, way: str = "", within: str = "day") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {within} ORDER BY {x} {way} NULLS LAST) + (count(*) OVER (PARTITION BY {within}, {x}) - 1) / 2.0 END"


def simple(value: str, source: str = "b", more: str = "") -> str:
    """A query of day, symbol and one value over the panel; ``more`` holds further CTEs."""
    return f"{more}\nSELECT day, symbol, round(cast({value} AS double) + {OFF}, 6) AS v FROM {source}"


# recurrences: a seed row per symbol, then one row a step


def ema(src: str, x: str, n: int, out: str) -> str:
    """CTE ``out`` (symbol, rn, v)."""
    return f""", {out}_f AS (SELECT symbol, min(CASE WHEN {x} IS NOT NULL THEN rn END) AS f FROM {src} GROUP BY symbol),
{out} AS (SELECT p.symbol, f.f + {n - 1} AS rn, avg(p.{x}) AS v FROM {src} p JOIN {out}_f f ON f.symbol = p.symbol AND p.rn BETWEEN f.f AND f.f + {n - 1} GROUP BY p.symbol, f.f HAVING count(p.{x}) = {n}
 UNION ALL SELECT e.symbol, e.rn + 1, CASE WHEN p.{x} IS NULL THEN e.v ELSE e.v + 2.0 / {n + 1} * (p.{x} - e.v) END FROM {out} e JOIN {src} p ON p.symbol = e.symbol AND p.rn = e.rn + 1)"""


def wilder(src: str, x: str, first: str, n: int, out: str) -> str:
    """CTE ``out`` (symbol, rn, v); ``first`` names a CTE of symbol and f, the row before the seed's first."""
    return f""", {out} AS (SELECT p.symbol, f.f + {n} AS rn, CASE WHEN count(p.{x}) = {n} THEN avg(p.{x}) END AS v FROM {src} p JOIN {first} f ON f.symbol = p.symbol AND p.rn BETWEEN f.f + 1 AND f.f + {n} GROUP BY p.symbol, f.f HAVING count(*) = {n}
 UNION ALL SELECT e.symbol, e.rn + 1, (e.v * {n - 1} + p.{x}) / {n} FROM {out} e JOIN {src} p ON p.symbol = e.symbol AND p.rn = e.rn + 1)"""


FIRST = ", born AS (SELECT symbol, min(CASE WHEN close IS NOT NULL THEN rn END) AS f FROM b GROUP BY symbol)"
RANGE = f""", t AS (SELECT *, greatest(high - low, abs(high - {lag()}), abs(low - {lag()})) AS tr, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM b),
u AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM t)"""
N = 5


def joined(out: str, value: str, more: str) -> str:
    return f"{more}\nSELECT b.day, b.symbol, round(cast({value} AS double) + {OFF}, 6) AS v FROM b LEFT JOIN {out} USING (symbol, rn)"


_DI = f"""{FIRST}{RANGE}{wilder('u', 'pdm', 'born', N, 'wp')}{wilder('u', 'mdm', 'born', N, 'wm')}{wilder('u', 'tr', 'born', N, 'wt')},
di AS (SELECT symbol, rn, 100 * wp.v / nullif(wt.v, 0) AS pdi, 100 * wm.v / nullif(wt.v, 0) AS mdi FROM wp JOIN wm USING (symbol, rn) JOIN wt USING (symbol, rn)),
dx AS (SELECT b.symbol, b.rn, CASE WHEN pdi + mdi = 0 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS d FROM b LEFT JOIN di USING (symbol, rn)),
dxf AS (SELECT symbol, f + {N - 1} AS f FROM born)"""
_MACD = ema("b", "close", 4, "ef") + ema("b", "close", 8, "es") + ", ml AS (SELECT b.symbol, b.rn, ef.v - es.v AS m FROM b LEFT JOIN ef USING (symbol, rn) LEFT JOIN es USING (symbol, rn))" + ema("ml", "m", 3, "sg")
_RSI = FIRST + f""", dd AS (SELECT symbol, rn, greatest(coalesce(close - {lag()}, 0), 0) AS g, greatest(-coalesce(close - {lag()}, 0), 0) AS l FROM b){wilder('dd', 'g', 'born', N, 'rg')}{wilder('dd', 'l', 'born', N, 'rl')},
rs AS (SELECT symbol, rn, CASE WHEN rl.v = 0 THEN 100 ELSE 100 - 100 / (1 + rg.v / rl.v) END AS v FROM rg JOIN rl USING (symbol, rn))"""
_TP = f", p AS (SELECT *, (high + low + close) / 3 AS tp, count(close) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS born FROM b)"
_SPAN = f"({full('max', N, 'high')} - {full('min', N, 'low')})"
_K = f"100 * (close - {full('min', N, 'low')}) / nullif({_SPAN}, 0)"
_MFI = f"""{_TP}, m AS (SELECT *, {lag('born')} > 0 AS started, CASE WHEN {lag('born')} > 0 AND tp > {lag('tp')} THEN tp * volume ELSE 0 END AS up, CASE WHEN {lag('born')} > 0 AND tp < {lag('tp')} THEN tp * volume ELSE 0 END AS down FROM p),
q AS (SELECT *, sum(CASE WHEN started THEN 1 ELSE 0 END) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS age, {full('sum', N, 'up')} AS u, {full('sum', N, 'down')} AS d FROM m)"""
_OBV = f"""{_TP}, o AS (SELECT *, CASE WHEN born > 0 AND coalesce({lag('born')}, 0) = 0 THEN volume WHEN born > 0 AND close > {lag()} THEN volume WHEN born > 0 AND close < {lag()} THEN -volume ELSE 0 END AS step FROM p)"""
_CROSS = f", x AS (SELECT *, {unit(f'close > {mean(N)}')} AS c FROM b)"
_EXIT = f""", x AS (SELECT *, close > {mean(N)} AS e, close < {full('min', 3, 'close')} * 1.000001 AS l FROM b),
y AS (SELECT *, CASE WHEN coalesce(e, false) AND NOT coalesce({lag('coalesce(e, false)')}, false) THEN 1.0 WHEN (NOT coalesce(e, false) AND coalesce({lag('coalesce(e, false)')}, false)) OR coalesce(l, false) THEN 0.0 END AS s FROM x)"""
_SEC = ", s AS (SELECT b.*, coalesce(r_name, '其他') AS sector FROM b LEFT JOIN nation ON n_name = symbol LEFT JOIN region ON r_regionkey = n_regionkey)"
_VT = f""", w AS (SELECT *, close / nullif(sum(close) OVER (PARTITION BY day), 0) AS wt FROM b), c AS (SELECT *, coalesce({lag('wt')}, 0) * coalesce(close / nullif({lag()}, 0) - 1, 0) AS part FROM w),
dy AS (SELECT day, sum(part) AS r FROM c GROUP BY day), sc AS (SELECT day, row_number() OVER (ORDER BY day) AS k, stddev_samp(r) OVER (ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) * sqrt(252.0) AS vol FROM dy)"""

_RANKED = "len(list_filter(range(1, len(en) + 1), lambda j: pts[j] > pts[i] OR (pts[j] = pts[i] AND j > i))) < 4"
# a rotation step by step: lists over the symbols of a day
_HOLD = f""", x AS (SELECT *, coalesce(close > {mean(5)}, false) AS e, coalesce(close < {lag()}, false) AS l, coalesce((volume - min(volume) OVER ()) / nullif(max(volume) OVER () - min(volume) OVER (), 0), 0) AS sc FROM b),
y AS (SELECT day, row_number() OVER (ORDER BY day) AS r, list(e ORDER BY ord) AS en, list(l ORDER BY ord) AS lv, list(sc ORDER BY ord) AS sc, list(symbol ORDER BY ord) AS sy FROM x GROUP BY day),
h AS (SELECT r, held FROM (SELECT r, list_transform(range(1, len(en) + 1), lambda i: {_RANKED} AND en[i] AND NOT lv[i]) AS held FROM (SELECT *, list_transform(en, lambda v: CASE WHEN v THEN 1.0 ELSE 0.0 END) AS pts FROM y WHERE r = 1))
 UNION ALL SELECT r, list_transform(range(1, len(en) + 1), lambda i: {_RANKED} AND pts[i] >= 0) FROM (SELECT *, list_transform(range(1, len(en) + 1), lambda i: CASE WHEN lv[i] OR NOT (en[i] OR was[i]) THEN -1.0 ELSE CASE WHEN en[i] THEN sc[i] ELSE 0 END + CASE WHEN was[i] THEN 3.0 ELSE 0 END END) AS pts FROM (SELECT y.*, h.held AS was FROM h JOIN y ON y.r = h.r + 1)))
SELECT day, symbol, round(CASE WHEN held THEN 1.0 ELSE 0.0 END + 2e-8, 6) AS v FROM (SELECT day, unnest(sy) AS symbol, unnest(held) AS held FROM y JOIN h USING (r))"""


#: name -> (expression, panel, SQL after the panel's CTEs); panels: day and month of brands, nat of nations with regions as sectors
OPS: dict[str, tuple[str, str, str]] = {
    "op01_data": ("close", "day", simple("close")),
    "op02_const": ("close + 1.5", "day", simple("close + 1.5")),
    "op03_gt": ("close > open", "day", simple(unit("close > open"))),
    "op04_lt": ("close < 1500", "day", simple(unit("close < 1500"))),
    "op05_ge": ("close >= open", "day", simple(unit("close >= open"))),
    "op06_le": ("high <= close", "day", simple(unit("high <= close"))),
    "op07_and": ("close > open and volume > 30", "day", simple(unit("close > open AND volume > 30"))),
    "op08_or": ("close > open or volume > 30", "day", simple(unit("coalesce(close > open, false) OR coalesce(volume > 30, false)"))),
    "op09_not": ("not (close > open)", "day", simple(unit("NOT coalesce(close > open, false)"))),
    "op10_add": ("close + open", "day", simple("close + open")),
    "op11_sub": ("high - low", "day", simple("high - low")),
    "op12_mul": ("close * volume", "day", simple("close * volume")),
    "op13_div": ("(high - low) / (close - close)", "day", simple("CASE WHEN high - low > 0 THEN 'inf'::double END")),
    "op14_neg": ("-close", "day", simple("-close")),
    "op15_ceil": ("ceil(close)", "day", simple("ceil(close)")),
    "op16_mask": ("mask(close, volume > 30)", "day", simple("CASE WHEN volume > 30 THEN close END")),
    "op17_sma": ("sma(close, 20)", "day", simple(mean(20))),
    "op18_ema": (f"ema(close, {N})", "day", joined("e", "e.v", ema("b", "close", N, "e"))),
    "op19_std": (f"std(close, {N})", "day", simple(full("stddev_pop", N))),
    "op20_rsi": (f"rsi(close, {N})", "day", joined("rs", "rs.v", _RSI)),
    "op21_pct_change": ("pct_change(close, 3)", "day", simple(f"(close - {lag(n=3)}) / {lag(n=3)}")),
    "op22_rise": ("rise(close, 2)", "day", simple(unit(f"close > {lag(n=2)}"))),
    "op23_fall": ("fall(close, 2)", "day", simple(unit(f"close < {lag(n=2)}"))),
    "op24_shift": ("shift(close, 4)", "day", simple(lag(n=4))),
    "op25_rolling_max": (f"rolling_max(close, {N})", "day", simple(full("max", N))),
    "op26_rolling_min": (f"rolling_min(close, {N})", "day", simple(full("min", N))),
    "op27_bollinger_mid": (f"bollinger_mid(close, {N})", "day", simple(mean(N))),
    "op28_bollinger_upper": (f"bollinger_upper(close, {N})", "day", simple(f"{mean(N)} + 2 * {full('stddev_pop', N)}")),
    "op29_bollinger_lower": (f"bollinger_lower(close, {N}, k=1.5)", "day", simple(f"{mean(N)} - 1.5 * {full('stddev_pop', N)}")),
    "op30_macd": ("macd(close, 4, 8)", "day", joined("ml", "ml.m", _MACD)),
    "op31_macd_signal": ("macd_signal(close, 4, 8, 3)", "day", joined("sg", "sg.v", _MACD)),
    "op32_macd_hist": ("macd_hist(close, 4, 8, 3)", "day", joined("sg", "ml.m - sg.v", _MACD) + " LEFT JOIN ml USING (symbol, rn)"),
    "op33_donchian_high": (f"donchian_high(close, {N})", "day", simple(full("max", N))),
    "op34_donchian_low": (f"donchian_low(close, {N})", "day", simple(full("min", N))),
    "op35_donchian_mid": (f"donchian_mid(close, {N})", "day", simple(f"({full('max', N)} + {full('min', N)}) * 0.5")),
    "op36_atr": (f"atr(high, low, close, {N})", "day", joined("wa", "wa.v", FIRST + RANGE + wilder("u", "tr", "born", N, "wa"))),
    "op37_natr": (f"natr(high, low, close, {N})", "day", joined("wa", "100 * wa.v / nullif(b.close, 0)", FIRST + RANGE + wilder("u", "tr", "born", N, "wa"))),
    "op38_willr": (f"willr(high, low, close, {N})", "day", simple(f"-100 * ({full('max', N, 'high')} - close) / nullif({_SPAN}, 0)")),
    "op39_cci": (f"cci(high, low, close, {N})", "day", simple("(tp - m) / (0.015 * nullif(list_sum(list_transform(l, lambda z: abs(z - m))) / 5, 0))", "q", _TP + f", q AS (SELECT *, {full('avg', N, 'tp')} AS m, list(tp) {over(N)} AS l FROM p)")),
    "op40_stoch_k": (f"stoch_k(high, low, close, {N})", "day", simple(_K)),
    "op41_stoch_d": (f"stoch_d(high, low, close, {N}, 3)", "day", simple(full("avg", 3, "k"), "q", f", q AS (SELECT *, {_K} AS k FROM b)")),
    "op42_aroon_up": (f"aroon_up(high, {N})", "day", simple(f"CASE WHEN count(high) {over(N + 1)} = {N + 1} THEN 100.0 * ({N} - (rn - arg_max(rn, (high, rn)) {over(N + 1)})) / {N} END")),
    "op43_aroon_down": (f"aroon_down(low, {N})", "day", simple(f"CASE WHEN count(low) {over(N + 1)} = {N + 1} THEN 100.0 * ({N} - (rn - arg_min(rn, (low, -rn)) {over(N + 1)})) / {N} END")),
    "op44_adx": (f"adx(high, low, close, {N})", "day", joined("wx", "wx.v", _DI + wilder("dx", "d", "dxf", N, "wx"))),
    "op45_plus_di": (f"plus_di(high, low, close, {N})", "day", joined("di", "di.pdi", _DI)),
    "op46_minus_di": (f"minus_di(high, low, close, {N})", "day", joined("di", "di.mdi", _DI)),
    "op47_obv": ("obv(close, volume)", "day", simple(f"CASE WHEN born > 0 AND max(CASE WHEN born > 0 AND step IS NULL THEN 1 ELSE 0 END) OVER ({PART} ROWS UNBOUNDED PRECEDING) = 0 THEN sum(step) OVER ({PART} ROWS UNBOUNDED PRECEDING) END", "o", _OBV)),
    "op48_mfi": (f"mfi(high, low, close, volume, {N})", "day", simple(f"CASE WHEN age >= {N} THEN CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / nullif(d, 0)) END END", "q", _MFI)),
    "op49_vwap": (f"vwap(high, low, close, volume, {N})", "day", simple(f"CASE WHEN count(tp * volume) {over(N)} = {N} THEN sum(tp * volume) {over(N)} / nullif(sum(volume) {over(N)}, 0) END", "p", _TP)),
    "op50_is_largest": ("is_largest(close, 3)", "day", simple(unit("close IS NOT NULL AND row_number() OVER (PARTITION BY day ORDER BY close DESC NULLS LAST, ord) <= 3"))),
    "op51_is_smallest": ("is_smallest(close, 3)", "day", simple(unit("close IS NOT NULL AND row_number() OVER (PARTITION BY day ORDER BY close NULLS LAST, ord) <= 3"))),
    "op52_rank": ("rank(volume)", "day", simple(f"{ranked('volume')} / nullif(count(volume) OVER (PARTITION BY day), 0)")),
    "op52_rank_desc": ("rank(volume, pct=false, ascending=false)", "day", simple(ranked("volume", "DESC"))),
    "op53_quantile_row": ("quantile_row(close, 0.25)", "day", "\nSELECT day, 'quantile' AS symbol, round(quantile_cont(close, 0.25) + 2e-8, 6) AS v FROM b GROUP BY day"),
    "op54_winsorize": ("winsorize(close, 0.1, 0.9)", "day", simple("CASE WHEN close IS NOT NULL THEN least(greatest(close, quantile_cont(close, 0.1) OVER (PARTITION BY day)), quantile_cont(close, 0.9) OVER (PARTITION BY day)) END")),
    "op55_zscore": ("zscore(close)", "day", simple("CASE WHEN close IS NOT NULL THEN CASE WHEN count(close) OVER (PARTITION BY day) = 1 THEN 0 ELSE (close - avg(close) OVER (PARTITION BY day)) / stddev_pop(close) OVER (PARTITION BY day) END END")),
    "op56_bucket": ("bucket(volume, 4)", "day", simple(f"least(greatest(floor(({ranked('volume')} - 1) / nullif(count(volume) OVER (PARTITION BY day), 0) * 4) + 1, 1), 4)").replace("FROM b", "FROM (SELECT * FROM b)").replace("least(greatest(", "CASE WHEN volume IS NOT NULL THEN least(greatest(").replace(", 1), 4)", ", 1), 4) END")),
    "op57_demean": ("demean(close)", "day", simple("close - avg(close) OVER (PARTITION BY day)")),
    "op58_normalize_row": ("normalize_row(close)", "day", simple("close / sum(abs(close)) OVER (PARTITION BY day)")),
    "op59_sustain": ("sustain(close > sma(close, 5), 4, 3)", "day", simple(unit(f"rn >= 4 AND sum(c) {over(4)} >= 3"), "x", _CROSS)),
    "op60_is_entry": ("is_entry(close > sma(close, 5))", "day", simple(unit(f"c = 1 AND coalesce({lag('c')}, 0) = 0"), "x", _CROSS)),
    "op61_is_exit": ("is_exit(close > sma(close, 5))", "day", simple(unit(f"c = 0 AND coalesce({lag('c')}, 0) = 1"), "x", _CROSS)),
    "op62_exit_when": ("exit_when(close > sma(close, 5), close < rolling_min(close, 3) * 1.000001)", "day", simple(f"coalesce(last_value(s IGNORE NULLS) OVER ({PART} ROWS UNBOUNDED PRECEDING), 0)", "y", _EXIT)),
    "op63_hold_until": ("hold_until(close > sma(close, 5), fall(close, 1), 4, volume)", "day", _HOLD),
    "op63_hold_unlimited": ("hold_until(close > sma(close, 5), fall(close, 2))", "day", simple(f"coalesce(last_value(s IGNORE NULLS) OVER ({PART} ROWS UNBOUNDED PRECEDING), 0)", f"(SELECT *, CASE WHEN coalesce(close < {lag(n=2)}, false) THEN 0.0 WHEN coalesce(close > {mean(5)}, false) THEN 1.0 END AS s FROM b)")),
    "op64_rebalance": ('rebalance(close, freq="W")', "day", "\nSELECT day, symbol, round(close + 2e-8, 6) AS v FROM b WHERE day IN (SELECT max(day) FROM b GROUP BY isoyear(day), weekofyear(day))"),
    "op64_rebalance_on": ("rebalance(close, on=volume > 200)", "day", "\nSELECT day, symbol, round(close + 2e-8, 6) AS v FROM b JOIN (SELECT DISTINCT day FROM b WHERE volume > 200) USING (day)"),
    "op65_vol_target": ("vol_target(normalize_row(close), close, 0.1, 6)", "day", _VT + "\nSELECT day, symbol, round(wt * CASE WHEN k > 6 AND vol > 0 THEN least(1, 0.1 / vol) ELSE 1 END + 2e-8, 6) AS v FROM w JOIN sc USING (day)"),
    "op66_neutralize": ("neutralize(close, [volume])", "day", simple("CASE WHEN close IS NOT NULL AND volume IS NOT NULL AND cnt >= 2 AND abs(sxx - sx * sx / cnt) > 1e-9 THEN close - ((sy - (sxy - sx * sy / cnt) / (sxx - sx * sx / cnt) * sx) / cnt) - (sxy - sx * sy / cnt) / (sxx - sx * sx / cnt) * volume END", "q", ", q AS (SELECT *, count(close * volume) OVER w AS cnt, sum(CASE WHEN close IS NOT NULL THEN volume END) OVER w AS sx, sum(CASE WHEN volume IS NOT NULL THEN close END) OVER w AS sy, sum(close * volume) OVER w AS sxy, sum(CASE WHEN close IS NOT NULL THEN volume * volume END) OVER w AS sxx FROM b WINDOW w AS (PARTITION BY day))")),
    "op67_neutralize_industry": ("neutralize_industry(close)", "nat", simple("CASE WHEN close IS NOT NULL AND count(close) OVER (PARTITION BY day) >= 2 AND len(list_distinct(list(CASE WHEN close IS NOT NULL THEN sector END) OVER (PARTITION BY day))) >= 2 THEN close - avg(close) OVER (PARTITION BY day, sector) END", "s", _SEC)),
    "op68_industry_rank": ('industry_rank(close, categories=["ASIA", "EUROPE"])', "nat", simple(f"{ranked('z', within='day, sector')} / nullif(count(z) OVER (PARTITION BY day, sector), 0)", "(SELECT *, CASE WHEN sector IN ('ASIA', 'EUROPE') THEN close END AS z FROM s)", _SEC)),
    "op69_cap_industry": ("cap_industry(normalize_row(close), 0.25)", "nat", simple("CASE WHEN sum(abs(w)) OVER (PARTITION BY day, sector) > 0.25 THEN w * 0.25 / sum(abs(w)) OVER (PARTITION BY day, sector) ELSE w END", "(SELECT *, close / sum(abs(close)) OVER (PARTITION BY day) AS w FROM s)", _SEC)),
    "op70_groupby_category": ('groupby_category(close, "std")', "nat", _SEC + "\nSELECT day, sector AS symbol, round(stddev_samp(close) + 2e-8, 6) AS v FROM s GROUP BY day, sector"),
    "op71_in_sector": ('in_sector(close, "ASIA")', "nat", simple("CASE WHEN sector = 'ASIA' THEN 1.0 ELSE 0.0 END", "s", _SEC)),
    "op_align_rebalanced": ('close - rebalance(close, freq="ME")', "day", "\nSELECT day, symbol, round(CASE WHEN day IN (SELECT max(day) FROM b GROUP BY year(day), month(day)) THEN close - close END, 6) AS v FROM b"),
    "op_strategy": ("let fast = sma(close, 5)\nis_largest(pct_change(close, 1), 3) and fast > sma(close, 20)", "day", simple(unit(f"coalesce(close IS NOT NULL AND (close - {lag()}) / {lag()} IS NOT NULL AND row_number() OVER (PARTITION BY day ORDER BY pc DESC NULLS LAST, ord) <= 3, false) AND f > s"), f"(SELECT *, (close - {lag()}) / {lag()} AS pc, {mean(5)} AS f, {mean(20)} AS s FROM b)").replace(f"(close - {lag()}) / {lag()} IS NOT NULL AND row_number", "pc IS NOT NULL AND row_number")),
}


def _query(text: str, panel: str) -> Callable[[SparkSession, str], DataFrame]:
    expression = parse(text)

    def run(spark: SparkSession, d: str) -> DataFrame:
        bars = nations(spark, d) if panel == "nat" else brands(spark, d, panel)
        out = evaluate(bars, expression, sectors(spark, d) if panel == "nat" else None)
        return out.select(packed("day").alias("day"), "symbol", F.round(F.col("v") + OFF, 6).alias("v"))

    return run


def queries() -> dict:
    return {name: _query(text, panel) for name, (text, panel, _) in OPS.items()}


def oracle_sql() -> dict:
    return {name: f"SELECT cast(strftime(day, '%Y%m%d') AS int) AS day, symbol, v FROM (WITH RECURSIVE {panel_sql('nations' if panel == 'nat' else 'brands', 'day' if panel == 'nat' else panel)}{sql})" for name, (_, panel, sql) in OPS.items() if sql}
