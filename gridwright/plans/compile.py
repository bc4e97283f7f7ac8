"""Expressions compiled to DataFrame plans.

Nodes on one grid become columns of one DataFrame, so Catalyst sees a single plan and merges
windows of one specification. Steps that change the grid (rebalance, quantile_row, groupby_category)
start a new one; where two grids meet they are aligned by joins. Equal subexpressions are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col, ratio
from gridwright.operators import recurrences as rec
from gridwright.operators.panel import AXES, align
from gridwright.plans.catalog import Node

OTHER = "其他"  # the fixed label of symbols without a sector
INF = float("inf")


class CompileError(ValueError):
    """An expression that cannot be evaluated."""


class Grid:
    """A DataFrame of day, symbol, ord and the columns computed so far."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.count = df, 0

    def add(self, value: Column) -> Ref:
        name = self.name()
        self.df = self.df.withColumn(name, value)
        return Ref(self, name)

    def name(self) -> str:
        self.count += 1
        return f"_x{self.count}"


@dataclass(frozen=True)
class Ref:
    grid: Grid
    column: str

    @property
    def c(self) -> Column:
        return col(self.column)


def _truth(c: Column) -> Column:
    return F.coalesce(c == 1.0, F.lit(False))


def _unit(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < INF, c)


def ts(n: int) -> Window:
    return Window.partitionBy("symbol").orderBy("day").rowsBetween(1 - n, 0)


def down() -> Window:
    return Window.partitionBy("symbol").orderBy("day")


def upto() -> Window:
    return down().rowsBetween(Window.unboundedPreceding, 0)


def across() -> Window:
    return Window.partitionBy("day")


def average_rank(c: Column, ascending: bool, *within: str) -> Column:
    """Ranks from 1 among the non-NULL values of a day (and ``within``), ties at their mean."""
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    w = Window.partitionBy("day", *within)
    return F.when(c.isNotNull(), F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy("day", *within, c)) - 1) / 2)


class Compiler:
    """Evaluates expressions over a panel. ``industry`` (symbol, sector) is a dimension that joins on demand."""

    def __init__(self, panel: DataFrame, industry: DataFrame | None = None) -> None:
        self.base = Grid(panel)
        self.series = [c for c in panel.columns if c not in AXES]
        self.industry = industry
        self.done: dict[Node, Ref] = {}

    def run(self, n: Node, name: str = "v") -> DataFrame:
        """day, symbol, ord and the value."""
        out = self.eval(n)
        return out.grid.df.select(*AXES, out.c.alias(name))

    def eval(self, n: Node) -> Ref:
        if n not in self.done:
            self.done[n] = self._eval(n)
        return self.done[n]

    def together(self, *refs: Ref) -> tuple[Grid, list[Column]]:
        """The refs as columns of one grid, aligned where they lie on several."""
        grid = refs[0].grid
        cols = [refs[0].column]
        for r in refs[1:]:
            if r.grid is not grid:
                left = [grid.name() for _ in cols]
                a = grid.df.select(*AXES, *[col(c).alias(f"_l{x}") for c, x in zip(cols, left, strict=True)])
                b = r.grid.df.select(*AXES, r.c.alias("_r"))
                grid = Grid(align(a, b))
                cols = [f"_l{x}" for x in left]
                r = Ref(grid, "_r")
                renamed = f"_r{len(cols)}"
                grid.df = grid.df.withColumnRenamed("_r", renamed)
                r = Ref(grid, renamed)
            cols.append(r.column)
        return grid, [col(c) for c in cols]

    def _number(self, n: Node, key: str, least: int = 1) -> int:
        v = int(n.get(key))
        if v < least:
            raise CompileError(f"{n.tag}: {key} must be at least {least}")
        return v

    def _sector(self, grid: Grid) -> Column:
        if "_sector" not in grid.df.columns:
            if self.industry is None:
                grid.df = grid.df.withColumn("_sector", F.lit(OTHER))
            else:
                dim = self.industry.groupBy("symbol").agg(F.min("sector").alias("_sector"))
                grid.df = grid.df.join(dim, "symbol", "left").withColumn("_sector", F.coalesce("_sector", F.lit(OTHER)))
        return F.col("_sector")

    def _eval(self, n: Node) -> Ref:
        tag = n.tag
        if tag == "Data":
            if n.get("name") not in self.series:
                raise CompileError(f"unknown series {n.get('name')}")
            return Ref(self.base, n.get("name"))
        if tag == "Const":
            raise CompileError("a number stands alone; only arithmetic and comparisons take one")
        if tag in ("Gt", "Lt", "Ge", "Le", "Add", "Sub", "Mul", "Div"):
            return self._binary(tag, n.get("l"), n.get("r"))
        if tag in ("And", "Or", "Mask"):
            sides = (n.get("of"), n.get("by")) if tag == "Mask" else (n.get("l"), n.get("r"))
            g, (a, b) = self.together(*(self.eval(x) for x in sides))
            if tag == "Mask":
                return g.add(F.when(_truth(b), a))
            return g.add(_unit(_truth(a) & _truth(b) if tag == "And" else _truth(a) | _truth(b)))
        if tag in ("Rebalance", "HoldUntil", "VolTarget", "Neutralize", "ExitWhen", "QuantileRow", "GroupbyCategory"):
            return getattr(self, f"_{tag.lower()}")(n)
        if tag in _MULTI:
            names = [k for k, v in n.args if isinstance(v, Node)]
            refs = [self.eval(n.get(k)) for k in names]
            if any(r.grid is not refs[0].grid for r in refs):
                raise CompileError(f"{tag}: inputs must share one grid")
            return self._technical(n, refs[0].grid, {k: r.c for k, r in zip(names, refs, strict=True)}, {k: r.column for k, r in zip(names, refs, strict=True)})
        of = self.eval(n.get("of"))
        return self._single(n, of.grid, of.c, of.column)

    def _binary(self, tag: str, left: Node, right: Node) -> Ref:
        lc, rc = left.tag == "Const", right.tag == "Const"
        if lc and rc:
            raise CompileError("both operands are numbers")
        if lc or rc:
            ref = self.eval(right if lc else left)
            g = ref.grid
            a, b = (F.lit(float(left.get("value"))), ref.c) if lc else (ref.c, F.lit(float(right.get("value"))))
        else:
            g, (a, b) = self.together(self.eval(left), self.eval(right))
        made = {"Gt": lambda: _unit(a > b), "Lt": lambda: _unit(a < b), "Ge": lambda: _unit(a >= b), "Le": lambda: _unit(a <= b), "Add": lambda: a + b, "Sub": lambda: a - b, "Mul": lambda: a * b, "Div": lambda: ratio(a, b)}
        return g.add(made[tag]())

    # single-input steps ------------------------------------------------------------------------------------------

    def _mean(self, v: Column, n: int) -> Column:
        return F.when(F.count(v).over(ts(n)) >= max(n // 2, 1), F.avg(v).over(ts(n)))

    def _spread(self, v: Column, n: int) -> Column:
        return F.when(F.count(_finite(v)).over(ts(n)) == n, F.stddev_pop(_finite(v)).over(ts(n)))

    def _extreme(self, v: Column, n: int, f) -> Column:
        return F.when(F.count(v).over(ts(n)) == n, f(v).over(ts(n)))

    def _scan(self, g: Grid, inputs: list[str], kernel) -> Ref:
        name = g.name()
        g.df = rec.per_symbol(g.df, inputs, kernel, name)
        return Ref(g, name)

    def _single(self, n: Node, g: Grid, v: Column, name: str) -> Ref:
        tag = n.tag
        if tag in ("Ema", "Rsi"):
            k = self._number(n, "n")
            kernel = rec.ema if tag == "Ema" else rec.rsi
            return self._scan(g, [name], lambda x: kernel(x, k))
        if tag.startswith("Macd"):
            fast, slow = self._number(n, "fast"), self._number(n, "slow")
            if tag == "Macd":
                return self._scan(g, [name], lambda x: rec.ema(x, fast) - rec.ema(x, slow))
            signal = self._number(n, "signal")
            if tag == "MacdSignal":
                return self._scan(g, [name], lambda x: rec.ema(rec.ema(x, fast) - rec.ema(x, slow), signal))

            def hist(x: np.ndarray) -> np.ndarray:
                line = rec.ema(x, fast) - rec.ema(x, slow)
                return line - rec.ema(line, signal)

            return self._scan(g, [name], hist)
        if tag in ("Average", "BollingerMid"):
            return g.add(self._mean(v, self._number(n, "n")))
        if tag == "Std":
            return g.add(self._spread(v, self._number(n, "n")))
        if tag in ("BollingerUpper", "BollingerLower"):
            k, w = float(n.get("k")), self._number(n, "n")
            return g.add(self._mean(v, w) + (k if tag == "BollingerUpper" else -k) * self._spread(v, w))
        if tag in ("PctChange", "Rise", "Fall", "Shift"):
            k = self._number(n, "n", 0)
            before = F.lag(v, k).over(down()) if k else v
            return g.add({"PctChange": lambda: ratio(v - before, before), "Rise": lambda: _unit(v > before), "Fall": lambda: _unit(v < before), "Shift": lambda: before}[tag]())
        if tag in ("RollingMax", "DonchianHigh"):
            return g.add(self._extreme(v, self._number(n, "n"), F.max))
        if tag in ("RollingMin", "DonchianLow"):
            return g.add(self._extreme(v, self._number(n, "n"), F.min))
        if tag == "DonchianMid":
            k = self._number(n, "n")
            return g.add((self._extreme(v, k, F.max) + self._extreme(v, k, F.min)) * 0.5)
        if tag == "Ceil":
            return g.add(F.when(F.abs(v) < INF, F.ceil(v).cast("double")).otherwise(v))
        if tag == "Neg":
            return g.add(-v)
        if tag == "Not":
            return g.add(_unit(~_truth(v)))
        if tag in ("IsLargest", "IsSmallest"):
            order = v.desc_nulls_last() if tag == "IsLargest" else v.asc_nulls_last()
            place = F.row_number().over(across().orderBy(order, "ord"))
            return g.add(_unit(v.isNotNull() & (place <= self._number(n, "n", 0))))
        if tag == "Rank":
            r = average_rank(v, bool(n.get("ascending")))
            return g.add(r / F.count(v).over(across()) if n.get("pct") else r)
        if tag == "Winsorize":
            lo, hi = sorted(min(max(float(n.get(k)), 0.0), 1.0) for k in ("lower", "upper"))
            return g.add(F.when(v.isNotNull(), F.least(F.greatest(v, F.percentile(v, lo).over(across())), F.percentile(v, hi).over(across()))))
        if tag == "Zscore":
            sd = F.stddev_pop(_finite(v)).over(across())
            return g.add(F.when(v.isNotNull(), F.when(sd == 0, 0.0).otherwise((v - F.avg(_finite(v)).over(across())) / F.nullif(sd, F.lit(0.0)))))
        if tag == "Bucket":
            k = self._number(n, "n")
            place = F.floor((average_rank(v, True) - 1) / F.count(v).over(across()) * k) + 1
            return g.add(F.when(v.isNotNull(), F.least(F.greatest(place, F.lit(1)), F.lit(k)).cast("double")))
        if tag == "Demean":
            return g.add(v - F.avg(_finite(v)).over(across()))
        if tag == "NormalizeRow":
            gross = F.sum(F.abs(v)).over(across())
            return g.add(F.when(gross == 0, v).otherwise(v / F.nullif(gross, F.lit(0.0))))
        if tag == "Sustain":
            w = self._number(n, "nwindow")
            least = int(n.get("nsatisfy", w))
            held = F.sum(F.when(_truth(v), 1).otherwise(0)).over(ts(w)) >= least
            return g.add(_unit(held & (F.count(F.lit(1)).over(ts(w)) == w)))
        if tag in ("IsEntry", "IsExit"):
            before = F.coalesce(F.lag(_truth(v)).over(down()), F.lit(False))
            return g.add(_unit(_truth(v) & ~before if tag == "IsEntry" else ~_truth(v) & before))
        sector = self._sector(g)
        if tag == "InSector":
            return g.add(_unit(sector == n.get("name")))
        if tag == "NeutralizeIndustry":
            ok = _finite(v)
            mean = F.avg(ok).over(Window.partitionBy("day", "_sector"))
            enough = (F.count(ok).over(across()) >= 2) & (F.size(F.collect_set(F.when(ok.isNotNull(), sector)).over(across())) >= 2)
            return g.add(F.when(enough & ok.isNotNull(), v - mean))
        if tag == "IndustryRank":
            ok = _finite(v)
            chosen = n.get("categories")
            if chosen:
                ok = F.when(sector.isin(*chosen), ok)
            h = g.add(ok)
            return g.add(average_rank(h.c, True, "_sector") / F.count(h.c).over(Window.partitionBy("day", "_sector")))
        if tag == "CapIndustry":
            cap = float(n.get("max_weight"))
            if not cap > 0:
                return g.add(v)
            gross = F.sum(F.abs(_finite(v))).over(Window.partitionBy("day", "_sector"))
            return g.add(F.when((gross > cap) & _finite(v).isNotNull(), v * cap / gross).otherwise(v))
        raise CompileError(f"no plan for {tag}")

    # several inputs of one grid -------------------------------------------------------------------------------------

    def _technical(self, n: Node, g: Grid, c: dict[str, Column], names: dict[str, str]) -> Ref:
        tag = n.tag
        if tag in ("Atr", "Natr", "Adx", "PlusDi", "MinusDi"):
            k = self._number(n, "n")
            kernel = {"Atr": lambda h, lo, x: rec.atr(h, lo, x, k), "Natr": lambda h, lo, x: rec.atr(h, lo, x, k), "Adx": lambda h, lo, x: rec.adx(h, lo, x, k), "PlusDi": lambda h, lo, x: rec.directional(h, lo, x, k)[0], "MinusDi": lambda h, lo, x: rec.directional(h, lo, x, k)[1]}[tag]
            out = self._scan(g, [names["high"], names["low"], names["close"]], kernel)
            return out if tag != "Natr" else g.add(F.when(c["close"] != 0, 100.0 * out.c / c["close"]))
        if tag in ("AroonUp", "AroonDown"):
            k = self._number(n, "n")
            v = _finite(c["high" if tag == "AroonUp" else "low"])
            w = ts(k + 1)
            row = g.add(F.row_number().over(down())).c
            far = F.max(F.struct(v.alias("v"), row.alias("r"))).over(w) if tag == "AroonUp" else F.min(F.struct(v.alias("v"), (-row).alias("r"))).over(w)
            at = far.getField("r")
            since = row - (at if tag == "AroonUp" else -at)
            return g.add(F.when(F.count(v).over(w) == k + 1, 100.0 * (k - since) / k))
        born = lambda x: F.count(F.when(_finite(x).isNotNull(), 1)).over(upto())
        if tag in ("WillR", "StochK", "StochD"):
            k = self._number(n, "n")
            top, low = self._extreme(c["high"], k, F.max), self._extreme(c["low"], k, F.min)
            span = F.when((F.abs(top) < INF) & (F.abs(low) < INF) & (F.abs(c["close"]) < INF) & (top != low), top - low)
            if tag == "WillR":
                return g.add(-100.0 * (top - c["close"]) / span)
            fast = g.add(100.0 * (c["close"] - low) / span)
            if tag == "StochK":
                return fast
            d = self._number(n, "d")
            return g.add(F.when(F.count(fast.c).over(ts(d)) == d, F.avg(fast.c).over(ts(d))))
        if tag == "Obv":
            d = c["close"] - F.lag(c["close"]).over(down())
            first = g.add(born(c["close"])).c
            listed = (first > 0) & (F.coalesce(F.lag(first).over(down()), F.lit(0)) == 0)
            step = F.when(listed, c["volume"]).when((d > 0) & (first > 0), c["volume"]).when((d < 0) & (first > 0), -c["volume"]).otherwise(0.0)
            bad = g.add(F.when(first > 0, step.isNull().cast("int")).otherwise(0)).c
            move = g.add(step).c
            return g.add(F.when((first > 0) & (F.max(bad).over(upto()) == 0), F.sum(move).over(upto())))
        price = g.add((c["high"] + c["low"] + c["close"]) / 3.0).c
        k = self._number(n, "n")
        if tag == "Cci":
            ok = _finite(price)
            mean = F.avg(ok).over(ts(k))
            window = g.add(F.collect_list(ok).over(ts(k)))
            m = g.add(F.when(F.count(ok).over(ts(k)) == k, mean)).c
            dev = F.aggregate(F.transform(window.c, lambda x: F.abs(x - m)), F.lit(0.0), lambda a, x: a + x) / k
            return g.add((price - m) / (0.015 * F.nullif(dev, F.lit(0.0))))
        if tag == "Vwap":
            ok = _finite(price).isNotNull() & _finite(c["volume"]).isNotNull()
            full = F.count(F.when(ok, 1)).over(ts(k)) == k
            return g.add(F.when(full, F.sum(price * c["volume"]).over(ts(k)) / F.nullif(F.sum(c["volume"]).over(ts(k)), F.lit(0.0))))
        if tag == "Mfi":
            born_row = g.add(born(c["close"])).c
            started = F.coalesce(F.lag(born_row).over(down()), F.lit(0)) > 0
            before = F.lag(price).over(down())
            flow = price * c["volume"]
            inflow = g.add(F.when(started & (price > before), flow).otherwise(0.0)).c
            outflow = g.add(F.when(started & (price < before), flow).otherwise(0.0)).c
            age = g.add(F.sum(F.when(started, 1).otherwise(0)).over(upto())).c
            lost = lambda x: F.max(F.when(x.isNull(), 1).otherwise(0)).over(ts(k)) == 1
            ups, downs = F.when(~lost(inflow), F.sum(inflow).over(ts(k))), F.when(~lost(outflow), F.sum(outflow).over(ts(k)))
            return g.add(F.when(age >= k, F.when(downs == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ups / F.nullif(downs, F.lit(0.0))))))
        raise CompileError(f"no plan for {tag}")

    # signals, schedules, portfolios -----------------------------------------------------------------------------

    def _exitwhen(self, n: Node) -> Ref:
        g, (entry, leave) = self.together(self.eval(n.get("entry")), self.eval(n.get("exit")))
        before = F.coalesce(F.lag(_truth(entry)).over(down()), F.lit(False))
        step = g.add(F.when(_truth(entry) & ~before, 1.0).when((~_truth(entry) & before) | _truth(leave), 0.0)).c
        return g.add(F.coalesce(F.last(step, ignorenulls=True).over(upto()), F.lit(0.0)))

    def _rebalance(self, n: Node) -> Ref:
        freq, on = n.get("freq"), n.get("on")
        if (freq is None) == (on is None):
            raise CompileError("Rebalance: exactly one of freq and on is needed")
        of = self.eval(n.get("of"))
        df = of.grid.df.select(*AXES, of.c.alias("_v"))
        if freq is not None:
            period = {"W": F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col("day")), F.weekofyear("day")), "ME": F.trunc("day", "month"), "QE": F.trunc("day", "quarter"), "YE": F.trunc("day", "year")}.get(freq)
            if period is None:
                raise CompileError(f"Rebalance: unknown frequency {freq}")
            keep = of.grid.df.select("day").distinct().groupBy(period.alias("_p")).agg(F.max("day").alias("day")).select("day")
        else:
            flag = self.eval(on)
            keep = flag.grid.df.where((F.abs(flag.c) < INF) & (flag.c != 0)).select("day").distinct()
        grid = Grid(df.join(keep, "day", "left_semi"))
        return Ref(grid, "_v")

    def _quantilerow(self, n: Node) -> Ref:
        of = self.eval(n.get("of"))
        q = min(max(float(n.get("c")), 0.0), 1.0)
        out = of.grid.df.groupBy("day").agg(F.percentile(of.c, q).alias("_v"))
        return Ref(Grid(out.select("day", F.lit("quantile").alias("symbol"), F.lit(0).alias("ord"), "_v")), "_v")

    def _groupbycategory(self, n: Node) -> Ref:
        agg = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp}.get(n.get("agg"))
        if agg is None:
            raise CompileError(f"GroupbyCategory: unknown aggregate {n.get('agg')}")
        of = self.eval(n.get("of"))
        self._sector(of.grid)
        v = _finite(of.c)
        value = F.coalesce(F.sum(v), F.lit(0.0)) if n.get("agg") == "sum" else agg(v)
        out = of.grid.df.groupBy("day", F.col("_sector").alias("symbol")).agg(value.alias("_v"))
        return Ref(Grid(out.select("day", "symbol", (F.dense_rank().over(across().orderBy("symbol")) - 1).alias("ord"), "_v")), "_v")

    def _voltarget(self, n: Node) -> Ref:
        g, (w, p) = self.together(self.eval(n.get("of")), self.eval(n.get("prices")))
        k, target = self._number(n, "n"), float(n.get("target"))
        before = F.lag(p).over(down())
        part = g.add(F.coalesce(F.lag(w).over(down()), F.lit(0.0)) * F.coalesce(F.when(before != 0, p / before - 1.0), F.lit(0.0))).c
        # one row a day from here on
        daily = g.df.groupBy("day").agg(F.sum(part).alias("_r"))
        order = Window.orderBy("day")
        daily = daily.withColumns({"_no": F.row_number().over(order), "_sd": F.stddev_samp("_r").over(order.rowsBetween(1 - k, 0))})
        vol = F.when(F.col("_no") > k, F.col("_sd") * float(np.sqrt(252.0)))
        scale = daily.select("day", F.coalesce(F.when(vol > 0, F.least(F.lit(1.0), target / vol)), F.lit(1.0)).alias("_scale"))
        name = g.name()
        g.df = g.df.join(scale, "day", "left").withColumn(name, w * F.col("_scale")).drop("_scale")
        return Ref(g, name)

    def _neutralize(self, n: Node) -> Ref:
        by = n.get("by")
        g, cols = self.together(self.eval(n.get("of")), *(self.eval(b) for b in by))
        ok = reduce(lambda a, b: a & b, [_finite(c).isNotNull() for c in cols])
        constant = bool(n.get("add_const"))
        k = len(by) + constant
        x = [*([F.lit(1.0)] if constant else []), *cols[1:]]
        # normal equations per day from sums that combine before the shuffle
        sums = {f"a{i}{j}": F.sum(F.when(ok, x[i] * x[j])) for i in range(k) for j in range(i, k)} | {f"b{i}": F.sum(F.when(ok, x[i] * cols[0])) for i in range(k)}
        moments = g.df.groupBy("day").agg(F.count(F.when(ok, 1)).alias("m"), *[v.alias(s) for s, v in sums.items()])

        index, least = {s: i for i, s in enumerate(sums)}, len(by) + 1

        @F.pandas_udf("array<double>")
        def solved(m: pd.Series, *parts: pd.Series) -> pd.Series:
            rows = pd.concat(parts, axis=1).to_numpy(float)
            out = []
            for row, size in zip(rows, m, strict=True):
                a = np.array([[row[index[f"a{min(i, j)}{max(i, j)}"]] for j in range(k)] for i in range(k)])
                b = np.array([row[index[f"b{i}"]] for i in range(k)])
                out.append(_solve(a, b) if size >= least and not np.isnan(a).any() else None)
            return pd.Series(out)

        beta = moments.select("day", solved("m", *sums).alias("_beta"))
        name = g.name()
        fit = reduce(lambda a, b: a + b, [x[i] * F.get("_beta", F.lit(i)) for i in range(k)])
        g.df = g.df.join(beta, "day", "left").withColumn(name, F.when(ok, cols[0] - fit)).drop("_beta")
        return Ref(g, name)

    def _holduntil(self, n: Node) -> Ref:
        refs = [self.eval(n.get("entry")), self.eval(n.get("exit"))]
        rank = n.get("rank")
        if rank is not None:
            refs.append(self.eval(rank))
        g, cols = self.together(*refs)
        limit = n.get("nstocks_limit")
        if len(cols) > 2:
            v = _finite(cols[2])
            ends = g.df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
            low, high = ends.select("a").scalar(), ends.select("b").scalar()
            score = F.coalesce((v - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
        else:
            score = F.lit(0.0)
        enter, leave = _truth(cols[0]), _truth(cols[1])
        name = g.name()
        if limit is None:
            # nothing competes: held from an entry to the next exit
            held = g.add(F.when(leave, 0.0).when(enter, 1.0)).c
            g.df = g.df.withColumn(name, F.coalesce(F.last(held, ignorenulls=True).over(upto()), F.lit(0.0)))
            return Ref(g, name)
        limit = max(int(limit), 0)
        # A holding only leaves by its exit, and at most ``limit`` are held: so of a day's entries the best 2 * limit suffice, each with its
        # next exit. On the first day scores don't count yet, and entries that are exits as well take places, but aren't held. Ties go to the later column.
        first = g.df.agg(F.min("day").alias("d")).scalar()
        later = Window.partitionBy("symbol").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
        cells = g.df.select(*AXES, F.when(F.col("day") == first, 1.0).otherwise(score).alias("_s"), F.when(F.col("day") == first, enter).otherwise(enter & ~leave).alias("_enter"), F.when(F.col("day") == first, leave).alias("_gone"), F.last(F.when(leave, F.col("day")), ignorenulls=True).over(later).alias("_exit"))
        place = F.row_number().over(across().orderBy(F.col("_s").desc(), F.col("ord").desc()))
        best = cells.where("_enter").withColumn("_place", place).where(F.col("_place") <= 2 * limit)

        def rotate(frame: pd.DataFrame) -> pd.DataFrame:
            held: dict[str, object] = {}
            out = []
            for day, own in frame.sort_values(["day", "_place"]).groupby("day", sort=True):
                held = {s: e for s, e in held.items() if e is None or e > day}
                for symbol, leaves, gone, place in zip(own["symbol"], own["_exit"], own["_gone"], own["_place"], strict=True):
                    if len(held) >= limit or (gone is not None and place > limit):
                        break
                    if symbol not in held and not gone:
                        held[symbol] = None if leaves is None or leaves != leaves else leaves
                        out.append((symbol, day, held[symbol]))
            return pd.DataFrame(out, columns=["symbol", "first", "until"])

        # a rotation's state is the book: one task goes through the panel's days, 2 * limit rows each
        made = best.select("day", "symbol", "_place", "_exit", "_gone").withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(rotate, "symbol string, first date, until date")
        steps = made.select("symbol", F.inline(F.array(F.struct(F.col("first").alias("day"), F.lit(1.0).alias("_step")), F.struct(F.col("until").alias("day"), F.lit(0.0).alias("_step"))))).where(F.col("day").isNotNull())
        steps = steps.groupBy("day", "symbol").agg(F.max("_step").alias("_step"))
        g.df = g.df.join(steps, ["day", "symbol"], "left").withColumn(name, F.coalesce(F.last("_step", ignorenulls=True).over(upto()), F.lit(0.0))).drop("_step")
        return Ref(g, name)


_MULTI = {"Atr", "Natr", "WillR", "Cci", "StochK", "StochD", "AroonUp", "AroonDown", "Adx", "PlusDi", "MinusDi", "Obv", "Mfi", "Vwap"}


def _solve(a: np.ndarray, b: np.ndarray) -> list[float] | None:
    """a x = b, or None if a is singular (a pivot under 1e-12)."""
    q = np.column_stack([a, b]).astype(float)
    k = len(b)
    for i in range(k):
        p = i + int(np.argmax(np.abs(q[i:, i])))
        if abs(q[p, i]) < 1e-12:
            return None
        q[[i, p]] = q[[p, i]]
        q[i] /= q[i, i]
        others = np.arange(k) != i
        q[others] -= np.outer(q[others, i], q[i])
    return q[:, -1].tolist()


def evaluate(panel: DataFrame, expression: Node, industry: DataFrame | None = None, name: str = "v") -> DataFrame:
    """day, symbol, ord and the expression's value over a panel."""
    return Compiler(panel, industry).run(expression, name)
