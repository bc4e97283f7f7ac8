"""Net asset value of positions: a day loop over whole books, one task per variant.

Variants (parameter sets, lags, segments) run side by side; within one, each day's
book depends on the day before. A variant's panel is bounded by its days times its symbols.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


@dataclass(frozen=True)
class Stops:
    """Exits from a holding's return since entry; ``fill`` is 'touched' (at the level, or the open beyond it) or 'close'."""

    stop_loss: float = -INF
    take_profit: float = INF
    trail_stop: float = INF
    trail_activation: float = 0.0
    fill: str = "touched"

    @property
    def on(self) -> bool:
        return self.stop_loss != -INF or self.take_profit != INF or self.trail_stop != INF


@dataclass(frozen=True)
class Costs:
    """Everything is off by default. Ratios are of traded weight; participation is traded value over the day's."""

    fee: float = 0.0
    tax: float = 0.0
    slippage: float = 0.0
    position_limit: float = 0.0
    capital: float = 0.0
    max_participation: float = 0.0
    impact: float = 0.0
    delist_after: int = 0
    delist_haircut: float = 0.0
    stops: Stops = field(default_factory=Stops)


def gone(px: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray]:
    """(dead, confirmed): prices missing for ``after`` rows on end, and the rows where that count is reached."""
    if after < 1:
        return np.zeros(px.shape, bool), np.zeros(px.shape, bool)
    rows = np.arange(len(px))[:, None]
    last = np.maximum.accumulate(np.where(np.isnan(px), -1, rows), axis=0)
    run = rows - last
    return run >= after, run == after


def costs(config: dict) -> Costs:
    """Costs from a plain object, its stops in an object of their own; unknown names are errors."""
    known = lambda kind, given: [n for n in given if n not in {f.name for f in fields(kind)}]
    stops = dict(config.get("stops") or {})
    wrong = known(Costs, config) + [f"stops.{n}" for n in known(Stops, stops)]
    if wrong:
        raise ValueError(f"unknown settings: {', '.join(wrong)}")
    return Costs(**{k: v for k, v in config.items() if k != "stops"}, stops=Stops(**stops))



class _Stopper:
    """Holdings' entries and peaks, a vector over the symbols."""

    def __init__(self, n: int, cfg: Stops) -> None:
        self.cfg, self.entry, self.side, self.peak = cfg, np.full(n, NAN), np.zeros(n), np.zeros(n)
        self.blocked = np.zeros(n, bool)

    def day(self, raw: np.ndarray, o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The day's book after stops, and the fills (NaN where none). A stopped name waits for its signal to reset."""
        held = raw != 0
        was = self.blocked.copy()
        self.blocked &= held
        raw = np.where(was, 0.0, raw)
        live = ~was & held
        self.entry[~was & ~held] = NAN
        side = np.sign(raw)
        fresh = live & (np.isnan(self.entry) | (self.side != side))
        self.entry[fresh], self.side[fresh], self.peak[fresh] = c[fresh], side[fresh], 0.0
        fill = self._fills(live, o, h, lo, c)
        hit = live & ~np.isnan(fill)
        self.blocked |= hit
        self.entry[hit] = NAN
        return np.where(hit, 0.0, raw), np.where(hit, fill, NAN)

    def _fills(self, live: np.ndarray, o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
        cfg, e, d = self.cfg, self.entry, self.side
        ok = live & ~np.isnan(e) & (e != 0)
        loss, gain, trail, arm = abs(cfg.stop_loss), abs(cfg.take_profit), abs(cfg.trail_stop), abs(cfg.trail_activation)
        with np.errstate(invalid="ignore", divide="ignore"):
            ret = lambda p: d * (p / e - 1.0)
            if cfg.fill == "close":
                ok &= ~np.isnan(c)
                now = ret(c)
                self.peak = np.where(ok, np.fmax(self.peak, now), self.peak)
                out = (now <= -loss) | (now >= gain) | ((self.peak >= arm) & (now <= self.peak - trail) & (trail != INF))
                return np.where(ok & out, c, NAN)
            ok &= ~np.isnan(h) & ~np.isnan(lo)
            best, worst = ret(np.where(d >= 0, h, lo)), ret(np.where(d >= 0, lo, h))
            before = self.peak.copy()
            self.peak = np.where(ok, np.fmax(self.peak, best), self.peak)
            # an adverse level is filled at the worse of open and level, a favourable one at the better
            worse = lambda p: np.where(np.isnan(o), p, np.where(d >= 0, np.fmin(o, p), np.fmax(o, p)))
            better = lambda p: np.where(np.isnan(o), p, np.where(d >= 0, np.fmax(o, p), np.fmin(o, p)))
            level = lambda t: e * (1.0 + d * t)
            fills = []
            if loss != INF:
                fills.append(np.where(worst <= -loss, worse(level(-loss)), NAN))
            if trail != INF:
                fills.append(np.where((before >= arm) & (worst <= before - trail), worse(level(before - trail)), NAN))
            adverse = np.full(len(e), NAN)
            for f in fills:  # the level met first on the way
                adverse = np.where(d >= 0, np.fmax(adverse, f), np.fmin(adverse, f))
            profit = np.where(best >= gain, better(level(gain)), NAN) if gain != INF else np.full(len(e), NAN)
            return np.where(ok, np.where(np.isnan(adverse), profit, adverse), NAN)


def run_book(pos: np.ndarray, px: np.ndarray, op: np.ndarray, hi: np.ndarray, lo: np.ndarray, vol: np.ndarray, cfg: Costs, start: np.ndarray | None = None) -> dict:
    """One variant. Arrays are days by symbols, missing NaN: positions hold where missing; a return over a missing price is 0.

    Weights are set to target when the carried-forward raw book changes, and drift in between.
    """
    rows, n = px.shape
    dead, confirmed = gone(px, cfg.delist_after)
    traded = vol * px if cfg.capital > 0 and (cfg.max_participation > 0 or cfg.impact > 0) else None
    stopper = _Stopper(n, cfg.stops) if cfg.stops.on else None
    target, fills, change = np.zeros((rows, n)), np.full((rows, n), NAN), np.zeros(rows, bool)
    raw, before = np.zeros(n), None
    for r in range(rows):
        raw = np.where(np.isnan(pos[r]), raw, pos[r])
        raw = np.where(dead[r], 0.0, raw)
        if stopper:
            raw, fills[r] = stopper.day(raw, op[r], hi[r], lo[r], px[r])
        change[r] = before is None or bool((raw != before).any())
        before = raw
        w = raw / max(np.abs(raw).sum(), 1.0)
        if cfg.position_limit > 0:
            w = np.clip(w, -cfg.position_limit, cfg.position_limit)
        if traded is not None and cfg.max_participation > 0:
            cap = cfg.max_participation * traded[r] / cfg.capital
            w = np.where(np.isnan(cap), w, np.clip(w, -np.nan_to_num(cap), np.nan_to_num(cap)))
        target[r] = w

    def cost(old: np.ndarray, new: np.ndarray, r: int) -> float:
        move = np.abs(new - old)
        out = (cfg.fee + cfg.slippage) * move.sum() + cfg.tax * np.maximum(old - new, 0.0).sum()
        if traded is not None and cfg.impact > 0:
            with np.errstate(invalid="ignore", divide="ignore"):
                share = np.where(traded[r] > 0, np.minimum(move * cfg.capital / traded[r], 1.0), 0.0)
            out += (move * cfg.impact * np.sqrt(share)).sum()
        return float(out)

    exits = np.where(np.isnan(fills), px, fills)
    with np.errstate(invalid="ignore", divide="ignore"):
        ret = np.zeros((rows, n))
        ret[1:] = np.where(px[:-1] != 0, exits[1:] / px[:-1] - 1.0, 0.0)
    ret = np.nan_to_num(ret, nan=0.0, posinf=INF, neginf=-INF)
    equity = np.ones(rows)
    held = target[0] if rows else np.zeros(n)
    if rows:
        equity[0] = 1.0 - cost(np.zeros(n) if start is None else start, held, 0)
    for r in range(1, rows):
        gain = float(held @ ret[r])
        value = equity[r - 1] * (1.0 + gain)
        drift = held * (1.0 + ret[r])
        if gain != -1.0:
            drift = drift / (1.0 + gain)
        if confirmed[r].any():
            # what is gone leaves the book at its written-down worth and costs no fee
            loss = float((drift * confirmed[r]).sum() * cfg.delist_haircut)
            drift = np.where(confirmed[r], 0.0, drift)
            value *= 1.0 - loss
            if loss not in (0.0, 1.0):
                drift = drift / (1.0 - loss)
        if change[r]:
            value *= 1.0 - cost(drift, target[r], r)
            drift = target[r]
        held, equity[r] = drift, value
    return {"equity": equity, "exposure": np.abs(target).sum(axis=1), "target": target, "fills": fills, "confirmed": confirmed, "weights": held}


def trades_of(book: dict, px: np.ndarray, hi: np.ndarray, lo: np.ndarray, cfg: Costs) -> list[tuple]:
    """(symbol number, entry row, exit row or None, return, worst and best on the way, entry price, exit price, side) of each holding."""
    target, out = book["target"], []
    rows, n = target.shape
    on = target != 0
    edge = np.diff(np.vstack([np.zeros((1, n), int), on.astype(int)]), axis=0)
    for c in range(n):
        begins, ends = np.flatnonzero(edge[:, c] > 0), np.flatnonzero(edge[:, c] < 0)
        for k, a in enumerate(begins):
            b = int(ends[k]) if k < len(ends) else None
            last = rows - 1 if b is None else b
            price, side = px[a, c], float(np.sign(target[a, c]))
            forced = b is not None and book["confirmed"][b, c]
            if b is None:
                leave = px[last, c]
            elif forced:
                known = px[: b + 1, c][~np.isnan(px[: b + 1, c])]
                leave = (known[-1] if len(known) else NAN) * (1.0 - cfg.delist_haircut)
            else:
                leave = book["fills"][b, c] if not np.isnan(book["fills"][b, c]) else px[b, c]
            sound = price != 0 and not np.isnan(price)
            gross = leave / price if sound and not np.isnan(leave) else 1.0
            if b is not None:
                gross *= (1.0 - cfg.fee - cfg.slippage) * (1.0 if forced else 1.0 - cfg.fee - cfg.tax - cfg.slippage)
            worst = best = None
            if sound:
                h, low = hi[a : last + 1, c], lo[a : last + 1, c]
                seen = ~np.isnan(h) & ~np.isnan(low)
                if seen.any():
                    up, down = side * (h[seen] / price - 1.0), side * (low[seen] / price - 1.0)
                    best, worst = float(np.maximum(up, down).max()), float(np.minimum(up, down).min())
            out.append((c, int(a), b, gross - 1.0, worst, best, float(price), None if b is None else float(leave), "short" if side < 0 else "long"))
    return out


ROWS = "variant string, kind string, day date, symbol string, value double, exposure double, exit_day date, period int, worst double, best double, entry_price double, exit_price double, side string"
PARTS = ["price", "open", "high", "low", "volume"]


def simulate(cells: DataFrame, cfg: Costs, start: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Rows of kind 'equity' (value, exposure), 'trade' (value is the return) and 'weight' (the last book) per variant; of one that fails a row of kind 'error', its message in ``side``.

    ``cells`` has variant, day, symbol, ord, position and price, and may have open, high, low and volume. Its groups are
    one variant each. ``start`` gives variants a first book, so that a following segment pays only for what differs.
    """
    have = [p for p in PARTS if p in cells.columns]
    names = ["position", *have]
    first = start or {}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return booked(frame)
        except Exception as e:  # noqa: BLE001 - one variant's failure is its own
            return pd.DataFrame([(frame["variant"].iloc[0], "error", *[None] * 10, f"{type(e).__name__}: {e}")], columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"period": "Int32"})

    def booked(frame: pd.DataFrame) -> pd.DataFrame:
        variant = frame["variant"].iloc[0]
        order = frame[["ord", "symbol"]].drop_duplicates().sort_values(["ord", "symbol"])["symbol"].tolist()
        days = np.sort(frame["day"].unique())
        at = (np.searchsorted(days, frame["day"].to_numpy()), pd.Categorical(frame["symbol"], categories=order).codes)
        m = {}
        for p in ("position", *PARTS):
            m[p] = np.full((len(days), len(order)), NAN)
            if p in names:
                m[p][at] = frame[p].to_numpy(float)
        carried = first.get(variant)
        book = run_book(m["position"], m["price"], m["open"], m["high"], m["low"], m["volume"], cfg, None if carried is None else np.array([carried.get(s, 0.0) for s in order]))
        out = [(variant, "equity", d, None, v, e, None, None, None, None, None, None, None) for d, v, e in zip(days, book["equity"], book["exposure"], strict=True)]
        for c, a, b, ret, worst, best, ep, xp, side in trades_of(book, m["price"], m["high"], m["low"], cfg):
            out.append((variant, "trade", days[a], order[c], ret, None, None if b is None else days[b], (len(days) - 1 if b is None else b) - a, worst, best, ep, xp, side))
        out += [(variant, "weight", days[-1], s, w, None, None, None, None, None, None, None, None) for s, w in zip(order, book["weights"], strict=True) if w != 0]
        made = pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])
        made["period"] = made["period"].astype("Int32")
        return made

    cells = cells.select("variant", "day", "symbol", "ord", *names)
    # symbols that are never held change nothing; the first one stays, so that every variant has its days
    whole = F.col("position").isNotNull() & (F.col("position") != 0)
    ever = cells.groupBy("variant", "symbol").agg(F.max(whole).alias("_on"), F.min("ord").alias("_ord"))
    if first:
        carried_on = [F.struct(F.lit(v).alias("variant"), F.lit(s).alias("symbol")) for v, b in first.items() for s, w in b.items() if w]
        ever = ever.withColumn("_on", F.col("_on") | F.array_contains(F.array(*carried_on), F.struct("variant", "symbol")) if carried_on else F.col("_on"))
    lead = Window.partitionBy("variant").orderBy("_ord", "symbol")
    ever = ever.withColumn("_place", F.row_number().over(lead)).where(F.col("_on") | (F.col("_place") == 1)).select("variant", "symbol")
    return cells.join(ever, ["variant", "symbol"], "left_semi").groupBy("variant").applyInPandas(run, ROWS)


def equity_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == "equity").select("variant", "day", F.col("value").alias("equity"), "exposure")


def trade_list(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == "trade").select("variant", "symbol", F.col("day").alias("entry_day"), "exit_day", F.col("value").alias("ret"), "period", "worst", "best", "entry_price", "exit_price", "side")


def book_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == "weight").select("variant", "symbol", F.col("value").alias("weight"))


def errors_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == "error").select("variant", F.col("side").alias("error"))
