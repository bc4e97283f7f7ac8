"""Order-dependent recurrences down a symbol's days: exponential and Wilder smoothing.

A symbol's group is bounded by its days. All smoothed columns that a step needs come from one pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def per_symbol(df: DataFrame, inputs: list[str], kernel: Callable[..., np.ndarray], name: str) -> DataFrame:
    """``df`` with column ``name``: kernel(*input arrays in day order), missing as NaN inside and NULL outside.

    The rows pass through their symbol's group whole, so ``df`` is computed once and nothing is joined back.
    """

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("day").to_numpy(zero_copy_only=False), kind="stable")
        cols = [t.column(c).to_numpy(zero_copy_only=False).astype(float)[order] for c in inputs]
        out = np.empty(len(order))
        out[order] = kernel(*cols)
        return t.append_column(name, pa.array(out, pa.float64(), mask=np.isnan(out)))

    return df.groupBy("symbol").applyInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def listing(x: np.ndarray) -> int | None:
    """The first row with a finite value."""
    at = np.flatnonzero(np.isfinite(x))
    return int(at[0]) if len(at) else None


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean, k = 2/(n+1), seeded with the mean of the n rows from the listing row; later missing rows carry it."""
    out = np.full(len(x), np.nan)
    first = listing(x)
    if n < 1 or first is None or first + n > len(x):
        return out
    k = 2.0 / (n + 1.0)
    now = x[first : first + n].mean()
    out[first + n - 1] = now
    for r in range(first + n, len(x)):
        if np.isfinite(x[r]):
            now += k * (x[r] - now)
        out[r] = now
    return out


def wilder(x: np.ndarray, first: int, n: int) -> np.ndarray:
    """Wilder's mean: seeded with the mean of the n rows after ``first``."""
    out = np.full(len(x), np.nan)
    if n < 1 or first + n >= len(x):
        return out
    now = x[first + 1 : first + n + 1].mean()
    out[first + n] = now
    for r in range(first + n + 1, len(x)):
        now = (now * (n - 1.0) + x[r]) / n
        out[r] = now
    return out


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    first = listing(x)
    if first is None:
        return np.full(len(x), np.nan)
    d = np.diff(x, prepend=np.nan)
    d[~np.isfinite(d)] = 0.0
    up, down = wilder(np.maximum(d, 0.0), first, n), wilder(np.maximum(-d, 0.0), first, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100.0 - 100.0 / (1.0 + up / down)
    return np.where(down == 0.0, 100.0, out)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Missing parts are passed over unless all are."""
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    first = listing(close)
    return np.full(len(close), np.nan) if first is None else wilder(true_range(high, low, close), first, n)


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """+DI and -DI in percent of the smoothed true range; missing while that is missing or 0."""
    first = listing(close)
    none = np.full(len(close), np.nan)
    if first is None:
        return none, none
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    span = wilder(true_range(high, low, close), first, n)
    span = np.where(np.isfinite(span) & (span != 0), span, np.nan)
    return 100.0 * wilder(plus, first, n) / span, 100.0 * wilder(minus, first, n) / span


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    plus, minus = directional(high, low, close, n)
    first = listing(close)
    if first is None:
        return plus
    both = plus + minus
    dx = np.where(both == 0, 0.0, 100.0 * np.abs(plus - minus) / np.where(both == 0, 1.0, both))
    return wilder(dx, first + n - 1, n)
