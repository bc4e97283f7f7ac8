"""The expression catalogue: 71 tags, their surface names and arguments (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field

#: kinds of argument: expr, expr? (optional), exprs (list), num, num?, bool?, str, str?, strs?
CALLS: dict[str, tuple[str, dict[str, str]]] = {
    "sma": ("Average", {"of": "expr", "n": "num"}),
    "ema": ("Ema", {"of": "expr", "n": "num"}),
    "std": ("Std", {"of": "expr", "n": "num"}),
    "rsi": ("Rsi", {"of": "expr", "n": "num"}),
    "pct_change": ("PctChange", {"of": "expr", "n": "num"}),
    "rise": ("Rise", {"of": "expr", "n": "num"}),
    "fall": ("Fall", {"of": "expr", "n": "num"}),
    "shift": ("Shift", {"of": "expr", "n": "num"}),
    "rolling_max": ("RollingMax", {"of": "expr", "n": "num"}),
    "rolling_min": ("RollingMin", {"of": "expr", "n": "num"}),
    "bollinger_mid": ("BollingerMid", {"of": "expr", "n": "num"}),
    "bollinger_upper": ("BollingerUpper", {"of": "expr", "n": "num", "k": "num?"}),
    "bollinger_lower": ("BollingerLower", {"of": "expr", "n": "num", "k": "num?"}),
    "macd": ("Macd", {"of": "expr", "fast": "num?", "slow": "num?"}),
    "macd_signal": ("MacdSignal", {"of": "expr", "fast": "num?", "slow": "num?", "signal": "num?"}),
    "macd_hist": ("MacdHist", {"of": "expr", "fast": "num?", "slow": "num?", "signal": "num?"}),
    "donchian_high": ("DonchianHigh", {"of": "expr", "n": "num"}),
    "donchian_low": ("DonchianLow", {"of": "expr", "n": "num"}),
    "donchian_mid": ("DonchianMid", {"of": "expr", "n": "num"}),
    "atr": ("Atr", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "natr": ("Natr", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "willr": ("WillR", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "cci": ("Cci", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "stoch_k": ("StochK", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "stoch_d": ("StochD", {"high": "expr", "low": "expr", "close": "expr", "n": "num", "d": "num?"}),
    "aroon_up": ("AroonUp", {"high": "expr", "n": "num"}),
    "aroon_down": ("AroonDown", {"low": "expr", "n": "num"}),
    "adx": ("Adx", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "plus_di": ("PlusDi", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "minus_di": ("MinusDi", {"high": "expr", "low": "expr", "close": "expr", "n": "num"}),
    "obv": ("Obv", {"close": "expr", "volume": "expr"}),
    "mfi": ("Mfi", {"high": "expr", "low": "expr", "close": "expr", "volume": "expr", "n": "num"}),
    "vwap": ("Vwap", {"high": "expr", "low": "expr", "close": "expr", "volume": "expr", "n": "num"}),
    "is_largest": ("IsLargest", {"of": "expr", "n": "num"}),
    "is_smallest": ("IsSmallest", {"of": "expr", "n": "num"}),
    "rank": ("Rank", {"of": "expr", "pct": "bool?", "ascending": "bool?"}),
    "quantile_row": ("QuantileRow", {"of": "expr", "c": "num"}),
    "winsorize": ("Winsorize", {"of": "expr", "lower": "num", "upper": "num"}),
    "zscore": ("Zscore", {"of": "expr"}),
    "bucket": ("Bucket", {"of": "expr", "n": "num"}),
    "demean": ("Demean", {"of": "expr"}),
    "normalize_row": ("NormalizeRow", {"of": "expr"}),
    "sustain": ("Sustain", {"of": "expr", "nwindow": "num", "nsatisfy": "num?"}),
    "is_entry": ("IsEntry", {"of": "expr"}),
    "is_exit": ("IsExit", {"of": "expr"}),
    "exit_when": ("ExitWhen", {"entry": "expr", "exit": "expr"}),
    "hold_until": ("HoldUntil", {"entry": "expr", "exit": "expr", "nstocks_limit": "num?", "rank": "expr?"}),
    "rebalance": ("Rebalance", {"of": "expr", "freq": "str?", "on": "expr?"}),
    "vol_target": ("VolTarget", {"of": "expr", "prices": "expr", "target": "num?", "n": "num?"}),
    "neutralize": ("Neutralize", {"of": "expr", "by": "exprs", "add_const": "bool?"}),
    "neutralize_industry": ("NeutralizeIndustry", {"of": "expr", "add_const": "bool?"}),
    "industry_rank": ("IndustryRank", {"of": "expr", "categories": "strs?"}),
    "cap_industry": ("CapIndustry", {"of": "expr", "max_weight": "num?"}),
    "groupby_category": ("GroupbyCategory", {"of": "expr", "agg": "str"}),
    "in_sector": ("InSector", {"of": "expr", "name": "str"}),
    "ceil": ("Ceil", {"of": "expr"}),
    "mask": ("Mask", {"of": "expr", "by": "expr"}),
}
ALIASES = {"average": "sma"}
INFIX = {"or": ("Or", 1), "and": ("And", 2), ">": ("Gt", 3), "<": ("Lt", 3), ">=": ("Ge", 3), "<=": ("Le", 3), "+": ("Add", 4), "-": ("Sub", 4), "*": ("Mul", 5), "/": ("Div", 5)}
PREFIX = {"not": "Not", "-": "Neg"}
DEFAULTS = {"k": 2.0, "fast": 12, "slow": 26, "signal": 9, "d": 3, "pct": True, "ascending": True, "target": 0.1, "add_const": True, "max_weight": 0.3}
NAMES = {tag: name for name, (tag, _) in CALLS.items()}
TAGS = ["Data", "Const", *(t for t, _ in INFIX.values()), *PREFIX.values(), *NAMES]


@dataclass(frozen=True)
class Node:
    """An expression: a tag and its arguments; expressions among them are nodes or tuples of nodes."""

    tag: str
    args: tuple[tuple[str, object], ...] = field(default=())

    def get(self, name: str, default: object = None) -> object:
        return dict(self.args).get(name, DEFAULTS.get(name, default) if default is None else default)

    def children(self) -> list[Node]:
        out: list[Node] = []
        for _, v in self.args:
            out += [v] if isinstance(v, Node) else [x for x in v if isinstance(x, Node)] if isinstance(v, tuple) else []
        return out


def node(tag: str, **args: object) -> Node:
    return Node(tag, tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in args.items() if v is not None))


def data(name: str) -> Node:
    return node("Data", name=name)


def const(value: float) -> Node:
    return node("Const", value=float(value))


def to_json(n: Node) -> dict:
    """The tagged-tree form: {"op": tag, argument: value, ...}."""
    plain = lambda v: to_json(v) if isinstance(v, Node) else [plain(x) for x in v] if isinstance(v, tuple) else v
    return {"op": n.tag, **{k: plain(v) for k, v in n.args}}


def from_json(d: dict) -> Node:
    if not isinstance(d, dict) or d.get("op") not in TAGS:
        raise ValueError(f"unknown op: {d.get('op') if isinstance(d, dict) else d!r}")
    made = lambda v: from_json(v) if isinstance(v, dict) and "op" in v else tuple(made(x) for x in v) if isinstance(v, list) else v
    return Node(d["op"], tuple((k, made(v)) for k, v in d.items() if k != "op" and v is not None))


def series_of(n: Node) -> list[str]:
    """The input series an expression reads, in order of first use."""
    own = [str(n.get("name"))] if n.tag == "Data" else []
    return list(dict.fromkeys([*own, *(s for c in n.children() for s in series_of(c))]))


def max_lookback(n: Node) -> int:
    """The longest single window among n, nwindow and d of any node."""
    own = max((int(v) for k, v in n.args if k in ("n", "nwindow", "d") and isinstance(v, (int, float))), default=0)
    return max([own, *(max_lookback(c) for c in n.children())])


def schema() -> list[dict]:
    """The catalogue in machine-readable form."""
    leaves = [{"tag": "Data", "form": "leaf", "args": {"name": "str"}}, {"tag": "Const", "form": "leaf", "args": {"value": "num"}}]
    calls = [{"tag": t, "form": "call", "name": n, "args": dict(a), "defaults": {k: DEFAULTS[k] for k in a if k in DEFAULTS}} for n, (t, a) in CALLS.items()]
    infix = [{"tag": t, "form": "infix", "name": s, "args": {"l": "expr", "r": "expr"}} for s, (t, _) in INFIX.items()]
    return leaves + calls + infix + [{"tag": t, "form": "prefix", "name": s, "args": {"of": "expr"}} for s, t in PREFIX.items()]


def within(n: Node, membership: str) -> Node:
    """The expression held to the members of an index: multiplied by whether its membership series is at least a half."""
    return node("Mul", l=n, r=node("Ge", l=data(membership), r=const(0.5)))
