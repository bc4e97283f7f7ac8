"""Sentence boundaries across languages and scripts.

Candidates are end marks (with the closing marks after them) before white space or, in scripts without
spaces, anywhere; in scripts without end marks, white space itself. Each is classified by a
maximum-entropy model over its neighbouring tokens, case, length, digits and script. The model learns from
reliable boundaries, paragraph ends, against all candidates inside paragraphs, which are unlabelled: a
candidate is a boundary if its chance of being a paragraph end is near that of sure ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.llm.mail import prose

_CLOSERS = "'\"”’»)\\]）」』】〉》›"
_OPENERS = "'\"“”„«»(\\[（「『【〈《¿¡‹›‘‚—–\\-"
_THAI = "฀-๿຀-໿ក-៿က-႟"
_CJK = "぀-ヿ㐀-鿿豈-﫿"
_CANDIDATE = re.compile(rf"(?P<gap>\s?)(?P<mark>[.!?…。！？؟।॥｡．۔]+)(?P<close>(?:[{_CLOSERS}]|\s[»›]|“(?=\s|$))*)|(?<=[{_THAI}])(?P<space>\s+)(?=\S)")
_LIST = re.compile(r"[ \t]*(?:[-*+•‣▪–—]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))[ \t]+\S")
_OPEN = re.compile(rf"[{_OPENERS}\s]*")
_LAST = re.compile(r"\S+$")
_FIRST = re.compile(r"[^\s.!?…,;:。，！？、؟।،؛]+")
_NETWORK = re.compile(r"[@/_\\:]|\d")


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the least score of a boundary."""

    weights: dict[str, float]
    least: float

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in chosen(features, w))


def chosen(features: list[str] | tuple[str, ...], known) -> list[str]:
    """The features that count: a word's own (w, W) if it is well known, else those of its shape (R)."""
    word = next((f for f in features if f[0] == "w"), None)
    drop = "" if word is None else "R" if word in known else "wW"
    return [f for f in features if f[0] not in drop]


def kind_of(ch: str) -> str:
    """The class of a character that begins a token: U, L, D, K (Chinese, Japanese), T (Thai and the like), O other letters, S signs."""
    if not ch:
        return "N"
    if ch.isdigit():
        return "D"
    if ch.isupper() or ch.istitle():
        return "U"
    if ch.islower():
        return "L"
    if re.match(f"[{_CJK}]", ch):
        return "K"
    if re.match(f"[{_THAI}]", ch):
        return "T"
    return "O" if ch.isalpha() else "S"


def caseless(s: str) -> bool:
    """Whether a text's letters are all of one case, so that case says nothing."""
    letters = [c for c in s if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    lower = sum(c.islower() for c in letters)
    return upper + lower >= 20 and not (upper and lower)


def _marked(mark: str) -> str:
    short = "".join(dict.fromkeys(mark)) if len(mark) > 1 else mark
    return "…" if mark.startswith(("..", "…")) else short


def _next(s: str, at: int, flat: bool) -> tuple[str, str]:
    """The token after a candidate, in lower case, and the class of its first letter, after opening marks."""
    start = _OPEN.match(s, at).end()
    kind = kind_of(s[start : start + 1])
    if kind == "K":
        return s[start : start + 2], kind
    m = _FIRST.match(s, start)
    token = m[0].lower() if m else ""
    if kind == "T":
        token = token[:4]
    elif kind == "D":
        token = "9"
    return token, "X" if flat and kind in "UL" else kind


def features(s: str, m: re.Match, after: tuple[str, str], flat: bool) -> list[str]:
    """What a candidate looks like: neighbouring tokens, case, length, digits and script."""
    token, kind = after
    if m["space"] is not None:
        last = s[max(0, m.start() - 4) : m.start()]
        return ["T", f"Tp{last}", f"Tq{last[-3:]}", f"Tn{kind}"]
    mark, close = _marked(m["mark"]), "".join(m["close"].split())
    gap = "_" if m["gap"] else ""
    out = ["B", f"m{gap}{mark}{close}", f"k{gap}{mark}{close}{kind}"]
    if close:
        return [*out, f"n{token}", f"c{close}{token}"]
    out += [f"n{token}"]
    if mark != ".":
        return out
    before = _LAST.search(s, max(0, m.start() - 40), m.start())
    word = before[0].lstrip("('\"«“„¿¡[（「") if before else ""
    # a single letter keeps its case: an initial is no word
    low = word if len(word) == 1 and not flat else word.lower()
    if any(c.isdigit() for c in low):
        return [*out, f"d{kind}", f"D{token}"]
    earlier = _LAST.search(s, max(0, (before.start() if before else m.start()) - 12), before.start() - 1) if before and before.start() > 1 else None
    chain = earlier[0].lower().lstrip("('\"«“„¿¡[") if earlier and earlier[0].endswith(".") else ""
    shape = f"{min(len(low), 4)}{'.' if '.' in low else ''}{kind_of(word[:1]) if not flat else 'X'}"
    return [*out, f"w{low}", f"W{chain}{low}", f"R{shape}", f"R{shape}{kind}"]


def candidates(s: str, flat: bool) -> Iterator[re.Match]:
    """The possible sentence ends of a paragraph, its own end left out."""
    for m in _CANDIDATE.finditer(s):
        if m["space"] is not None:
            yield m
            continue
        end = m.end()
        if end >= len(s) or not s[end:].strip():
            return
        if s[end].isspace():
            yield m
            continue
        last, here = m["mark"][-1], kind_of(s[end])
        if last in "。！？｡।॥" or (here == "K" and last in "…．"):
            yield m
            continue
        if m["close"] and here == "K":
            yield m
            continue
        # a missing blank: letters on both sides, and no part of an address, a file name or an abbreviation
        left = _LAST.search(s, max(0, m.start() - 40), m.start())
        right = _FIRST.match(s, _OPEN.match(s, end).end())
        if not left or not right or m["gap"]:
            continue
        tail = re.match(r"\S*", s[end:])[0]
        if _NETWORK.search(left[0]) or _NETWORK.search(tail.rstrip(".,!?:;…")):
            continue
        a, b = kind_of(s[m.start() - 1]), kind_of(right[0][0])
        if a == "L" and b == "U" and len(left[0].strip("(\"'«“")) > 1:
            yield m
        elif a == b and a in "ULO" and (flat or a == "O") and len(right[0]) > 1 and len(left[0]) > 1 and ("." not in left[0] or m["mark"] != "."):
            yield m
        elif a == "U" and b == "U" and "." not in tail[:2] and len(right[0]) > 1 and right[0][1].islower():
            yield m


def paragraphs(text: str) -> Iterator[tuple[str, int, bool]]:
    """(paragraph, where it begins in text, whether it is a list entry) of a mail's own prose."""
    for lines in prose(text):
        start = 0
        if _LIST.match(text, lines[0][0], lines[0][1]):
            for k in range(1, len(lines) + 1):
                if k == len(lines) or _LIST.match(text, lines[k][0], lines[k][1]):
                    yield text[lines[start][0] : lines[k - 1][1]], lines[start][0], True
                    start = k
        else:
            # a list may follow its announcing line without a blank one
            k = next((k for k in range(1, len(lines)) if text[lines[k - 1][0] : lines[k - 1][1]].rstrip().endswith((":", "：")) and _LIST.match(text, lines[k][0], lines[k][1])), len(lines))
            yield text[lines[0][0] : lines[k - 1][1]], lines[0][0], False
            start = k
            for j in range(k + 1, len(lines) + 1):
                if j == len(lines) or _LIST.match(text, lines[j][0], lines[j][1]):
                    yield text[lines[start][0] : lines[j - 1][1]], lines[start][0], True
                    start = j


def units(text: str, model: Model, memo: dict | None = None) -> list[tuple[int, int]]:
    """The sentence units of a mail as code point spans, end exclusive, without outer blanks."""
    out = []
    memo = {} if memo is None else memo
    for s, base, entry in paragraphs(text):
        begin = 0
        if not entry:
            flat = caseless(s)
            for m in candidates(s, flat):
                f = features(s, m, _next(s, m.end(), flat), flat)
                key = tuple(f)
                good = memo.get(key)
                if good is None:
                    good = memo[key] = model.score(f) > model.least
                    if len(memo) > 200_000:
                        memo.clear()
                if good:
                    _add(out, s, begin, m.start() if m["space"] is not None else m.end(), base)
                    begin = m.end()
        _add(out, s, begin, len(s), base)
    return out


def _add(out: list[tuple[int, int]], s: str, begin: int, end: int, base: int) -> None:
    piece = s[begin:end]
    left = len(piece) - len(piece.lstrip())
    piece = piece.strip()
    if piece:
        out.append((base + begin + left, base + begin + left + len(piece)))


def examples(text: str) -> Iterator[tuple[bool, tuple[str, ...], str]]:
    """(reliable, features, context) of a mail's candidates: reliable ones end a paragraph, the rest are unlabelled."""
    paras = list(paragraphs(text))
    for i, (s, _, entry) in enumerate(paras):
        if entry:
            continue
        flat = caseless(s)
        for m in candidates(s, flat):
            yield False, tuple(features(s, m, _next(s, m.end(), flat), flat)), " ".join(s[max(0, m.start() - 14) : m.end() + 14].split())
        end = len(s.rstrip())
        follow = paras[i + 1] if i + 1 < len(paras) else None
        after = _next(follow[0], 0, caseless(follow[0])) if follow and not follow[2] else ("", "N")
        last = None
        for m in _CANDIDATE.finditer(s, max(0, end - 12)):
            if m["space"] is None and m.end() == end:
                last = m
        if last is None and re.match(f"[{_THAI}]", s[end - 1 : end]) and " " in s.strip():
            last = re.compile(r"(?P<space>\s*)(?P<mark>)(?P<close>)(?P<gap>)").match(s, end)
        if last is not None:
            yield True, tuple(features(s, last, after, flat)), " ".join(s[max(0, end - 14) : end].split()) + "|" + after[0]


def fit(rows: list[tuple[bool, tuple[str, ...]]], rounds: int = 300, penalty: float = 2.0, common: int = 25) -> Model:
    """A maximum-entropy model of being a paragraph end, by gradient steps on the whole sample, and the score that parts boundaries.

    A word in fewer than ``common`` rows counts by its shape. With none or only one class of rows every candidate counts as a boundary.
    """
    good = np.array([r[0] for r in rows], float)
    if not len(rows) or good.all() or not good.any():
        return Model({}, -1.0)
    seen = Counter(f for r in rows for f in r[1] if f[0] == "w")
    known = {f for f, n in seen.items() if n >= common}
    names: dict[str, int] = {}
    index = [[names.setdefault(f, len(names)) for f in chosen(r[1], known)] for r in rows]
    width = max(map(len, index))
    x = np.array([i + [len(names)] * (width - len(i)) for i in index])
    n, k = len(rows), len(names) + 1
    # before any evidence, a small letter after an unknown word's point is taken for a continuation
    prior = np.zeros(k)
    for f, i in names.items():
        if f[0] == "R" and f.endswith("L") and f[-2].isupper():
            prior[i] = -2.0
    w, m1, m2 = prior.copy(), np.zeros(k), np.zeros(k)
    flat = x.ravel()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-w[x].sum(axis=1)))
        g = np.bincount(flat, np.repeat((p - good) / n, width), k) + penalty / n * (w - prior)
        g[-1] = 0.0
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    p = 1 / (1 + np.exp(-w[x].sum(axis=1)))
    sure = float(np.median(p[good == 1]))
    least = 0.3 * sure
    return Model({f: float(w[i]) for f, i in names.items()}, float(np.log(least / (1 - least))))


def trained(docs: DataFrame, doc_id: str, text: str, fit_docs: int = 8000) -> Model:
    """A model fitted on the mails of a bounded sample: about ``fit_docs`` of them, chosen by a hash of their ids (all, if there are fewer).

    Repeated contexts, as in standard paragraphs, count once.
    """
    total = max(1, docs.count())
    parts = 1_000_000
    share = min(parts, max(1, int(parts * fit_docs / total)))
    sample = docs.where(F.pmod(F.xxhash64(col(doc_id)), F.lit(parts)) < share).select(col(text).alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(good, "\x1f".join(f), context) for t in batch.column(0).to_pylist() if t for good, f, context in examples(t)]
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.bool_()), pa.array(b, pa.string()), pa.array(c, pa.string())], names=["good", "features", "context"])

    # contexts without order of arrival: the fit is the same in every run
    rows = sample.mapInArrow(found, "good boolean, features string, context string").distinct().select("good", "features").toPandas().sort_values(["good", "features"])
    return fit([(g, tuple(f.split("\x1f"))) for g, f in zip(rows["good"], rows["features"], strict=True)])


def sentences(docs: DataFrame, doc_id: str, text: str, fit_docs: int = 8000) -> DataFrame:
    """doc_id, start_char, end_char: one row per sentence unit of every document's own prose.

    Documents with NULL or empty text, or without prose, have no row. Repeated documents come out as often as they
    occur. Texts of any length are processed whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(trained(docs, doc_id, text, fit_docs))
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = held.value, {}
        for batch in batches:
            counts, starts, ends = [], [], []
            for t in batch.column(1).to_pylist():
                spans = units(t, model, memo) if t else []
                counts.append(len(spans))
                starts += [a for a, _ in spans]
                ends += [b for _, b in spans]
            at = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])

    out = docs.select(col(doc_id), col(text)).mapInArrow(cut, f"doc_id {kind}, start_char int, end_char int")
    return out.withColumnRenamed("doc_id", doc_id)
