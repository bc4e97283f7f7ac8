"""Evaluation passages in documents: a prefix-filtered set join over rare shingles with exact verification.

A document holds part of an item if it has ``least`` consecutive tokens of the item's passage (words; characters for
scripts without spaces). Each such window of an item is a set of shingles of which a document must
contain all, so its prefix is one shingle, and the rarest in the corpus is taken. Documents meet the items in
prefix shingles only; length and position bounds drop pairs with no room for a window; the rest is verified token by token.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.llm.mail import texts
from gridwright.session import staged

_WORD = re.compile(r"[^\W_]+")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Rule:
    """``least`` consecutive tokens count as a hit; shingles of ``width`` tokens are joined."""

    least: int
    width: int


WORDS, SIGNS = Rule(13, 5), Rule(20, 8)
#: The items' shingles are broadcast as a bitmap of at most this many bits (16 MB), whatever their number; it only lets too much pass, never too little.
MOST_BITS = 1 << 27
#: Over so many keys the places of one shingle and the pairs of one item are spread.
SALTS = 16


def normal(text: str) -> str:
    """Compatibility form, lower case, without invisible characters."""
    if not text.isascii():
        text = text.translate(_INVISIBLE)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return text.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(normal(text))


def signs(text: str) -> str:
    return "".join(_WORD.findall(normal(text)))


def hashed(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of tokens, the same in every process."""
    import xxhash

    seen: dict[str, int] = {}
    get = xxhash.xxh3_64_intdigest
    return np.fromiter((seen[t] if t in seen else seen.setdefault(t, get(t)) for t in tokens), np.uint64, len(tokens))


def coded(text: str) -> np.ndarray:
    """Hashes of a text's characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (points + np.uint64(1)) * _MIX


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """Rolling hashes of all runs of ``width`` token codes, as signed 64-bit numbers."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _FACTOR + codes[k : k + n]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def item_tokens(items: DataFrame, item_id: str, passage: str, lang: str, dense: tuple[str, ...]) -> DataFrame:
    """item, dense, tokens, shingles of every passage long enough to leak; languages in ``dense`` go by characters."""
    kind = items.schema[item_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flags, toks, shs = [], [], [], []
            for i, p, lg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not p:
                    continue
                is_dense = (lg or "").strip().lower() in dense
                rule = SIGNS if is_dense else WORDS
                t = list(signs(p)) if is_dense else words(p)
                if len(t) < rule.least:
                    continue
                ids.append(i)
                flags.append(is_dense)
                toks.append(t)
                shs.append(shingles(coded("".join(t)) if is_dense else hashed(t), rule.width).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(flags, pa.bool_()), pa.array(toks, pa.list_(pa.string())), pa.array(shs, pa.list_(pa.int64()))], names=["item", "dense", "tokens", "shingles"])

    return items.select(col(item_id), col(passage), col(lang)).mapInArrow(cut, f"item {kind}, dense boolean, tokens array<string>, shingles array<bigint>").dropDuplicates(["item"])


def _streams(text: str) -> Iterator[tuple[bool, list[str] | str, np.ndarray]]:
    """The token streams of a mail: words of each text in it, and characters where it holds dense script."""
    for t in texts(text):
        w = words(t)
        if len(w) >= WORDS.width:
            yield False, w, hashed(w)
        if _DENSE.search(t):
            s = "".join(w)
            if len(s) >= SIGNS.width:
                yield True, s, coded(s)


HIT = "doc {kind}, seg int, dense boolean, size int, start int, window array<string>, places array<int>, found array<bigint>"


def bitmap(shingled: DataFrame, n: int) -> np.ndarray:
    """The shingles as bits of a power of two in number, 64 a shingle if that many may be; put together before it is collected."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (64 * n - 1).bit_length()))
    at = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    made = shingled.select(F.shiftright(at, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits >> 5, np.uint32)
    out[made["word"].to_numpy(np.int64)] = made["bit"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_runs(sh: np.ndarray, bits: np.ndarray, least: int) -> np.ndarray:
    """Places of the shingles that may be wanted, in runs of at least ``least`` of them: a window of tokens is such a run."""
    at = sh.view(np.uint64) & np.uint64(len(bits) * 32 - 1)
    there = (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], there.astype(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    return np.concatenate([np.arange(a, b) for a, b in zip(begin[long], end[long], strict=True)]) if long.any() else np.zeros(0, np.int64)


def hits(docs: DataFrame, doc_id: str, text: str, bits: np.ndarray) -> DataFrame:
    """Where documents hold runs of wanted shingles, with the tokens around them."""
    kind = docs.schema[doc_id].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = held.value
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for seg, (dense, tokens, codes) in enumerate(_streams(t or "")):
                    rule = SIGNS if dense else WORDS
                    if len(codes) < rule.least:
                        continue
                    sh = shingles(codes, rule.width)
                    at = in_runs(sh, want, rule.least - rule.width + 1)
                    if not len(at):
                        continue
                    for group in np.split(at, np.flatnonzero(np.diff(at) > rule.least) + 1):
                        low, high = max(0, int(group[0]) - rule.least), int(group[-1]) + rule.width + rule.least
                        rows.append((d, seg, dense, len(codes), low, list(tokens[low:high]), (group - low).tolist(), sh[group].tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [batch.column(0).type, pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc", "seg", "dense", "size", "start", "window", "places", "found"])

    return docs.select(col(doc_id), col(text)).mapInArrow(cut, HIT.format(kind=kind))


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, lang: str, dense: tuple[str, ...] = ("zh", "ja")) -> DataFrame:
    """doc_id, item_id: each document with each item of which it holds a window of consecutive tokens.

    NULL and empty texts and passages hold nothing; passages shorter than a window can't leak. Repeated documents
    and items give one row. Whole texts are read: own and quoted text, HTML and attachments.
    """
    it = staged(item_tokens(items, item_id, passage, lang, dense), "items")
    flat = it.select("item", "dense", F.size("tokens").alias("n"), F.posexplode("shingles").alias("q", "shingle"))
    bound = it.agg(F.sum(F.size("shingles"))).first()[0] or 0
    raw = staged(hits(docs, doc_id, text, bitmap(flat, bound)), "hits")
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("_salt")
    salted = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = raw.select("doc", "seg", "start", "size", salt, F.explode(F.arrays_zip("places", "found")).alias("h")).select("doc", "seg", "start", "size", "_salt", F.col("h.places").alias("p"), F.col("h.found").alias("shingle"))
    # rarity: in how many documents each item shingle occurs in a run that may be a window, over the whole corpus
    rarity = found.select("shingle", "doc").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(rarity, "shingle", "left").withColumn("_rank", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("shingle"), F.col("q")))
    reach = lambda r: r.least - r.width
    by = Window.partitionBy("item", "dense").orderBy("q")
    picked = F.when(F.col("dense"), F.min("_rank").over(by.rowsBetween(0, reach(SIGNS)))).otherwise(F.min("_rank").over(by.rowsBetween(0, reach(WORDS))))
    least = F.when(F.col("dense"), SIGNS.least).otherwise(WORDS.least)
    prefix = ranked.withColumn("_pick", picked).where(F.col("q") + least <= F.col("n")).select("item", "dense", "n", F.col("_pick.shingle").alias("shingle"), F.col("_pick.q").alias("q"), F.col("_pick.df").alias("df")).where(F.col("df") > 0).distinct()
    # length and position bounds: a window around the shared shingle must fit into both; ``p`` counts from the window's start
    met = found.join(salted(prefix), ["shingle", "_salt"]).withColumn("_at", F.col("p") + F.col("start"))
    room = F.least("_at", "q") + F.least(F.col("size") - F.col("_at"), F.col("n") - F.col("q"))
    met = met.where(room >= least).select("doc", "seg", "start", "_salt", "item", "dense", (F.col("p") - F.col("q")).alias("shift")).distinct()
    pairs = met.join(raw.select("doc", "seg", "start", "dense", "window"), ["doc", "seg", "start", "dense"]).join(salted(it.select("item", "tokens")), ["item", "_salt"])
    # exact: the longest run of equal tokens with the passage laid at this shift
    n = F.greatest(F.lit(0), F.least(F.size("tokens"), F.size("window") - F.col("shift")) - F.greatest(F.lit(0), -F.col("shift")))
    first = F.greatest(F.lit(0), -F.col("shift"))
    same = F.zip_with(F.slice("tokens", first + 1, n), F.slice("window", first + F.col("shift") + 1, n), lambda a, b: a == b)
    run = F.aggregate(same, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda acc, x: F.struct(F.when(x, acc.now + 1).otherwise(0).alias("now"), F.greatest(acc.most, F.when(x, acc.now + 1).otherwise(0)).alias("most"))).most
    out = pairs.where(run >= least).select("doc", "item").distinct()
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
