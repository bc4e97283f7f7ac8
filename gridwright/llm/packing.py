"""Filling fixed-capacity containers with items.

Sizes are whole tokens, so a histogram of sizes, at most ``capacity`` numbers
whatever the number of items, decides everything: the driver packs *counts* of sizes (items above a third of
the capacity are matched greedily, at most two to a container; smaller ones best-fit the gaps), and each item then
takes the next free slot of its size, found from its rank among the items of that size.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.session import staged

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Plan:
    """For each size the slots in order: from slot ``at`` on, ``each`` in every container from ``first`` on."""

    containers: int = 0
    at: dict[int, list[int]] = field(default_factory=dict)
    first: dict[int, list[int]] = field(default_factory=dict)
    each: dict[int, list[int]] = field(default_factory=dict)
    filled: dict[int, int] = field(default_factory=dict)

    def place(self, size: int, first: int, bins: int, each: int) -> None:
        """``each`` items of ``size`` into each of ``bins`` containers from ``first`` on."""
        done = self.filled.get(size, 0)
        self.at.setdefault(size, []).append(done)
        self.first.setdefault(size, []).append(first)
        self.each.setdefault(size, []).append(each)
        self.filled[size] = done + bins * each

    def open(self, bins: int) -> int:
        self.containers += bins
        return self.containers - bins


class _Gaps:
    """Groups of containers (first, number) by the room left in them."""

    def __init__(self) -> None:
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, bins: int) -> None:
        if gap <= 0 or bins <= 0:
            return
        if gap not in self.groups:
            self.groups[gap] = []
            insort(self.sizes, gap)
        self.groups[gap].append((first, bins))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """The group with the least room of at least ``size``."""
        i = bisect_left(self.sizes, size)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, bins = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.sizes.pop(i)
        return gap, first, bins


def packed(counts: dict[int, int], capacity: int) -> Plan:
    """A plan for ``counts`` items of each size from 1 to ``capacity``."""
    plan, gaps = Plan(), _Gaps()
    left = {s: c for s, c in counts.items() if c > 0 and 0 < s <= capacity}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        big = large[-1]
        # the largest partner that fits beside it
        i = bisect_left(large, capacity - big + 1) - 1
        if i < 0:
            n = left[big]
            first = plan.open(n)
            plan.place(big, first, n, 1)
            gaps.add(capacity - big, first, n)
            left[big] = 0
        else:
            mate = large[i]
            n = left[big] // 2 if mate == big else min(left[big], left[mate])
            if n:
                first = plan.open(n)
                plan.place(big, first, n, 2 if mate == big else 1)
                if mate != big:
                    plan.place(mate, first, n, 1)
                gaps.add(capacity - big - mate, first, n)
                left[big] -= n
                left[mate] -= n
            if mate == big and left[big]:
                # one is left: beside the next smaller one, or alone
                if i > 0:
                    mate = large[i - 1]
                    first = plan.open(1)
                    plan.place(big, first, 1, 1)
                    plan.place(mate, first, 1, 1)
                    gaps.add(capacity - big - mate, first, 1)
                    left[mate] -= 1
                else:
                    first = plan.open(1)
                    plan.place(big, first, 1, 1)
                    gaps.add(capacity - big, first, 1)
                left[big] = 0
        large = [s for s in large if left[s]]
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            found = gaps.take(size)
            if found is None:
                each = capacity // size
                bins, rest = divmod(n, each)
                if bins:
                    first = plan.open(bins)
                    plan.place(size, first, bins, each)
                    gaps.add(capacity - each * size, first, bins)
                if rest:
                    first = plan.open(1)
                    plan.place(size, first, 1, rest)
                    gaps.add(capacity - rest * size, first, 1)
                break
            gap, first, bins = found
            each = min(gap // size, n)
            use = min(bins, n // each)
            plan.place(size, first, use, each)
            gaps.add(gap - each * size, first, use)
            gaps.add(gap, first + use, bins - use)
            n -= use * each
    return plan


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens: the size of every document's whole text; 0 for NULL and empty texts. ``tokenizer`` is a file that every executor can read."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc", "n_tokens"])

    return docs.select(col(doc_id), col(text)).mapInArrow(cut, f"doc {kind}, n_tokens bigint").withColumnRenamed("doc", doc_id)


def fill(sizes: DataFrame, item: str, size: str, containers: DataFrame, kind: str, capacity: str, salts: int = 64) -> DataFrame:
    """kind, container_id, item, piece_no, n_tokens: every item whole in one container of each kind.

    An item above the capacity is split into full containers and a rest; no other is. Items of size 0 or NULL take no
    room and have no row; repeated items are packed as often as they occur. ``containers`` (kind, capacity) is a small
    table; a NULL or non-positive capacity holds nothing. Ranks within a size are counted in ``salts`` parts, so no
    size, however common, is ordered in one task.
    """
    kinds = {r[0]: int(r[1]) for r in containers.select(col(kind), col(capacity)).distinct().collect() if r[0] is not None and r[1] and r[1] > 0}
    caps = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("cap")) for k, c in kinds.items()])
    base = sizes.select(col(item).alias("item"), col(size).cast("bigint").alias("n")).where(F.col("n") > 0)
    if not kinds:
        return base.select(F.lit("").alias(kind), F.lit(0).cast("bigint").alias("container_id"), F.col("item").alias(item), F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("n_tokens")).where("false")
    cut = base.select("item", "n", F.inline(caps))
    pieces = cut.select("item", "kind", "n", "cap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("cap")).cast("bigint"))).alias("piece"))
    pieces = pieces.select("item", "kind", F.col("piece").cast("int").alias("piece"), F.least("cap", F.col("n") - F.col("piece") * F.col("cap")).alias("size"))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("item", "piece"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("kind", "size", "_salt").agg(F.count(F.lit(1)).alias("c"))
    histogram: dict[str, dict[int, int]] = {k: {} for k in kinds}
    for r in counts.groupBy("kind", "size").agg(F.sum("c").alias("c")).toLocalIterator():  # at most the capacity's number of rows a kind
        histogram[r["kind"]][r["size"]] = r["c"]
    plans = {k: packed(histogram[k], c) for k, c in kinds.items()}
    arrays = {(k, s): (np.array(p.at[s]), np.array(p.first[s]), np.array(p.each[s])) for k, p in plans.items() for s in p.at}
    held = sizes.sparkSession.sparkContext.broadcast(arrays)
    offsets = counts.withColumn("_before", F.sum("c").over(Window.partitionBy("kind", "size").orderBy("_salt")) - F.col("c")).drop("c")
    rank = F.row_number().over(Window.partitionBy("kind", "size", "_salt").orderBy("item", "piece")) - 1
    ranked = pieces.withColumn("_rank", rank).join(offsets, ["kind", "size", "_salt"]).select("kind", "item", "piece", "size", (F.col("_before") + F.col("_rank")).alias("rank"))
    type_of = sizes.schema[item].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            sz, rk = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            out = np.zeros(len(sz), np.int64)
            order = np.lexsort((sz, names.astype(str))) if len(sz) else np.zeros(0, int)
            a, b = names[order], sz[order]
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1 if len(sz) else []
            for own in np.split(order, cuts) if len(sz) else []:
                at, first, each = plan[(names[own[0]], int(sz[own[0]]))]
                i = np.searchsorted(at, rk[own], "right") - 1
                out[own] = first[i] + (rk[own] - at[i]) // each[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), batch.column(1), batch.column(2), batch.column(3)], names=["kind", "container_id", "item", "piece_no", "n_tokens"])

    out = ranked.mapInArrow(placed, f"kind string, container_id bigint, item {type_of}, piece_no int, n_tokens bigint")
    return out.select(F.col("kind").alias(kind), "container_id", F.col("item").alias(item), "piece_no", "n_tokens")


def pack_documents(docs: DataFrame, doc_id: str, text: str, containers: DataFrame, kind: str, capacity: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents measured by a public tokenizer and packed; sizes are counted once and kept in the shared folder."""
    return fill(staged(token_counts(docs, doc_id, text, tokenizer), "sizes"), doc_id, "n_tokens", containers, kind, capacity)
