"""Texts packed into containers of a fixed number of tokens.

Sizes are whole numbers up to the capacity, so a packing is worked out on their histogram, whose size is
bounded by the capacity however many documents there are:

* large pieces, above a third of the capacity, are matched greedily, the largest with the largest that still
  fits beside it: at most two to a container;
* smaller ones, in falling size, go to the container where they leave the least room (best fit); new
  containers are opened only when none has room.

The result says which places a run of equally large pieces takes. Each document then finds its own place by
its rank among the pieces of its size.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizer splits a text before it merges bytes (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of one size that are ranked together.
RANKED = 50_000

Segment = tuple[int, int, int, int]  # size, first rank, count, first container


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; a null or empty text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["d"], "n_tokens": [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b["t"]]})

    return docs.select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null").mapInPandas(run, "doc_id bigint, n_tokens bigint")


class _Gaps:
    """Containers by the room left in them, as runs of neighbouring containers."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, start: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.sizes, gap)
            self.runs[gap].append((start, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        k = bisect_left(self.sizes, least)
        if k == len(self.sizes):
            return None
        gap = self.sizes[k]
        start, n = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.pop(k)
        return gap, start, n


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Places for all pieces of a histogram of sizes (1 to capacity), and the number of containers."""
    ranks = dict.fromkeys(counts, 0)
    out: list[Segment] = []
    gaps, bins = _Gaps(), 0

    def place(size: int, n: int, start: int) -> None:
        out.append((size, ranks[size], n, start))
        ranks[size] += n

    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        k = bisect_left(large, capacity - s + 1) - 1
        partner = large[k] if k >= 0 else None
        if partner is None or (partner == s and left[s] == 1 and k == 0):
            n = left[s]
            place(s, n, bins)
            gaps.add(capacity - s, bins, n)
            left[s] = 0
        else:
            if partner == s and left[s] == 1:
                partner = large[k - 1]
            n = left[s] // 2 if partner == s else min(left[s], left[partner])
            place(s, n, bins)
            place(partner, n, bins)
            gaps.add(capacity - s - partner, bins, n)
            left[s] -= n
            left[partner] -= n
        bins += n
        large = [x for x in large if left[x]]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            gap, start, m = gaps.take(s) or (capacity, bins, -(-n // (capacity // s)))
            if start == bins:
                bins += m
            each = gap // s
            full = min(m, n // each)
            for j in range(each if full else 0):
                place(s, full, start)
            gaps.add(gap - each * s, start, full)
            n -= full * each
            rest = m - full
            if rest and n:  # fewer than fill one container
                k = min(n, each)
                for _ in range(k):
                    place(s, 1, start + full)
                gaps.add(gap - k * s, start + full, 1)
                n -= k
                rest -= 1
                full += 1
            gaps.add(gap, start + full, rest)
    return out, bins


def pack(sizes: DataFrame, capacity: int = 2048, doc: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(doc_id, piece_no, token_start, n_tokens, bin_id): every piece with its container.

    A document above the capacity is cut into full pieces and a rest; no other is cut. Documents of size
    0 or null need no container: bin_id is null. Repeated rows are packed each. An empty table gives
    no rows. Containers are numbered from 1.
    """
    tmp = Scratch(sizes.sparkSession, "packing")
    base, _ = tmp.cut(sizes.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n")))
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1)))
    pieces = base.select("doc_id", "n", cut.alias("k"))
    pieces = pieces.select("doc_id", (F.col("k") + 1).cast("int").alias("piece_no"), (F.col("k") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("k") * capacity).alias("n_tokens"))
    histogram = {r["n_tokens"]: r["c"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()}
    total = sum(histogram.values())
    segments, _ = plan({s: c for s, c in histogram.items() if s > 0}, capacity)
    segments.sort()
    # a piece is numbered by the pieces of smaller sizes and its rank among its own: no number exceeds their count
    sizes_ = np.array(sorted({s for s, _, _, _ in segments}), dtype=np.int64)
    base = np.cumsum([0, *(histogram[s] for s in sizes_.tolist())], dtype=np.int64)[:-1]
    keys = np.array([base[np.searchsorted(sizes_, s)] + r for s, r, _, _ in segments], dtype=np.int64)
    firsts = np.array([r for _, r, _, _ in segments], dtype=np.int64)
    starts = np.array([b for _, _, _, b in segments], dtype=np.int64)

    def find(size: pd.Series, rank: pd.Series) -> pd.Series:
        if not len(keys):
            return pd.Series([None] * len(size), dtype="Int64")
        own = np.minimum(np.searchsorted(sizes_, size.to_numpy(np.int64)), len(sizes_) - 1)
        at = np.maximum(np.searchsorted(keys, base[own] + rank.to_numpy(np.int64), side="right") - 1, 0)
        return pd.Series(starts[at] + rank.to_numpy(np.int64) - firsts[at] + 1).where(size.to_numpy() > 0, None).astype("Int64")

    # ranks by size: counted in hash buckets, so that no task ranks more than about RANKED rows
    buckets = max(8, -(-total // RANKED))
    hashed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    offsets = hashed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.select("n_tokens", "bucket", before.alias("before"))
    ranked = hashed.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no")) - 1).join(offsets, ["n_tokens", "bucket"])
    return ranked.select("doc_id", "piece_no", "token_start", "n_tokens", F.pandas_udf(find, "bigint")("n_tokens", (F.col("before") + F.col("r")).cast("bigint")).alias("bin_id"))


def bin_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(bin_id, n_pieces, n_tokens, unused) of each container."""
    return packed.where("bin_id is not null").groupBy("bin_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", capacity - F.col("n_tokens"))
