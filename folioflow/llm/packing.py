"""Problem 8: documents packed into containers of fixed token capacity.

Method: conflict-constrained best fit. Each group of items is packed by decreasing size; open bins are ordered by their
residual and carry bitmaps of the sources and duplicate clusters they hold. A successor search walks up from the
smallest sufficient residual until it meets the tightest bin without a conflict. Copies of one text never share a bin;
a source conflict is soft: it is given up only when no bin without it has room.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed together by one task: enough for a tight fit, few enough for any executor.
GROUP = 16_384


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, copy_key); null and blank texts are left out. Only these few columns go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            texts, sizes, memo = batch.column("text").to_pylist(), [], {}
            for t in texts:
                if t not in memo:
                    memo[t] = len(encode(t))
                sizes.append(memo[t])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int32()), batch.column("copy_key")], names=["doc_id", "source", "n_tokens", "copy_key"])

    given = documents.where(F.col("text").rlike(r"[^\s\p{Z}]")).select("doc_id", "source", "text", F.xxhash64("text").alias("copy_key"))
    return given.mapInArrow(run, "doc_id long, source string, n_tokens int, copy_key long")


class Bins:
    """Open bins by residual. ``fit`` is the successor search; ``levels`` has a bit for each residual with open bins."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.levels = capacity, 0
        self.open: dict[int, list[int]] = {}
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def new(self) -> int:
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.residual) - 1

    def fit(self, size: int, source: int, cluster: int) -> int:
        """The tightest bin without any conflict, else the tightest that only shares the source, else -1."""
        above, soft = self.levels >> size, -1
        level = size
        while above:
            step = (above & -above).bit_length() - 1
            level += step
            above >>= step
            for b in self.open[level]:
                if self.clusters[b] & cluster:
                    continue
                if not self.sources[b] & source:
                    return b
                if soft < 0:
                    soft = b
            level += 1
            above >>= 1
        return soft

    def put(self, b: int, size: int, source: int, cluster: int) -> None:
        old = self.residual[b]
        if old in self.open and b in self.open[old]:
            self.open[old].remove(b)
            if not self.open[old]:
                del self.open[old]
                self.levels &= ~(1 << old)
        left = self.residual[b] = old - size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if left:
            self.open.setdefault(left, []).append(b)
            self.levels |= 1 << left


def pack_group(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, part, start, tokens, bin) for the items of one group; only items over the capacity are in several parts."""
    bins, out = Bins(capacity), []
    bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    # only a cluster with several items here can conflict, so only those have a bit
    shared = {c: 1 << i for i, c in enumerate(c for c, n in Counter(clusters.tolist()).items() if n > 1)}
    mark = [shared.get(c, 0) for c in clusters.tolist()]
    rest = []
    for i, n in enumerate(sizes):
        part = 0
        while n - part * capacity > capacity:
            b = bins.new()
            bins.put(b, capacity, bit[sources[i]], mark[i])
            out.append((i, part, part * capacity, capacity, b))
            part += 1
        rest.append((int(n) - part * capacity, i, part))
    for size, i, part in sorted(rest, key=lambda x: (-x[0], x[1])):
        source, cluster = bit[sources[i]], mark[i]
        b = bins.fit(size, source, cluster)
        if b < 0:
            b = bins.new()
        bins.put(b, size, source, cluster)
        out.append((i, part, part * capacity, size, b))
    return out


def pack(documents: DataFrame, *, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """(container_id, doc_id, part, start_token, n_tokens).

    Items are dealt to groups of about ``group`` items by a hash of their id, whatever their source, so a hot source
    spreads evenly; the groups are packed independently and each wastes at most a few bins. Text stays behind at the
    scan: only ids and sizes are shuffled. Null and blank texts, and null ids, are left out; an empty table gives an empty packing;
    a text whose tokens exceed the capacity is cut into parts of the full capacity and a rest.
    """
    sized = token_counts(documents.where("doc_id is not null"), tokenizer)
    n = max(1, -(-documents.where("doc_id is not null").count() // group))

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("doc_id", kind="stable").reset_index(drop=True)
        sources = items["source"].where(items["source"].notna(), "").to_numpy()
        packed = pack_group(items["n_tokens"].to_numpy(), sources, items["copy_key"].to_numpy(), capacity)
        out = pd.DataFrame(packed, columns=["i", "part", "start_token", "n_tokens", "bin"])
        return pd.DataFrame({"container_id": out["bin"] * n + key[0], "doc_id": items["doc_id"].to_numpy()[out["i"]] if len(out) else [], "part": out["part"], "start_token": out["start_token"], "n_tokens": out["n_tokens"]})

    dealt = sized.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("g").applyInPandas(run, "container_id long, doc_id long, part int, start_token int, n_tokens int")


def containers(packing: DataFrame) -> DataFrame:
    """Use of each container: (container_id, items, used_tokens)."""
    return packing.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("used_tokens"))
