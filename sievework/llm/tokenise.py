"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two-tier lookup. A pre-token that is itself an entry of the vocabulary resolves through a minimal perfect
hash: keys are put into small buckets, each bucket gets the first displacement that sends its keys to free
slots, and a slot holds exactly one key, which is compared before its id is taken. All other pre-tokens are
merged by a heap of neighbouring pairs over a doubly linked list of bytes, in ``O(n log n)`` whatever their
length. Resolved pre-tokens are kept in a bounded memo per worker.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

TOKENIZER_DIR = os.environ.get("SIEVEWORK_TOKENIZERS", "/opt/tokenizers")
MEMO = 1 << 19
# fixed value: the pattern that splits text before the merges of the vocabularies of ranks
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PerfectHash:
    """Minimal perfect hash of byte strings to their ids, built by hash and displace."""

    def __init__(self, keys: list[bytes], ids: list[int]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate(h):
            groups[(x >> 96) % self.buckets].append(i)
        self.shift = [0] * self.buckets
        slot: list[int] = [-1] * n
        free_from = 0
        for b in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            g = groups[b]
            if len(g) == 1:  # a lone key takes any free slot, named directly
                while slot[free_from] >= 0:
                    free_from += 1
                slot[free_from] = g[0]
                self.shift[b] = -free_from - 1
                continue
            d = 0
            while g:
                at = [((h[i] & 0xFFFFFFFF) + d * ((h[i] >> 32 & 0xFFFFFFFF) | 1)) % n if d < n else xxhash.xxh64_intdigest(keys[i], d) % n for i in g]
                if len(set(at)) == len(at) and all(slot[a] < 0 for a in at):
                    for a, i in zip(at, g, strict=True):
                        slot[a] = i
                    self.shift[b] = d
                    break
                d += 1
        self.keys = [keys[i] for i in slot]
        self.ids = [ids[i] for i in slot]

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        x = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(x >> 96) % self.buckets]
        if d < 0:
            at = -d - 1
        elif d < self.n:
            at = ((x & 0xFFFFFFFF) + d * ((x >> 32 & 0xFFFFFFFF) | 1)) % self.n
        else:
            at = xxhash.xxh64_intdigest(key, d) % self.n
        return self.ids[at] if self.keys[at] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token, lowest rank first, leftmost among equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # part i covers piece[i:end[i]]; end[i] is also the next part
    prev = list(range(-1, n - 1))
    live = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        live[j] = 0
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts by one vocabulary of ranks; no text is read as a special token. Built on the driver and sent to the tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.pattern = pattern
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self._start()

    def _start(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def piece(self, t: str) -> tuple[int, ...]:
        b = t.encode("utf-8", "replace")
        at = self.whole.get(b)
        ids = (at,) if at >= 0 else tuple(merge_bytes(b, self.ranks))
        if len(b) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[t] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, piece = self.memo, self.piece
        return list(chain.from_iterable([memo.get(t) or piece(t) for t in self.split(text)]))


@lru_cache(4)
def encoder(name: str, folder: str = TOKENIZER_DIR) -> Encoder:
    """The encoder of a file of ranks, which only the driver reads."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return Encoder({base64.b64decode(k): int(v) for k, v in pairs})


def _sent(df: DataFrame, name: str, folder: str):
    """The encoder for all tasks of a query; its size is that of the vocabulary. Executors keep one copy per worker."""
    return df.sparkSession.sparkContext.broadcast(encoder(name, folder))


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, ids)``: the token ids of every text, an empty list for an empty or null text. Ids may repeat or be null; each row gives one row."""

    sent = _sent(docs, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                ids = [np.array(enc.encode(t), np.int32) for t in b.column(1).to_pylist()]
                ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                arr = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), arr], names=["doc", "ids"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(run, "doc bigint, ids array<int>").withColumnRenamed("doc", id_col)


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, n_tokens)`` of every text, 0 for an empty or null one."""

    sent = _sent(docs, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value
        for b in batches:
            n = [sum(len(enc.memo.get(t) or enc.piece(t)) for t in enc.split(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc", "n_tokens"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(run, "doc bigint, n_tokens bigint").withColumnRenamed("doc", id_col)
