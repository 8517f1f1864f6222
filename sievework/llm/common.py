"""Text folding, shingle hashing, set sketches and the expansion of class pairs, shared by the operators of this subpackage."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BASE = 0x2545F4914F6CDD1D  # odd, so that its powers can be undone modulo 2**64
PIECE = 1 << 20  # bytes of text that are hashed at once
MEMBERS = 2048  # documents of one class that meet those of another in one task


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than the cluster has cores; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fold(c: Column) -> Column:
    """Blanks collapsed to one, trimmed, lower-cased; null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words (a-z, 0-9), and a value for each byte."""
    word = np.zeros(256, bool)
    word[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
    return word, mix64(np.arange(1, 257, dtype=np.uint64) * M1)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**k`` and its inverse for k < n, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE * 2)
        _POWERS.clear()
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: one hash per word of all texts in order, and how many words each text has.

    Words are the longest runs of a-z and 0-9 of the lower-cased text. A word's hash is a polynomial over its
    bytes, read off running sums, so the work is a few passes over the bytes whatever the words are.
    """
    low = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    is_word, value = _byte_tables()
    out, counts = [], np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(low):
        hi, size = lo, 0
        while hi < len(low) and (hi == lo or size + len(low[hi]) < PIECE):
            size += len(low[hi]) + 1
            hi += 1
        buf = np.frombuffer(b"\n".join(low[lo:hi]) + b"\n", np.uint8)
        inside = is_word[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.r_[0, edge]
        start, end = edge[::2], edge[1::2]
        power, inverse = _powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(value[buf] * power[:-1], out=run[1:])
            h = mix64((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64) * M2)
        ends = np.cumsum([len(x) + 1 for x in low[lo:hi]])
        counts[lo:hi] = np.diff(np.r_[0, np.searchsorted(start, ends)])
        out.append(h)
        lo = hi
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def by_doc(doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` sorted by document, stable; document numbers fit 16 bits in most batches, which sort by counting."""
    d = doc[order]
    if len(d) and d.max() < 65536:
        d = d.astype(np.uint16)
    return order[np.argsort(d, kind="stable")]


def shingle_batch(texts: list[str | None], width: int = 2, min_words: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, shingle)`` of all texts, sorted by both and without repeats; texts of under ``min_words`` words give none.

    A capital I with a dot is an i, as in SQL; by itself it would be an i and a combining dot, which ends a word.
    """
    h, counts = word_hashes([t and t.replace("\u0130", "i") for t in texts])
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    keep = (doc[:n] == doc[width - 1 :]) & (counts >= max(min_words, width))[doc[:n]]
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for k in range(1, width):
            s = mix64(s * M1 + h[k : n + k] * M2 + np.uint64(k))
    s, d = s[keep], doc[:n][keep]
    order = by_doc(d, np.argsort(s))
    s, d = s[order], d[order]
    first = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])][: len(s)]
    return d[first], s[first]


def set_keys(doc: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, sizes, hi, lo)`` of each document present; equal sets have equal keys of 128 bits."""
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    sizes = np.diff(np.r_[starts, len(doc)])
    with np.errstate(over="ignore"):
        hi = mix64(np.add.reduceat(mix64(sh ^ M1), starts) ^ sizes.astype(np.uint64))
        lo = mix64(np.add.reduceat(mix64(sh ^ M2), starts) * M1 + np.bitwise_xor.reduceat(sh, starts))
    return starts, sizes, hi, lo


def parity_sketch(doc: np.ndarray, sh: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """One bit per bucket: whether an odd number of the set's shingles fall into it.

    The Hamming distance of two sketches is at most the size of the sets' symmetric difference, so a
    cut on it loses no pair.
    """
    at = (mix64(sh ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(bits)).astype(np.int64)
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(sh)]))
    odd = (np.bincount(row * bits + at, minlength=len(starts) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(starts), bits), axis=1, bitorder="little").view(np.uint64)


KEY = "struct<hi: bigint, lo: bigint>"


def key_array(hi: np.ndarray, lo: np.ndarray) -> pa.StructArray:
    """128-bit class keys as Arrow structs."""
    return pa.StructArray.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["hi", "lo"])


def member_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(key_a, key_b, a, b)``: the document ids of all members of the classes ``key_a`` (``left``) and ``key_b`` (``right``) of each pair.

    ``left`` and ``right`` hold ``(id, key)``. A class of more than ``MEMBERS`` documents is cut into blocks, and each pair
    of blocks meets by itself, so a group of copies that holds a third of all rows is spread over many tasks.
    """
    out = pairs.select("key_a", "key_b")
    sizes: dict[int, DataFrame | None] = {}
    for s, members in (("a", left), ("b", right)):
        if id(members) not in sizes:
            many = cut(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS).select("key", F.ceil(F.col("n") / MEMBERS).cast("int").alias("k")))
            sizes[id(members)] = many if many.limit(1).count() else None
        many = sizes[id(members)]
        named = members.select(F.col("key").alias(f"key_{s}"), F.col("id").alias(s))
        if many is None:
            out = out.join(named, f"key_{s}")
            continue
        many = many.withColumnRenamed("key", f"key_{s}")
        blocks = named.join(many, f"key_{s}", "left").withColumn("block", F.pmod(F.xxhash64(s), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
        out = out.join(many, f"key_{s}", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
        out = out.join(blocks, [f"key_{s}", "block"]).drop("block")
    return out.select("key_a", "key_b", "a", "b")
