"""Exact prefix filter over shingle sets: the candidates of problems 4 and 6.

A first pass over all texts counts shingles in ``BUCKETS`` hash buckets and notes each text's class (equal
sets are one class). The counts order shingles from rare to common; any order is right, a good one is fast.
Two sets of Jaccard similarity ``t`` or more share one of their ``n - ceil(t*n) + 1`` first shingles in that
order, and at the first one they share, what is left of both sets still allows the overlap needed. So a
second pass sends only those first shingles, as postings packed per task and partition of the
shingles, with each class's size and parity sketch once per partition. A partition sorts its postings by
shingle and size, reads each posting's partners off one range, and hands the pairs whose sizes and
positions fit to ``compare``, which decides by the sketches. Every filter is exact; nothing is left to chance.

A shingle in the first part of more than ``HOT`` classes is counted exactly, and its postings are cut into tiles; each
pair of tiles meets in a group of its own, so no task meets more than the square of a tile. Only such shingles are copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import KEY, M2, by_doc, key_array, mix64, parity_sketch, set_keys, shingle_batch, spread

BUCKETS, BITS = 1 << 20, 384
HOT, MOST_HOT = 1 << 17, 1 << 20
POSTINGS = 2_000_000  # of a partition
LANES = 1 << 20  # pairs that are looked at together
CLASS = np.dtype([("hi", np.uint64), ("lo", np.uint64), ("size", np.int32), ("side", np.uint8), ("sketch", np.uint64, (BITS // 64,))])
POSTING = np.dtype([("group", np.uint64), ("cls", np.int32), ("pos", np.int32), ("half", np.uint8)])


def level_of(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit levels that keep their order apart from near ties."""
    return np.minimum(np.round(np.log2(1.0 + counts) * 1400), 65535).astype(np.uint16)


def _kept(size: np.ndarray, t: float) -> np.ndarray:
    """How many of a set's first shingles are needed."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _first_shingles(doc, sh, starts, sizes, levels, t):
    """``(shingle, row of its set, position)`` of the first shingles of every set, by level and hash."""
    order = by_doc(doc, np.argsort(levels[(sh % np.uint64(BUCKETS)).astype(np.int64)], kind="stable"))
    pos = np.arange(len(sh)) - np.repeat(starts, sizes)
    keep = pos < np.repeat(_kept(sizes, t), sizes)
    return sh[order][keep], np.repeat(np.arange(len(starts)), sizes)[keep], pos[keep]


def _distinct(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, number)``: one row of each class and side, and which of them each row is."""
    order = np.lexsort((cls["side"], cls["lo"], cls["hi"]))
    s = cls[order]
    new = np.r_[True, (s["hi"][1:] != s["hi"][:-1]) | (s["lo"][1:] != s["lo"][:-1]) | (s["side"][1:] != s["side"][:-1])][: len(s)]
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def survey(src: DataFrame, width: int, min_words: int) -> DataFrame:
    """One pass over ``(id, text, side)``: rows ``(id, side, key, size)`` of all texts with enough words, and rows ``(bucket, n)`` of each task's counts."""
    schema = f"id bigint, side tinyint, key {KEY}, size int, bucket int, n bigint"
    kinds = [pa.int64(), pa.int8(), pa.struct([("hi", pa.int64()), ("lo", pa.int64())]), pa.int32(), pa.int32(), pa.int64()]
    names = ["id", "side", "key", "size", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            doc, sh = shingle_batch(b.column(1).to_pylist(), width, min_words)
            if not len(doc):
                continue
            counts += np.bincount((sh % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            starts, sizes, hi, lo = set_keys(doc, sh)
            at = pa.array(doc[starts])
            n = len(starts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), key_array(hi, lo), pa.array(sizes.astype(np.int32)), pa.nulls(n, kinds[4]), pa.nulls(n, kinds[5])], names=names)
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 1 << 17):
            part = at[lo : lo + (1 << 17)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), k) for k in kinds[:4]), pa.array(part.astype(np.int32)), pa.array(counts[part])], names=names)

    return src.mapInArrow(run, schema)


def hot_shingles(src: DataFrame, levels, t: float, width: int, min_words: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shingles, counts)`` that stand in the first part of more than ``most`` sets, by an exact count of those in full buckets."""
    bound = level_of(np.array([most]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sh = shingle_batch(b.column(1).to_pylist(), width, min_words)
            if len(doc):
                starts, sizes, _, _ = set_keys(doc, sh)
                s = _first_shingles(doc, sh, starts, sizes, levels.value, t)[0]
                s, n = np.unique(s[levels.value[(s % np.uint64(BUCKETS)).astype(np.int64)] >= bound], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], names=["s", "n"])

    rows = src.mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > most).orderBy("s").toArrow()
    s, n = rows.column("s").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _send(levels, hot, t: float, width: int, min_words: int, parts: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: list[np.ndarray] = []
        posts: list[np.ndarray] = []
        n_classes = n_posts = 0
        hot_s, hot_n = hot.value

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_classes, n_posts
            if classes:
                cls, post = np.concatenate(classes), np.concatenate(posts)
                part = (mix64(post["group"] ^ M2) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                post, part = post[order], part[order]
                ends = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
                lo = 0
                for hi in ends:
                    own = post[lo:hi].copy()
                    used, own["cls"] = np.unique(own["cls"], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([part[lo]], pa.int32()), pa.array([cls[used].tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())], names=["part", "classes", "postings"])
                    lo = hi
            classes.clear()
            posts.clear()
            n_classes = n_posts = 0

        for b in batches:
            doc, sh = shingle_batch(b.column(1).to_pylist(), width, min_words)
            if not len(doc):
                continue
            starts, sizes, hi, lo = set_keys(doc, sh)
            cls = np.empty(len(starts), CLASS)
            cls["hi"], cls["lo"], cls["size"] = hi, lo, sizes
            cls["side"] = b.column(2).to_numpy(zero_copy_only=False)[doc[starts]]
            cls["sketch"] = parity_sketch(doc, sh, starts, BITS)
            s, row, pos = _first_shingles(doc, sh, starts, sizes, levels.value, t)
            # copies in one batch are sent once
            lone = np.zeros(len(cls), bool)
            lone[_distinct(cls)[0]] = True
            ok = lone[row]
            s, row, pos = s[ok], row[ok], pos[ok]
            new = np.cumsum(lone) - 1
            post = np.empty(len(s), POSTING)
            post["group"], post["cls"], post["pos"], post["half"] = s, new[row] + n_classes, pos, 2
            if len(hot_s):
                at = np.minimum(np.searchsorted(hot_s, s), len(hot_s) - 1)
                is_hot = hot_s[at] == s
                tiles = -(-hot_n[at[is_hot]] // tile)
                own = post[is_hot]
                copy = np.repeat(np.arange(len(own)), tiles)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                mine = (mix64(hi[row[is_hot]] ^ s[is_hot]) % tiles.astype(np.uint64)).astype(np.int64)[copy]
                own = own[copy]
                with np.errstate(over="ignore"):
                    own["group"] = mix64(own["group"] ^ mix64((np.minimum(mine, other).astype(np.uint64) << np.uint64(32)) + np.maximum(mine, other).astype(np.uint64) + np.uint64(1)))
                own["half"] = np.where(mine == other, 2, mine > other)
                post = np.concatenate([post[~is_hot], own])
            classes.append(cls[lone])
            posts.append(post)
            n_classes += int(lone.sum())
            n_posts += len(post)
            if n_posts > POSTINGS // 2:
                yield from flush()
        yield from flush()

    return run


def partners(post: np.ndarray, cls: np.ndarray, t: float, bipartite: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class index pairs that share a group and whose sizes and positions allow the threshold, in pieces of about ``LANES``."""
    _, group = np.unique(post["group"], return_inverse=True)
    size = cls["size"][post["cls"]].astype(np.int64)
    order = np.lexsort((post["cls"], size, group))
    group, size, c, half = group[order].astype(np.int64), size[order], post["cls"][order], post["half"][order]
    left = size - post["pos"][order]
    again = np.r_[False, (group[1:] == group[:-1]) & (c[1:] == c[:-1]) & (half[1:] == half[:-1])][: len(c)]
    if again.any():
        group, size, c, half, left = (x[~again] for x in (group, size, c, half, left))
    # a partner's size that what is left here still allows; both ways round the condition is exact
    reach = np.floor(left * (1 + t) / t - size + 1e-6).astype(np.int64)
    code = group << 32
    end = np.searchsorted(code + size, code + np.minimum(reach, (1 << 31) - 1), side="right")
    here = np.arange(len(c))
    count = np.maximum(end - here - 1, 0)
    count[reach < size] = 0
    total = np.cumsum(count)
    lo = 0
    while lo < len(c):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LANES, side="right"))
        hi = max(hi, lo + 1)
        n = count[lo:hi]
        i = np.repeat(here[lo:hi], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = reach[j] >= size[i]
        ok &= (half[i] == 2) | (half[i] != half[j])
        i, j = c[i[ok]], c[j[ok]]
        if bipartite:
            ok = cls["side"][i] != cls["side"][j]
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j
        lo = hi


def _meet(t: float, bipartite: bool, compare: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    ratio = (1 - t) / (1 + t)

    def solve(cls: list[bytes], posts: list[bytes]) -> Iterator[pa.RecordBatch]:
        at = np.cumsum([0] + [len(x) // CLASS.itemsize for x in cls])
        rows = np.frombuffer(b"".join(cls), CLASS)
        post = np.frombuffer(b"".join(posts), POSTING).copy()
        post["cls"] += np.repeat(at[:-1], [len(x) // POSTING.itemsize for x in posts]).astype(np.int32)
        first, number = _distinct(rows)  # copies come from several tasks
        rows = rows[first]
        post["cls"] = number[post["cls"]]
        size, sketch, side = (np.ascontiguousarray(rows[x]) for x in ("size", "sketch", "side"))
        found = []
        for i, j in partners(post, rows, t, bipartite):
            radius = np.floor((size[i].astype(np.int64) + size[j]) * ratio + 1e-9).astype(np.int32)
            near = compare(sketch[i] ^ sketch[j], radius)
            i, j = i[near], j[near]
            if bipartite:
                i, j = np.where(side[i] == 0, i, j), np.where(side[i] == 0, j, i)
            else:
                i, j = np.minimum(i, j), np.maximum(i, j)
            found.append(np.unique(i.astype(np.int64) * len(rows) + j))
        if found:
            code = np.unique(np.concatenate(found))
            i, j = code // len(rows), code % len(rows)
            if len(i):
                yield pa.RecordBatch.from_arrays([key_array(rows["hi"][i], rows["lo"][i]), key_array(rows["hi"][j], rows["lo"][j])], names=["key_a", "key_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cls, posts = None, [], []
        for b in batches:
            for p, c, q in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if p != part:
                    if cls:
                        yield from solve(cls, posts)
                    part, cls, posts = p, [], []
                cls.append(c)
                posts.append(q)
        if cls:
            yield from solve(cls, posts)

    return run


def candidate_classes(docs: DataFrame, id_col: str, text_col: str, side: object, t: float, width: int, min_words: int, compare: Callable) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``members`` holds ``(id, side, key, size)`` of every text with enough words, ``pairs`` distinct ``(key_a, key_b)`` that may reach ``t``.

    ``side`` is a column of 0 and 1 (pairs then join a class of side 0 with one of side 1, equal ones too) or None (pairs of different classes).
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), (F.lit(0) if side is None else side).cast("tinyint").alias("side"))
    src = spread(src.where("id is not null and text is not null and side is not null"))
    seen = cut(survey(src, width, min_words))
    members = seen.where("id is not null").select("id", "side", "key", "size")
    counts = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    table = np.zeros(BUCKETS, np.int64)
    table[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    total = members.agg(F.sum(F.col("size") - F.ceil(F.col("size") * t) + 1)).first()[0] or 0
    levels = spark.sparkContext.broadcast(level_of(table))
    most = max(HOT, total // MOST_HOT)  # so at most MOST_HOT shingles are hot
    hot = (np.empty(0, np.uint64), np.empty(0, np.int64))
    if table.max() > most:
        hot = hot_shingles(src, levels, t, width, min_words, most)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // POSTINGS))
    rows = src.mapInArrow(_send(levels, spark.sparkContext.broadcast(hot), t, width, min_words, parts, most), "part int, classes binary, postings binary")
    met = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_meet(t, side is not None, compare), f"key_a {KEY}, key_b {KEY}")
    return members, cut(met.distinct())


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float, width: int, min_words: int) -> DataFrame:
    """``(key_a, key_b, shared, jaccard)`` of the class pairs that reach the threshold on their whole shingle sets.

    One text of each class is read by its id and its class found anew, as other texts may have the same id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sh = shingle_batch(b.column(0).to_pylist(), width, min_words)
            if len(doc):
                starts, _, hi, lo = set_keys(doc, sh)
                sets = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(sh)].astype(np.int32)), pa.array(sh.view(np.int64)))
                yield pa.RecordBatch.from_arrays([key_array(hi, lo), sets], names=["key", "sh"])

    keys = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    one = members.join(keys, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(one, "id", "left_semi")
    sets = cut(text.select("text").mapInArrow(run, f"key {KEY}, sh array<bigint>").join(keys, "key", "left_semi").dropDuplicates(["key"]))
    a = sets.select(F.col("key").alias("key_a"), F.col("sh").alias("sh_a"))
    b = sets.select(F.col("key").alias("key_b"), F.col("sh").alias("sh_b"))
    both = pairs.join(a, "key_a").join(b, "key_b").withColumn("shared", F.size(F.array_intersect("sh_a", "sh_b")))
    both = both.withColumn("all", F.size("sh_a") + F.size("sh_b") - F.col("shared"))
    return both.where(F.col("shared") + 1e-9 >= F.lit(threshold) * F.col("all")).select("key_a", "key_b", "shared", (F.col("shared") / F.col("all")).alias("jaccard"))
