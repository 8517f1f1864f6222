"""Items that appear together: heavy-light pair counting with lift.

Items held by at least a ``1/heavy``-th share of all basket entries are heavy, so at most ``heavy`` of them
exist whatever the data, and their names are sent to all tasks. Each task lays its baskets out as one bit column per heavy
item and counts heavy-heavy pairs by AND + popcount over packed words. Pairs of rare items are counted by
sorting their packed codes, and a rare item with heavy ones by probing the basket's heavy list. Every task sums its
counts before they are shuffled. Items in fewer than ``min_together`` baskets cannot form a case and leave first: a heavy
item is looked up in the list that was sent, so only rare ones, none of which is hot, are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import fold

CHUNK = 512  # rare items of one basket that meet in one task
PAIRS = 1 << 20  # pairs that are held before they are summed


def _pair_counter(n_heavy: int, block: int = 65536):
    """Counts pairs of item codes; heavy items have the codes below ``n_heavy``.

    A row holds ``heavy`` codes, ``rare`` codes, and ``other`` rare codes: with null in ``other`` the row's rare items meet each
    other and its heavy ones, else they meet ``other`` only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_heavy, n_heavy), np.int64)
        bits = np.zeros((n_heavy, block), np.uint8)
        filled = 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush_bits() -> None:
            nonlocal filled
            if not filled or not n_heavy:
                return
            packed = np.packbits(bits[:, : -(-filled // 64) * 64], axis=1).view(np.uint64)
            present = np.flatnonzero(packed.any(axis=1))
            for x, i in enumerate(present):
                rest = present[x + 1 :]
                if len(rest):
                    counts[i, rest] += np.bitwise_count(packed[i] & packed[rest]).sum(axis=1, dtype=np.int64)
            bits[:] = 0
            filled = 0

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return a[first], b[first], np.add.reduceat(n, first)

        def add(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal waiting
            if len(a):
                held.append((np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64)))
                waiting += len(a)

        def emit(a, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lists = []
                for c in batch.columns:
                    size = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    lists.append((c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size, np.cumsum(size) - size))
                (heavy, n_h, at_h), (rare, n_r, at_r), (other, n_o, at_o) = lists
                alone = batch.column(2).is_null().to_numpy(zero_copy_only=False)
                # bit columns of the baskets that hold a heavy item
                live = np.flatnonzero(n_h)
                for lo in range(0, len(live), block):
                    some = live[lo : lo + block]
                    if filled + len(some) > block:
                        flush_bits()
                    column = np.repeat(np.arange(len(some)) + filled, n_h[some])
                    bits[heavy[_ranges(at_h[some], n_h[some])], column] = 1
                    filled += len(some)
                row = np.repeat(np.arange(len(n_r)), n_r)  # the row of each rare item
                # probing: each rare item with the heavy ones of its row
                add(np.repeat(rare, n_h[row]), heavy[_ranges(at_h[row], n_h[row])])
                # each rare item with those behind it in its row
                here = np.arange(len(rare))
                behind = np.where(alone[row], at_r[row] + n_r[row] - here - 1, 0)
                add(np.repeat(rare, behind), rare[_ranges(here + 1, behind)])
                across = np.where(alone[row], 0, n_o[row])
                add(np.repeat(rare, across), other[_ranges(at_o[row], across)])
                if waiting > PAIRS:
                    one = summed()
                    held[:] = [one]
                    waiting = len(one[0])
                    if waiting > PAIRS // 2:
                        yield emit(*one)
                        held.clear()
                        waiting = 0
        flush_bits()
        i, j = np.nonzero(counts)
        if len(i):
            held.append((i.astype(np.int64), j.astype(np.int64), counts[i, j]))
        if held:
            yield emit(*summed())

    return run


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``start``, ``start + 1``, ... (``n`` of them) of each pair, behind each other."""
    return np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def item_pairs(entries: DataFrame, basket: str, item: str, min_together: int = 5, min_lift: float = 3.0, heavy: int = 512) -> DataFrame:
    """Pairs of folded items with ``ab``, ``a``, ``b``, ``n`` and ``lift = ab*n/(a*b)``; kept if ``ab >= min_together`` and ``lift >= min_lift``.

    Null or blank items and null baskets are none; repeated entries count once; an empty table gives no
    row. ``item_a < item_b`` by code point. A basket with more than ``CHUNK`` rare items is split into
    chunks whose pairs are counted in separate tasks.
    """
    spark = entries.sparkSession
    one = cut(entries.select(F.col(basket).alias("basket"), fold(F.col(item)).alias("item")).where("basket is not null and item <> ''").distinct())
    total = one.agg(F.countDistinct("basket").alias("n_all"), F.count("*").alias("entries")).first()
    if not total["n_all"]:
        return spark.createDataFrame([], "item_a string, item_b string, ab bigint, a bigint, b bigint, n bigint, lift double")
    freq = one.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_together)
    # at most `heavy` items can hold a 1/heavy share of the entries each, so this list is bounded; the others are numbered behind them
    is_heavy = F.col("n") * F.lit(heavy) >= F.lit(total["entries"])
    freq = cut(freq.withColumn("is_heavy", is_heavy))
    tops = spark.createDataFrame([(r["item"], k) for k, r in enumerate(freq.where("is_heavy").select("item").orderBy("item").collect())], "item string, code bigint")
    n_heavy = tops.count()
    light = freq.where("not is_heavy").select("item", "n", (F.monotonically_increasing_id() + n_heavy).alias("code"))
    named = cut(light.unionByName(freq.where("is_heavy").join(F.broadcast(tops), "item").select("item", "n", "code")))
    tagged = one.join(F.broadcast(tops), "item", "left")
    kept = tagged.where("code is not null").select("basket", "code").unionByName(tagged.where("code is null").select("basket", "item").join(named.where(F.col("code") >= n_heavy).select("item", "code"), "item").select("basket", "code"))
    kept = cut(kept.groupBy("basket").agg(F.collect_list(F.when(F.col("code") < n_heavy, F.col("code"))).alias("heavy"), F.sort_array(F.collect_list(F.when(F.col("code") >= n_heavy, F.col("code")))).alias("rare")))
    none = F.array().cast("array<bigint>")
    counted = kept.where(F.size("rare") <= CHUNK).select("heavy", "rare", F.lit(None).cast("array<bigint>").alias("other"))
    large = kept.where(F.size("rare") > CHUNK)
    # a large basket: its heavy items once, and each chunk of rare ones with the heavy ones, itself and the chunks behind it
    starts = F.sequence(F.lit(1), F.size("rare"), F.lit(CHUNK))
    chunks = large.select("heavy", "rare", F.explode(starts).alias("i")).select("heavy", "rare", "i", F.slice("rare", F.col("i"), F.lit(CHUNK)).alias("own"))
    within = chunks.select(F.when(F.col("i") == 1, F.col("heavy")).otherwise(none).alias("heavy"), "own", F.lit(None).cast("array<bigint>").alias("other"))
    probing = chunks.where("i > 1 and size(heavy) > 0").select(none.alias("heavy"), "own", F.col("heavy").alias("other"))
    behind = F.filter(starts, lambda j: j > F.col("i"))
    across = chunks.select("own", "rare", F.explode(behind).alias("j")).select(none.alias("heavy"), "own", F.slice("rare", F.col("j"), F.lit(CHUNK)).alias("other"))
    split = within.unionByName(probing).unionByName(across).withColumnRenamed("own", "rare")
    counted = counted.unionByName(split.repartition(F.xxhash64("rare", "other")))
    pairs = counted.mapInArrow(_pair_counter(n_heavy), "a bigint, b bigint, n bigint")
    ab = pairs.groupBy("a", "b").agg(F.sum("n").alias("ab")).where(F.col("ab") >= min_together)
    n = int(total["n_all"])
    side = lambda s: named.select(F.col("code").alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))
    scored = ab.join(side("a"), "a").join(side("b"), "b").where(F.col("ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return scored.select(
        F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "ab", F.when(F.col("item_a") < F.col("item_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("a"),
        F.when(F.col("item_a") < F.col("item_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("b"), F.lit(n).alias("n"), (F.col("ab") * F.lit(n) / (F.col("n_a") * F.col("n_b"))).alias("lift"),
    )
