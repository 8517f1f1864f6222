"""Top N items within every group, by score histograms.

Each group of more than N items has a histogram of its scores. The bins are ``PER_OCTAVE`` steps to each doubling of the
score, with the sign, and the same for all groups, so an outlier doesn't coarsen the others. Walking down the bins until N
items are reached gives a threshold that at least N items pass; rows below it leave before any row is
sorted, and the survivors are ranked exactly, each task keeping its N best of a group before they meet, so equal scores
gather nowhere. Thresholds are sent to all tasks while they are few; beyond, rows are spread over ``SALTS`` salts,
so a group with a third of all rows never meets its threshold in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import spread

PER_OCTAVE, SALTS = 64, 32
MOST_SENT = 100_000  # groups up to which their thresholds are sent to all tasks


def score_bin(s: Column) -> Column:
    """A whole number that never falls as the score rises."""
    size = F.least(F.greatest(F.abs(s), F.lit(1e-300)), F.lit(1e300))
    step = 1 + F.floor((F.log2(size) + 1000) * PER_OCTAVE).cast("int")
    return F.when(s > 0, step).when(s < 0, -step).otherwise(F.lit(0))


def thresholds(best: DataFrame, group: list[str], n: int) -> DataFrame:
    """``(group, least_bin)`` of every group of more than ``n`` rows ``(group, bin)``: at least ``n`` of them lie in that bin or above."""
    histogram = best.groupBy(*group, "bin").agg(F.count("*").alias("in_bin"))
    down = Window.partitionBy(*group).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = histogram.withColumn("above", F.sum("in_bin").over(down))
    return walk.groupBy(*group).agg(F.max(F.when(F.col("above") >= n, F.col("bin"))).alias("least_bin"), F.max("above").alias("items")).where(F.col("items") > n).drop("items")


def top_n(rows: DataFrame, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """The ``n`` items of each group with the highest score, ties by item ascending, with ``rank_no`` from 1.

    An item's score is its highest non-null, non-NaN one. Rows with a null in a group column, the item or the score
    are left out; smaller groups list all; an empty table gives no row. Infinite scores rank first or last.
    """
    names, group = group, [f"_group{k}" for k in range(len(group))]
    live = rows.select(*(F.col(n).alias(g) for n, g in zip(names, group, strict=True)), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    live = live.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("item").isNotNull())
    for g in group:
        live = live.where(F.col(g).isNotNull())
    best = cut(live.groupBy(*group, "item").agg(F.max("score").alias("score")).withColumn("bin", score_bin(F.col("score"))))
    floor = cut(thresholds(best, group, n))
    passed = _meet(best, floor, group, floor.count()).where(F.col("least_bin").isNull() | (F.col("bin") >= F.col("least_bin")))
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("item"))
    out = passed.select(*group, "item", "score").withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)
    return out.select(*(F.col(g).alias(name) for g, name in zip(group, names, strict=True)), "item", "score", "rank_no")


def _meet(rows: DataFrame, floor: DataFrame, group: list[str], count: int) -> DataFrame:
    """``rows`` with the threshold of their group: sent to all tasks if few, else joined in salts of which each has a copy."""
    if count <= MOST_SENT:
        return rows.join(F.broadcast(floor), group, "left")
    salted = floor.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread_out = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
    return spread_out.join(salted.hint("merge"), [*group, "salt"], "left").drop("salt")


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def json_scores(rows: DataFrame, key: str, scores: str) -> DataFrame:
    """``(key, label, score)`` of the numeric entries of a JSON object column, each task's best of a key and label.

    Text that isn't one whole JSON object gives no row, nor does an entry that isn't a number, nor a null key. Labels
    are trimmed, upper-cased, with ``_`` read as ``-``.
    """
    src = rows.select(F.col(key).alias("key"), F.col(scores).alias("scores")).where("key is not null and scores is not null")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = json.JSONDecoder(object_pairs_hook=tuple, parse_constant=_refuse).decode
        labels: dict[str, str] = {}
        for b in batches:
            best: dict[tuple, float] = {}
            for k, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not text.lstrip().startswith("{"):
                    continue
                try:
                    entries = decode(text)
                except (ValueError, RecursionError):
                    continue
                for raw, v in entries:
                    if v.__class__ is not float:
                        if v.__class__ is not int:
                            continue
                        v = float(v) if abs(v) < 1 << 1023 else float("inf") * (1 if v > 0 else -1)
                    label = labels.get(raw)
                    if label is None:
                        if len(labels) > 100_000:
                            labels.clear()
                        label = labels[raw] = raw.strip(" ").upper().replace("_", "-")
                    at = (k, label)
                    if (old := best.get(at)) is None or v > old:
                        best[at] = v
            keys, names = zip(*best, strict=True) if best else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(names, pa.string()), pa.array(list(best.values()), pa.float64())], names=["key", "label", "score"])

    return spread(src).mapInArrow(run, f"key {kind}, label string, score double")
