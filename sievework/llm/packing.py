"""Filling fixed-capacity containers: vector best-fit.

An item longer than a container is cut into full containers and one remainder; every other item stays
whole. Items are dealt by the hash of their id into groups of about ``GROUP`` items, each packed in one
task, longest first, so a group loses at most about one container in some hundreds. A container has
three capacities: tokens, documents and attention cost (the sum of squared lengths). Among the open
containers that can take an item under all three, the one whose weighted residual after placing it has
the least norm is chosen. An item that alone exceeds the attention cost is not split: it has a container for itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 4096


def best_fit(sizes: np.ndarray, capacity: int, most_docs: int, most_cost: float, weights: tuple[float, float, float]) -> np.ndarray:
    """Container number of each size (given longest first), by vector best-fit.

    Containers of equal residual tokens and documents are alike for tokens and documents, so they are
    scanned as one vector; closed ones (no room for the smallest item) leave it.
    """
    limit = np.array([capacity, most_docs, most_cost], float)
    res = np.empty((len(sizes), 3))
    name = np.empty(len(sizes), np.int64)
    out = np.empty(len(sizes), np.int64)
    live = made = 0
    smallest = int(sizes[-1]) if len(sizes) else 0
    w = np.array(weights, float) / limit**2
    for i, n in enumerate(sizes):
        need = np.array([n, 1.0, float(n) * n])
        left = res[:live] - need
        ok = np.flatnonzero((left >= 0).all(axis=1))
        if len(ok):
            at = ok[np.argmin((left[ok] ** 2) @ w)]
        else:
            at = live
            res[at], name[at] = limit, made
            live += 1
            made += 1
        res[at] -= need
        out[i] = name[at]
        if res[at, 0] < smallest or res[at, 1] < 1 or res[at, 2] < smallest * smallest:
            live -= 1
            res[at], name[at] = res[live], name[live]
    return out


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = 2048, most_docs: int | None = None, most_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> DataFrame:
    """``(id_col, piece_no, start_at, n_tokens, container_id)``, one row per placed piece.

    Items of null or no size take no room and give no row; ids must be unique; an empty table gives no
    row. ``container_id`` is 'group-number'. No container holds more than ``capacity`` tokens, ``most_docs``
    pieces or, if it holds several, a summed squared length of ``most_cost`` (by default both follow from ``capacity`` alone).
    """
    docs_cap, cost_cap = most_docs or capacity, most_cost or float(capacity) ** 2
    live = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size")).where("size > 0 and id is not null")
    pieces = live.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))))
    pieces = pieces.select("id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start_at"), F.least(F.lit(capacity), F.col("size") - F.col("piece_no") * capacity).alias("n_tokens"))
    full = pieces.where(F.col("n_tokens") >= capacity).withColumn("container_id", F.concat(F.lit("f-"), "id", F.lit("-"), "piece_no"))
    rest = pieces.where(F.col("n_tokens") < capacity)
    groups = max(1, -(-live.count() // GROUP))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable")
        at = best_fit(pdf["n_tokens"].to_numpy(np.int64), capacity, docs_cap, cost_cap, weights)
        g = pdf["grp"].iloc[0]
        return pdf[["id", "piece_no", "start_at", "n_tokens"]].assign(container_id=[f"{g}-{k}" for k in at])

    packed = rest.groupBy("grp").applyInPandas(run, "id bigint, piece_no int, start_at bigint, n_tokens bigint, container_id string")
    return full.unionByName(packed).withColumnRenamed("id", id_col)


def packing_report(packed: DataFrame, id_col: str, capacity: int, most_docs: int, most_cost: float) -> DataFrame:
    """One row ``(documents, tokens, containers, fill, over_capacity, split_needlessly)`` of the result of ``pack``: the share of the room that is used, how many containers break a capacity, and how many documents no longer than a container are split."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("c"))
    over = (F.col("t") > capacity) | (F.col("k") > most_docs) | (F.col("k") > 1) & (F.col("c") > most_cost)
    b = bins.agg(F.count("*").alias("containers"), (F.sum("t") / (F.count("*") * capacity)).alias("fill"), F.count(F.when(over, 1)).alias("over_capacity"))
    docs = packed.groupBy(id_col).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    d = docs.agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"), F.count(F.when((F.col("t") <= capacity) & (F.col("k") > 1), 1)).alias("split_needlessly"))
    return d.crossJoin(b)  # one row each
