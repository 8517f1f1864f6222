"""Same or near-same records across splits: exact prefix-filter bipartite join.

The rarest shingles of each evaluation text are indexed and probed with those of the training texts; a match is kept
only if the sizes, the positions and the parity sketches of the two sets still allow the threshold, all
three exact (``prefix``). The rest is verified on the whole sets. Equal sets are one class per side, so exact
copies cost nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import member_pairs
from .prefix import candidate_classes, verified


def within(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` have at most ``radius`` set bits."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32) <= radius


def overlap_classes(docs: DataFrame, id_col: str, text_col: str, side_col: str, threshold: float = 0.8, width: int = 5, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: members ``(id, key, side)`` with ``side`` 0 (evaluation) or 1 (training), pairs of an evaluation class ``key_a`` and a training class ``key_b``.

    Rows with a null id, text or side and texts of fewer than ``min_words`` words take no part; an empty table gives two empty results.
    """
    members, found = candidate_classes(docs, id_col, text_col, F.col(side_col), threshold, width, min_words, within)
    # equal sets on both sides need no check
    same = found.where("key_a = key_b").select("key_a", "key_b", F.lit(None).cast("int").alias("shared"), F.lit(1.0).alias("jaccard"))
    near = verified(found.where("key_a <> key_b"), docs, members, id_col, text_col, threshold, width, min_words)
    return members.select("id", "key", "side"), same.unionByName(near)


def cross_split_pairs(docs: DataFrame, id_col: str, text_col: str, split_col: str, source_col: str, eval_splits: tuple[str, ...] = ("dev", "test"), train_split: str = "train", **kw) -> DataFrame:
    """``(split, source, eval_id, train_id)`` of every evaluation record that also stands, wholly or nearly, in the training split.

    ``split`` must be folded already; other or null splits take no part. A null source stays null.
    """
    side = F.when(F.col(split_col) == train_split, 1).when(F.col(split_col).isin(*eval_splits), 0)
    sided = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"), side.alias("side"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    members, pairs = overlap_classes(sided, "rid", "text", "side", **kw)
    ids = member_pairs(pairs, members.where("side = 0"), members.where("side = 1"))
    info = sided.where("side = 0").select(F.col("rid").alias("a"), "split", "source")
    return ids.join(info, "a").select("split", "source", F.col("a").alias("eval_id"), F.col("b").alias("train_id")).distinct()
