"""Skills matched by likeness: a target counts in part if a candidate's skill is close to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import small

FLOOR = 0.5  # fixed value: weight of a match just at the threshold


def soft_weight(cosine: Column, threshold: float) -> Column:
    """1 at a cosine of 1, 0 below the threshold, between them from ``FLOOR`` to 1 in a straight line."""
    rise = FLOOR + (1 - FLOOR) * (cosine - threshold) / max(1e-6, 1 - threshold)
    return F.when(cosine >= 1, 1.0).when(cosine < threshold, 0.0).otherwise(rise)


def likeness(vectors: DataFrame, least: float) -> DataFrame:
    """``(skill, target, cosine)`` of the different names whose unit vectors ``(id, term, weight)`` share a term and reach ``least``."""
    a = vectors.select(F.col("id").alias("skill"), "term", F.col("weight").alias("x"))
    b = vectors.select(F.col("id").alias("target"), "term", F.col("weight").alias("y"))
    dots = a.join(b, "term").where("skill <> target").groupBy("skill", "target").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.select("skill", "target", F.least(F.round("dot", 9), F.lit(1.0)).alias("cosine")).where(F.col("cosine") >= least)


def closest(skills: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(resume_id, near)``: for each document a map from target to ``(cosine, skill)`` of its closest skill, ties by name."""
    met = skills.select("resume_id", F.col("canonical").alias("skill")).distinct().join(small(pairs), "skill")
    best = met.groupBy("resume_id", "target").agg(F.min_by("skill", F.struct(-F.col("cosine"), "skill")).alias("skill"), F.max("cosine").alias("cosine"))
    return best.groupBy("resume_id").agg(F.map_from_entries(F.collect_list(F.struct("target", F.struct("cosine", "skill")))).alias("near"))


def overlap(own: Column, near: Column, targets: Column, threshold: float) -> tuple[Column, Column]:
    """``(score, matched)`` of a set of targets: exact ones count 1, close ones their weight; no own skills or no targets score 0.

    Weights of 0 don't match, so with a threshold above 1 only exact names do.
    """
    close = lambda t: F.coalesce(soft_weight(F.try_element_at(near, t)["cosine"], threshold), F.lit(0.0))
    weight = lambda t: F.when(F.array_contains(own, t), 1.0).otherwise(close(t))
    live = F.when(F.size(own) > 0, targets).otherwise(F.array().cast("array<string>"))
    weights = F.transform(live, weight)
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s + w), F.sort_array(F.filter(live, lambda t: weight(t) > 0))
