"""Candidate by profile scores, decisions and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import softmatch
from .extract import small

PROFILES = 1000  # of one block that is laid onto every document
# fixed values: weights of the score's components

UNSHARED = 1.4054651081081644  # ln(3/2) + 1, the weight of a term in one of two texts
WEIGHTS = {"required": 0.28, "preferred": 0.16, "coverage": 0.14, "years": 0.14, "leadership": 0.08, "text_similarity": 0.12, "overlap": 0.08}


def text_similarity(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(resume_id, label, text_similarity)`` of pairs that share a term: TF-IDF cosine over the two texts alone, in closed form.

    Only terms that profiles use are joined; both norms follow from the shared terms' and the whole squared counts.
    """
    tf = lambda df, key, text: df.select(key, F.explode(tx.tokens(F.col(text), tx.STOP)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    d, p = tf(docs, "resume_id", "text"), tf(profiles, "label", "description")
    whole = lambda t, key, name: t.groupBy(key).agg(F.sum(F.col("tf") * F.col("tf")).alias(name))
    dn, pn = whole(d, "resume_id", "d2"), whole(p, "label", "p2")
    shared = d.join(small(p.withColumnRenamed("tf", "ptf")), "term").groupBy("resume_id", "label").agg(
        F.sum(F.col("tf") * F.col("ptf")).alias("dot"), F.sum(F.col("tf") * F.col("tf")).alias("ds"), F.sum(F.col("ptf") * F.col("ptf")).alias("ps")
    )
    norm = lambda s, w: F.sqrt(F.col(s) + UNSHARED**2 * (F.col(w) - F.col(s)))
    out = shared.join(dn, "resume_id").join(small(pn), "label")
    return out.select("resume_id", "label", (F.col("dot") / (norm("ds", "d2") * norm("ps", "p2"))).alias("text_similarity"))


def score_all(docs: DataFrame, skills: DataFrame, experience: DataFrame, profiles: DataFrame, pairs: DataFrame | None = None, threshold: float = 1.01) -> DataFrame:
    """Every document against every profile with its components and ``fit_score``.

    ``docs`` (resume_id, text), ``skills`` (resume_id, canonical), ``experience`` (resume_id, total_years,
    leadership_indicators), ``profiles`` as learned. If ``docs`` has a column ``only``, a document meets the profile of that label alone. The profile list
    is laid onto each document row in blocks and exploded there, with the document's text similarities as a map, so no pair is
    shuffled. With ``pairs`` of like skills (``softmatch.likeness``) close skills count by ``threshold`` as well.
    """
    none = F.array().cast("array<string>")
    own = skills.groupBy("resume_id").agg(F.sort_array(F.collect_set("canonical")).alias("own"))
    sims = text_similarity(docs, profiles).groupBy("resume_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "text_similarity"))).alias("sims"))
    only = [F.col("only")] if "only" in docs.columns else []
    base = docs.select("resume_id", *only).join(own, "resume_id", "left").join(experience.select("resume_id", "total_years", "leadership_indicators"), "resume_id", "left").join(sims, "resume_id", "left")
    if pairs is not None:
        base = base.join(softmatch.closest(skills, pairs), "resume_id", "left")
    base = base.withColumn("own", F.coalesce("own", none)).na.fill(0, ["total_years", "leadership_indicators"])
    prof = profiles.select("label", F.array_distinct(F.coalesce("required_skills", none)).alias("req"), F.array_distinct(F.coalesce("preferred_skills", none)).alias("pref"))
    blocks = prof.groupBy(F.floor(F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.ceil(F.lit(prof.count() / PROFILES))))).alias("block")).agg(F.collect_list(F.struct("label", "req", "pref")).alias("all"))
    laid = base.join(small(blocks.drop("block")))  # each document with each block of profiles
    every = F.filter("all", lambda p: p["label"] == F.col("only")) if only else F.col("all")
    rows = laid.select(*base.columns, F.explode(every).alias("p")).select("*", "p.*").drop("p")
    both = F.array_union("req", "pref")
    least1 = lambda n: F.greatest(n, F.lit(1))
    if pairs is None:
        hit = lambda target: F.size(F.array_intersect("own", target))
        matched = F.sort_array(F.array_intersect("own", both))
    else:
        near = F.coalesce("near", F.create_map().cast("map<string,struct<cosine:double,skill:string>>"))
        hit = lambda target: softmatch.overlap(F.col("own"), near, target, threshold)[0]
        matched = softmatch.overlap(F.col("own"), near, both, threshold)[1]
    parts = {
        "required": hit(F.col("req")) / least1(F.size("req")), "preferred": hit(F.col("pref")) / least1(F.size("pref")),
        "coverage": F.least(hit(both) / least1(F.size("own")), F.lit(1.0)), "years": F.least(F.col("total_years") / 8.0, F.lit(1.0)),
        "leadership": F.least(F.col("leadership_indicators") / 2.0, F.lit(1.0)), "text_similarity": F.coalesce(F.try_element_at("sims", "label"), F.lit(0.0)),
        "overlap": F.size(F.array_intersect("own", both)) / least1(F.size(F.array_union("own", both))),
    }
    fit = sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0)) * 100
    out = rows.select("resume_id", "label", F.round(F.least(F.greatest(fit, F.lit(0.0)), F.lit(100.0)), 2).alias("fit_score"), *(F.round(v, 4).alias(k) for k, v in parts.items()), matched.alias("matched"), both.alias("both"))
    return out.withColumn("missing", F.sort_array(F.array_except("both", "matched"))).drop("both")


def json_scores(rows: DataFrame, keys: list[str], scores: str) -> DataFrame:
    """``(keys, label, score)`` of each numeric entry of a JSON object column; text that isn't one whole JSON object gives no row."""
    text = F.trim(F.col(scores))
    whole = F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    src = rows.select(*keys, whole.alias("v")).where(F.schema_of_variant("v").startswith("ARRAY<OBJECT") & F.expr("try_variant_get(v, '$[1]', 'variant') is null"))
    parsed = src.select(*keys, F.explode(F.expr("try_variant_get(v, '$[0]', 'map<string,variant>')")).alias("label", "value"))
    kind = F.schema_of_variant("value")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return parsed.where(number).select(*keys, tx.label_key(F.col("label")).alias("label"), F.expr("try_variant_get(value, '$', 'double')").alias("score"))


def best_and_margin(scores: DataFrame, id_col: str, label: str, score: str) -> DataFrame:
    """``(id, best_label, best, second, margin)`` of each document; a lone label is its own second."""
    w = Window.partitionBy(id_col).orderBy(F.desc(score), F.asc(label))
    top = scores.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy(id_col).agg(
        F.max(F.when(F.col("rn") == 1, F.col(label))).alias("best_label"), F.max(F.when(F.col("rn") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("rn") == 2, F.col(score))).alias("second")
    )
    return top.withColumn("second", F.coalesce("second", "best")).withColumn("margin", F.col("best") - F.col("second"))


def fit_band(c: Column) -> Column:
    """Fixed values: 'advance' from 70 on, 'consider' from 40 on, else 'reject'."""
    return F.when(c >= 70, "advance").when(c >= 40, "consider").otherwise("reject")


def classification_metrics(rows: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1 over the union of true and predicted labels, weighted F1 and support; a zero denominator gives 0."""
    cells = rows.groupBy(F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count("*").alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("tn"), F.lit(0).cast("bigint").alias("pn"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tn"), F.col("n").alias("pn"), F.lit(0).cast("bigint").alias("tp")))).alias("c")).select("c.*")
    by = each.groupBy("label").agg(F.sum("tn").alias("tn"), F.sum("pn").alias("pn"), F.sum("tp").alias("tp"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))
    by = by.withColumn("prec", div(F.col("tp"), F.col("pn"))).withColumn("rec", div(F.col("tp"), F.col("tn"))).withColumn("f1", div(2 * F.col("tp"), F.col("tn") + F.col("pn")))
    return by.agg(
        F.round(F.sum("tp") / F.sum("tn"), 4).alias("accuracy"), F.round(F.avg("prec"), 4).alias("precision_macro"), F.round(F.avg("rec"), 4).alias("recall_macro"), F.round(F.avg("f1"), 4).alias("f1_macro"),
        F.round(F.sum(F.col("f1") * F.col("tn")) / F.sum("tn"), 4).alias("f1_weighted"), F.sum("tn").alias("support"), F.count("*").alias("classes"),
    )


def ranking_metrics(rows: DataFrame, job: str, item: str, score: str, relevant: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """P@k, recall@k, MAP@k and nDCG@k, averaged over the jobs with a relevant item.

    Rank is by score descending, ties by item; only the ``max(ks)`` best rows of a job are kept past the sort.
    """
    rel = F.col(relevant).cast("int")
    totals = rows.groupBy(job).agg(F.sum(rel).alias("total")).where("total > 0")
    w = Window.partitionBy(job).orderBy(F.desc_nulls_last(score), F.asc(item))
    top = rows.select(job, item, score, rel.alias("rel")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(ks))
    run = Window.partitionBy(job).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = top.withColumn("hits", F.sum("rel").over(run)).join(totals, job)
    cut = top.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    by = cut.groupBy(job, "k", "total").agg(
        F.sum("rel").alias("hit"), F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("k"), F.col("total").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    by = by.withColumn("ideal", ideal)
    return by.groupBy("k").agg(
        F.round(F.avg(F.col("hit") / F.col("k")), 4).alias("precision_at"), F.round(F.avg(F.col("hit") / F.col("total")), 4).alias("recall_at"), F.round(F.avg(F.col("ap") / F.least(F.col("k"), F.col("total"))), 4).alias("map_at"),
        F.round(F.avg(F.col("dcg") / F.col("ideal")), 4).alias("ndcg_at"), F.count("*").alias("jobs"),
    )


def extraction_metrics(gold: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of ``(id, skill)`` rows per group; ids without gold are ignored, missing predictions count as empty."""
    g = gold.distinct().withColumn("g", F.lit(1))
    f = found.distinct().join(gold.select("id").distinct(), "id", "left_semi").withColumn("f", F.lit(1))
    both = g.join(f, list(dict.fromkeys(["id", "skill", *by])), "full")
    out = both.groupBy(*by).agg(F.count(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / F.when(b != 0, b), 4))
    return out.select(*by, "tp", "fp", "fn", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def extraction_report(gold: DataFrame, found: DataFrame, categories: DataFrame) -> DataFrame:
    """One row over all ids with gold: macro averages of the rounded values per id, micro values of the summed counts, and how many skills each side has.

    ``categories`` holds ``(id, category)``; its ids are those that count, so an id of which neither side names a skill counts as 0.
    """
    each = categories.select("id").distinct().join(extraction_metrics(gold, found, ["id"]), "id", "left").na.fill(0)
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / F.when(b != 0, b), 4))
    t, p, n = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return each.agg(
        F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"), F.round(F.avg("f1"), 4).alias("macro_f1"),
        div(t, t + p).alias("micro_precision"), div(t, t + n).alias("micro_recall"), div(2 * t, 2 * t + p + n).alias("micro_f1"), F.count("*").alias("n_resumes"), (t + n).alias("n_gold_skills"), (t + p).alias("n_pred_skills"),
    )


def metric_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two one-row results of ``classification_metrics``."""
    names = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]
    both = a.select(*(F.col(n).alias(f"a_{n}") for n in names)).join(b.select(*(F.col(n).alias(f"b_{n}") for n in names)))  # one row each
    return both.select(*(F.round(F.col(f"a_{n}") - F.col(f"b_{n}"), 4).alias(f"{n}_delta") for n in names))


def fairness(pairs: DataFrame, original: str, perturbed: str, threshold: float = 60.0) -> DataFrame:
    """One row over documents scored twice: mean difference, difference of the selection rates, both means and how many; zeros for none."""
    zero = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    rate = lambda c: F.avg((F.col(c) >= threshold).cast("double"))
    live = pairs.where(F.col(original).isNotNull() & F.col(perturbed).isNotNull())
    return live.agg(
        zero(F.avg(F.col(perturbed) - F.col(original))).alias("mean_score_difference"), zero(rate(perturbed) - rate(original)).alias("selection_rate_difference"),
        zero(F.avg(original)).alias("original_mean"), zero(F.avg(perturbed)).alias("perturbed_mean"), F.count("*").alias("variant_count"),
    )


def bootstrap_interval(values: DataFrame, value: str, iterations: int = 500, seed: int = 42) -> DataFrame:
    """``(lower, upper)`` 95 % interval of the mean over resamples; zeros for no values.

    Poisson bootstrap: each task draws a weight for every row and resample and sends one pair of sums per resample, so the rows are
    read once, and equal rows are drawn apart. Resamples depend on how the rows lie in partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rng = np.random.default_rng([seed, context.partitionId() if context else 0])
        sums, weights = np.zeros(iterations), np.zeros(iterations)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(v), 4096):
                w = rng.poisson(1.0, (iterations, len(v[lo : lo + 4096]))).astype(np.float64)
                sums += w @ v[lo : lo + 4096]
                weights += w.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), pa.array(sums), pa.array(weights)], names=["it", "s", "w"])

    live = values.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    means = live.mapInArrow(run, "it bigint, s double, w double").groupBy("it").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("mean")).where("mean is not null and not isnan(mean)")
    at = lambda q: F.coalesce(F.round(F.get(F.sort_array(F.collect_list("mean")), F.lit(int(q * (iterations - 1)))), 4), F.lit(0.0))
    return means.agg(at(0.025).alias("lower"), at(0.975).alias("upper"))
