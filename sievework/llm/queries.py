"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import canon, cooccur, crosssplit, mojibake, neardup, packing, pii, termfreq, tokenise, topn
from .common import fold


def p1_lift(spark: SparkSession, d: str) -> DataFrame:
    resume = cooccur.item_pairs(table(spark, d, "skill_matches"), "resume_id", "canonical_skill", 5, 3.0)
    need = table(spark, d, "profiles_learned").select(F.col("label").alias("row"), F.explode("required_skills").alias("skill"))
    profile = cooccur.item_pairs(need, "row", "skill", 3, 3.0)
    return resume.withColumn("basket", F.lit("resume")).unionByName(profile.withColumn("basket", F.lit("profile")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_lift(spark, d).select("basket", "item_a", "item_b")


def _p2_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "skill_matches").select(F.lit("canonical_skill").alias("field_name"), F.col("resume_id").alias("record"), F.array("canonical_skill").alias("terms"))
    e = table(spark, d, "extracted").select(F.lit("skills_raw").alias("field_name"), F.col("resume_id").alias("record"), F.col("skills_raw").alias("terms"))
    both = m.unionByName(e)
    totals = both.groupBy("field_name").agg(F.countDistinct("record").alias("all_records"))
    rows = both.select("field_name", "record", F.explode("terms").alias("term")).withColumn("term", fold(F.col("term")))
    return rows, totals


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, totals = _p2_rows(spark, d)
    return termfreq.term_verdicts(termfreq.term_counts(rows), totals).select("field_name", "term", "occurrences", "records", "verdict")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_counts(spark, d).where("verdict <> 'useful'").select("field_name", "term", "verdict")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lexicon = table(spark, d, "lexicon")
    matches, extracted = table(spark, d, "skill_matches"), table(spark, d, "extracted")
    frequency = matches.groupBy(fold(F.col("canonical_skill")).alias("canonical")).agg(F.count("*").alias("n")).where("canonical is not null")
    forms = lexicon.select(F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array())))).select(fold(F.col("col")).alias("value")).where("value <> ''").distinct()
    phrase = matches.where("canonical_skill is null").select(F.lit("phrase").alias("field_name"), "resume_id", F.col("pos").cast("bigint").alias("pos"), fold(F.col("phrase")).alias("value"))
    raw = extracted.select(F.lit("skills_raw").alias("field_name"), "resume_id", F.posexplode("skills_raw").alias("pos", "value"))
    raw = raw.select("field_name", "resume_id", F.col("pos").cast("bigint").alias("pos"), fold(F.col("value")).alias("value"))
    raw = raw.join(forms, "value", "left_anti").select(phrase.columns)
    cases = phrase.unionByName(raw).where("value <> ''")
    out = canon.map_values(cases, "value", lexicon, frequency)
    return out.select("field_name", "resume_id", "pos", F.col("meant").alias("canonical_skill")).distinct()


P4 = {"threshold": 0.6, "width": 2, "min_words": 20}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = neardup.near_duplicate_pairs(table(spark, d, "resumes"), "resume_id", "resume_text", **P4)
    return out.select(F.col("id_a").alias("resume_id_a"), F.col("id_b").alias("resume_id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per resume of enough words: its class of equal texts, the class's size and its links to other classes."""
    out = neardup.near_duplicate_rows(table(spark, d, "resumes"), "resume_id", "resume_text", **P4)
    return out.withColumnRenamed("id", "resume_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions")
    labels = topn.top_n(topn.json_scores(p, "resume_id", "scores"), ["key"], "label", "score", 3)
    resumes = topn.top_n(p.select(F.col("req_id").alias("key"), F.col("resume_id").alias("item"), F.col("fit_score").alias("score")), ["key"], "item", "score", 5)
    shape = lambda x, kind: x.select(F.lit(kind).alias("grouping_kind"), F.col("key").cast("string").alias("group_key"), "rank_no", F.col("item").cast("string").alias("item_key"))
    return shape(labels, "resume").unionByName(shape(resumes, "requisition"))


P6 = {"threshold": 0.75, "width": 2, "min_words": 20}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "resumes").withColumn("split", fold(F.col("split")))
    out = crosssplit.cross_split_pairs(docs, "resume_id", "resume_text", "split", "source", **P6)
    return out.select("split", "source", F.least("eval_id", "train_id").alias("resume_id_a"), F.greatest("eval_id", "train_id").alias("resume_id_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation records per split and source."""
    docs = table(spark, d, "resumes").withColumn("split", fold(F.col("split")))
    out = crosssplit.cross_split_pairs(docs, "resume_id", "resume_text", "split", "source", **P6)
    return out.groupBy("split", "source").agg(F.countDistinct("eval_id").alias("eval_records"), F.count("*").alias("pairs"))


def _p7_docs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resumes").select(F.lit("resumes").alias("source_table"), F.col("resume_id").alias("record_id"), F.col("resume_text").alias("text"))
    s = table(spark, d, "sample_resumes").select(F.lit("sample_resumes").alias("source_table"), F.col("raw_id").alias("record_id"), "text")
    return r.unionByName(s)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(_p7_docs(spark, d), table(spark, d, "name_list")).select("source_table", "record_id", "pii_type", "start_at")


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    docs = _p7_docs(spark, d)
    return pii.masked_texts(docs, pii.find_pii(docs, table(spark, d, "name_list")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


P9 = {"capacity": 2048, "most_docs": 64, "most_cost": 0.75 * 2048**2}  # both further capacities bind: see the README


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokenise.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sizes, "doc_id", "n_tokens", **P9)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document is placed whole and within the capacities, and whether at most 2 % more containers are used than the tokens fill, and one."""
    r = packing.packing_report(cut(p9_pack(spark, d)), "doc_id", **P9)
    least = F.col("tokens") / P9["capacity"]
    return r.select("documents", "over_capacity", "split_needlessly", (F.col("containers") <= 1.02 * least + 1).alias("well_filled"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {q.__name__: q for q in (p1_found, p1_lift, p2_found, p2_counts, p3_found, p4_found, p4_classes, p5_found, p6_found, p6_report, p7_found, p7_masked, p8_ids, p9_pack, p9_report, p10_found, p10_restored)}
