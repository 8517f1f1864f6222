"""The jobs a user runs, as functions over paths and as commands: ``python -m sievework.plans.entrypoints preprocess --input-csv ... --output-dir ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract, rationale, scoring, vectors
from ..session import cut
from ..sources import files

CORPUS = "resume_id long, resume_text string, label string"


def truthy(value: str | None) -> bool:
    """Whether a setting is switched on."""
    return (value or "").strip().lower() in {"1", "true", "yes", "on"}


def encoder(name: str, extra: dict | None = None):
    """A phrase encoder by name: 'tfidf' (built in, also what 'auto' falls back on), or one that the caller registers in ``extra``; each takes ``(phrases, lexicon)`` and gives the search's rows."""
    known = {"tfidf": lambda p, lexicon: vectors.lexicon_search(p, "phrase", lexicon)} | (extra or {})
    if name == "auto":
        return known.get("semantic", known["tfidf"])
    if name not in known:
        raise ValueError(f"no encoder {name!r} among {sorted(known)}")
    return known[name]


def preprocess(spark: SparkSession, input_csv: str, output_dir: str, text_col: str | None = None, label_col: str | None = None, test_size: float = 0.2, seed: int = 42) -> tuple[str, str]:
    """A corpus CSV masked, normalised, freed of blank texts and split by label into ``train`` and ``test`` JSON lines."""
    raw = files.read_corpus_csv(spark, input_csv, text_col, label_col)
    clean = raw.withColumn("resume_text", tx.squeeze(tx.nfkc(tx.mask_pii(F.col("resume_text"))))).where("resume_text <> ''")
    split = cut(vectors.stratified_split(clean, "resume_id", "label", test_size, seed))
    paths = f"{output_dir}/train.jsonl", f"{output_dir}/test.jsonl"
    for path, name in zip(paths, ("train", "test"), strict=True):
        files.write_jsonl(split.where(F.col("split_name") == name).drop("split_name"), path)
    return paths


def baseline(spark: SparkSession, train_jsonl: str, test_jsonl: str, output_dir: str, max_features: int = 30_000, ngram_max: int = 2) -> DataFrame:
    """Nearest class centroids over TF-IDF: predictions as CSV and one row of metrics, also as JSON."""
    rows = lambda p, t: files.read_jsonl(spark, p, CORPUS).select(F.col("resume_id").alias("id"), F.col("resume_text").alias("text"), "label", F.lit(t).alias("train"))
    docs = cut(rows(train_jsonl, True).unionByName(rows(test_jsonl, False)))
    train, test = docs.where("train"), docs.where("not train")
    counts = lambda x: cut(vectors.term_counts(x, "id", "text", ngram_max))
    seen = counts(train)
    vocab = cut(vectors.vocabulary(seen, train.count(), 2, most=max_features))
    cents = cut(vectors.centroids(vectors.weigh(seen, vocab), train.select("id", "label")))
    said = vectors.nearest_centroid(vectors.weigh(counts(test), vocab), cents)
    out = cut(test.select(F.col("id").alias("resume_id"), F.col("label").alias("y_true")).join(said.select(F.col("id").alias("resume_id"), F.col("label").alias("y_pred")), "resume_id"))
    files.write_csv(out, f"{output_dir}/baseline_predictions")
    metrics = scoring.classification_metrics(out, "y_true", "y_pred").join(train.agg(F.count("*").alias("train_size")))  # one row each
    files.write_metrics(metrics, f"{output_dir}/baseline_metrics.json")
    return metrics


def build_gold(spark: SparkSession, source_jsonl: str, lexicon: DataFrame, output: str, per_class: int = 4, max_total: int = 120, seed: int = 42) -> DataFrame:
    """Gold records with skill spans of a sample per label."""
    picked = cut(vectors.stratified_sample(files.read_jsonl(spark, source_jsonl, CORPUS), "resume_id", "label", per_class, max_total, seed))
    spans = extract.skill_spans(picked.where("resume_text is not null"), "resume_id", "resume_text", lexicon)
    files.write_gold(spans, picked.select(F.col("resume_id").alias("id"), F.coalesce("label", F.lit("unknown")).alias("category")), output)
    return files.read_gold(spark, output)


def build_profiles(spark: SparkSession, train_jsonl: str, lexicon: DataFrame, output: str, required_threshold: float = 0.30, preferred_threshold: float = 0.10) -> DataFrame:
    """A profile per label from the skills its texts name, described by its characteristic terms, as JSON."""
    docs = cut(files.read_jsonl(spark, train_jsonl, CORPUS).where("resume_text is not null and label is not null").select(F.col("resume_id").alias("id"), F.col("resume_text").alias("text"), "label"))
    skills = extract.lexicon_matches(docs, "id", "text", lexicon).select("id", F.col("canonical").alias("skill"))
    learned = vectors.learned_profiles(skills, docs.select("id", "label"), required_threshold, preferred_threshold)
    vec = cut(vectors.tfidf(cut(vectors.term_counts(docs, "id", "text", 2, tx.STOP)), docs.count(), 3, sublinear=True, max_df=0.6, most=10_000))
    terms = vectors.characteristic_terms(vec, docs.select("id", "label"), 5, 2, r"^(?i)[a-z][a-z\-+#]+(?: [a-z][a-z\-+#]+){0,2}$")
    profiles = learned.join(vectors.term_lists(terms), "label", "left").select("label", tx.profile_description(F.col("label"), F.col("terms")).alias("description"), "required_skills", "preferred_skills")
    files.write_profiles(profiles, output)
    return files.read_profiles(spark, output)


def evaluate(spark: SparkSession, test_jsonl: str, profiles: DataFrame, lexicon: DataFrame, output_dir: str, selection_threshold: float = 60.0) -> dict[str, DataFrame]:
    """Every test document scored against every profile by rules: predictions, their metrics, the ranking and the fairness audit, each also as a file."""
    docs = cut(files.read_jsonl(spark, test_jsonl, CORPUS).where("resume_text is not null").select("resume_id", F.col("resume_text").alias("text"), "label"))
    skills = cut(extract.lexicon_matches(docs, "resume_id", "text", lexicon).select(F.col("id").alias("resume_id"), "canonical"))
    exp = lambda x: x.select("resume_id", tx.experience_struct(F.col("text")).alias("x")).select("resume_id", "x.*")
    scores = cut(scoring.score_all(docs.select("resume_id", "text"), skills, exp(docs), profiles).select("resume_id", "label", "fit_score"))
    best = scoring.best_and_margin(scores, "resume_id", "label", "fit_score")
    as_json = scores.groupBy("resume_id").agg(tx.sorted_scores(F.map_from_entries(F.collect_list(F.struct("label", "fit_score")))).alias("scores"))
    pred = cut(docs.select("resume_id", F.col("label").alias("y_true")).join(best, "resume_id").join(as_json, "resume_id").select("resume_id", "y_true", F.col("best_label").alias("y_pred"), F.col("best").alias("fit_score"), F.lit("multi-agent").alias("decision_source"), "scores"))
    changed = cut(docs.select("resume_id", tx.identity_cue(tx.swap_pronouns(tx.swap_name(F.col("text")))).alias("text")))
    again = scoring.score_all(changed, skills, exp(changed), profiles).select("resume_id", "label", F.col("fit_score").alias("b"))
    pairs = pred.select("resume_id", F.col("y_pred").alias("label"), F.col("fit_score").alias("a")).join(again, ["resume_id", "label"])
    ranked = scores.join(docs.select("resume_id", F.col("label").alias("truth")), "resume_id").withColumn("rel", (F.col("label") == F.col("truth")).cast("int"))
    out = {
        "predictions": pred, "metrics": scoring.classification_metrics(pred.where("y_true is not null"), "y_true", "y_pred"),
        "ranking": scoring.ranking_metrics(ranked, "label", "resume_id", "fit_score", "rel"), "fairness": scoring.fairness(pairs, "a", "b", selection_threshold),
    }
    files.write_csv(pred, f"{output_dir}/predictions")
    for name in ("metrics", "ranking", "fairness"):
        files.write_jsonl(out[name], f"{output_dir}/{name}")
    return out


def skill_evaluation(spark: SparkSession, gold: str, predictions: str, output: str) -> DataFrame:
    """Macro and micro values of extracted skills against gold records, also as JSON."""
    g, p = files.read_gold(spark, gold), files.read_extractions(spark, predictions)
    flat = lambda x: x.select(F.col("resume_id").alias("id"), F.explode("skills").alias("skill"))
    report = scoring.extraction_report(flat(g), flat(p).withColumn("skill", F.lower(F.trim("skill"))), g.select(F.col("resume_id").alias("id"), "category"))
    files.write_metrics(report, output)
    return report


def rationale_evaluation(spark: SparkSession, records_jsonl: str, output: str) -> DataFrame:
    """The rationale report of a file of records, also as JSON."""
    lists = ", ".join(f"{n}: array<string>" for n in ("matched_skills", "missing_skills", "strengths", "gaps"))
    rows = files.read_jsonl(spark, records_jsonl, f"resume_id long, evaluation struct<fit_score: double, rationale: string, recommendation: string, {lists}>")
    report = rationale.report(rationale.audit(rows.select("resume_id", "evaluation.*")))
    files.write_metrics(report, output)
    return report


def view(spark: SparkSession, records_jsonl: str, schema: str, resume_id: int, kind: str = "text") -> str:
    """One record for reading."""
    return files.viewed(files.find_record(files.read_jsonl(spark, records_jsonl, schema), "resume_id", resume_id), kind)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    args = {
        "preprocess": {"--input-csv": {}, "--output-dir": {}, "--text-col": {"default": None}, "--label-col": {"default": None}, "--test-size": {"type": float, "default": 0.2}, "--seed": {"type": int, "default": 42}},
        "baseline": {"--train-jsonl": {}, "--test-jsonl": {}, "--output-dir": {}, "--max-features": {"type": int, "default": 30_000}, "--ngram-max": {"type": int, "default": 2}},
        "build_gold": {"--source-jsonl": {}, "--lexicon": {}, "--output": {}, "--per-class": {"type": int, "default": 4}, "--max-total": {"type": int, "default": 120}, "--seed": {"type": int, "default": 42}},
        "build_profiles": {"--train-jsonl": {}, "--lexicon": {}, "--output": {}, "--required-threshold": {"type": float, "default": 0.30}, "--preferred-threshold": {"type": float, "default": 0.10}},
        "evaluate": {"--test-jsonl": {}, "--profiles": {}, "--lexicon": {}, "--output-dir": {}, "--selection-threshold": {"type": float, "default": 60.0}},
        "skill_evaluation": {"--gold": {}, "--predictions": {}, "--output": {}}, "rationale_evaluation": {"--records-jsonl": {}, "--output": {}},
    }
    for name, options in args.items():
        c = commands.add_parser(name)
        for flag, how in options.items():
            c.add_argument(flag, **({"required": True} if not how else how))
    said = vars(p.parse_args(argv))
    job = globals()[said.pop("command")]
    spark = SparkSession.builder.appName(f"sievework-{job.__name__}").getOrCreate()
    if "lexicon" in said:
        said["lexicon"] = spark.read.parquet(said["lexicon"])
    if "profiles" in said:
        said["profiles"] = files.read_profiles(spark, said["profiles"])
    job(spark, **said)


if __name__ == "__main__":
    main()
