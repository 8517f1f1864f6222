"""Readers and writers: corpus CSV, JSON lines, gold records, profiles, a key-value cache and reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: column names under which text and label are looked for, by priority
TEXT_NAMES = ["resume_text", "text", "resume", "content", "description"]
LABEL_NAMES = ["label", "category", "class", "target", "occupation", "job_role", "genre"]


def guess_column(columns: list[str], names: list[str]) -> str | None:
    """The first of ``names`` among the columns, whatever its case."""
    by = {c.lower().strip(): c for c in columns}
    return next((by[n] for n in names if n in by), None)


def read_corpus_csv(spark: SparkSession, path: str, text_col: str | None = None, label_col: str | None = None) -> DataFrame:
    """``(resume_id, resume_text, label)`` of a CSV with multi-line cells; ids are given before blank rows leave, so they keep gaps."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    text = text_col or guess_column(raw.columns, TEXT_NAMES)
    if text is None or text not in raw.columns:
        raise ValueError(f"no text column among {raw.columns}")
    label = label_col or guess_column(raw.columns, LABEL_NAMES)
    rows = numbered(raw, "resume_id")
    out = rows.select("resume_id", F.coalesce(F.col(text), F.lit("")).alias("resume_text"), (F.coalesce(F.col(label), F.lit("nan")) if label else F.lit("unknown")).alias("label"))
    return out.where(F.trim("resume_text") != "")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with numbers 0, 1, 2, ... in the order they are read in: each partition counts on from the sum of those before it, nothing is sorted."""
    counts = dict(rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, starts = 0, []
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(before)]
        before += counts[p]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, (place + (F.create_map(*starts)[F.spark_partition_id()] if starts else F.lit(0))).cast("bigint"))


def find_record(rows: DataFrame, id_col: str, value: object) -> DataFrame:
    """The one row of an id; an error if there is none."""
    hit = rows.where(F.col(id_col) == F.lit(value)).limit(1)
    if not hit.take(1):
        raise LookupError(f"{id_col}={value} is not there")
    return hit


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_if_there(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame | None:
    """An optional input: None if the path does not exist. Cells of a CSV may hold line breaks."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if kind == "csv" else reader.json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``(resume_id, skills)`` lower-case and distinct; the spans' names where no skills are listed."""
    rows = spark.read.schema("resume_id long, category string, skills array<string>, spans array<struct<canonical: string, surface: string, start: int, end: int>>").json(path)
    named = F.when(F.size("skills") > 0, F.col("skills")).otherwise(F.transform("spans", lambda s: s["canonical"]))
    return rows.select("resume_id", "category", F.array_distinct(F.transform(F.coalesce(named, F.array()), lambda s: F.lower(F.trim(s)))).alias("skills"))


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """``(resume_id, skills)``: the first non-empty of three fields; of repeated ids the last line wins."""
    rows = spark.read.schema("resume_id long, skills array<string>, predicted_skills array<string>, normalized_skills array<struct<canonical_skill: string, canonical: string>>").json(path)
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    norm = F.transform("normalized_skills", lambda s: F.coalesce(s["canonical_skill"], s["canonical"]))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("out", F.coalesce(full("skills"), full("predicted_skills"), norm, F.array()))
    return rows.groupBy("resume_id").agg(F.max_by("out", "at").alias("skills"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from one JSON object keyed by label; a profile's own label wins over its key."""
    text = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value"))
    kind = "map<string, struct<label: string, description: string, required_skills: array<string>, preferred_skills: array<string>>>"
    each = text.select(F.explode(F.from_json("value", kind)).alias("key", "p"))
    return each.select(F.coalesce("p.label", "key").alias("label"), "p.description", "p.required_skills", "p.preferred_skills")


def write_profiles(profiles: DataFrame, path: str, most: int = 10_000) -> None:
    """Profiles as one readable JSON object; a catalogue of more than ``most`` is refused, as it must fit the driver."""
    rows = profiles.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} profiles")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({r["label"]: r.asDict() for r in sorted(rows, key=lambda r: r["label"])}, f, indent=2, ensure_ascii=False)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row result as readable JSON."""
    row = df.limit(1).collect()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row[0].asDict(recursive=True) if row else {}, f, indent=2, default=str)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` of requests against a key-value table."""
    return requests.join(cache.select(key, "response"), key), requests.join(cache.select(key), key, "left_anti")


def cache_upsert(cache: DataFrame, new: DataFrame, key: str = "cache_key", at: str = "created_at") -> DataFrame:
    """The latest row of each key, of rows as late as each other that with the greatest response; a null time is the oldest. Each task keeps one row a key before they meet."""
    cols = [c for c in cache.columns if c != key]
    both = cache.unionByName(new)
    order = F.struct(F.col(at).isNotNull().alias("_there"), F.col(at).alias("_at"), F.col("response").alias("_r"))
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in cols)).select(cache.columns)


def vector_upsert(store: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """A store of ``(id, document, embedding, metadata)`` in which the new entries replace those of their id."""
    return store.join(entries.select(key), key, "left_anti").unionByName(entries)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, merge) -> DataFrame:
    """Merges rows into a Parquet table as a new version beside the old one; ``merge(old, new)`` makes it, and the last whole version is read. An interrupted write leaves the old version."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) if fs.exists(root) else []
    old = spark.read.schema(new.schema).parquet(f"{path}/v{versions[-1]}") if versions else new.limit(0)
    at = f"{path}/v{versions[-1] + 1 if versions else 0}"
    merge(old, new).write.parquet(at)
    return spark.read.schema(new.schema).parquet(at)


def to_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_gold(spans: DataFrame, categories: DataFrame, path: str) -> None:
    """Gold records ``(resume_id, category, skills, spans, review_status)`` as JSON lines; ``spans`` holds ``(id, canonical, surface, start_at, end_at)``, ``categories`` ``(id, category)`` of all records, those without a span too."""
    span = F.struct("canonical", "surface", F.col("start_at").alias("start"), F.col("end_at").alias("end"))
    per = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start_at", span.alias("span")))).alias("s"))
    rows = categories.join(per, "id", "left").select("id", "category", F.transform(F.coalesce("s", F.expr("filter(s, x -> false)")), lambda x: x["span"]).alias("spans"))
    skills = F.array_sort(F.array_distinct(F.transform(F.coalesce("spans", F.expr("filter(spans, x -> false)")), lambda x: x["canonical"])))
    none = F.array().cast("array<string>")
    write_jsonl(rows.select(F.col("id").alias("resume_id"), "category", F.coalesce(skills, none).alias("skills"), "spans", F.lit("auto").alias("review_status")), path)


REPORTS, SKILLS_SHOWN = 20, 12  # fixed values


def candidate_report(rows: DataFrame) -> DataFrame:
    """``(resume_id, report)``: one text per row ``(resume_id, label, fit_score, recommendation, skills, strengths, gaps, rationale, total_years, leadership_indicators, impact_statements)``."""
    text = lambda n, other: F.coalesce(F.col(n).cast("string"), F.lit(other))
    names = lambda n, other: F.when(F.size(F.coalesce(n, F.array().cast("array<string>"))) > 0, F.array_join(n, ", ")).otherwise(F.lit(other))
    parts = [
        F.concat(F.lit("# Candidate Report: Resume "), F.col("resume_id").cast("string")), F.lit(""), F.concat(F.lit("Label: "), text("label", "unknown")), F.concat(F.lit("Fit score: "), text("fit_score", "0.0")),
        F.concat(F.lit("Recommendation: "), text("recommendation", "n/a")), F.lit(""), F.lit("## Extracted Skills"), names("skills", "None detected"), F.lit(""), F.lit("## Strengths"), names("strengths", "None"),
        F.lit(""), F.lit("## Gaps"), names("gaps", "None"), F.lit(""), F.lit("## Rationale"), text("rationale", "n/a"), F.lit(""), F.lit("## Experience Signals"),
        *(F.concat(F.lit(f"{title}: "), text(n, "0")) for title, n in (("Years", "total_years"), ("Leadership indicators", "leadership_indicators"), ("Impact statements", "impact_statements"))),
    ]
    return rows.select("resume_id", F.concat_ws("\n", *parts).alias("report"))


def write_report_bundle(rows: DataFrame, folder: str, fairness: DataFrame | None = None, clusters: DataFrame | None = None, rules: DataFrame | None = None) -> tuple[str, str]:
    """A readable report of the first ``REPORTS`` rows by id, with the small one-table results asked for (refused beyond 1,000 rows), and the rows themselves as JSON lines; the paths of both."""

    def small(df: DataFrame | None, most: int = 1000) -> list[dict]:
        rows = df.limit(most + 1).collect() if df is not None else []
        if len(rows) > most:
            raise ValueError(f"more than {most} rows for a readable report")
        return [r.asDict(recursive=True) for r in rows]

    lines = ["# Analysis Report", "", f"Candidates analyzed: {rows.count()}"]
    for title, got in (("Fairness Audit", small(fairness)), ("Clusters", small(clusters)), ("Association Rules", small(rules))):
        if got:
            lines += ["", f"## {title}", json.dumps(got, indent=2, default=str)]
    for r in candidate_report(rows).orderBy("resume_id").limit(REPORTS).collect():
        lines += ["", r["report"]]
    os.makedirs(folder, exist_ok=True)
    report, data = os.path.join(folder, "report.md"), os.path.join(folder, "analyses")
    with open(report, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    write_jsonl(rows, data)
    return report, data


def viewed(record: DataFrame, kind: str = "text") -> str:
    """One record for reading, as 'text', 'markdown' or 'json': its scores, and of its ``matches`` ``(canonical, phrase, confidence)`` the ``SKILLS_SHOWN`` surest."""
    row = record.limit(1).collect()
    if not row:
        raise LookupError("no record to view")
    r = row[0].asDict(recursive=True)
    if kind == "json":
        return json.dumps(r, indent=2, default=str, ensure_ascii=False)
    matches = sorted(r.pop("matches", None) or [], key=lambda m: (-(m["confidence"] or 0), m["canonical"]))[:SKILLS_SHOWN]
    cut = lambda v: f"{v[:160]}..." if isinstance(v, str) and len(v) > 160 else v
    head, item = ("## ", "- ") if kind == "markdown" else ("# ", "  ")
    lines = [f"{head}Record {r.get('resume_id')}"] + [f"{item}{k}: {cut(v)}" for k, v in r.items() if k != "resume_id"]
    lines += [f"{head}Skills"] + [f"{item}{m['canonical']} ({m['confidence'] or 0:.2f}) <- {m['phrase']!r}" for m in matches]
    return "\n".join(lines)
