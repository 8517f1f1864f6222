"""Core operators against hand-worked cases and brute force."""

from __future__ import annotations

import importlib
import json
import math
import numbers
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.operators import extract, rationale, scoring, softmatch, supervised, vectors
from sievework.plans import entrypoints, evaluation, registry
from sievework.sources import files
from sievework.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()["x"]


def test_masks_keep_a_leading_bracket(spark):
    assert one(spark, tx.mask_pii(F.col("t")), "call (602) 555-0101 or a.b@c.example") == "call ([PHONE] or [EMAIL]"
    assert one(spark, tx.mask_pii(F.col("t")), None) is None


def test_pronouns_swap_one_after_the_other(spark):
    assert one(spark, tx.swap_pronouns(F.col("t")), "he she him her his hers himself herself") == "he he him him her his himself himself"


@pytest.mark.parametrize(("text", "years"), [("5+ yrs", 5.0), ("3.5 years and 2 years", 3.5), ("none", 0.0), ("", 0.0)])
def test_years(spark, text, years):
    assert one(spark, tx.years_of(F.col("t")), text) == years


def test_phrases_split_and_deduplicate(spark):
    got = spark.createDataFrame([(["SQL, Python; sql", None, " - R: "],)], "a array<string>").select(tx.phrases(F.col("a")).alias("x")).first()["x"]
    assert got == ["sql", "python", "r"]


def test_json_block(spark):
    assert one(spark, tx.json_block(F.col("t")), 'note ```json {"a": {"b": 1}} ``` end') == '{"a": {"b": 1}}'
    assert one(spark, tx.json_block(F.col("t")), "x [1, 2] y") == "[1, 2]"


def test_compatibility_normalisation(spark):
    assert one(spark, tx.squeeze(tx.nfkc(F.col("t"))), "ｆｕｌｌ  ﬁt ") == "full fit"


def test_identity_cue_and_name(spark):
    assert one(spark, tx.identity_cue(F.col("t")), "A\nB") == "A\nIdentity cue: from an underrepresented background.\nB"
    assert one(spark, tx.identity_cue(F.col("t")), "\nB") == "\nB"
    assert one(spark, tx.swap_name(F.col("t"), [("Ann", "Bea"), ("Cy", "Dan")]), "Cy met Ann, Ann left") == "Cy met Bea, Ann left"
    assert one(spark, tx.swap_name(F.col("t"), [("Ann", "Bea"), ("Cy", "Dan")], 1), "Cy met Ann") == "Dan met Ann"
    assert one(spark, tx.swap_name(F.col("t")), "Lena Quill\nLena Quill sews") == "Aisha Khan\nLena Quill sews"
    assert one(spark, tx.swap_name(F.col("t")), "no Name here") == "no Name here"


def test_sections_carry_the_last_header(spark):
    docs = spark.createDataFrame([(1, "intro\nSkills: sql\npython\n\nEducation\nBSc"), (2, None), (3, "")], "id long, t string")
    got = {r["id"]: r.asDict() for r in extract.sections(docs, "id", "t").collect()}
    assert got[1]["experience"] == ["intro"] and got[1]["skills"] == ["sql", "python"] and got[1]["education"] == ["BSc"] and set(got) == {1}


def test_lexicon_matches_whole_words_only(spark):
    lex = spark.createDataFrame([("machine learning", ["ml"], "x"), ("r", [], "x"), ("go", None, "x")], "canonical string, aliases array<string>, category string")
    docs = spark.createDataFrame([(1, "ML career in category"), (2, "R, Go!"), (3, None), (4, "")], "id long, t string")
    got = sorted((r["id"], r["canonical"]) for r in extract.lexicon_matches(docs, "id", "t", lex).collect())
    assert got == [(1, "machine learning"), (2, "go"), (2, "r")]


def test_text_similarity_closed_form(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "alpha gamma")], "resume_id long, text string")
    profiles = spark.createDataFrame([("L", "alpha beta")], "label string, description string")
    got = {r["resume_id"]: r["text_similarity"] for r in scoring.text_similarity(docs, profiles).collect()}
    w2 = scoring.UNSHARED**2
    assert got[1] == pytest.approx(1.0) and 2 not in got and got[3] == pytest.approx(1 / (1 + w2))


def test_ranking_by_hand(spark):
    rows = spark.createDataFrame([("j", 1, 0.9, 0), ("j", 2, 0.8, 1), ("j", 3, 0.8, 1), ("k", 1, 0.5, 0)], "job string, item int, score double, rel int")
    got = {r["k"]: r for r in scoring.ranking_metrics(rows, "job", "item", "score", "rel", (1, 3, 10)).collect()}
    assert got[1]["precision_at"] == 0 and got[3]["jobs"] == 1
    assert got[3]["map_at"] == pytest.approx(round((1 / 2 + 2 / 3) / 2, 4)) and got[10]["precision_at"] == 0.2
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    assert got[3]["ndcg_at"] == pytest.approx(round(dcg / (1 + 1 / math.log2(3)), 4))


def test_classification_counts_the_union_of_labels(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "t string, p string")
    got = scoring.classification_metrics(rows, "t", "p").first()
    assert got["accuracy"] == pytest.approx(0.3333) and got["classes"] == 3 and got["f1_macro"] == pytest.approx(round(0.5 / 3, 4))


def test_extraction_ignores_ids_without_gold(spark):
    g = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "id int, skill string")
    f = spark.createDataFrame([(1, "x"), (1, "z"), (9, "x")], "id int, skill string")
    got = {r["id"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.extraction_metrics(g, f, ["id"]).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 1)}


def test_bootstrap_of_a_constant(spark):
    v = spark.range(200).withColumn("v", F.lit(3.0))
    got = scoring.bootstrap_interval(v, "v", 50).first()
    assert (got["lower"], got["upper"]) == (3.0, 3.0)
    assert tuple(scoring.bootstrap_interval(v.limit(0), "v", 50).first()) == (0.0, 0.0)
    spread = spark.range(4000).withColumn("v", (F.col("id") % 2) * 2.0)  # equal rows are drawn apart: the mean's deviation is 1 / sqrt(4000)
    got = scoring.bootstrap_interval(spread, "v").first()
    assert 0.95 < got["lower"] < 0.985 and 1.015 < got["upper"] < 1.05


def test_margin_of_a_lone_label(spark):
    s = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (2, "b", 5.0)], "id int, label string, score double")
    got = {r["id"]: r for r in scoring.best_and_margin(s, "id", "label", "score").collect()}
    assert got[1]["margin"] == 0 and got[2]["best_label"] == "a" and got[2]["second"] == 5.0


def test_rules_against_brute_force(spark):
    baskets = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c", "d"], []]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): (round(r["support"], 6), round(r["confidence"], 6), round(r["lift"], 6)) for r in vectors.association_rules(df, "items", 0.3, 0.6).collect()}
    n = len(baskets)
    sup = {c: sum(set(c) <= set(b) for b in baskets) / n for k in range(1, 5) for c in combinations("abcd", k)}
    want = {}
    for c, s in sup.items():
        if len(c) > 1 and s >= 0.3:
            for k in range(1, len(c)):
                for left in combinations(c, k):
                    right = tuple(x for x in c if x not in left)
                    if s / sup[left] >= 0.6 - 1e-12:
                        want[left, right] = (round(s, 6), round(s / sup[left], 6), round(s / sup[left] / sup[right], 6))
    assert got == want and want


def test_search_against_brute_force(spark):
    lex = spark.createDataFrame([("crop rotation", ["field cycle"], "farm", "turn crops"), ("soil test", [], "farm", "")], "canonical string, aliases array<string>, category string, description string")
    p = spark.createDataFrame([("crop rotation",), ("soil",), ("nothing",), (None,)], "phrase string").where("phrase is not null")
    got = {(r["phrase"], r["rank_no"]): r["canonical"] for r in vectors.lexicon_search(p, "phrase", lex).collect()}
    assert got[("crop rotation", 1)] == "crop rotation" and got[("soil", 1)] == "soil test" and not any(k[0] == "nothing" for k in got)


def test_clusters_cover_all_rows(spark):
    rows = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["x", "y"]) for i in range(16)] + [(99, [])], "id int, items array<string>")
    got = vectors.cluster(rows, "id", "items", k=2).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["id"] % 2)
    assert len(got) == 16 and all(len(g) == 1 for g in groups.values())


def test_csv_cells_with_line_breaks(spark, tmp_path):
    """Each table row comes back as one row, equal to the SQL, whatever its cells hold; a score that is not a number stays one."""
    cells = ["a\nb", "\n", "a\rb", "a\r\nb", '"\n', ',\n"', " x ", "\\", 'a"b', "", None]
    rows = [(i, None, c, "p", s, c, c) for i, (c, s) in enumerate((c, s) for c in cells for s in (0.1, float("nan"), float("-inf"), None))]
    table = spark.createDataFrame(rows, "req_id long, resume_id long, y_true string, y_pred string, fit_score double, decision_source string, scores string")
    table.repartition(3).write.parquet(str(tmp_path / "predictions.parquet"))
    got = [tuple(r) for r in registry.csv_round_trip(spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        predictions = table.toArrow()  # noqa: F841  (read by the SQL)
        want = con.execute(registry.ORACLE["csv_round_trip"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(rows)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Text,Category\n"a\nb ""q""",X\n" ",Y\nz,\n', encoding="utf-8")
    got = [tuple(r) for r in files.read_corpus_csv(spark, str(tmp_path / "c.csv")).orderBy("resume_id").collect()]
    assert got == [(0, 'a\nb "q"', "X"), (2, "z", "nan")]
    profiles = spark.createDataFrame([("A-B", "dé", ["x"], ["y"])], "label string, description string, required_skills array<string>, preferred_skills array<string>")
    files.write_profiles(profiles, str(tmp_path / "p.json"))
    assert [tuple(r) for r in files.read_profiles(spark, str(tmp_path / "p.json")).collect()] == [tuple(r) for r in profiles.collect()]
    assert files.read_if_there(spark, str(tmp_path / "none.csv"), "a int") is None
    (tmp_path / "g.jsonl").write_text('{"resume_id": 1, "skills": [" SQL ", "sql"]}\n{"resume_id": 2, "skills": [], "spans": [{"canonical": "Go"}]}\n')
    assert {r["resume_id"]: r["skills"] for r in files.read_gold(spark, str(tmp_path / "g.jsonl")).collect()} == {1: ["sql"], 2: ["go"]}
    (tmp_path / "e.jsonl").write_text('{"resume_id": 1, "skills": ["a"]}\n{"resume_id": 1, "predicted_skills": ["b"]}\n')
    assert files.read_extractions(spark, str(tmp_path / "e.jsonl")).first()["skills"] == ["b"]


def test_cache(spark):
    old = spark.createDataFrame([("k", "v1", 1.0), ("m", "w", 1.0)], "cache_key string, response string, created_at double")
    new = spark.createDataFrame([("k", "v2", 2.0)], "cache_key string, response string, created_at double")
    now = files.cache_upsert(old, new)
    assert {r["cache_key"]: r["response"] for r in now.collect()} == {"k": "v2", "m": "w"}
    hits, misses = files.cache_lookup(spark.createDataFrame([("k",), ("z",)], "cache_key string"), now)
    assert hits.count() == 1 and misses.first()["cache_key"] == "z"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    s = incremental.windowed_counts(incremental.stream_table(spark, str(tmp_path / "in"), src.schema.simpleString()[7:-1].replace(":", " ")), "ts", "event_type")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = Counter({(r["event_type"], r["start_at"]): r["n"] for r in src.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start_at"), "n").collect()})
    assert Counter({(r["event_type"], r["start_at"]): r["n"] for r in spark.table("counts").collect()}) == batch


def test_streamed_masking(spark, tmp_path):
    spark.createDataFrame([("a.b@c.example  x",)], "t string").write.parquet(str(tmp_path / "in"))
    q = incremental.masked(incremental.stream_table(spark, str(tmp_path / "in"), "t string"), "t").writeStream.format("memory").queryName("masked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("masked").first()["t"] == "[EMAIL] x"


def rows_of(df):
    """Rows as strings, columns by name; numbers to four places whatever their type."""

    def told(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([told(x) for x in v])
        if str(v) in ("<NA>", "nan", "None", "NaT"):
            return "None"
        return f"{float(v):.4f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return Counter(tuple(map(told, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["mask_pii", "section_sizes", "experience", "score_candidates", "ranking", "classification", "learned_profiles", "nearest_centroid", "perturbations", "stratified_split", "rationale_audit", "soft_overlap", "skill_spans", "rule_extract", "metric_deltas", "fairness_audit", "basket_rules", "cache_hits", "gold_round_trip"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("resumes", "sample_resumes", "extracted", "skill_matches", "predictions", "documents", "lexicon", "profiles_learned", "lineitem", "part", "orders"):
        con.execute(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_imports_without_a_session():
    e = importlib.import_module("__spark_entry__")
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_characteristic_terms_by_hand(spark):
    v = spark.createDataFrame([(1, "x", 1.0), (2, "x", 0.5), (2, "y", 0.5), (3, "y", 0.4)], "id long, term string, weight double")
    labels = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id long, label string")
    got = {(r["label"], r["rank_no"]): (r["term"], r["score"]) for r in vectors.characteristic_terms(v, labels, 2).collect()}
    assert got == {("A", 1): ("x", 0.75), ("A", 2): ("y", -0.15), ("B", 1): ("y", 0.15)}


def test_feature_rows(spark):
    made = lambda data, schema: spark.createDataFrame(data, schema)
    docs = made([(1, 3.0), (2, 1.0)], "resume_id long, log_length double")
    scores = made([(1, "B", 80.0), (1, "A", 80.0), (2, "A", 5.0), (2, "B", 7.5)], "resume_id long, label string, fit_score double")
    exp = made([(1, 12.0, 1, 2, 3, 4)], "resume_id long, total_years double, role_count int, leadership_indicators int, impact_statements int, quantified_impact int")
    skills = made([(1, "x", "c1", 0.5), (1, "y", "c1", 0.9), (1, "z", "c2", 0.7), (1, "q", None, 0.9)], "resume_id long, canonical string, category string, confidence double")
    row = (1, ["s", " ", None, "t"], ["e"], ["f", "g"], None, ["p", "p"])
    ext = made([row, row], "resume_id long, skills_raw array<string>, education array<string>, experience array<string>, certifications array<string>, projects array<string>")
    got = {r["resume_id"]: r["features"] for r in vectors.feature_rows(docs, scores, exp, skills, ext, ["A", "B"], ["c1", "c2", "c3"]).collect()}
    assert got[1] == pytest.approx([0.8, 0.8, 1, 0, 12, 1, 1, 2, 3, 4, 1, 2, 4, 0.75, 0.9, 2 / 3, 1 / 3, 0, 1, 2, 0, 2, 3])
    assert got[2] == pytest.approx([0.05, 0.075, 0, 1] + [0] * 18 + [1])
    assert len(vectors.feature_names(["A", "B"], ["c1", "c2", "c3"])) == len(got[1]) == 23


def test_characteristic_terms_leave_out_numbers_and_lone_documents(spark):
    v = spark.createDataFrame([(1, "2019", 1.0), (1, "soil", 0.5), (2, "soil", 0.5), (2, "x", 0.9), (3, "late", 0.4)], "id long, term string, weight double")
    labels = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id long, label string")
    got = [(r["label"], r["term"], r["rank_no"]) for r in vectors.characteristic_terms(v, labels, 2, least_docs=2, shape="^[a-z][a-z]+$").collect()]
    assert got == [("A", "soil", 1)]
    counts = spark.createDataFrame([(i, "all", 1) for i in range(4)] + [(0, "few", 1), (1, "few", 1)], "id long, term string, tf long")
    assert {r["term"] for r in vectors.tfidf(counts, 4, 1, max_df=0.6).collect()} == {"few"}


# ---- rationales


def audit_one(spark, **given):
    row = {"resume_id": 1, "fit_score": 50.0, "rationale": "", "recommendation": "", "matched_skills": ["python", "communication"], "missing_skills": ["docker", "kubernetes"], "strengths": ["python"], "gaps": ["docker"]} | given
    lists = ", ".join(f"{n} array<string>" for n in ("matched_skills", "missing_skills", "strengths", "gaps"))
    return rationale.audit(spark.createDataFrame([tuple(row.values())], f"resume_id long, fit_score double, rationale string, recommendation string, {lists}")).first()


@pytest.mark.parametrize(("score", "said", "right"), [(85.0, "Advance to interview", True), (85.0, "Do not advance", False), (50.0, "Consider with reservation", True), (50.0, "Hire now", False), (20.0, "Reject", True), (20.0, "Recommend", False), (50.0, "", False)])
def test_calibration(spark, score, said, right):
    assert audit_one(spark, fit_score=score, recommendation=said)["calibrated"] is right


def test_audit_of_a_record(spark):
    got = audit_one(spark, rationale="She is Young and knows Python, but no docker; " + "word " * 10, strengths=["Python", "juggling", "flying"], gaps=[])
    assert got["identity_terms"] == ["She", "Young"] and not got["identity_clean"] and got["is_specific"] and got["grounded_in_matched"] and got["missing_skill_hits"] == ["docker"]
    assert got["strengths_grounded_ratio"] == pytest.approx(1 / 3) and got["strengths_invented"] == ["juggling", "flying"] and got["gaps_grounded_ratio"] == 1.0
    got = audit_one(spark, rationale="a career in r&d", matched_skills=["r", "R&D ", None, "c++"], strengths=None, fit_score=None)
    assert got["matched_skill_hits"] == ["r", "r&d"] and got["fit_band"] == "reject" and not got["is_specific"]
    assert audit_one(spark, rationale="career", matched_skills=["r"])["matched_skill_hits"] == []


def test_report_over_audits(spark):
    lists = ", ".join(f"{n} array<string>" for n in ("matched_skills", "missing_skills", "strengths", "gaps"))
    rows = [(k, s, t, r, ["python"], [], [], []) for k, (s, t, r) in enumerate([(80.0, "python", "advance"), (20.0, "he", "reject"), (20.0, "x", "hire")])]
    df = spark.createDataFrame(rows, f"resume_id long, fit_score double, rationale string, recommendation string, {lists}")
    got = rationale.report(rationale.audit(df)).first()
    assert (got["n"], got["calibrated_pct"], got["identity_clean_pct"], got["band_advance"], got["band_consider"], got["band_reject"], got["tone_unclassified"]) == (3, 0.6667, 0.6667, 1, 0, 2, 0)
    none = rationale.report(rationale.audit(df.limit(0))).first()
    assert all(v == 0 for v in none)


# ---- soft matches


def test_soft_overlap(spark):
    v = spark.createDataFrame([("machine learning", "x", 0.8), ("machine learning", "y", 0.6), ("deep learning", "x", 1.0), ("docker", "z", 1.0)], "id string, term string, weight double")
    pairs = softmatch.likeness(v, 0.5)
    assert {(r["skill"], r["target"]) for r in pairs.collect()} == {("machine learning", "deep learning"), ("deep learning", "machine learning")}
    skills = spark.createDataFrame([(1, "python"), (1, "sql"), (1, "machine learning"), (2, "docker")], "resume_id long, canonical string")
    rows = skills.groupBy("resume_id").agg(F.collect_set("canonical").alias("own")).join(softmatch.closest(skills, pairs), "resume_id", "left").withColumn("near", F.coalesce("near", F.create_map().cast("map<string,struct<cosine:double,skill:string>>")))

    def score(targets, threshold):
        s, m = softmatch.overlap(F.col("own"), F.col("near"), F.array(*map(F.lit, targets)) if targets else F.array().cast("array<string>"), threshold)
        return {r["resume_id"]: (round(r["s"], 6), r["m"]) for r in rows.select("resume_id", s.alias("s"), m.alias("m")).collect()}

    assert score(["python", "deep learning"], 1.01)[1] == (1.0, ["python"])
    assert score(["python", "deep learning"], 0.5)[1] == (1.8, ["deep learning", "python"])  # 0.5 + 0.5 * (0.8 - 0.5) / 0.5
    assert score([], 0.5)[1] == (0.0, []) and score(["kubernetes"], 0.5)[2] == (0.0, [])


# ---- spans and extraction


def test_spans_from_left_to_right(spark):
    lex = spark.createDataFrame([("machine learning", ["ml"]), ("learning design", []), ("go", None), ("r", [])], "canonical string, aliases array<string>").withColumn("category", F.lit("x"))
    text = "Category go;  Machine  Learning Design, ML and learning design. R!"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = {r["canonical"]: (r["start_at"], r["surface"]) for r in extract.skill_spans(docs, "id", "t", lex).collect()}
    assert got == {"go": (9, "go"), "machine learning": (14, "Machine  Learning"), "learning design": (text.index("learning design"), "learning design"), "r": (len(text) - 2, "R")}


def test_rule_extraction(spark):
    docs = spark.createDataFrame([(1, "Intro\r\nSkills: Python, juggling; SQL\nknitting\nEducation\nBSc"), (2, "knows excel and Excel, a@b.example"), (3, " "), (4, None)], "id long, t string")
    got = {r["id"]: r for r in extract.rule_extract(docs, "id", "t").collect()}
    assert got[1]["skills_raw"] == ["Python", "juggling", "SQL"] and got[1]["education"] == ["BSc"] and got[1]["experience"] == ["Intro"]
    assert got[2]["skills_raw"] == ["excel", "Excel"] and got[2]["contact"] == ["a@b.example"] and set(got) == {1, 2}
    rule = extract.rule_extract(docs, "id", "t")
    model = rule.where("id = 1").withColumn("skills_raw", F.array(F.lit(" "), F.lit("chess"))).withColumn("education", F.array(F.lit("")))
    merged = {r["id"]: r for r in extract.merge_extractions(rule, model).collect()}
    assert merged[1]["skills_raw"] == ["chess"] and merged[1]["education"] == ["BSc"] and merged[2]["skills_raw"] == ["excel", "Excel"]


def test_ordered_forms(spark):
    lex = spark.createDataFrame([("ml", ["machine learning", "ML", " ", None])], "canonical string, aliases array<string>")
    assert extract.ordered_forms(lex.withColumn("aliases", F.filter("aliases", lambda x: x.isNotNull()))).first()["forms"] == ["machine learning", "ml"]


# ---- splits, classifier, files and entry points


def test_split_deals_the_whole_share(spark):
    rows = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 97 else None) for i in range(101)], "id long, label string")
    got = Counter((r["label"], r["split_name"]) for r in vectors.stratified_split(rows, "id", "label").collect())
    assert got == {("a", "test"): 14, ("a", "train"): 56, ("b", "test"): 6, ("b", "train"): 21, (None, "test"): 1, (None, "train"): 3}  # 21 of 101: 14.55, 5.61, 0.83
    lone = rows.where("id < 10").unionByName(spark.createDataFrame([(500, "z")], "id long, label string"))
    assert Counter(r["split_name"] for r in vectors.stratified_split(lone, "id", "label").collect()) == {"test": 3, "train": 8}
    assert vectors.stratified_split(rows.limit(0), "id", "label").count() == 0


def test_classifier_tells_two_vocabularies_apart(spark):
    words = {"A": "plough harvest tractor soil", "B": "ledger invoice audit tax", "C": "needle ward patient dose"}
    data = [(k, " ".join([words[c], c.lower() * 4, f"n{k}"]), c, k % 4 != 0, [float(k), 1.0]) for k, c in enumerate("ABC" * 16)]
    docs = spark.createDataFrame(data, "id long, text string, label string, train boolean, extra array<double>")
    got = {r["id"]: (r["label"], r["margin"]) for r in supervised.fit_and_predict(docs, "id", "text", "label", "train", "extra").collect()}
    assert set(got) == {k for k in range(48) if k % 4 == 0} and all(got[k][0] == data[k][2] and got[k][1] > 0 for k in got)
    assert supervised.fit_and_predict(docs.where("not train"), "id", "text", "label", "train", "extra").count() == 0
    m, s = supervised.scaling(docs, "extra", "train")
    assert s[1] == 1.0 and m[1] == 1.0


def test_numbers_follow_the_partitions(spark):
    rows = spark.range(100).repartition(7).select("id")
    order = [r["id"] for r in rows.collect()]
    got = files.numbered(spark.createDataFrame([(i,) for i in order], "id long").repartition(3), "n").collect()
    assert sorted(r["n"] for r in got) == list(range(100)) and files.numbered(spark.range(0), "n").count() == 0


def test_outputs(spark, tmp_path):
    row = (7, "A", 61.5, None, ["sql"], [], None, "fits", 3.0, 1, 0)
    rows = spark.createDataFrame([row], "resume_id long, label string, fit_score double, recommendation string, skills array<string>, strengths array<string>, gaps array<string>, rationale string, total_years double, leadership_indicators int, impact_statements int")
    report, data = files.write_report_bundle(rows, str(tmp_path / "out"), fairness=spark.createDataFrame([(0.5,)], "delta double"))
    text = open(report).read()
    assert "Candidates analyzed: 1" in text and '"delta": 0.5' in text and "# Candidate Report: Resume 7" in text and "Recommendation: n/a" in text and "## Gaps\nNone" in text
    assert spark.read.json(data).count() == 1
    files.write_metrics(rows.select("resume_id", "fit_score"), str(tmp_path / "m.json"))
    assert json.load(open(tmp_path / "m.json")) == {"resume_id": 7, "fit_score": 61.5}
    seen = rows.select("resume_id", F.expr("array(named_struct('canonical', 'sql', 'phrase', 'SQL db', 'confidence', 0.9D))").alias("matches"))
    assert "sql (0.90) <- 'SQL db'" in files.viewed(seen) and files.viewed(seen, "markdown").startswith("## Record 7") and json.loads(files.viewed(seen, "json"))["resume_id"] == 7
    with pytest.raises(LookupError):
        files.find_record(rows, "resume_id", 8)
    assert files.find_record(rows, "resume_id", 7).count() == 1
    assert json.loads(files.to_json(rows.select("resume_id", "recommendation")).first()["json"]) == {"resume_id": 7, "recommendation": None}
    assert json.loads(spark.createDataFrame([({"b": 1.0, "a": 2.0},)], "m map<string,double>").select(tx.sorted_scores(F.col("m")).alias("j")).first()["j"]) == {"a": 2.0, "b": 1.0}


def test_entry_points(spark, tmp_path):
    trades = {"FARM": "crop rotation and soil work on fields", "LEDGER": "invoice matching and cost allocation in ledgers", "WARD": "wound dressing and patient care on wards"}
    lines = ["text,label"] + [f'"{w} number {k} with 3 years, led people","{label}"' for label, w in trades.items() for k in range(10)]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    lex = spark.createDataFrame([(n, []) for n in ("crop rotation", "invoice matching", "cost allocation", "wound dressing")], "canonical string, aliases array<string>").withColumn("category", F.lit("x")).withColumn("description", F.lit(""))
    train, test = entrypoints.preprocess(spark, str(tmp_path / "c.csv"), str(tmp_path / "split"))
    assert spark.read.json(test).count() == 6 and spark.read.json(train).count() == 24
    assert entrypoints.baseline(spark, train, test, str(tmp_path / "base")).first()["accuracy"] == 1.0
    gold = entrypoints.build_gold(spark, train, lex, str(tmp_path / "gold"), per_class=2)
    assert gold.count() == 6 and all(r["skills"] for r in gold.collect())
    profiles = entrypoints.build_profiles(spark, train, lex, str(tmp_path / "p" / "profiles.json"))
    assert {r["label"]: r["required_skills"] for r in profiles.collect()}["LEDGER"] == ["cost allocation", "invoice matching"]
    out = entrypoints.evaluate(spark, test, profiles, lex, str(tmp_path / "eval"))
    assert out["metrics"].first()["accuracy"] == 1.0 and out["fairness"].first()["variant_count"] == 6 and out["ranking"].count() == 4
    files.write_jsonl(gold.select("resume_id", "skills"), str(tmp_path / "pred"))
    assert entrypoints.skill_evaluation(spark, str(tmp_path / "gold"), str(tmp_path / "pred"), str(tmp_path / "s.json")).first()["micro_f1"] == 1.0
    (tmp_path / "r.jsonl").write_text('{"resume_id": 1, "evaluation": {"fit_score": 80, "rationale": "knows sql", "recommendation": "advance", "matched_skills": ["sql"]}}\n')
    assert entrypoints.rationale_evaluation(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "q.json")).first()["calibrated_pct"] == 1.0
    assert "Record 1" in entrypoints.view(spark, str(tmp_path / "r.jsonl"), "resume_id long", 1)
    assert entrypoints.truthy(" Yes ") and not entrypoints.truthy(None) and entrypoints.encoder("auto") and entrypoints.encoder("own", {"own": len}) is len
    with pytest.raises(ValueError, match="encoder"):
        entrypoints.encoder("none")


def test_merged_experience_and_prompts(spark):
    kind = "struct<total_years: double, role_count: int, leadership_indicators: int, impact_statements: int, quantified_impact: int, evidence: array<string>>"
    df = spark.createDataFrame([((3.0, 1, 2, 0, 0, ["r"]), (75.0, 0, 3, 1, None, [" ", "m"])), ((3.0, 1, 2, 0, 0, ["r"]), None)], f"a {kind}, b {kind}")
    got = [tuple(r["m"]) for r in df.select(tx.merged_experience(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [(60.0, 1, 3, 1, 0, ["m"]), (3.0, 1, 2, 0, 0, ["r"])]
    assert one(spark, tx.prompt("say %s", F.col("t")), "x") == "say x"


def test_scores_of_the_asked_profile_alone(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "L"), (2, "gamma", "M")], "resume_id long, text string, only string")
    skills = spark.createDataFrame([(1, "x")], "resume_id long, canonical string")
    exp = spark.createDataFrame([(1, 4.0, 1)], "resume_id long, total_years double, leadership_indicators int")
    prof = spark.createDataFrame([("L", "alpha", ["x", "y"], ["z"]), ("M", "", None, ["x"])], "label string, description string, required_skills array<string>, preferred_skills array<string>")
    got = {(r["resume_id"], r["label"]): r for r in scoring.score_all(docs, skills, exp, prof).collect()}
    assert set(got) == {(1, "L"), (2, "M")} and got[1, "L"]["required"] == 0.5 and got[1, "L"]["matched"] == ["x"] and got[1, "L"]["missing"] == ["y", "z"] and got[2, "M"]["fit_score"] == 0
    assert scoring.score_all(docs.drop("only"), skills, exp, prof).count() == 4


def test_evaluation_queries_are_registered():
    assert {"rationale_audit", "soft_overlap", "skill_spans", "fairness_audit", "svc_predictions"} <= set(registry.QUERIES) and evaluation.SWEEP[0] == 2.0
