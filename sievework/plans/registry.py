"""All queries of the core operators, each over its whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract, rationale, scoring, vectors
from ..session import cut, shared_dir, table
from ..sources import files
from ..streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_MASK = "t"
for _p, _m in ((tx.EMAIL, "[EMAIL]"), (tx.PHONE, "[PHONE]"), (tx.LINKEDIN, "[LINKEDIN]"), (tx.GITHUB, "[GITHUB]"), (tx.URL, "[URL]")):
    SQL_MASK = f"regexp_replace({SQL_MASK}, {_lit(_p)}, {_lit(_m)}, 'g')"
SQL_SQUEEZE = r"trim(regexp_replace({}, '[\s\x{{a0}}]+', ' ', 'g'))"
SQL_KEY = r"trim(regexp_replace(lower(replace({}, '/', ' ')), '[\s\x{{a0}}]+', ' ', 'g'))"
SQL_LABEL = "replace(upper(trim({})), '_', '-')"
SQL_STOP = "[" + ", ".join(map(_lit, tx.STOP)) + "]"
SQL_WORDS = "regexp_extract_all(lower({}), " + _lit(tx.WORD).replace("{", "{{").replace("}", "}}") + ")"
SQL_TOKENS = "list_filter(" + SQL_WORDS + ", lambda x: not list_contains(" + SQL_STOP + ", x))"
SQL_LINES = r"regexp_split_to_array({}, '\r\n|\r|\n')"


# ---- text functions


@query(f"select raw_id, {SQL_SQUEEZE.format(SQL_MASK)} masked from (select raw_id, text t from sample_resumes where text is not null)")
def mask_pii(spark: SparkSession, d: str) -> DataFrame:
    """P1, P3, F1."""
    return table(spark, d, "sample_resumes").where("text is not null").select("raw_id", tx.squeeze(tx.mask_pii(F.col("text"))).alias("masked"))


@query()
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    """Masked, compatibility-normalised, squeezed, blank texts dropped."""
    t = table(spark, d, "sample_resumes").where("text is not null").select("raw_id", tx.squeeze(tx.nfkc(tx.mask_pii(F.col("text")))).alias("resume_text"), F.coalesce("label", F.lit("unknown")).alias("label"))
    return t.where("resume_text <> ''")


@query(f"select {SQL_LABEL.format('label')} label_key, count(*) n, count(distinct label) spellings from resumes where label is not null group by 1")
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    """P5, A20."""
    return table(spark, d, "resumes").where("label is not null").groupBy(tx.label_key(F.col("label")).alias("label_key")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("spellings"))


@query("select canonical, concat_ws(' ', nullif(canonical, ''), nullif(category, ''), nullif(description, ''), array_to_string(aliases, ' ')) embedding_text from lexicon")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """P6, S9."""
    return table(spark, d, "lexicon").select("canonical", tx.embedding_text(F.col("canonical"), F.col("category"), F.col("description"), F.col("aliases")).alias("embedding_text"))


_HEAD = "case " + " ".join(f"when regexp_matches(line, {_lit(p)}) then {_lit(n)}" for n, p in extract.HEADERS) + " end"


@query(rf"""with lines as (select raw_id, unnest(l) raw, generate_subscripts(l, 1) no from (select raw_id, regexp_split_to_array(text, '\r\n|\r|\n') l from sample_resumes where text is not null)),
live as (select raw_id, no, trim(raw) line from lines where trim(raw) <> ''), heads as (select *, {_HEAD} head from live),
filled as (select *, coalesce(last_value(head ignore nulls) over (partition by raw_id order by no rows between unbounded preceding and current row), 'experience') section from heads),
rest as (select raw_id id, section, case when head is null then line else regexp_replace(regexp_replace(line, {_lit(extract.HEADER_WORDS)}, ''), '^[ :\-]+|[ :\-]+$', '', 'g') end line from filled)
select id, section, count(*) n_lines, sum(length(line))::bigint n_chars from rest where line <> '' group by 1, 2""")
def section_sizes(spark: SparkSession, d: str) -> DataFrame:
    """P7, W1."""
    lines = extract.section_lines(table(spark, d, "sample_resumes").where("text is not null"), "raw_id", "text")
    return lines.groupBy("id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


_PHRASES = r"list_distinct(list_filter(list_transform(flatten(list_transform(list_filter({}, lambda x: x is not null), lambda x: regexp_split_to_array(x, '[,;/|\n]'))), lambda x: lower(regexp_replace(x, '^[ \-:\t]+|[ \-:\t]+$', '', 'g'))), lambda x: x <> ''))"


@query(f"""select resume_id, phrase, count(*) n from (select resume_id, unnest(case when len(a) > 0 then a else b end) phrase from (select resume_id, coalesce({_PHRASES.format('skills_raw')}, []) a,
{_PHRASES.format('list_concat(coalesce(experience, []), coalesce(projects, []), coalesce(certifications, []))')} b from extracted)) group by 1, 2""")
def candidate_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of the skills, else of experience, projects and certifications."""
    e = table(spark, d, "extracted")
    skills = F.coalesce("skills_raw", F.array().cast("array<string>"))
    return e.select("resume_id", F.explode(tx.gathered_phrases(skills, *(F.col(n) for n in ("experience", "projects", "certifications")))).alias("phrase")).groupBy("resume_id", "phrase").agg(F.count("*").alias("n"))


@query(f"select raw_id, regexp_extract_all(text, {_lit(tx.CONTACT)}) contacts from sample_resumes where text is not null")
def contact_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every match in order."""
    return table(spark, d, "sample_resumes").where("text is not null").select("raw_id", tx.contacts(F.col("text")).alias("contacts"))


_S = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"


def _many(*patterns: str) -> str:
    return "len(list_filter(s, lambda x: " + " and ".join(f"regexp_matches(x, {_lit(p)})" for p in patterns) + "))"


def _experience_sql(key: str, text: str, rows: str) -> str:
    return f"""select {key}, coalesce(list_max(list_transform(regexp_extract_all(t, {_lit(tx.YEARS)}, 1), lambda x: x::double)), 0.0) total_years, {_many(tx.ROLE)} role_count,
{_many(tx.LEADERSHIP)} leadership_indicators, {_many(tx.IMPACT)} impact_statements, {_many(tx.IMPACT, tx.QUANTITY)} quantified_impact, list_filter(s, lambda x: regexp_matches(x, {_lit(tx.IMPACT)}))[1:3] evidence
from (select {key}, t, {_S} s from (select {key}, {text} t from {rows} where {text} is not null))"""


_EXPERIENCE = _experience_sql("resume_id", "resume_text", "resumes")


def experience_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    x = docs.where(F.col(text).isNotNull()).select(key, tx.experience_struct(F.col(text)).alias("x"))
    return x.select(key, "x.*")


@query(_EXPERIENCE)
def experience(spark: SparkSession, d: str) -> DataFrame:
    """P14, P15 over whole resumes (their texts are one line, so all of it is the experience section)."""
    return experience_of(table(spark, d, "resumes"), "resume_id", "resume_text")


def _pronouns_sql(text: str) -> str:
    for p, m in tx.PRONOUNS:
        text = f"regexp_replace({text}, {_lit(p)}, {_lit(m)}, 'g')"
    return text


@query(f"select doc_id, {_pronouns_sql('text')} swapped from documents where text is not null")
def swap_pronouns(spark: SparkSession, d: str) -> DataFrame:
    """P20."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.swap_pronouns(F.col("text")).alias("swapped"))


def _names_sql(text: str) -> str:
    listed = " ".join(f"when contains({text}, {_lit(o)}) then substr({text}, 1, strpos({text}, {_lit(o)}) - 1) || {_lit(n)} || substr({text}, strpos({text}, {_lit(o)}) + {len(o)})" for o, n in tx.NAME_SWAPS)
    first = f"{SQL_LINES.format(text)}[1]"
    return f"case {listed} when regexp_matches(trim({first}), {_lit(tx.FULL_NAME)}) then {_lit(tx.NAME_SWAPS[0][1])} || substr({text}, length({first}) + 1) else {text} end"


def _cue_sql(text: str) -> str:
    lines = SQL_LINES.format(text)
    return f"case when trim({lines}[1]) = '' or contains({text}, 'from an underrepresented background') then {text} else array_to_string(list_concat([{lines}[1], 'Identity cue: from an underrepresented background.'], {lines}[2:]), chr(10)) end"


_VARIANTS = f"""(with base as (select raw_id, text t from sample_resumes where text is not null), named as (select raw_id, t, {_names_sql('t')} n from base), swapped as (select *, {_pronouns_sql('t')} p, {_pronouns_sql('n')} np from named)
select raw_id, 0 k, 'original' variant_type, t as text from swapped union all select raw_id, 1, 'name_swap', n from swapped union all select raw_id, 2, 'pronoun_swap', p from swapped union all select raw_id, 3, 'combined', {_cue_sql('np')} from swapped)"""


def perturbed(c, kind: str):
    """The text with one of the perturbations; 'combined' is all of them."""
    if kind == "name_swap":
        return tx.swap_name(c)
    if kind == "pronoun_swap":
        return tx.swap_pronouns(c)
    return tx.identity_cue(tx.swap_pronouns(tx.swap_name(c))) if kind == "combined" else c


@query(f"select raw_id, variant_type, md5(text) text_md5 from (select *, row_number() over (partition by raw_id, trim(text) order by k) rn from {_VARIANTS} where trim(text) <> '') where rn = 1")
def perturbations(spark: SparkSession, d: str) -> DataFrame:
    """The text, with another name, with other pronouns and with both and a cue; equal ones once."""
    t = table(spark, d, "sample_resumes").where("text is not null")
    kinds = ["original", "name_swap", "pronoun_swap", "combined"]
    v = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("variant_type"), perturbed(F.col("text"), kind).alias("text")) for k, kind in enumerate(kinds)))
    first = F.min_by("variant_type", "k").alias("variant_type")
    rows = t.select("raw_id", F.explode(v).alias("v")).select("raw_id", "v.*").where(F.trim("text") != "")
    return rows.groupBy("raw_id", F.trim("text").alias("same")).agg(first, F.min_by("text", "k").alias("text")).select("raw_id", "variant_type", F.md5("text").alias("text_md5"))


@query("select doc_id, sha256(concat_ws(chr(31), 'rules', 'v1', coalesce(doc_kind, ''), coalesce(text, ''))) cache_key from documents")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """P19."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return table(spark, d, "documents").select("doc_id", tx.cache_key(F.lit("rules"), F.lit("v1"), c("doc_kind"), c("text")).alias("cache_key"))


@query(r"""select req_id, resume_id, case when o <> '' then o when a <> '' then a else s end block from (select *, regexp_extract(s, '(?s)\{.*\}') o, regexp_extract(s, '(?s)\[.*\]') a
from (select req_id, resume_id, trim(regexp_replace(scores, '```(?:json)?', '', 'g')) s from predictions where scores is not null))""")
def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    """P17."""
    return table(spark, d, "predictions").where("scores is not null").select("req_id", "resume_id", tx.json_block(F.col("scores")).alias("block"))


@query("""select distinct lower(trim(form)) form, canonical, category from (select canonical, category, unnest(list_concat([canonical], coalesce(aliases, []))) form from lexicon) where trim(form) <> ''""")
def surface_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form once, with the category of its entry."""
    return extract.lexicon_forms(table(spark, d, "lexicon")).select("form", "canonical", "category")


_IDENTITY_RE = r"(?i)\b(" + "|".join(rationale.IDENTITY) + r")\b"


@query(f"select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, {_lit(_IDENTITY_RE)}), lambda x: lower(x)))) terms from documents where regexp_matches(text, {_lit(_IDENTITY_RE)})")
def identity_terms(spark: SparkSession, d: str) -> DataFrame:
    """F7."""
    t = table(spark, d, "documents").where(F.col("text").rlike(_IDENTITY_RE))
    return t.select("doc_id", F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_IDENTITY_RE), F.lit(0)), F.lower))).alias("terms"))


# ---- lexicon joins


@query(r"""with forms as (select distinct lower(trim(form)) form, canonical from (select canonical, unnest(list_concat([canonical], coalesce(aliases, []))) form from lexicon) where trim(form) <> ''),
docs as (select resume_id, lower(resume_text) t from resumes where resume_text is not null)
select distinct resume_id id, canonical from docs join forms on regexp_matches(t, '(^|[^a-z0-9])' || replace(form, ' ', '\s+') || '([^a-z0-9]|$)')""")
def lexicon_scan(spark: SparkSession, d: str) -> DataFrame:
    """F5, J5."""
    return extract.lexicon_matches(table(spark, d, "resumes").where("resume_text is not null"), "resume_id", "resume_text", table(spark, d, "lexicon"))


_CANON = f"""(select m.resume_id, l.canonical, l.category, max(m.confidence) confidence from skill_matches m join lexicon l on {SQL_KEY.format('m.canonical_skill')} = {SQL_KEY.format('l.canonical')} where m.confidence >= 0.4 group by all)"""


@query(f"select * from {_CANON}")
def canonical_skills(spark: SparkSession, d: str) -> DataFrame:
    """F3, F4, J11, P4."""
    return extract.canonical_skills(table(spark, d, "skill_matches"), table(spark, d, "lexicon"))


@query("""select resume_id, canonical_skill, phrase, pos from (select *, row_number() over (partition by resume_id, canonical_skill order by pos, phrase) rn from (select distinct resume_id, canonical_skill, phrase, pos from skill_matches where canonical_skill is not null)) where rn = 1""")
def first_phrases(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    m = table(spark, d, "skill_matches").where("canonical_skill is not null").select("resume_id", "canonical_skill", "phrase", "pos").distinct()
    w = Window.partitionBy("resume_id", "canonical_skill").orderBy("pos", "phrase")
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("resume_id", "canonical_skill", "phrase", "pos")


@query()
def lexicon_search(spark: SparkSession, d: str) -> DataFrame:
    """Nearest lexicon entries of every distinct phrase."""
    p = table(spark, d, "skill_matches").where("phrase is not null").select(tx.phrase_key(F.col("phrase")).alias("phrase")).where("phrase <> ''")
    return vectors.lexicon_search(p, "phrase", table(spark, d, "lexicon"))


@query(f"select resume_id, count(*) n_skills, round(sum(confidence), 4) sum_confidence, max(confidence) max_confidence, count(distinct category) n_categories from {_CANON} group by 1")
def skill_stats(spark: SparkSession, d: str) -> DataFrame:
    """A18, A19."""
    c = canonical_skills(spark, d)
    return c.groupBy("resume_id").agg(F.count("*").alias("n_skills"), F.round(F.sum("confidence"), 4).alias("sum_confidence"), F.max("confidence").alias("max_confidence"), F.countDistinct("category").alias("n_categories"))


@query(f"select resume_id, category, round(count(*) / sum(count(*)) over (partition by resume_id), 6) share from {_CANON} group by 1, 2")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    c = canonical_skills(spark, d).groupBy("resume_id", "category").agg(F.count("*").alias("n"))
    return c.select("resume_id", "category", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("resume_id")), 6).alias("share"))


# ---- scoring


def _score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "resumes").where("resume_text is not null").select("resume_id", F.col("resume_text").alias("text"))
    return scoring.score_all(docs, canonical_skills(spark, d), experience(spark, d), table(spark, d, "profiles_learned"))


def _tf(key: str, text: str, rows: str) -> str:
    return f"select {key}, term, count(*) tf from (select {key}, unnest({SQL_TOKENS.format(text)}) term from {rows}) group by 1, 2"


def scores_sql(rows: str = "(select resume_id, resume_text, null only_label from resumes where resume_text is not null)") -> str:
    """Scores of the texts in ``rows`` (resume_id, resume_text, only_label) against every profile, or that of ``only_label`` alone."""
    return f"""with docs as (select * from {rows}), dt as ({_tf('resume_id', 'resume_text', 'docs')}), pt as ({_tf('label', 'description', 'profiles_learned')}),
dn as (select resume_id, sum(tf * tf) d2 from dt group by 1), pn as (select label, sum(tf * tf) p2 from pt group by 1),
sh as (select resume_id, label, sum(dt.tf * pt.tf) dot, sum(dt.tf * dt.tf) ds, sum(pt.tf * pt.tf) ps from dt join pt using (term) group by 1, 2),
sim as (select resume_id, label, dot / (sqrt(ds + {scoring.UNSHARED**2} * (d2 - ds)) * sqrt(ps + {scoring.UNSHARED**2} * (p2 - ps))) ts from sh join dn using (resume_id) join pn using (label)),
own as (select resume_id, list(distinct canonical) own from {_CANON} group by 1), ex as ({_experience_sql('resume_id', 'resume_text', 'docs')}),
pairs as (select d.resume_id, p.label, coalesce(own, []) own, list_distinct(required_skills) req, list_distinct(preferred_skills) pref, list_distinct(list_concat(required_skills, preferred_skills)) both_,
  coalesce(total_years, 0) y, coalesce(leadership_indicators, 0) l, coalesce(ts, 0) ts from docs d cross join profiles_learned p left join own using (resume_id) left join ex using (resume_id) left join sim using (resume_id, label) where only_label is null or only_label = p.label),
parts as (select *, len(list_intersect(own, req)) / greatest(len(req), 1) required, len(list_intersect(own, pref)) / greatest(len(pref), 1) preferred, least(len(list_intersect(own, both_)) / greatest(len(own), 1), 1.0) coverage,
  least(y / 8.0, 1.0) yrs, least(l / 2.0, 1.0) leadership, len(list_intersect(own, both_)) / greatest(len(list_distinct(list_concat(own, both_))), 1) overlap from pairs)
select resume_id, label, round(100 * (0.28 * required + 0.16 * preferred + 0.14 * coverage + 0.14 * yrs + 0.08 * leadership + 0.12 * ts + 0.08 * overlap), 2) fit_score,
  round(required, 4) required, round(preferred, 4) preferred, round(coverage, 4) coverage, round(yrs, 4) as "years", round(leadership, 4) leadership, round(ts, 4) text_similarity, round(overlap, 4) overlap,
  list_sort(list_intersect(own, both_)) matched, list_sort(list_filter(both_, lambda x: not list_contains(own, x))) missing from parts"""


_SCORES = scores_sql()


@query(_SCORES)
def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every resume against every learned profile."""
    return _score(spark, d)


@query(f"""with s as (select resume_id, label, fit_score from ({_SCORES})), r as (select *, row_number() over (partition by resume_id order by fit_score desc, label) rn from s)
select resume_id, max(case when rn = 1 then label end) best_label, max(case when rn = 1 then fit_score end) best, max(case when rn = 2 then fit_score end) as "second",
round(max(case when rn = 1 then fit_score end) - max(case when rn = 2 then fit_score end), 2) margin, case when max(case when rn = 1 then fit_score end) >= 70 then 'advance' when max(case when rn = 1 then fit_score end) >= 40 then 'consider' else 'reject' end band
from r where rn <= 2 group by 1""")
def best_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The best label of every resume and its margin."""
    b = scoring.best_and_margin(_score(spark, d), "resume_id", "label", "fit_score")
    return b.withColumn("margin", F.round("margin", 2)).withColumn("band", scoring.fit_band(F.col("best")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return best_profiles(spark, d)


@query("""select req_id, resume_id, y_true, y_pred, decision_source from (select *, row_number() over (partition by req_id, resume_id order by scored_at desc nulls last, loaded_at desc nulls last, y_pred, decision_source, scores) rn from predictions) where rn = 1""")
def latest_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The last scoring of each application."""
    w = Window.partitionBy("req_id", "resume_id").orderBy(F.desc_nulls_last("scored_at"), F.desc_nulls_last("loaded_at"), F.asc_nulls_last("y_pred"), F.asc_nulls_last("decision_source"), F.asc_nulls_last("scores"))
    return table(spark, d, "predictions").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("req_id", "resume_id", "y_true", "y_pred", "decision_source")


_PRED = f"(select {SQL_LABEL.format('y_true')} t, {SQL_LABEL.format('y_pred')} p from predictions where y_true is not null and y_pred is not null)"


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").where("y_true is not null and y_pred is not null").select(tx.label_key(F.col("y_true")).alias("t"), tx.label_key(F.col("y_pred")).alias("p"))


@query(f"""with x as (select t, p, count(*) n from {_PRED} group by 1, 2), l as (select t label from x union select p from x),
per as (select label, coalesce((select sum(n) from x where t = label), 0) tn, coalesce((select sum(n) from x where p = label), 0) pn, coalesce((select sum(n) from x where p = label and t = label), 0) tp from l),
m as (select *, case when pn = 0 then 0 else tp / pn end pr, case when tn = 0 then 0 else tp / tn end rc, case when tn + pn = 0 then 0 else 2 * tp / (tn + pn) end f1 from per)
select round(sum(tp) / sum(tn), 4) accuracy, round(avg(pr), 4) precision_macro, round(avg(rc), 4) recall_macro, round(avg(f1), 4) f1_macro, round(sum(f1 * tn) / sum(tn), 4) f1_weighted, sum(tn)::bigint support, count(*) classes from m""")
def classification(spark: SparkSession, d: str) -> DataFrame:
    """A1, M7."""
    return scoring.classification_metrics(_pred(spark, d), "t", "p")


@query(f"select t, p, count(*) n from {_PRED} where t <> p group by 1, 2 order by n desc, t, p limit 8")
def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    return _pred(spark, d).where("t <> p").groupBy("t", "p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t", "p").limit(8)


@query("select decision_source, count(*) n from predictions group by 1")
def decision_sources(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    return table(spark, d, "predictions").groupBy("decision_source").agg(F.count("*").alias("n"))


@query(f"""select th threshold, count(*) n, round(avg((y_true = y_pred)::int), 6) accuracy, round(avg((fit_score >= th)::int), 6) selected from (select {SQL_LABEL.format('y_true')} y_true, {SQL_LABEL.format('y_pred')} y_pred, fit_score from predictions where y_true is not null and y_pred is not null and fit_score is not null and not isnan(fit_score)), (select unnest([40.0, 50.0, 60.0, 70.0, 80.0]::double[]) th) group by 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """stored scores by five cut-offs."""
    p = table(spark, d, "predictions").where("y_true is not null and y_pred is not null and fit_score is not null and not isnan(fit_score)")
    x = p.select((tx.label_key(F.col("y_true")) == tx.label_key(F.col("y_pred"))).cast("int").alias("ok"), "fit_score", F.explode(F.array(*(F.lit(v) for v in (40.0, 50.0, 60.0, 70.0, 80.0)))).alias("threshold"))
    return x.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"), F.round(F.avg((F.col("fit_score") >= F.col("threshold")).cast("int")), 6).alias("selected"))


@query("select decision_source, round(quantile_cont(fit_score, 0.25), 6) q25, round(quantile_cont(fit_score, 0.5), 6) q50, round(quantile_cont(fit_score, 0.75), 6) q75 from predictions where fit_score is not null and not isnan(fit_score) group by 1")
def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the stored scores by source."""
    p = table(spark, d, "predictions").where("fit_score is not null and not isnan(fit_score)")
    return p.groupBy("decision_source").agg(*(F.round(F.percentile("fit_score", F.lit(q)), 6).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)))


_RANK = f"""with best as (select {SQL_LABEL.format('y_pred')} job, resume_id item, max(fit_score) score, max(({SQL_LABEL.format('y_true')} = {SQL_LABEL.format('y_pred')})::int) rel from predictions where y_true is not null and y_pred is not null and fit_score is not null and not isnan(fit_score) group by 1, 2),
tot as (select job, sum(rel) total from best group by 1 having sum(rel) > 0), r as (select *, row_number() over (partition by job order by score desc, item) rk from best),
h as (select *, sum(rel) over (partition by job order by rk) hits from r where rk <= 10), k as (select unnest([1, 3, 5, 10]) k),
c as (select job, k, total, sum(rel) hit, sum(case when rel > 0 then hits / rk else 0 end) ap, sum(rel / log2(rk + 1)) dcg from h join tot using (job) join k on rk <= k group by 1, 2, 3),
i as (select *, list_sum(list_transform(range(1, least(k, total)::int + 1), lambda x: 1 / log2(x + 1))) ideal from c)
select k, round(avg(hit / k), 4) precision_at, round(avg(hit / total), 4) recall_at, round(avg(ap / least(k, total)), 4) map_at, round(avg(dcg / ideal), 4) ndcg_at, count(*) jobs from i group by 1"""


@query(_RANK)
def ranking(spark: SparkSession, d: str) -> DataFrame:
    """A12, A23, W3, W4, W5, J14."""
    p = table(spark, d, "predictions").where("y_true is not null and y_pred is not null and fit_score is not null and not isnan(fit_score)")
    best = p.select(tx.label_key(F.col("y_pred")).alias("job"), F.col("resume_id").alias("item"), F.col("fit_score").alias("score"), (tx.label_key(F.col("y_true")) == tx.label_key(F.col("y_pred"))).cast("int").alias("rel"))
    return scoring.ranking_metrics(best.groupBy("job", "item").agg(F.max("score").alias("score"), F.max("rel").alias("rel")), "job", "item", "score", "rel")


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gold = lexicon_scan(spark, d).select("id", F.col("canonical").alias("skill"))
    found = canonical_skills(spark, d).select(F.col("resume_id").alias("id"), F.col("canonical").alias("skill"))
    return gold, found


_PRF = f"""with g as (select id, canonical skill from ({ORACLE['lexicon_scan']})), f as (select distinct resume_id id, canonical skill from {_CANON} where resume_id in (select id from g)),
b as (select coalesce(g.id, f.id) id, coalesce(g.skill, f.skill) skill, (g.id is not null and f.id is not null)::int tp, (g.id is null)::int fp, (f.id is null)::int fn from g full join f on g.id = f.id and g.skill = f.skill),
s as (select {{0}}, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from b group by 1)
select {{0}}, tp, fp, fn, case when tp + fp = 0 then 0 else round(tp / (tp + fp), 4) end as "precision", case when tp + fn = 0 then 0 else round(tp / (tp + fn), 4) end recall, case when 2 * tp + fp + fn = 0 then 0 else round(2 * tp / (2 * tp + fp + fn), 4) end f1 from s"""


@query(_PRF.replace("{0}", "id"))
def extraction_by_resume(spark: SparkSession, d: str) -> DataFrame:
    """J9, J10, A11, U2."""
    return scoring.extraction_metrics(*_gold(spark, d), ["id"])


@query(_PRF.replace("{0}", "skill"))
def extraction_by_skill(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    return scoring.extraction_metrics(*_gold(spark, d), ["skill"])


@query()
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return scoring.bootstrap_interval(table(spark, d, "predictions").where("not isnan(fit_score)").select("req_id", "resume_id", "scored_at", "fit_score"), "fit_score")


# ---- term vectors and mining


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resumes").where("resume_text is not null and label is not null").select(F.col("resume_id").alias("id"), F.col("resume_text").alias("text"), tx.label_key(F.col("label")).alias("label"))
    return r


def _grams_sql(words: str, longest: int) -> str:
    """All runs of 1 to ``longest`` of a list of words."""
    runs = [f"list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))" for n in range(1, longest + 1)]
    return "flatten([" + ", ".join(runs) + "])"


def _tfidf_sql(name: str, rows: str, key: str, words: str, longest: int, fit: str, min_df: int = 2, max_df: float = 1.0, most: int = 1 << 30, sublinear: bool = False) -> str:
    """Common tables ``{name}`` (key, term, w): unit vectors over the vocabulary of the rows for which ``fit`` holds."""
    tf = "1 + ln(tf)" if sublinear else "tf"
    return f"""{name}_w as (select {key}, {fit} fit, {words} w from {rows}), {name}_tf as (select {key}, fit, term, count(*) tf from (select {key}, fit, unnest({_grams_sql('w', longest)}) term from {name}_w) group by 1, 2, 3),
{name}_n as (select count(*) n from {name}_w where fit), {name}_df as (select term, ln((1 + n) / (1 + count(*))) + 1 idf, sum(tf) a from {name}_tf, {name}_n where fit group by term, n having count(*) >= {min_df} and count(*) <= {max_df} * n order by a desc, term limit {most}),
{name}_raw as (select {key}, term, ({tf}) * idf w from {name}_tf join {name}_df using (term)), {name} as (select {key}, term, w / sqrt(sum(w * w) over (partition by {key})) w from {name}_raw)"""


_LABELLED = f"(select resume_id id, resume_text t, {SQL_LABEL.format('label')} label, coalesce(lower(trim(split)) = 'train', false) train from resumes where resume_text is not null and label is not null)"


@query(f"""with docs as {_LABELLED}, {_tfidf_sql('vec', 'docs', 'id', SQL_WORDS.format('t'), 2, 'train', 2, 1.0, 30000)},
size as (select label, count(*) c from docs where train group by 1), cent as (select label, term, sum(w) / any_value(c) w from vec join docs using (id) join size using (label) where train group by 1, 2), cn as (select label, sqrt(sum(w * w)) nrm from cent group by 1),
sims as (select v.id, c.label, sum(v.w * c.w) / any_value(nrm) s from vec v join docs d on d.id = v.id and not d.train join cent c using (term) join cn on cn.label = c.label group by 1, 2),
r as (select *, row_number() over (partition by id order by round(s, 9) desc, label) rn from sims) select id, label, round(s, 5) similarity from r where rn = 1""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of words; vocabulary, weights and centroids of the training split, labels of all other resumes."""
    docs = cut(_labelled(spark, d).join(_split(spark, d), "id"))
    counts = cut(vectors.term_counts(docs, "id", "text", 2))
    train = docs.where("train")
    seen = counts.join(train.select("id"), "id", "left_semi")
    vec = cut(vectors.weigh(counts, cut(vectors.vocabulary(seen, train.count(), 2, most=30_000))))
    cents = cut(vectors.centroids(vec.join(train.select("id"), "id", "left_semi"), train.select("id", "label")))
    out = vectors.nearest_centroid(vec.join(docs.where("not train").select("id"), "id", "left_semi"), cents)
    return out.withColumn("similarity", F.round("similarity", 5))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resumes").select(F.col("resume_id").alias("id"), F.coalesce(F.lower(F.trim("split")) == "train", F.lit(False)).alias("train"))


_TERM_SHAPE = r"^(?i)[a-z][a-z\-+#]+(?: [a-z][a-z\-+#]+){0,2}$"


@query(rf"""with docs as {_LABELLED}, {_tfidf_sql('vec', 'docs', 'id', SQL_TOKENS.format('t'), 2, 'true', 3, 0.6, 10000, True)}, n as (select label, count(*) n from docs group by 1), al as (select count(*) al from docs),
ins as (select label, term, sum(w) s_in from vec join docs using (id) group by 1, 2), whole as (select term, sum(s_in) s_all from ins group by 1),
sc as (select label, term, round(s_in / n - (s_all - s_in) / greatest(al - n, 1), 6) score from ins join whole using (term) join n using (label), al where n >= 2),
r as (select *, row_number() over (partition by label order by score desc, term) rn from sc qualify rn <= 24)
select label, term, score, (row_number() over (partition by label order by score desc, term))::int rank_no from r where regexp_matches(term, '(?i)^[a-z][a-z\-+#]+(?: [a-z][a-z\-+#]+){{0,2}}$') qualify rank_no <= 8""")
def characteristic_terms(spark: SparkSession, d: str) -> DataFrame:
    """Of the 24 best terms of a label the 8 best that are no numbers or single letters."""
    docs = _labelled(spark, d)
    vec = cut(vectors.tfidf(cut(vectors.term_counts(docs, "id", "text", 2, tx.STOP)), docs.count(), 3, sublinear=True, max_df=0.6, most=10_000))
    return vectors.characteristic_terms(vec, docs.select("id", "label"), least_docs=2, shape=_TERM_SHAPE)


_ENTRY_TEXT = "concat_ws(' ', nullif(canonical, ''), nullif(category, ''), nullif(description, ''), array_to_string(aliases, ' '))"
LEXICON_SQL = _tfidf_sql("ent", f"(select canonical, {_ENTRY_TEXT} t from lexicon)", "canonical", SQL_WORDS.format("t"), 3, "true", 1)
ORACLE["lexicon_search"] = f"""with {LEXICON_SQL}, p as (select distinct {SQL_KEY.format('phrase')} phrase from skill_matches where phrase is not null),
tf as (select phrase, term, count(*) tf from (select phrase, unnest({_grams_sql('w', 3)}) term from (select phrase, {SQL_WORDS.format('phrase')} w from p where phrase <> '')) group by 1, 2),
raw as (select phrase, term, tf * idf w from tf join ent_df using (term)), nm as (select phrase, sqrt(sum(w * w)) nrm from raw group by 1),
s as (select phrase, canonical, round(least(sum(raw.w * ent.w) / any_value(nrm), 1.0), 6) score from raw join ent using (term) join nm using (phrase) group by 1, 2 having score >= 0.15)
select phrase, canonical, score, (row_number() over (partition by phrase order by score desc, canonical))::int rank_no from s qualify rank_no <= 3"""


def _skill_lists(spark: SparkSession, d: str) -> DataFrame:
    return canonical_skills(spark, d).groupBy(F.col("resume_id").alias("id")).agg(F.sort_array(F.collect_set("canonical")).alias("items"))


@query()
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """L10, L11, A17."""
    lists = cut(_skill_lists(spark, d))
    assigned = vectors.cluster(lists, "id", "items")
    return vectors.cluster_summary(assigned, lists.select("id", F.explode("items").alias("item")))


# itemsets of up to four skills, which are all that two in a hundred resumes share
_RULES = f"""with e as (select distinct resume_id r, canonical x from {_CANON}), n as (select count(distinct r) n from e),
c1 as (select [x] s, count(*) c from e group by 1), c2 as (select [a.x, b.x] s, count(*) c from e a join e b on a.r = b.r and a.x < b.x group by 1),
c3 as (select [a.x, b.x, c.x] s, count(*) c from e a join e b on a.r = b.r and a.x < b.x join e c on b.r = c.r and b.x < c.x group by 1),
c4 as (select [a.x, b.x, c.x, d.x] s, count(*) c from e a join e b on a.r = b.r and a.x < b.x join e c on b.r = c.r and b.x < c.x join e d on c.r = d.r and c.x < d.x group by 1),
sets as (select s, c / n sup from (from c1 union all from c2 union all from c3 union all from c4), n where c >= ceil(0.02 * n)),
m as (select s, sup, unnest(range(1, (1 << len(s)) - 1)) k from sets where len(s) > 1),
p as (select sup, list_filter(s, lambda x, i: (k >> (i - 1)::int) & 1 = 1) l, list_filter(s, lambda x, i: (k >> (i - 1)::int) & 1 = 0) r from m)
select l antecedents, r consequents, round(p.sup, 6) support, round(p.sup / a.sup, 6) confidence, round(p.sup / a.sup / c.sup, 6) lift from p join sets a on a.s = l join sets c on c.s = r where p.sup / a.sup >= 0.3 - 1e-12"""


@query(_RULES)
def association_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules between skills of a resume over all splits of the frequent sets."""
    r = vectors.association_rules(cut(_skill_lists(spark, d)), "items", 0.02, 0.3)
    return r.select("antecedents", "consequents", *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@query(f"""with l as (select resume_id id, {SQL_LABEL.format('label')} label from resumes where label is not null), s as (select distinct resume_id id, canonical skill from {_CANON}), n as (select label, count(*) n from l group by 1),
c as (select label, skill, count(distinct id) / any_value(n) cov, any_value(n) n from s join l using (id) join n using (label) group by 1, 2),
r as (select *, row_number() over (partition by label order by cov desc, skill) rn from c where cov >= case when n < 35 then 0.05 else 0.1 end),
q as (select *, rn <= 6 and cov >= case when n < 35 then 0.2 else 0.3 end rq from r), h as (select *, max(rq::int) over (partition by label) = 1 has from q), f as (select *, case when has then rq else rn <= 3 end req from h),
p as (select *, sum(case when req then 0 else 1 end) over (partition by label order by cov desc, skill) pn from f)
select label, list(skill order by rn) filter (where req) required_skills, coalesce(list(skill order by rn) filter (where not req), []) preferred_skills from p where req or pn <= 8 group by 1""")
def learned_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A5, A6, A7, A8, F2."""
    labels = table(spark, d, "resumes").where("label is not null").select(F.col("resume_id").alias("id"), tx.label_key(F.col("label")).alias("label"))
    skills = canonical_skills(spark, d).select(F.col("resume_id").alias("id"), F.col("canonical").alias("skill")).distinct()
    return vectors.learned_profiles(skills, labels)


@query(f"""with want as (select distinct label from resumes where label is not null), big as (select {SQL_LABEL.format('label')} k from resumes where label is not null group by 1 having count(*) >= 20),
l as (select label k, required_skills, preferred_skills from ({ORACLE['learned_profiles']}) where label in (select k from big)), p as (select {SQL_LABEL.format('label')} k, * exclude (label) from profiles_learned)
select w.label, case when l.k is not null then 'learned' when p.k is not null then 'curated' else 'made up' end origin, case when l.k is null and p.k is not null then p.description else 'Role focused on ' || lower(replace(replace(w.label, '_', ' '), '-', ' ')) || '.' end description,
coalesce(l.required_skills, p.required_skills, string_split(lower(replace(replace(w.label, '_', ' '), '-', ' ')), ' ')) required_skills, coalesce(l.preferred_skills, p.preferred_skills, []) preferred_skills from want w left join l on {SQL_LABEL.format('w.label')} = l.k left join p on {SQL_LABEL.format('w.label')} = p.k""")
def resolve_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile for every label spelling: learned where 20 resumes have the label, else the given one, else made up from its words."""
    labels = table(spark, d, "resumes").where("label is not null")
    big = labels.groupBy(tx.label_key(F.col("label")).alias("label")).agg(F.count("*").alias("n")).where("n >= 20").select("label")
    learned = learned_profiles(spark, d).join(big, "label", "left_semi").withColumn("description", F.lit(None).cast("string"))
    return vectors.resolve_profiles(labels.select("label").distinct(), learned, table(spark, d, "profiles_learned"))


@query(f"""with b as (select resume_id, {SQL_LABEL.format('label')} label from resumes), c as (select label, count(*) n from b group by 1), one as (select case when min(n) = 1 then 1 else 0 end mixed from c),
k as (select resume_id, label, case when mixed = 1 then '' else coalesce(label, chr(0)) end g from b, one), s as (select g, count(*) n from k group by 1), t as (select sum(n) total, ceil(sum(n) * 0.2 - 1e-9) want from s),
q as (select g, n, n * want / total exact, floor(n * want / total) least_, want from s, t), z as (select g, least_ + case when row_number() over (order by round(exact - least_, 9) desc, g) <= want - sum(least_) over () then 1 else 0 end quota from q),
r as (select resume_id, label, row_number() over (partition by g order by md5('42:' || resume_id), resume_id) <= quota test from k join z using (g))
select label, count(*) n, count(*) filter (where test) n_test, min(case when test then resume_id end) first_test from r group by 1""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """L13 over labels in one spelling; by label."""
    s = vectors.stratified_split(table(spark, d, "resumes").select("resume_id", tx.label_key(F.col("label")).alias("label")), "resume_id", "label")
    test = F.col("split_name") == "test"
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(test, 1)).alias("n_test"), F.min(F.when(test, F.col("resume_id"))).alias("first_test"))


@query("""with x as (select label, generate_subscripts(embedding, 1) i, unnest(embedding)::double v from embeddings), m as (select label, i, avg(v) v from x group by 1, 2)
select a.label label_a, b.label label_b, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 5) cosine from m a join m b on a.i = b.i and a.label < b.label group by 1, 2""")
def centroid_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosine between the mean vectors of all labels."""
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    a, b = m.select(F.col("label").alias("label_a"), "i", F.col("v").alias("va")), m.select(F.col("label").alias("label_b"), "i", F.col("v").alias("vb"))
    p = a.join(b, "i").where("label_a < label_b").groupBy("label_a", "label_b")
    return p.agg(F.round(F.sum(F.col("va") * F.col("vb")) / (F.sqrt(F.sum(F.col("va") * F.col("va"))) * F.sqrt(F.sum(F.col("vb") * F.col("vb")))), 5).alias("cosine"))


@query(r"select resume_id, round(ln(1 + length(resume_text)), 6) log_length, len(regexp_extract_all(resume_text, '\S+')) n_words, len(regexp_extract_all(resume_text, '[0-9]+')) n_numbers from resumes where resume_text is not null")
def structure_features(spark: SparkSession, d: str) -> DataFrame:
    """log1p of the text length, as in M9, and counts of words and numbers; M8, M9 and L6 are in ``feature_matrix``."""
    n = lambda p: F.size(F.regexp_extract_all("resume_text", F.lit(p), F.lit(0)))
    return table(spark, d, "resumes").where("resume_text is not null").select("resume_id", F.round(F.log1p(F.length("resume_text")), 6).alias("log_length"), n(r"\S+").alias("n_words"), n("[0-9]+").alias("n_numbers"))


_SIZE = "len(list_filter(coalesce({0}, []), lambda x: trim(x) <> ''))"


@query(f"""with labels as (select list_sort(list(distinct label)) l from profiles_learned), cats as (select list_sort(list(distinct category)) c from lexicon where category is not null),
s as (select resume_id, map(list(label), list(fit_score / 100)) f from ({_SCORES}) group by 1), x as ({_EXPERIENCE}), k as (select resume_id, category, count(*) n, sum(confidence) s, max(confidence) m from {_CANON} group by 1, 2),
own as (select resume_id, sum(n) n, sum(s) / sum(n) a, max(m) m, map(list(category), list(n)) by_ from k group by 1),
e as (select resume_id, {', '.join(f"max({_SIZE.format(n)}) n_{n}" for n in ('skills_raw', 'education', 'experience', 'certifications', 'projects'))} from extracted group by 1),
v as (select r.resume_id, list_transform(l, lambda y: coalesce(f[y], 0)::double) fits, total_years y, x.*, coalesce(own.n, 0) n, coalesce(a, 0) a, coalesce(m, 0) m, list_transform(c, lambda y: coalesce(by_[y] / own.n, 0)::double) shares, e.*, ln(1 + length(resume_text)) log_length
  from (select * from resumes where resume_text is not null) r cross join labels cross join cats left join s using (resume_id) left join x using (resume_id) left join own using (resume_id) left join e using (resume_id))
select resume_id, list_transform(flatten([fits, list_transform(range(1, len(fits) + 1), lambda i: (i = list_position(fits, list_max(fits)))::int::double),
 [coalesce(y, 0), least(coalesce(y, 0), 8) / 8, coalesce(role_count, 0), coalesce(leadership_indicators, 0), coalesce(impact_statements, 0), coalesce(quantified_impact, 0), (coalesce(y, 0) >= 5)::int]::double[],
 [coalesce(n_skills_raw, 0), n, a, m]::double[], shares, [coalesce(n_education, 0), coalesce(n_experience, 0), coalesce(n_certifications, 0), coalesce(n_projects, 0), log_length]::double[]]), lambda z: round(z + 1e-9, 4)) features from v""")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """``(resume_id, features)`` of every resume with a text, in the order of ``vectors.feature_names``, to four places."""
    docs = table(spark, d, "resumes").where("resume_text is not null").select("resume_id", F.log1p(F.length("resume_text")).alias("log_length"))
    labels = [r[0] for r in table(spark, d, "profiles_learned").select("label").distinct().orderBy("label").collect()]  # fixed tables
    categories = [r[0] for r in table(spark, d, "lexicon").where("category is not null").select("category").distinct().orderBy("category").collect()]
    out = vectors.feature_rows(docs, _score(spark, d), experience(spark, d), canonical_skills(spark, d), table(spark, d, "extracted"), labels, categories)
    return out.withColumn("features", F.transform("features", lambda x: F.round(x + 1e-9, 4)))


# ---- sources, sinks and streams


def _place(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex}"


_LISTS = ("education", "experience", "skills_raw", "projects", "certifications", "contact")


@query("select resume_id, raw_text, " + ", ".join(f"coalesce({n}, ['no list']) {n}" for n in _LISTS) + " from extracted")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nested records written as JSON lines and read again."""
    at = _place(spark, "jsonl")
    rows = table(spark, d, "extracted")
    files.write_jsonl(rows, at)
    back = files.read_jsonl(spark, at, "resume_id long, raw_text string, " + ", ".join(f"{n} array<string>" for n in _LISTS))
    return back.select("resume_id", "raw_text", *(F.coalesce(n, F.array(F.lit("no list"))).alias(n) for n in _LISTS))


@query("select row_number() over (order by resume_id) - 1 resume_id, resume_text, label from (select resume_id, coalesce(resume_text, '') resume_text, coalesce(label, 'nan') label from resumes) qualify trim(resume_text) <> ''")
def corpus_csv(spark: SparkSession, d: str) -> DataFrame:
    """A corpus written as CSV and read as a new one: columns found by name, rows numbered before blank ones leave."""
    at = _place(spark, "corpus")
    files.write_csv(table(spark, d, "resumes").orderBy("resume_id").coalesce(1).select(F.col("resume_text").alias("Text"), F.col("label").alias("Category")), at)
    return files.read_corpus_csv(spark, at)


@query("select req_id, resume_id, nullif(y_true, '') y_true, nullif(y_pred, '') y_pred, fit_score, nullif(decision_source, '') decision_source, nullif(scores, '') scores from predictions")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as CSV and read as an optional input (empty cells are null); a missing one reads as none."""
    at = _place(spark, "csv")
    cols = "req_id long, resume_id long, y_true string, y_pred string, fit_score double, decision_source string, scores string"
    files.write_csv(table(spark, d, "predictions").select(*(c.split()[0] for c in cols.split(", "))), at)
    assert files.read_if_there(spark, at + "-none", cols) is None
    return files.read_if_there(spark, at, cols)


_KEYED = "(select doc_kind cache_key, text response, received_at created_at from documents where doc_kind is not null and text is not null and received_at is not null)"


@query(f"select cache_key, max(response) response from (select *, row_number() over (partition by cache_key order by created_at desc, response desc) rn from {_KEYED}) where rn = 1 group by 1")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K9: the later half of the entries merged into a table that holds the earlier half."""
    t = table(spark, d, "documents").where("doc_kind is not null and text is not null and received_at is not null").select(F.col("doc_kind").alias("cache_key"), F.col("text").alias("response"), F.col("received_at").alias("created_at"))
    late = F.pmod(F.xxhash64("response"), F.lit(2)) == 1
    at = _place(spark, "cache")
    files.upsert_table(spark, at, t.where(~late), files.cache_upsert)
    return files.upsert_table(spark, at, t.where(late), files.cache_upsert).select("cache_key", "response")


@query(f"select doc_id, cache_key, md5(response) response_md5 from (select doc_id, doc_kind from documents) join (select cache_key, max(response) response from (select *, row_number() over (partition by cache_key order by created_at desc, response desc) rn from {_KEYED}) where rn = 1 group by 1) on doc_kind = cache_key")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose key is in the cache, with its response."""
    asked = table(spark, d, "documents").select("doc_id", F.col("doc_kind").alias("cache_key"))
    hits, _ = files.cache_lookup(asked, cache_upsert(spark, d))
    return hits.select("doc_id", "cache_key", F.md5("response").alias("response_md5"))


@query(f"select distinct trim(regexp_replace(lower(replace(canonical, '/', ' ')), '\\s+', ' ', 'g')) id, concat_ws(' ', nullif(canonical, ''), nullif(category, ''), nullif(description, ''), array_to_string(aliases, ' ')) as document, upper(category) category from lexicon")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """K8: the lexicon put into a store under its folded names, then put again with other metadata, which replaces it."""
    lex = table(spark, d, "lexicon")
    rows = lambda c: lex.select(tx.phrase_key(F.col("canonical")).alias("id"), tx.embedding_text(F.col("canonical"), F.col("category"), F.col("description"), F.col("aliases")).alias("document"), c.alias("category"))
    at = _place(spark, "vectors")
    files.upsert_table(spark, at, rows(F.col("category")), files.vector_upsert)
    return files.upsert_table(spark, at, rows(F.upper("category")), files.vector_upsert)


@query("select event_type, count(*) n, count(distinct user_id) users from events group by 1")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"select doc_id, {SQL_MASK} masked from (select doc_id, text t from documents) where t is not null")
def streamed_masks(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.15: the documents masked by a stream that runs until they are all read, written by a file sink that survives a restart."""
    at = _place(spark, "stream")
    table(spark, d, "documents").select("doc_id", "text").write.parquet(f"{at}/in")  # a stream reads a folder
    source = incremental.stream_table(spark, f"{at}/in", "doc_id bigint, text string")
    masked = source.where("text is not null").select("doc_id", tx.mask_pii(F.col("text")).alias("masked"))
    run = masked.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("doc_id bigint, masked string").parquet(f"{at}/out")
