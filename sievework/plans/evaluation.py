"""Queries over rationales, soft matches, spans, extraction and evaluation, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract, rationale, scoring, softmatch, supervised, vectors
from ..session import cut, table
from ..sources import files
from . import registry as base
from .registry import _lit, query

# ---- rationales

_FIT = r"^Fit ([0-9]+(?:\.[0-9]+)?) for ([A-Za-z_-]+): matched ([^,.]*), missing ([^.]*)\."


def rationale_records(spark: SparkSession, d: str) -> DataFrame:
    """Rationales among the documents as records: score, label, strengths and gaps stand in their first sentence, the skills asked for in the label's profile; what follows is the recommendation."""
    t = table(spark, d, "documents").where("doc_kind = 'rationale' and text is not null")
    part = lambda k: F.regexp_extract("text", _FIT, k)
    rec = t.select(F.col("doc_id").alias("resume_id"), "text", F.expr("try_cast(" + f"regexp_extract(text, {_lit(_FIT)}, 1)".replace("\\", "\\\\") + " as double)").alias("fit_score"), tx.label_key(part(2)).alias("key"), part(3).alias("s"), part(4).alias("g"))
    prof = table(spark, d, "profiles_learned").select(tx.label_key(F.col("label")).alias("key"), "required_skills", "preferred_skills")
    first = F.regexp_extract("text", r"(?s)^[^\n]*", 0)
    rest = F.regexp_replace("text", r"(?s)^[^\n]*\n?", "")
    one = lambda c: F.when(F.trim(c) != "", F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))
    return rec.join(extract.small(prof), "key", "left").select("resume_id", "fit_score", first.alias("rationale"), rest.alias("recommendation"), F.col("required_skills").alias("matched_skills"), F.col("preferred_skills").alias("missing_skills"), one(F.col("s")).alias("strengths"), one(F.col("g")).alias("gaps"))


def _mention_sql(text: str, phrases: str) -> str:
    return f"list_filter(list_filter(list_transform({phrases}, lambda p: lower(trim(p))), lambda p: p <> ''), lambda p: regexp_matches(lower({text}), '(^|[^A-Za-z0-9])' || regexp_escape(p) || '([^A-Za-z0-9]|$)'))"


def _tone_sql(text: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower({text}), {_lit(w)})" for w in words) + f" then '{name}'" for name, words in rationale.TONES.items()) + " end"


def _ground_sql(items: str, reference: str, yes: bool) -> str:
    rests = f"len(list_filter({reference}, lambda r: contains(lower(r), lower(trim(x))) or contains(lower(trim(x)), lower(r)))) > 0"
    return f"list_filter({items}, lambda x: trim(x) <> '' and {'' if yes else 'not '}({rests}))"


_AUDIT = f"""with r0 as (select doc_id resume_id, text, regexp_extract(text, {_lit(_FIT)}, 1) f, replace(upper(trim(regexp_extract(text, {_lit(_FIT)}, 2))), '_', '-') key, trim(regexp_extract(text, {_lit(_FIT)}, 3)) s, trim(regexp_extract(text, {_lit(_FIT)}, 4)) g from documents where doc_kind = 'rationale' and text is not null),
r1 as (select resume_id, coalesce(try_cast(f as double), 0.0) fit_score, split_part(text, chr(10), 1) rationale, case when contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) else '' end recommendation,
  coalesce(required_skills, []) m, coalesce(preferred_skills, []) n, case when s <> '' then [s] else []::varchar[] end st, case when g <> '' then [g] else []::varchar[] end ga from r0 left join profiles_learned p on r0.key = replace(upper(trim(p.label)), '_', '-')),
r2 as (select *, rationale || chr(10) || recommendation w, case when fit_score >= 70 then 'advance' when fit_score >= 40 then 'consider' else 'reject' end fit_band, {_tone_sql('recommendation')} recommendation_tone from r1),
r3 as (select resume_id, fit_score, fit_band, recommendation_tone, {_mention_sql('w', 'm')} matched_skill_hits, {_mention_sql('w', 'n')} missing_skill_hits, len(regexp_extract_all(rationale, '\\S+')) word_count,
  list_filter([{', '.join(f"regexp_extract(w, {_lit(rf'(?i)\b({x})\b')}, 1)" for x in rationale.IDENTITY)}], lambda x: x <> '') identity_terms,
  case when len(st) = 0 then 1.0::double else len({_ground_sql('st', 'm', True)}) / len(st) end strengths_grounded_ratio, case when len(ga) = 0 then 1.0::double else len({_ground_sql('ga', 'n', True)}) / len(ga) end gaps_grounded_ratio,
  {_ground_sql('st', 'm', False)} strengths_invented, {_ground_sql('ga', 'n', False)} gaps_invented from r2)
select *, len(matched_skill_hits) > 0 grounded_in_matched, len(missing_skill_hits) > 0 grounded_in_missing, word_count >= 15 is_specific, coalesce(recommendation_tone = fit_band, false) calibrated, len(identity_terms) = 0 identity_clean from r3"""


@query(_AUDIT)
def rationale_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row per written rationale."""
    return rationale.audit(rationale_records(spark, d))


_SHARE = "coalesce(round(avg(({})::int), 4), 0.0)"


@query(f"""select count(*) n, {_SHARE.format('grounded_in_matched')} grounded_in_matched_pct, {_SHARE.format('grounded_in_missing')} grounded_in_missing_pct, {_SHARE.format('grounded_in_matched and grounded_in_missing')} grounded_in_both_pct, {_SHARE.format('is_specific')} specific_pct,
{_SHARE.format('calibrated')} calibrated_pct, {_SHARE.format('identity_clean')} identity_clean_pct, coalesce(round(avg(word_count), 2), 0.0) avg_word_count, coalesce(round(avg(strengths_grounded_ratio), 4), 0.0) strengths_grounded_pct, coalesce(round(avg(gaps_grounded_ratio), 4), 0.0) gaps_grounded_pct,
{', '.join(f"count(*) filter (where recommendation_tone = '{t}') tone_{t}, count(*) filter (where fit_band = '{t}') band_{t}" for t in ('advance', 'consider', 'reject'))}, count(*) filter (where recommendation_tone is null) tone_unclassified from ({_AUDIT})""")
def rationale_report(spark: SparkSession, d: str) -> DataFrame:
    """The audits of a run in one row."""
    return rationale.report(rationale_audit(spark, d))


# ---- soft matches

SOFT = 0.45


def lexicon_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of the lexicon entries over runs of one to three words."""
    texts = table(spark, d, "lexicon").select("canonical", tx.embedding_text(F.col("canonical"), F.col("category"), F.col("description"), F.col("aliases")).alias("text"))
    return cut(vectors.tfidf(vectors.term_counts(texts, "canonical", "text", 3), texts.count(), 1))


_LIKE = "like_ as (select a.canonical skill, b.canonical target, least(round(sum(a.w * b.w), 9), 1.0) c from ent a join ent b on a.term = b.term and a.canonical <> b.canonical group by 1, 2)"


def _soft_sql(threshold: str) -> str:
    """``soft`` (resume_id, target, w): weight of each skill for each resume; ``own`` as a list."""
    return f"""own as (select resume_id, list(distinct canonical) own from {base._CANON} group by 1), has as (select resume_id, unnest(own) skill from own),
near as (select resume_id, target, max(c) c from has join like_ using (skill) group by 1, 2),
soft as (select resume_id, target, case when c >= 1 then 1.0 when c < {threshold} then 0.0 else 0.5 + 0.5 * (c - {threshold}) / greatest(1e-6, 1 - {threshold}) end w from near where not list_contains((select own from own o where o.resume_id = near.resume_id), target) union all select resume_id, skill, 1.0 from has)"""


@query(f"""with {base.LEXICON_SQL}, {_LIKE}, {_soft_sql(str(SOFT))},
t as (select label, unnest(list_distinct(list_concat(required_skills, preferred_skills))) target from profiles_learned)
select own.resume_id, p.label, coalesce(round(sum(w), 5), 0.0) score, coalesce(list_sort(list(soft.target) filter (where w > 0)), []) matched from own cross join profiles_learned p left join (soft join t on t.target = soft.target) on soft.resume_id = own.resume_id and t.label = p.label group by 1, 2""")
def soft_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the skills of every resume cover those of every profile if close skills count in part."""
    skills = base.canonical_skills(spark, d).select("resume_id", "canonical").distinct()
    own = skills.groupBy("resume_id").agg(F.collect_set("canonical").alias("own"))
    near = softmatch.closest(skills, softmatch.likeness(lexicon_vectors(spark, d), SOFT))
    targets = table(spark, d, "profiles_learned").select("label", F.array_union("required_skills", "preferred_skills").alias("targets"))
    all_targets = targets.agg(F.collect_list(F.struct("label", "targets")).alias("all"))  # one row, checked below
    rows = own.join(near, "resume_id", "left").join(extract.small(all_targets)).select("resume_id", "own", F.coalesce("near", F.create_map().cast("map<string,struct<cosine:double,skill:string>>")).alias("near"), F.explode("all").alias("t")).select("*", "t.*")
    score, matched = softmatch.overlap(F.col("own"), F.col("near"), F.col("targets"), SOFT)
    return rows.select("resume_id", "label", F.round(score, 5).alias("score"), matched.alias("matched"))


SWEEP = [2.0, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4]  # fixed values: thresholds of the sweep


@query()
def soft_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All resumes scored again for each soft-match threshold; how often the best profile is the resume's label."""
    docs = cut(table(spark, d, "resumes").where("resume_text is not null and label is not null").select("resume_id", F.col("resume_text").alias("text"), tx.label_key(F.col("label")).alias("truth")))
    skills, exp = cut(base.canonical_skills(spark, d)), cut(base.experience(spark, d))
    like = cut(softmatch.likeness(lexicon_vectors(spark, d), min(SWEEP)))
    out = None
    for t in SWEEP:  # one job a threshold; each reads the same tables
        s = scoring.score_all(docs.select("resume_id", "text"), skills, exp, table(spark, d, "profiles_learned"), like, t)
        best = scoring.best_and_margin(s, "resume_id", "label", "fit_score").join(docs, "resume_id")
        row = best.agg(F.lit(t).alias("threshold"), F.round(F.avg((tx.label_key(F.col("best_label")) == F.col("truth")).cast("double")), 4).alias("accuracy"), F.round(F.avg("best"), 3).alias("mean_best"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""with {base.LEXICON_SQL}, asked as (select required_skills[1] name_a, preferred_skills[1] name_b from profiles_learned union select required_skills[1], 'no such skill' from profiles_learned)
select name_a, name_b, case when name_a in (select canonical from ent) and name_b in (select canonical from ent) then coalesce(round((select sum(x.w * y.w) from ent x join ent y using (term) where x.canonical = name_a and y.canonical = name_b), 6), 0.0) end cosine from asked where name_a is not null and name_b is not null""")
def named_pair_cosines(spark: SparkSession, d: str) -> DataFrame:
    """The first required with the first preferred skill of each profile, and with a name that is unknown."""
    p = table(spark, d, "profiles_learned").select(F.get("required_skills", F.lit(0)).alias("name_a"), F.get("preferred_skills", F.lit(0)).alias("name_b"))
    asked = p.unionByName(p.withColumn("name_b", F.lit("no such skill"))).where("name_a is not null and name_b is not null")
    return vectors.named_cosines(asked, lexicon_vectors(spark, d))


# ---- spans and extraction

SPANS_SQL = r"""with recursive forms as (select distinct lower(trim(form)) form, canonical from (select canonical, unnest(list_concat([canonical], coalesce(aliases, []))) form from lexicon) where trim(form) <> ''),
heads as (select form, canonical, regexp_extract(form, '^[a-z0-9]+') head, '^(' || replace(regexp_escape(form), '\ ', '\s+') || ')([^a-z0-9]|$)' rx from forms),
docs as (select resume_id id, resume_text t, lower(resume_text) low from resumes where resume_text is not null),
starts as (select id, t, low, i from (select id, t, low, unnest(range(1, length(low) + 1)) i from docs) where regexp_matches(substr(low, i, 1), '[a-z0-9]') and (i = 1 or not regexp_matches(substr(low, i - 1, 1), '[a-z0-9]'))),
words as (select *, regexp_extract(substr(low, i, 80), '^[a-z0-9]+') head from starts),
m as (select id, i - 1 s, i - 1 + length(regexp_extract(substr(low, i, 120), rx, 1)) e, canonical from words join heads using (head) where regexp_matches(substr(low, i, 120), rx)),
best as (select id, s, max(e) e, min(canonical) c from (select *, max(e) over (partition by id, s) mx from m) where e = mx group by 1, 2),
nxt as (select a.id, a.s, a.e, a.c, b.s n from best a asof left join best b on a.id = b.id and a.e <= b.s),
walk as (select id, min(s) s from best group by id union all select walk.id, nxt.n from walk join nxt on walk.id = nxt.id and walk.s = nxt.s where nxt.n is not null),
got as (select nxt.id, nxt.c canonical, nxt.s, nxt.e from walk join nxt on walk.id = nxt.id and walk.s = nxt.s)
select id, canonical, substr(t, s + 1, e - s) surface, s::int start_at, e::int end_at from got join docs using (id) qualify row_number() over (partition by id, canonical order by s) = 1"""


@query(SPANS_SQL)
def skill_spans(spark: SparkSession, d: str) -> DataFrame:
    """The first place of every skill in every resume."""
    return extract.skill_spans(table(spark, d, "resumes").where("resume_text is not null"), "resume_id", "resume_text", table(spark, d, "lexicon"))


HINTS = r"(?i)\b(welding|audit|training|planning|coaching|design|coding|invoice|patient|harvester|soil|communication|leadership)\b"
_LIST = "list_distinct(list_filter(list_transform(flatten(list_transform({}, lambda x: regexp_split_to_array(x, '[,;/|]'))), lambda x: regexp_replace(x, '^[ \\-:\\t]+|[ \\-:\\t]+$', '', 'g')), lambda x: x <> ''))"
_LINES_OF = "coalesce(list(line order by no) filter (where section = '{0}' and line <> ''), []) {0}"
_EXTRACT_SQL = rf"""with src as (select raw_id id, trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) raw_text from sample_resumes where text is not null), live as (select * from src where raw_text <> ''),
lines as (select id, trim(raw) line, no from (select id, unnest(l) raw, generate_subscripts(l, 1) no from (select id, regexp_split_to_array(raw_text, '\n') l from live)) where trim(raw) <> ''), heads as (select *, {base._HEAD} head from lines),
filled as (select *, coalesce(last_value(head ignore nulls) over (partition by id order by no rows between unbounded preceding and current row), 'experience') section from heads),
rest as (select id, section, no, case when head is null then line else regexp_replace(regexp_replace(line, {_lit(extract.HEADER_WORDS)}, ''), '^[ :\-]+|[ :\-]+$', '', 'g') end line from filled),
sec as (select id, {', '.join(_LINES_OF.format(n) for n, _ in extract.HEADERS)} from rest group by id),
parts as (select live.id, raw_text, coalesce(education, []) education, coalesce(experience, []) ex, coalesce(skills, []) sk, coalesce(projects, []) projects, coalesce(certifications, []) certifications from live left join sec using (id)),
hint as (select *, {_LIST.format("list_filter(sk, lambda x: regexp_matches(x, " + _lit(HINTS) + "))")} of_section, list_distinct(regexp_extract_all(raw_text, {_lit(HINTS)}, 1)) anywhere from parts)
select id, raw_text, education, case when len(ex) > 0 then ex else [raw_text] end experience, case when len(of_section) > 0 then of_section else anywhere end skills_raw, projects, certifications, regexp_extract_all(raw_text, {_lit(tx.CONTACT)}) contact from hint"""


@query("select id, raw_text, education, experience, list_sort(skills_raw) skills_raw, projects, certifications, contact from (" + _EXTRACT_SQL + ")")
def rule_extract(spark: SparkSession, d: str) -> DataFrame:
    """Sections, skill hints (of this corpus' trades) and contacts of every raw text, by rules."""
    out = extract.rule_extract(table(spark, d, "sample_resumes").where("text is not null"), "raw_id", "text", HINTS)
    return out.withColumn("skills_raw", F.sort_array("skills_raw"))


@query(f"""with e as (select resume_id id, any_value(education) education, any_value(skills_raw) skills_raw from extracted group by 1), r as (select resume_id id, [resume_text] exp from resumes where trim(resume_text) <> ''),
live as (select id, list_filter(education, lambda x: trim(x) <> '') ed, list_filter(skills_raw, lambda x: trim(x) <> '') sk from e)
select id, case when len(ed) > 0 then len(ed) else 0 end n_education, case when len(sk) > 0 then len(sk) else len(list_distinct(regexp_extract_all(exp[1], {_lit(HINTS)}, 1))) end n_skills from r left join live using (id)""")
def merged_extraction(spark: SparkSession, d: str) -> DataFrame:
    """The stored extractions where they hold anything, else what the rules find in the resume."""
    rule = extract.rule_extract(table(spark, d, "resumes").where("resume_text is not null"), "resume_id", "resume_text", HINTS)
    names = ["education", "experience", "skills_raw", "projects", "certifications"]
    stored = table(spark, d, "extracted").groupBy(F.col("resume_id").alias("id")).agg(*(F.first(n).alias(n) for n in names))
    m = extract.merge_extractions(rule, stored)
    return m.select("id", F.size("education").alias("n_education"), F.size("skills_raw").alias("n_skills"))


@query(r"select doc_id, 'Kind: ' || coalesce(doc_kind, '') || chr(10) || 'Text: ' || coalesce(text, '') as prompt from documents")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt per document with its whole text."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return table(spark, d, "documents").select("doc_id", tx.prompt("Kind: %s\nText: %s", c("doc_kind"), c("text")).alias("prompt"))


_EXP = base._EXPERIENCE


@query(f"""with a as ({_EXP}), b as ({base._experience_sql('doc_id', 'text', 'documents')})
select resume_id, least(greatest(a.total_years, coalesce(b.total_years, 0), 0), 60)::double total_years, greatest(a.role_count, coalesce(b.role_count, 0)) role_count, greatest(a.leadership_indicators, coalesce(b.leadership_indicators, 0)) leadership_indicators,
greatest(a.impact_statements, coalesce(b.impact_statements, 0)) impact_statements, greatest(a.quantified_impact, coalesce(b.quantified_impact, 0)) quantified_impact, case when len(coalesce(b.evidence, [])) > 0 then b.evidence[1:3] else a.evidence[1:3] end evidence
from a left join b on b.doc_id = a.resume_id""")
def merged_experience(spark: SparkSession, d: str) -> DataFrame:
    """Each resume's signals with those of the document of the same number, as a second opinion."""
    a = base.experience(spark, d)
    b = base.experience_of(table(spark, d, "documents"), "doc_id", "text")
    names = ["total_years", "role_count", "leadership_indicators", "impact_statements", "quantified_impact", "evidence"]
    both = a.select("resume_id", F.struct(*names).alias("a")).join(b.select(F.col("doc_id").alias("resume_id"), F.struct(*names).alias("b")), "resume_id", "left")
    return both.select("resume_id", tx.merged_experience(F.col("a"), F.col("b")).alias("m")).select("resume_id", "m.*")


# ---- evaluation


def _gold_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resumes").where("resume_text is not null").select(F.col("resume_id").alias("id"), F.coalesce(tx.label_key(F.col("label")), F.lit("unknown")).alias("category"))


_CAT = f"(select resume_id id, coalesce({base.SQL_LABEL.format('label')}, 'unknown') category from resumes where resume_text is not null)"
_CELLS = f"""g as (select id, canonical skill from ({base.ORACLE['lexicon_scan']})), f as (select distinct resume_id id, canonical skill from {base._CANON}),
b as (select coalesce(g.id, f.id) id, coalesce(g.skill, f.skill) skill, (g.id is not null and f.id is not null)::int tp, (g.id is null)::int fp, (f.id is null)::int fn from g full join f on g.id = f.id and g.skill = f.skill)"""
_D = "case when {1} = 0 then 0.0 else round({0} / {1}, 4) end"


@query(f"""with {_CELLS}, e as (select id, coalesce(sum(tp), 0) tp, coalesce(sum(fp), 0) fp, coalesce(sum(fn), 0) fn from {_CAT} c left join b using (id) where id in (select id from g) or not exists (select 1 from b x where x.id = c.id) or id not in (select id from g) group by 1),
k as (select id, case when id in (select id from g) then fp else 0 end fp, tp, fn from e),
p as (select *, {_D.format('tp', '(tp + fp)')} p, {_D.format('tp', '(tp + fn)')} r, {_D.format('2 * tp', '(2 * tp + fp + fn)')} f1 from k)
select round(avg(p), 4) macro_precision, round(avg(r), 4) macro_recall, round(avg(f1), 4) macro_f1, {_D.format('sum(tp)', 'sum(tp + fp)')} micro_precision, {_D.format('sum(tp)', 'sum(tp + fn)')} micro_recall, {_D.format('2 * sum(tp)', 'sum(2 * tp + fp + fn)')} micro_f1,
count(*) n_resumes, sum(tp + fn)::bigint n_gold_skills, sum(tp + fp)::bigint n_pred_skills from p""")
def extraction_report(spark: SparkSession, d: str) -> DataFrame:
    """Macro and micro values; gold is what the texts name, predictions are the stored matches."""
    return scoring.extraction_report(*base._gold(spark, d), _gold_categories(spark, d))


@query(f"""with {_CELLS}, s as (select category, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from b join {_CAT} c using (id) where id in (select id from g) group by 1)
select category, tp, fp, fn, {_D.format('tp', '(tp + fp)')} as "precision", {_D.format('tp', '(tp + fn)')} recall, {_D.format('2 * tp', '(2 * tp + fp + fn)')} f1 from s""")
def extraction_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Counts per label of the resume."""
    gold, found = base._gold(spark, d)
    of = extract.small(_gold_categories(spark, d))
    return scoring.extraction_metrics(gold.join(of, "id"), found.join(of, "id"), ["category"])


_NUMBERS = """(select req_id, resume_id, y_true, y_pred, replace(upper(trim(k)), '_', '-') label, max(try_cast(json_extract(scores, '$."' || k || '"') as double)) score
from (select *, unnest(json_keys(scores)) k from (select distinct req_id, resume_id, y_true, y_pred, scores from predictions where json_valid(scores) and json_type(scores) = 'OBJECT')) where json_type(json_extract(scores, '$."' || k || '"')) in ('DOUBLE', 'BIGINT', 'UBIGINT') group by all)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """each scored application's labels; rows of unreadable scores are left out."""
    keys = ["req_id", "resume_id", "y_true", "y_pred"]
    p = table(spark, d, "predictions").select(*keys, "scores").distinct()
    return scoring.json_scores(p, keys, "scores").groupBy(*keys, "label").agg(F.max("score").alias("score"))


_AGENT = f"""(select req_id, resume_id, y_true, y_pred, max(case when rn = 1 then label end) agent, max(case when rn = 1 then score end) best, coalesce(max(case when rn = 2 then score end), max(case when rn = 1 then score end)) as "second"
from (select *, row_number() over (partition by req_id, resume_id, y_true, y_pred order by score desc, label) rn from (select req_id, resume_id, y_true, y_pred, label, max(score) score from {_NUMBERS} group by all)) where rn <= 2 group by 1, 2, 3, 4)"""


@query(f'select req_id, resume_id, y_true, y_pred, agent, best, "second", round(best - "second", 4) margin from {_AGENT}')
def agent_choice(spark: SparkSession, d: str) -> DataFrame:
    """Best and second label of each application by its stored scores."""
    keys = ["req_id", "resume_id", "y_true", "y_pred"]
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "label")))
    top = _scored(spark, d).groupBy(*keys).agg(ranked.alias("r"))  # the labels of one application are few
    best, second = -F.get("r", F.lit(0))["down"], F.coalesce(-F.get("r", F.lit(1))["down"], -F.get("r", F.lit(0))["down"])
    return top.select(*keys, F.get("r", F.lit(0))["label"].alias("agent"), best.alias("best"), second.alias("second"), F.round(best - second, 4).alias("margin"))


def _metrics_sql(pairs: str) -> str:
    """One row of classification metrics of a table of ``t`` and ``p``."""
    return base.ORACLE["classification"].replace(base._PRED, pairs)


_BOTH = f"(select {base.SQL_LABEL.format('y_true')} t, {base.SQL_LABEL.format('y_pred')} p, agent a from {_AGENT} where y_true is not null and y_pred is not null)"


@query(f"with a as ({_metrics_sql(f'(select t, p from {_BOTH})')}), b as ({_metrics_sql(f'(select t, a p from {_BOTH})')}) select " + ", ".join(f"round(a.{n} - b.{n}, 4) {n}_delta" for n in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")) + " from a, b")
def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The decided labels against the best by score alone, over the same applications."""
    c = cut(agent_choice(spark, d).where("y_true is not null and y_pred is not null").select(tx.label_key(F.col("y_true")).alias("t"), tx.label_key(F.col("y_pred")).alias("p"), F.col("agent").alias("a")))
    return scoring.metric_deltas(scoring.classification_metrics(c, "t", "p"), scoring.classification_metrics(c, "t", "a"))


@query(f"""with p as (select d.label t, n.label p from ({base.ORACLE['nearest_centroid']}) n join {base._LABELLED} d using (id)), m as ({_metrics_sql('(select t, p from p)')})
select m.*, (select count(*) from {base._LABELLED} where train) train_size, (select count(*) from {base._LABELLED} where not train) test_size from m""")
def baseline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The centroid labels against the true ones, with the sizes of both sides."""
    docs = cut(base._labelled(spark, d).join(base._split(spark, d), "id"))
    said = docs.select("id", F.col("label").alias("t")).join(base.nearest_centroid(spark, d).select("id", F.col("label").alias("p")), "id")
    sizes = docs.agg(F.count(F.when(F.col("train"), 1)).alias("train_size"), F.count(F.when(~F.col("train"), 1)).alias("test_size"))
    return scoring.classification_metrics(said, "t", "p").join(sizes)  # one row each


@query(f"""with s as (select label job, resume_id item, max(score) score from {_NUMBERS} group by 1, 2), r as (select distinct {base.SQL_LABEL.format('y_true')} job, resume_id item from predictions where y_true is not null and resume_id is not null),
best as (select coalesce(s.job, r.job) job, coalesce(s.item, r.item) item, score, (r.item is not null)::int rel from s full join r on s.job = r.job and s.item = r.item),
tot as (select job, sum(rel) total from best group by 1 having sum(rel) > 0), rk as (select *, row_number() over (partition by job order by score desc nulls last, item) rk from best),
h as (select *, sum(rel) over (partition by job order by rk) hits from rk where rk <= 10), k as (select unnest([1, 3, 5, 10]) k),
c as (select job, k, total, sum(rel) hit, sum(case when rel > 0 then hits / rk else 0 end) ap, sum(rel / log2(rk + 1)) dcg from h join tot using (job) join k on rk <= k group by 1, 2, 3),
i as (select *, list_sum(list_transform(range(1, least(k, total)::int + 1), lambda x: 1 / log2(x + 1))) ideal from c)
select k, round(avg(hit / k), 4) precision_at, round(avg(hit / total), 4) recall_at, round(avg(ap / least(k, total)), 4) map_at, round(avg(dcg / ideal), 4) ndcg_at, count(*) jobs from i group by 1""")
def ranking_by_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every label as a job, its candidates by their stored score; who has none comes last."""
    scored = _scored(spark, d).groupBy(F.col("label").alias("job"), F.col("resume_id").alias("item")).agg(F.max("score").alias("score"))
    right = table(spark, d, "predictions").where("y_true is not null and resume_id is not null").select(tx.label_key(F.col("y_true")).alias("job"), F.col("resume_id").alias("item")).distinct().withColumn("rel", F.lit(1))
    return scoring.ranking_metrics(scored.join(right, ["job", "item"], "full").na.fill(0, ["rel"]), "job", "item", "score", "rel")


@query(f"select decision_source, round(quantile_cont(margin, 0.25), 6) q25, round(quantile_cont(margin, 0.5), 6) q50, round(quantile_cont(margin, 0.75), 6) q75, count(*) n from (select distinct p.decision_source, a.req_id, a.resume_id, best - \"second\" margin from {_AGENT} a join predictions p on p.req_id = a.req_id and p.resume_id = a.resume_id) group by 1")
def margin_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the margin between best and second label, by the source of the decision."""
    src = table(spark, d, "predictions").select("req_id", "resume_id", "decision_source").distinct()
    m = agent_choice(spark, d).select("req_id", "resume_id", (F.col("best") - F.col("second")).alias("margin")).join(src, ["req_id", "resume_id"]).distinct()
    return m.groupBy("decision_source").agg(*(F.round(F.percentile("margin", F.lit(q)), 6).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.count("*").alias("n"))


@query(f"select t label, count(*) n, sum((t = p)::int)::bigint hits, round(avg((t = p)::int), 4) accuracy from {base._PRED} group by 1")
def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many of each label's applications are told rightly."""
    ok = (F.col("t") == F.col("p")).cast("int")
    return base._pred(spark, d).groupBy(F.col("t").alias("label")).agg(F.count("*").alias("n"), F.sum(ok).alias("hits"), F.round(F.avg(ok), 4).alias("accuracy"))


@query(f"select distinct {base.SQL_LABEL.format('l')} label from (select label l from profiles_learned union select y_pred from predictions union select y_true from predictions) where l is not null")
def label_space(spark: SparkSession, d: str) -> DataFrame:
    """Every label of the profiles and of the predictions."""
    p = table(spark, d, "predictions")
    all_labels = table(spark, d, "profiles_learned").select("label").unionByName(p.select(F.col("y_pred").alias("label"))).unionByName(p.select(F.col("y_true").alias("label")))
    return all_labels.where("label is not null").select(tx.label_key(F.col("label")).alias("label")).distinct()


_OWN = "(select resume_id, resume_text, {0} only_label from resumes where resume_text is not null and label is not null)"


def _own_scores(own: str) -> str:
    return base.scores_sql(f"(select resume_id, {own} resume_text, (select min(p.label) from profiles_learned p where {base.SQL_LABEL.format('p.label')} = {base.SQL_LABEL.format('r.label')}) only_label from resumes r where resume_text is not null and label is not null and {base.SQL_LABEL.format('r.label')} in (select {base.SQL_LABEL.format('label')} from profiles_learned))")


_FAIR = f"(with o as (select resume_id, fit_score a from ({_own_scores('resume_text')})), p as (select resume_id, fit_score b from ({_own_scores(base._cue_sql(base._pronouns_sql(base._names_sql('resume_text'))))})) select * from o join p using (resume_id))"


def _fair_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each resume with a learned profile of its label, scored against that as it is and with name, pronouns and cue changed."""
    prof = table(spark, d, "profiles_learned")
    own = prof.groupBy(tx.label_key(F.col("label")).alias("key")).agg(F.min("label").alias("only"))
    docs = table(spark, d, "resumes").where("resume_text is not null and label is not null").withColumn("key", tx.label_key(F.col("label"))).join(extract.small(own), "key")
    skills = base.canonical_skills(spark, d)

    def scored(kind: str, name: str) -> DataFrame:
        t = cut(docs.select("resume_id", "only", base.perturbed(F.col("resume_text"), kind).alias("text")))
        s = scoring.score_all(t, skills, base.experience_of(t, "resume_id", "text"), prof)
        return s.select("resume_id", F.col("fit_score").alias(name))

    return scored("original", "a").join(scored("combined", "b"), "resume_id")


@query(f"""select coalesce(round(avg(b - a), 4), 0.0) mean_score_difference, coalesce(round(avg((b >= 60)::int) - avg((a >= 60)::int), 4), 0.0) selection_rate_difference, coalesce(round(avg(a), 4), 0.0) original_mean, coalesce(round(avg(b), 4), 0.0) perturbed_mean, count(*) variant_count from {_FAIR}""")
def fairness_audit(spark: SparkSession, d: str) -> DataFrame:
    """Original against perturbed resumes."""
    return scoring.fairness(_fair_pairs(spark, d), "a", "b")


@query()
def fairness_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean score difference."""
    return scoring.bootstrap_interval(_fair_pairs(spark, d).select((F.col("b") - F.col("a")).alias("delta")), "delta")


# ---- features and mining


@query(f"""with cats as (select list_sort(list(distinct category)) c from lexicon where category is not null), k as (select resume_id, category, count(*) n, sum(confidence) s, max(confidence) m from {base._CANON} group by 1, 2),
a as (select resume_id, sum(n) n, sum(s) s, max(m) m, map(list(category), list(n)) by_ from k group by 1)
select r.resume_id, coalesce(a.n, 0)::int n_skills, coalesce(round(s / a.n + 1e-9, 4), 0.0) avg_confidence, coalesce(m, 0.0) max_confidence, list_transform(c, lambda x: coalesce(round(by_[x] / a.n, 6), 0.0)) category_shares from (select distinct resume_id from resumes) r cross join cats left join a using (resume_id)""")
def skill_vector(spark: SparkSession, d: str) -> DataFrame:
    """Of every resume, those without skills too, how many skills, how sure, and the share of every category in order."""
    cats = [r[0] for r in table(spark, d, "lexicon").where("category is not null").select("category").distinct().orderBy("category").collect()]  # a fixed table
    by = base.canonical_skills(spark, d).groupBy("resume_id", "category").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.max("confidence").alias("m"))
    own = by.groupBy("resume_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("by"))
    rows = table(spark, d, "resumes").select("resume_id").distinct().join(own, "resume_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = F.array(*(zero(F.round(F.try_element_at("by", F.lit(c)) / F.col("n"), 6)) for c in cats))
    return rows.select("resume_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_skills"), zero(F.round(F.col("s") / F.col("n") + 1e-9, 4)).alias("avg_confidence"), zero(F.col("m")).alias("max_confidence"), share.alias("category_shares"))


@query(f"""with s as (select resume_id, label, fit_score / 100 f from ({base._SCORES})), t as (select resume_id, min(label) filter (where f = mx) top from (select *, max(f) over (partition by resume_id) mx from s) group by 1)
select resume_id, list(f order by label) fit_vector, list((label = top)::int order by label) top_vector from s join t using (resume_id) group by 1""")
def fit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The scores of all profiles in order, and the best of them as one-hot."""
    s = base._score(spark, d)
    v = s.groupBy("resume_id").agg(F.array_sort(F.collect_list(F.struct("label", (F.col("fit_score") / 100).alias("f")))).alias("x"))
    fits = F.transform("x", lambda x: x["f"])
    top = F.array_position(fits, F.array_max(fits))
    return v.select("resume_id", fits.alias("fit_vector"), F.transform("x", lambda x, i: (i + 1 == top).cast("int")).alias("top_vector"))


@query(f"""with s as ({base._SCORES}), r as (select *, row_number() over (partition by resume_id order by fit_score desc, label) rn from s)
select resume_id, label, fit_score, matched[1:5] strengths, missing[1:5] gaps, format('{{:.2f}}', fit_score) || ' for ' || label || ': ' || len(matched) || ' matched, ' || len(missing) || ' missing' summary from r where rn = 1""")
def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """M6 without its texts, T5, E3: the best profile of each resume with the first five strengths and gaps."""
    w = Window.partitionBy("resume_id").orderBy(F.desc("fit_score"), F.asc("label"))
    best = base._score(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    summary = F.format_string("%.2f for %s: %d matched, %d missing", "fit_score", "label", F.size("matched"), F.size("missing"))
    return best.select("resume_id", "label", "fit_score", F.slice("matched", 1, 5).alias("strengths"), F.slice("missing", 1, 5).alias("gaps"), summary.alias("summary"))


_BASKETS = """with kinds as (select p_type, row_number() over (order by p_type) - 1 i from (select distinct p_type from part)), b as (select l_orderkey, bit_or((1 << i)::int) m from lineitem join part on p_partkey = l_partkey join kinds using (p_type) group by 1), n as (select count(*) n from orders),
masks as (select unnest(range(1, 1 << (select count(*) from kinds)))::int s), sets as (select s, count(*) / any_value(n) sup from masks join b on m & s = s, n group by 1 having count(*) >= 0.2 * any_value(n)),
rules as (select x.s, a.s l, (x.s & ~a.s)::int r, x.sup, x.sup / a.sup conf, x.sup / a.sup / c.sup lift from sets x join sets a on a.s <> x.s and x.s & a.s = a.s join sets c on c.s = (x.s & ~a.s)::int where x.sup / a.sup >= 0.5 - 1e-12)
select (select list(p_type order by p_type) from kinds where l & (1 << i)::int <> 0) antecedents, (select list(p_type order by p_type) from kinds where r & (1 << i)::int <> 0) consequents, round(sup, 6) support, round(conf, 6) confidence, round(lift, 6) lift from rules"""


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    items = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("items"))
    none = F.array().cast("array<string>")
    return table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.coalesce("items", none).alias("items"))


@query(_BASKETS)
def basket_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules over all splits of the frequent sets of part types in an order; empty orders count."""
    r = vectors.association_rules(cut(_baskets(spark, d)), "items", 0.2, 0.5)
    return r.select(F.sort_array("antecedents").alias("antecedents"), F.sort_array("consequents").alias("consequents"), *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@query(f"select * from ({_BASKETS}) order by lift desc, confidence desc, support desc, antecedents, consequents limit 10")
def top_rules(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest rules."""
    return basket_rules(spark, d).orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequents").limit(10)


@query("""with k as (select resume_id, label, row_number() over (partition by coalesce(label, 'unknown') order by md5('42:' || resume_id), resume_id) rn from resumes) select resume_id, label from k where rn <= 4 order by md5('42-all:' || resume_id), resume_id limit 120""")
def gold_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most four resumes a label and 120 in all."""
    return vectors.stratified_sample(table(spark, d, "resumes").select("resume_id", "label"), "resume_id", "label")


@query()
def svc_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Words and character triples with scaled extra features, a linear classifier fitted on the training split, label and margin of all other resumes."""
    docs = base._labelled(spark, d).join(base._split(spark, d), "id")
    extra = base.structure_features(spark, d).select(F.col("resume_id").alias("id"), F.array(*(F.col(c).cast("double") for c in ("log_length", "n_words", "n_numbers"))).alias("extra"))
    return supervised.fit_and_predict(docs.join(extra, "id"), "id", "text", "label", "train", "extra")


@query(f"""with c as ({base.ORACLE['characteristic_terms']}), t as (select label, list(term order by rank_no) terms from c group by 1), w as (select distinct {base.SQL_LABEL.format('label')} label from resumes where label is not null),
n as (select label, array_to_string(list_transform(string_split(lower(replace(replace(label, '_', ' '), '-', ' ')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') nm from w)
select label, case when terms is not null then nm || ' role focused on ' || array_to_string(terms[1:5], ', ') || '.' else 'Role focused on ' || lower(nm) || '.' end description from n left join t using (label)""")
def profile_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Every label described by its characteristic terms."""
    want = table(spark, d, "resumes").where("label is not null").select(tx.label_key(F.col("label")).alias("label")).distinct()
    terms = vectors.term_lists(base.characteristic_terms(spark, d))
    return want.join(terms, "label", "left").select("label", tx.profile_description(F.col("label"), F.col("terms")).alias("description"))


@query("""with f as (select canonical, trim(form) form, i from (select canonical, unnest(list_concat([canonical], coalesce(aliases, []))) form, generate_subscripts(list_concat([canonical], coalesce(aliases, [])), 1) i from lexicon) where trim(form) <> ''),
one as (select canonical, min_by(form, i) form, min(i) i from f group by canonical, lower(form)) select canonical, list(form order by length(form) desc, i) forms from one group by 1""")
def ordered_forms(spark: SparkSession, d: str) -> DataFrame:
    """The surface forms of each lexicon entry, longest first."""
    return extract.ordered_forms(table(spark, d, "lexicon"))


# ---- outputs


@query(f"""with sp as ({SPANS_SQL.replace('with recursive', 'with recursive', 1)}), r as (select resume_id, coalesce({base.SQL_LABEL.format('label')}, 'unknown') category from resumes where resume_text is not null)
select resume_id, category, coalesce(list_sort(list(distinct canonical) filter (where canonical is not null)), []) skills from r left join sp on id = resume_id group by 1, 2""")
def gold_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Gold records with their spans written and read again."""
    at = base._place(spark, "gold")
    files.write_gold(skill_spans(spark, d), _gold_categories(spark, d), at)
    return files.read_gold(spark, at)


_REPORT = "'# Candidate Report: Resume ' || resume_id || chr(10) || chr(10) || 'Label: ' || label || chr(10) || 'Fit score: ' || fit_score"


@query(f"""with s as ({base._SCORES}), r as (select resume_id, label, matched, missing from s qualify row_number() over (partition by resume_id order by fit_score desc, label) = 1), x as ({base._EXPERIENCE}), own as (select resume_id, list_sort(list(distinct canonical)) own from {base._CANON} group by 1)
select resume_id, md5('# Candidate Report: Resume ' || resume_id || chr(10) || chr(10) || 'Label: ' || label || chr(10) || 'Fit score: 0.0' || chr(10) || 'Recommendation: n/a' || chr(10) || chr(10) || '## Extracted Skills' || chr(10) || coalesce(array_to_string(own, ', '), 'None detected') || chr(10) || chr(10)
|| '## Strengths' || chr(10) || case when len(matched) > 0 then array_to_string(matched[1:5], ', ') else 'None' end || chr(10) || chr(10) || '## Gaps' || chr(10) || case when len(missing) > 0 then array_to_string(missing[1:5], ', ') else 'None' end || chr(10) || chr(10) || '## Rationale' || chr(10) || 'n/a' || chr(10) || chr(10)
|| '## Experience Signals' || chr(10) || 'Years: ' || total_years || chr(10) || 'Leadership indicators: ' || leadership_indicators || chr(10) || 'Impact statements: ' || impact_statements) report_md5 from r join x using (resume_id) left join own using (resume_id)""")
def candidate_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report text per resume (without its score, which engines print differently)."""
    return files.candidate_report(report_rows(spark, d).withColumn("fit_score", F.lit(None).cast("double"))).select("resume_id", F.md5("report").alias("report_md5"))


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a report tells of each resume."""
    own = base.canonical_skills(spark, d).groupBy("resume_id").agg(F.sort_array(F.collect_set("canonical")).alias("skills"))
    rows = evaluations(spark, d).join(base.experience(spark, d), "resume_id").join(own, "resume_id", "left")
    none = F.lit(None).cast("string")
    return rows.select("resume_id", "label", "fit_score", none.alias("recommendation"), "skills", "strengths", "gaps", none.alias("rationale"), "total_years", "leadership_indicators", "impact_statements")


@query("""select resume_id, label, split from resumes""")
def serialised(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON objects, read again."""
    t = table(spark, d, "resumes").select("resume_id", "label", "split")
    return files.to_json(t).select(F.from_json("json", "resume_id long, label string, split string").alias("r")).select("r.*")
