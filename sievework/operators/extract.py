"""Extraction from document text: sections, phrases, lexicon matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# fixed values: section names and the words that open them
HEADERS = [
    ("education", r"(?i)^education\b[:\s-]*"), ("experience", r"(?i)^(experience|work experience|employment)\b[:\s-]*"), ("skills", r"(?i)^skills\b[:\s-]*"),
    ("projects", r"(?i)^projects?\b[:\s-]*"), ("certifications", r"(?i)^(certifications?|licenses?)\b[:\s-]*"),
]
HEADER_WORDS = "|".join(p if k == 0 else p.replace("(?i)", "") for k, (_, p) in enumerate(HEADERS))
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts a dimension table if its rows come to at most ``most`` bytes as JSON, counted where they are; a larger one is joined by shuffle."""
    size = df.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def section_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, line_no, section, line)``: each non-blank line under the last header above it, 'experience' before any."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), r"\r\n|\r|\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    head = None
    for name, pattern in HEADERS:
        hit = F.col("line").rlike(pattern)
        head = F.when(hit, name) if head is None else head.when(hit, name)
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines.withColumn("head", head).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("experience")))
    rest = F.when(F.col("head").isNotNull(), F.regexp_replace(F.regexp_replace("line", HEADER_WORDS, ""), r"^[ :\-]+|[ :\-]+$", "")).otherwise(F.col("line"))
    return out.select("id", "line_no", "section", rest.alias("line")).where("line <> ''")


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document with its lines by section."""
    lines = section_lines(docs, id_col, text_col)
    at = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("line_no", "line")))), lambda x: x["line"]).alias(name)
    return lines.groupBy("id").agg(*(at(name) for name, _ in HEADERS))


def rule_extract(docs: DataFrame, id_col: str, text_col: str, hints: str = tx.SKILL_HINTS) -> DataFrame:
    """``(id, raw_text, education, experience, skills_raw, projects, certifications, contact)`` of every non-blank text, by rules alone.

    Experience falls back on the whole text; skills are those of the skills section, else of all pieces of the text. A null or blank text gives no row.
    """
    text = F.trim(F.regexp_replace(F.col(text_col), r"\r\n|\r", "\n"))
    src = docs.select(F.col(id_col).alias("id"), text.alias("raw_text")).where("raw_text <> ''")
    rows = src.join(sections(src, "id", "raw_text"), "id", "left")
    none = F.array().cast("array<string>")
    full = lambda n: F.coalesce(n, none)
    of_section = tx.skill_hints(full("skills"), F.lit(""), hints)
    pieces = F.filter(F.transform(F.split("raw_text", r"[\n\u2022;|]"), lambda x: F.trim(x)), lambda x: x != "")
    anywhere = F.array_distinct(F.regexp_extract_all("raw_text", F.lit(hints), F.lit(1)))
    skills = F.when(F.size(of_section) > 0, of_section).when(F.size(anywhere) > 0, anywhere).otherwise(tx.skill_hints(pieces, F.col("raw_text"), hints))
    experience = F.when(F.size(full("experience")) > 0, F.col("experience")).otherwise(F.array("raw_text"))
    return rows.select("id", "raw_text", full("education").alias("education"), experience.alias("experience"), skills.alias("skills_raw"), full("projects").alias("projects"), full("certifications").alias("certifications"), tx.contacts(F.col("raw_text")).alias("contact"))


def merge_extractions(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Field by field the model's lists where they hold anything, else the rules'; contacts are always the rules'. Documents that the model lacks keep the rules' row."""
    fields = ["education", "experience", "skills_raw", "projects", "certifications"]
    other = model.select("id", *(F.col(f).alias(f"m_{f}") for f in fields))
    return rule.join(other, "id", "left").select("id", "raw_text", *(tx.prefer(F.col(f"m_{f}"), F.col(f)).alias(f) for f in fields), "contact")


def lexicon_forms(lexicon: DataFrame) -> DataFrame:
    """``(form, canonical, category)`` of every distinct surface form in lower case."""
    forms = lexicon.select("canonical", "category", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array()))).alias("form"))
    return forms.select(F.lower(F.trim("form")).alias("form"), "canonical", "category").where("form <> ''").distinct()


def ordered_forms(lexicon: DataFrame) -> DataFrame:
    """``(canonical, forms)``: the distinct surface forms of each entry, whatever their case, longest first, the first written one of a case kept."""
    forms = F.filter(F.transform(F.concat(F.array("canonical"), F.coalesce("aliases", F.array())), lambda f: F.trim(f)), lambda f: f != "")
    first = F.filter(forms, lambda f, i: F.array_position(F.transform(forms, F.lower), F.lower(f)) == i + 1)
    keyed = F.transform(first, lambda f, i: F.struct((-F.length(f)).alias("n"), i.alias("i"), f.alias("f")))
    return lexicon.select("canonical", F.transform(F.array_sort(keyed), lambda x: x["f"]).alias("forms"))


PIECE = r"[a-z0-9]+|[^a-z0-9\s]"


def _grams(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, i, n, canonical)`` of every run of ``n`` pieces of a text, from piece ``i`` on, that is a lexicon form.

    Word runs of each text are joined with the forms, so the cost is that of the text, not text times lexicon.
    """
    split = lambda c: F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    forms = lexicon_forms(lexicon).select(split(F.col("form")).alias("w"), "canonical").where("size(w) > 0")
    keyed = forms.select(F.array_join("w", " ").alias("gram"), F.col("w")[0].alias("head"), F.size("w").alias("n"), "canonical").distinct()
    longest = keyed.agg(F.max("n")).first()[0] or 1
    src = docs.select(F.col(id_col).alias("id"), split(F.lower(F.col(text_col))).alias("w")).where("size(w) > 0")
    heads = F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("head"), F.slice("w", i + 1, F.lit(longest)).alias("run")))
    rows = src.select("id", F.explode(heads).alias("h")).select("id", "h.*").join(small(keyed.select("head").distinct()), "head", "left_semi")
    runs = F.array(*(F.when(F.size("run") >= n, F.struct(F.lit(n).alias("n"), F.array_join(F.slice("run", 1, n), " ").alias("gram"))) for n in range(1, longest + 1)))
    grams = rows.select("id", "i", F.explode(runs).alias("g")).where("g is not null").select("id", "i", "g.n", "g.gram")
    return grams.join(small(keyed.select("gram", "canonical")), "gram").select("id", "i", "n", "canonical")


def lexicon_matches(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, canonical)`` of every lexicon entry that stands in a text as whole words."""
    return _grams(docs, id_col, text_col, lexicon).select("id", "canonical").distinct()


def skill_spans(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, canonical, surface, start_at, end_at)``: the first place of each entry in each text, as whole words, the longest form where several begin; positions count characters from 0.

    An entry that stands only inside a longer form of another entry is none.
    """
    found = _grams(docs, id_col, text_col, lexicon).groupBy("id").agg(F.collect_set(F.struct("i", F.col("n").alias("n"), "canonical")).alias("m"))
    low = F.lower(F.col(text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.regexp_extract_all(low, F.lit(PIECE), F.lit(0)).alias("w"), F.split(low, PIECE).alias("gaps"))
    long = lambda c, upto: F.aggregate(F.slice(c, F.lit(1), upto), F.lit(0), lambda s, x: s + F.length(x))
    start = lambda x: long("gaps", x["i"] + 1) + long("w", x["i"])
    end = lambda x: long("gaps", x["i"] + x["n"]) + long("w", x["i"] + x["n"])
    places = F.array_sort(F.transform("m", lambda x: F.struct(start(x).alias("start_at"), (-end(x)).alias("back"), x["canonical"].alias("canonical"))))
    at = src.where(F.col("text").isNotNull()).join(found, "id").select("id", "text", places.alias("at"))
    # from left to right, each match begins where the one before it has ended
    free = F.expr("""aggregate(at, named_struct('upto', 0, 'got', cast(array() as array<struct<start_at: int, end_at: int, canonical: string>>)),
        (s, x) -> if(x.start_at < s.upto, s, named_struct('upto', -x.back, 'got',
            if(exists(s.got, g -> g.canonical = x.canonical), s.got, concat(s.got, array(named_struct('start_at', x.start_at, 'end_at', -x.back, 'canonical', x.canonical)))))),
        s -> s.got)""")
    out = at.select("id", "text", F.explode(free).alias("s"))
    return out.select("id", "s.canonical", F.substring("text", F.col("s.start_at") + 1, F.col("s.end_at") - F.col("s.start_at")).alias("surface"), "s.start_at", "s.end_at")


def canonical_skills(matches: DataFrame, lexicon: DataFrame, least: float = 0.4) -> DataFrame:
    """``(resume_id, canonical, category, confidence)``: matches that name a lexicon entry with enough confidence, once each."""
    names = lexicon.select(tx.phrase_key(F.col("canonical")).alias("key"), "canonical", "category")
    m = matches.where(F.col("confidence") >= least).select("resume_id", tx.phrase_key(F.col("canonical_skill")).alias("key"), "confidence")
    return m.join(small(names), "key").groupBy("resume_id", "canonical", "category").agg(F.max("confidence").alias("confidence"))
