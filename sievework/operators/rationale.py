"""Audit of written rationales: what they rest on, how specific they are, and a summary over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import fit_band

SPECIFIC = 15  # fixed value: words from which a rationale counts as specific
# fixed values: words of a recommendation by tone, and words that name an attribute of a person
TONES = {
    "reject": ["do not advance", "do not proceed", "not advance", "not suitable", "not a fit", "not a match", "not recommended", "lacks", "insufficient", "weak match", "weak fit", "decline", "reject", "pass on", "not the right fit"],
    "advance": ["advance", "recommend", "strong fit", "strong match", "great fit", "great match", "excellent fit", "excellent match", "proceed", "move forward", "hire", "good fit", "strong candidate", "well suited", "well-suited"],
    "consider": ["consider", "reservation", "borderline", "marginal", "may be", "could be", "possibly", "moderate fit", "moderate match", "potentially", "worth a closer look", "additional review"],
}
IDENTITY = [
    "she", "her", "hers", "herself", "he", "him", "his", "himself", "mr", "mrs", "ms", "miss", "sir", "madam", "gentleman", "lady", "woman", "women", "man", "men", "female", "male",
    "young", "old", "elderly", "youthful", "ageing", "aging", "married", "unmarried", "single", "divorced", "widowed", "spouse", "husband", "wife", "christian", "muslim", "jewish", "hindu",
    "buddhist", "sikh", "atheist", "caucasian", "asian", "african-american", "african american", "hispanic", "latino", "latina", "disabled", "handicapped", "blind", "deaf",
]


def mentioned(text: Column, phrases: Column) -> Column:
    """The distinct phrases, trimmed and in lower case, that stand in the text between other characters than ASCII letters and digits, in order."""
    asked = F.array_distinct(F.filter(F.transform(phrases, lambda p: F.lower(F.trim(p))), lambda p: p != ""))
    low = F.lower(text)
    literal = lambda p: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.regexp_replace(p, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E(?![A-Za-z0-9])"))
    return F.filter(asked, lambda p: F.contains(low, p) & F.rlike(low, literal(p)))


def identity_hits(text: Column) -> Column:
    """The first mention of each identity word, as written, in the order of the list."""
    hits = F.array(*(F.regexp_extract(text, rf"(?i)\b({w})\b", 1) for w in IDENTITY))
    return F.filter(hits, lambda h: h != "")


def tone(text: Column) -> Column:
    """The first tone, of reject, advance and consider, of which a word stands in the text; null if none."""
    low, out = F.lower(F.trim(text)), None
    for name, words in TONES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def grounded(items: Column, reference: Column) -> tuple[Column, Column]:
    """``(share, invented)``: how many of the items equal, hold or stand in one of the reference names, and those that don't; no items are wholly grounded, blank ones count in the share's base only."""
    low = F.transform(reference, F.lower)
    clean = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    rests = lambda x: F.exists(low, lambda r: F.contains(r, clean(x)) | F.contains(clean(x), r))
    yes = F.filter(items, lambda x: (clean(x) != "") & rests(x))
    no = F.filter(items, lambda x: (clean(x) != "") & ~rests(x))
    return F.when(F.size(items) == 0, 1.0).otherwise(F.size(yes) / F.greatest(F.size(items), F.lit(1))), no


def audit(records: DataFrame) -> DataFrame:
    """One audit row per record ``(resume_id, fit_score, rationale, recommendation, matched_skills, missing_skills, strengths, gaps)``.

    Null texts are empty, null lists empty and a null score 0. Grounding looks at rationale and recommendation, the word count at the rationale alone.
    """
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    names = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>"))
    r = records.select("resume_id", F.coalesce("fit_score", F.lit(0.0)).alias("fit_score"), text("rationale").alias("rationale"), text("recommendation").alias("recommendation"), *(names(n).alias(n) for n in ("matched_skills", "missing_skills", "strengths", "gaps")))
    whole = F.concat("rationale", F.lit("\n"), "recommendation")
    strong, strong_no = grounded(F.col("strengths"), F.col("matched_skills"))
    weak, weak_no = grounded(F.col("gaps"), F.col("missing_skills"))
    r = r.select(
        "resume_id", "fit_score", fit_band(F.col("fit_score")).alias("fit_band"), tone(F.col("recommendation")).alias("recommendation_tone"),
        mentioned(whole, F.col("matched_skills")).alias("matched_skill_hits"), mentioned(whole, F.col("missing_skills")).alias("missing_skill_hits"),
        F.size(F.regexp_extract_all("rationale", F.lit(r"\S+"), F.lit(0))).alias("word_count"), identity_hits(whole).alias("identity_terms"),
        strong.alias("strengths_grounded_ratio"), weak.alias("gaps_grounded_ratio"), strong_no.alias("strengths_invented"), weak_no.alias("gaps_invented"),
    )
    return r.select(
        "*", (F.size("matched_skill_hits") > 0).alias("grounded_in_matched"), (F.size("missing_skill_hits") > 0).alias("grounded_in_missing"), (F.col("word_count") >= SPECIFIC).alias("is_specific"),
        F.coalesce(F.col("recommendation_tone") == F.col("fit_band"), F.lit(False)).alias("calibrated"), (F.size("identity_terms") == 0).alias("identity_clean"),
    )


def report(audits: DataFrame) -> DataFrame:
    """One row over all audits: shares, mean words, mean grounding and the counts of tones and bands; zeros for no audits."""
    share = lambda c: F.coalesce(F.round(F.avg(c.cast("double")), 4), F.lit(0.0))
    both = F.col("grounded_in_matched") & F.col("grounded_in_missing")
    count = lambda c: F.count(F.when(c, 1))
    return audits.agg(
        F.count("*").alias("n"), share(F.col("grounded_in_matched")).alias("grounded_in_matched_pct"), share(F.col("grounded_in_missing")).alias("grounded_in_missing_pct"), share(both).alias("grounded_in_both_pct"),
        share(F.col("is_specific")).alias("specific_pct"), share(F.col("calibrated")).alias("calibrated_pct"), share(F.col("identity_clean")).alias("identity_clean_pct"),
        F.coalesce(F.round(F.avg("word_count"), 2), F.lit(0.0)).alias("avg_word_count"), share(F.col("strengths_grounded_ratio")).alias("strengths_grounded_pct"), share(F.col("gaps_grounded_ratio")).alias("gaps_grounded_pct"),
        *(count(F.col("recommendation_tone") == t).alias(f"tone_{t}") for t in ("advance", "consider", "reject")), count(F.col("recommendation_tone").isNull()).alias("tone_unclassified"),
        *(count(F.col("fit_band") == t).alias(f"band_{t}") for t in ("advance", "consider", "reject")),
    )
