"""Column functions over text; all run inside the JVM except compatibility normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: patterns and word lists that results depend on
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
LINKEDIN = r"(?i)\b(?:https?://)?(?:www\.)?linkedin\.com/\S+\b"
GITHUB = r"(?i)\b(?:https?://)?(?:www\.)?github\.com/\S+\b"
URL = r"(?i)\b(?:https?://|www\.)\S+\b"
YEARS = r"(?i)(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?)"
LEADERSHIP = r"(?i)\b(led|managed|mentored|supervised|headed|owned|coordinated|directed)\b"
IMPACT = r"(?i)\b(improved|increased|decreased|reduced|delivered|built|created|launched|optimized|saved)\b"
QUANTITY = r"\b\d+(?:\.\d+)?%?\b"
ROLE = r"(?i)\b(engineer|developer|analyst|specialist|manager|lead|coordinator|scientist|recruiter|consultant|administrator)\b"
PRONOUNS = [
    (r"\bhe\b", "she"), (r"\bshe\b", "he"), (r"\bhim\b", "her"), (r"\bher\b", "him"), (r"\bhis\b", "her"), (r"\bhers\b", "his"),
    (r"\bhimself\b", "herself"), (r"\bherself\b", "himself"), (r"\bHe\b", "She"), (r"\bShe\b", "He"), (r"\bHim\b", "Her"), (r"\bHer\b", "Him"),
    (r"\bHis\b", "Her"), (r"\bHers\b", "His"), (r"\bHimself\b", "Herself"), (r"\bHerself\b", "Himself"),
]
NAME_SWAPS = [
    ("John Doe", "Aisha Khan"), ("Jane Smith", "Miguel Santos"), ("Alex Johnson", "Priya Patel"), ("Maria Garcia", "Darnell Brooks"), ("Kevin Brown", "Wei Chen"),
    ("Ravi Patel", "Elena Petrova"), ("Emily Davis", "Omar Ali"), ("Samuel Lee", "Fatima Rahman"), ("Linda Nguyen", "Noah Williams"), ("Anika Sharma", "Grace Miller"),
]
FULL_NAME = r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)+$"
CONTACT = r"(?i)\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b|\b\S+@\S+\b|https?://\S+|www\.\S+"
SKILL_HINTS = (
    r"(?i)\b(python|sql|pytorch|tensorflow|scikit-learn|sklearn|tableau|docker|kubernetes|react|javascript|java|flask|nlp|machine learning|data science|hr|recruiting|onboarding"
    r"|communication|leadership|excel|aws|azure|gcp|powerbi|power bi|tableau|figma|photoshop|autocad)\b"
)
WORD = r"[\p{L}\p{N}_]{2,}"


def stop_words() -> list[str]:
    """The English stop words that Spark ships, read from its library file, so that no session is needed."""
    import glob
    import os
    import zipfile

    import pyspark

    found = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not found:
        return ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with"]
    with zipfile.ZipFile(found[0]) as z:
        words = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8").split("\n")
    return sorted({w.strip() for w in words if w.strip()})


STOP = stop_words()


def mask_pii(c: Column) -> Column:
    """E-mail, phone, profile and web addresses become masks, in that fixed order."""
    for pattern, mask in ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (LINKEDIN, "[LINKEDIN]"), (GITHUB, "[GITHUB]"), (URL, "[URL]")):
        c = F.regexp_replace(c, pattern, mask)
    return c


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation; ASCII texts pass as they are."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def phrase_key(c: Column) -> Column:
    """Lower case, slashes as blanks, blanks collapsed."""
    return squeeze(F.lower(F.translate(c, "/", " ")))


def label_key(c: Column) -> Column:
    """Trimmed, upper case, underscores as hyphens."""
    return F.translate(F.upper(F.trim(c)), "_", "-")


def strip_edges(c: Column) -> Column:
    """Without blanks, hyphens, colons and tabs at the ends."""
    return F.regexp_replace(c, r"^[ \-:\t]+|[ \-:\t]+$", "")


def chunks(c: Column, pattern: str = r"[,;/|]") -> Column:
    """Distinct non-empty stripped parts of an array of lines, in order."""
    parts = F.flatten(F.transform(c, lambda x: F.split(x, pattern)))
    return F.array_distinct(F.filter(F.transform(parts, strip_edges), lambda x: x != ""))


def skill_hints(lines: Column, text: Column, pattern: str = SKILL_HINTS) -> Column:
    """All parts of the lines that hold a hint; where no line does, the hints themselves that stand in the text."""
    of_lines = chunks(F.filter(lines, lambda x: x.rlike(pattern)))
    return F.when(F.size(of_lines) > 0, of_lines).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def contacts(c: Column) -> Column:
    """Every phone number, e-mail and web address in order, repeats included."""
    return F.regexp_extract_all(c, F.lit(CONTACT), F.lit(0))


def gathered_phrases(*fields: Column) -> Column:
    """Candidate phrases of the first array; where it has none, those of all the others together."""
    first, rest = phrases(fields[0]), phrases(F.concat(*(F.coalesce(f, F.array().cast("array<string>")) for f in fields[1:])))
    return F.when(F.size(first) > 0, first).otherwise(rest)


def prefer(full: Column, otherwise: Column) -> Column:
    """An array without its blank elements, or another one where nothing is left of it."""
    live = F.filter(full, lambda x: F.trim(x) != "")
    return F.when(F.size(live) > 0, live).otherwise(otherwise)


def prompt(template: str, *parts: Column) -> Column:
    """A prompt template with its ``%s`` places filled."""
    return F.format_string(template, *parts)


def merged_experience(rule: Column, model: Column) -> Column:
    """The larger of both for each number, years within 0 and 60, at most three pieces of evidence, the model's if it has any."""
    larger = lambda n: F.greatest(rule[n], F.coalesce(model[n], rule[n])).alias(n)
    years = F.least(F.greatest(rule["total_years"], F.coalesce(model["total_years"], F.lit(0.0)), F.lit(0.0)), F.lit(60.0))
    return F.struct(years.alias("total_years"), *(larger(n) for n in ("role_count", "leadership_indicators", "impact_statements", "quantified_impact")), F.slice(prefer(model["evidence"], rule["evidence"]), 1, 3).alias("evidence"))


def phrases(c: Column) -> Column:
    """Distinct lower-case candidate phrases of an array of items, in order."""
    parts = F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.split(x, r"[,;/|\n]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(strip_edges(x))), lambda x: x != ""))


def sentences(c: Column) -> Column:
    """Trimmed non-empty sentences, ended by a mark and white space or by line ends."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def years_of(c: Column) -> Column:
    """The largest number of years named, 0 if none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(YEARS), F.lit(1)), lambda x: x.cast("double"))), F.lit(0.0))


def experience_struct(c: Column) -> Column:
    """Years, and how many sentences tell of roles, leadership, impact and quantified impact."""
    s = sentences(c)
    many = lambda *p: F.size(F.filter(s, lambda x: _all(x, p)))
    return F.struct(
        years_of(c).alias("total_years"), many(ROLE).alias("role_count"), many(LEADERSHIP).alias("leadership_indicators"), many(IMPACT).alias("impact_statements"),
        many(IMPACT, QUANTITY).alias("quantified_impact"), F.slice(F.filter(s, lambda x: x.rlike(IMPACT)), 1, 3).alias("evidence"),
    )


def _all(x: Column, patterns: tuple[str, ...]) -> Column:
    out = x.rlike(patterns[0])
    for p in patterns[1:]:
        out = out & x.rlike(p)
    return out


def swap_pronouns(c: Column) -> Column:
    """Sixteen replacements one after the other, so a later one may undo an earlier one."""
    for pattern, other in PRONOUNS:
        c = F.regexp_replace(c, pattern, other)
    return c


def swap_name(c: Column, swaps: list[tuple[str, str]] = NAME_SWAPS, start: int = 0) -> Column:
    """The first listed name present, from ``start`` on and around, is replaced once; without any, a first line in the shape of a full name."""
    out = None
    for old, new in swaps[start:] + swaps[:start]:
        here = F.contains(c, F.lit(old))
        swapped = F.overlay(c, F.lit(new), F.locate(old, c), F.lit(len(old)))
        out = F.when(here, swapped) if out is None else out.when(here, swapped)
    first = F.split(c, r"\r\n|\r|\n")[0]
    of_line = F.when(F.trim(first).rlike(FULL_NAME), F.concat(F.lit(swaps[start][1]), F.substring(c, F.length(first) + 1, F.length(c)))).otherwise(c) if swaps else c
    return of_line if out is None else out.otherwise(of_line)


def identity_cue(c: Column, cue: str = "from an underrepresented background") -> Column:
    """A line with the cue after the first line, unless that is blank or the cue is there already."""
    lines = F.split(c, r"\r\n|\r|\n")
    with_cue = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.lit(f"Identity cue: {cue}.")), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n")
    return F.when((F.trim(lines[0]) == "") | F.contains(c, F.lit(cue)), c).otherwise(with_cue)


def tokens(c: Column, stop: list[str] = ()) -> Column:
    """Lower-case words of two or more letters, digits or underscores of any script, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(list(stop))) if stop else words


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by blanks; give it a plain column, which every run reads."""
    def runs_of(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", *(F.get(words, i + (k - 1)) for k in range(n))))

    return F.concat(words, *(runs_of(n) for n in range(2, longest + 1)))


def char_grams(c: Column, n: int = 3) -> Column:
    """All runs of ``n`` of an array of characters; give it a plain column, which every run reads."""
    at = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(*(F.get(c, i + (k - 1)) for k in range(n))))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def json_block(c: Column) -> Column:
    """The outermost object, else the outermost array, else the text itself, without code fences."""
    bare = F.trim(F.regexp_replace(c, r"```(?:json)?", ""))
    obj, arr = F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.when(obj != "", obj).when(arr != "", arr).otherwise(bare)


def embedding_text(canonical: Column, category: Column, description: Column, aliases: Column) -> Column:
    """The non-empty parts of a lexicon entry joined by blanks."""
    full = lambda x: F.when(x != "", x)
    return F.concat_ws(" ", full(canonical), full(category), full(description), F.concat_ws(" ", aliases))


def sorted_scores(scores: Column) -> Column:
    """A score map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(scores))))


def profile_description(label: Column, terms: Column) -> Column:
    """A sentence on a label in title case, with its five most characteristic terms if it has any."""
    name = F.initcap(F.lower(F.translate(label, "_-", "  ")))
    five = F.array_join(F.slice(terms, 1, 5), ", ")
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.concat(name, F.lit(" role focused on "), five, F.lit("."))).otherwise(F.concat(F.lit("Role focused on "), F.lower(name), F.lit(".")))
