"""Personal information inside free text: detection by what terms disclose, and typed placeholders.

Patterns and word shapes only propose places; the corpus decides. The protected entities are the persons, known by the listed
names and by the values around them; a term discloses them as far as its pointwise mutual information
``PMI(entity; term) = log2(p(entity | term) / p(entity))`` reaches the information content ``IC = -log2 p(entity)``
of the entity itself.

*Names.* A place of a name is two neighbouring words of the same case (or family name, comma, given name). For the word in the
given place, ``p`` is the share of its distinct contexts (it and ``AROUND`` words on each side; copies add none)
before a listed family name, for each way of writing it apart, as 'May' and 'may' are different terms. For the word in the
family place it is the mean of ``p`` of the given names before it, without the one it stands behind here,
which would count twice; a title before a listed given name counts in full. A listed name has ``PRIOR`` as its prior share, any other word the
base share. The place is a name, and is removed, if both terms together disclose ``DISCLOSED`` of the information
content, and the given name ``GIVEN`` of it. So a listed word that the corpus uses otherwise is no name, and
an unlisted one that stands where names stand is. A name with a legal form behind it is an organisation's.

*Numbers, addresses and mail.* Their form (letters and digits replaced by classes) is the term: ``p`` is the share of distinct values of
that form that stand within ``NEAR`` characters of another protected value, against the chance of any place to do so. A form
that stands near protected values no more often than chance discloses nothing and is left.

All counts cover all texts and are made distinct per batch before they are shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import spread

AROUND, NEAR = 5, 60
WEIGHT, PRIOR, PRIOR_LOWER = 3.0, 0.8, 0.5  # contexts that the prior counts for, and the prior share of listed names (in lower case, where most words stand, the second) and known forms
DISCLOSED, GIVEN, BASE_MOST = 0.75, 1 / 3, 0.125
MOST_SENT = 500_000  # words up to which a table is sent to all tasks; beyond, it is joined by shuffle

# fixed values: patterns of the kinds of personal data, street words of several languages, organisation forms
LOCAL_BEFORE = re.compile(r"[^\W_][\w.+%'’-]*$")
HOST = r"[^\W_][\w-]*(?:\.[^\W_][\w-]*)*\.[^\W\d_]{2,}"
DOT = r"(?:\.|[ \t]*[\[({<][ \t]*(?:dot|DOT|Dot)[ \t]*[\])}>][ \t]*)"
AT_SIGN = re.compile(rf"[@＠]{HOST}|[ \t]+@[ \t]+{HOST}")
AT_CLOSED = re.compile(rf"[ \t]*[\[({{<][ \t]*(?:at|AT|At|@)[ \t]*[\])}}>][ \t]*[^\W_][\w-]*(?:{DOT}[^\W_][\w-]*)+")
AT_SAID = re.compile(r"[ \t](?:at|AT|At)[ \t]+[^\W_][\w-]*(?:[ \t]+(?:dot|DOT|Dot)[ \t]+[^\W_][\w-]*)+")
MOST_LOCAL = 320
WEB = re.compile(r"(?:https?://|www\.)\S+|(?<![\w.])[@＠][\w.]+|\[[A-Z_ ]+\]")
D = r"[-–‑‐—.\u00a0 \t]"
ID_BARE = re.compile(r"(?=[A-Z0-9])(?<![\w.-])(?:\d{3}-\d{2}-\d{4}(?![\w-])|\d{2}\.\d{3}\.\d{3}-[A-Z](?!\w)|(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D](?!\w))")
ID_WORDS = ("ssn", "social security", "passport", "licence", "license", "national", "identity", "tax ")
ID_NUMBER = re.compile(
    rf"(?i:\b(?:ssn|social[ ]security(?:[ ](?:no\.?|number|nr\.?|\#))?)[ \t:#.]*)(?P<ssn>\d{{3}}{D}?\d{{2}}{D}?\d{{4}})(?!\d)"
    rf"|(?i:\bpassport(?:[ ](?:no\.?|number|nr\.?|\#))?)[ \t:#.]*(?P<passport>[A-Z]{{0,2}}[ ]?\d{{3}}[ ]?\d{{3}}[ ]?\d{{2,3}})(?!\d)"
    rf"|(?i:\b(?:driver|driving)(?:['’]?s)?[ ]licen[cs]e(?:[ ](?:no\.?|number|nr\.?))?)[ \t:#.]*(?P<driver>(?=[A-Z0-9-]*\d)[A-Z0-9]+(?:[- ]?\d{{2,}})+)"
    rf"|(?i:\b(?:national|identity|tax)[ ](?:id|identity|insurance|card)?[ ]?(?:card|no\.?|number|nr\.?|\#)?)[ \t:#.]*(?P<national>\d{{1,3}}(?:[. ]?\d{{3}}){{2,3}}(?:-?[A-Z])?)(?!\d)"
)
PHONE = re.compile(
    rf"(?=[+(0-9])(?<![\w.+-])(?<!\d/)(?:"
    rf"\+\d{{1,3}}(?:{D}?\(\d{{1,4}}\))?(?:{D}?\d{{1,5}}){{2,6}}"
    rf"|(?:1{D})?\(\d{{3}}\){D}?\d{{3}}{D}\d{{4}}"
    rf"|(?:1{D})?\d{{3}}{D}\d{{3}}{D}\d{{4}}"
    rf"|0\d{{1,4}}[ ]?/[ ]?\d{{3,8}}(?:[ -]\d{{1,5}})*"
    rf"|0\d{{4}}[ ]\d{{6}}|0\d{{3}}[ ]\d{{3}}[ ]\d{{4}}|0\d{{2}}[ ]\d{{4}}[ ]\d{{4}}|0\d(?:[ .]\d{{2}}){{4}}"
    rf"|[2-9]\d{{9}})(?![\w/]|[-.]\d)"
)
STREET_WORD = r"(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Close|Crescent|Square|Row|Highway|Parkway|Trail)"
CAP = r"(?:[A-ZÀ-ÖØ-Þ][\w'’-]*|[NSEW]\.)"
SIDE = r"(?:(?:North|South|East|West|NORTH|SOUTH|EAST|WEST|[NSEW]\.)[ \t]+)?"
STREET = re.compile(
    rf"(?=\d)(?<![\w.,/-])\d{{1,5}}[A-Z]?[ \t]+{SIDE}(?:{CAP}[ \t]+){{1,3}}?(?:{STREET_WORD}|{STREET_WORD.upper()})\b\.?"
    rf"|(?=\d)(?<![\w.,/-])\d{{1,4}}(?:[ \t]*(?:bis|ter|quater|BIS|TER))?,?[ \t]+(?i:rue|avenue|impasse|boulevard|chemin|allée|place|quai|cours|passage|route)[ \t]+(?i:de[ \t]+la|de[ \t]+l['’]|du|des|de|d['’])[ \t]*[A-ZÀ-ÖØ-Þ][\w'’-]*(?:[ \t]+[A-ZÀ-ÖØ-Þ][\w'’-]*){{0,3}}"
)
STREET_END = re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|STRASSE|STRAßE|STR\.|GASSE|WEG|PLATZ|ALLEE)[ \t]+\d{1,4}[a-zA-Z]?(?!\w)")
STREET_BEFORE = re.compile(r"(?<!\w)[A-ZÄÖÜ][\w-]*$")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
GAP = re.compile(r"[ \t\u00a0]+")
COMMA = re.compile(r",[ \t\u00a0]+")
PARTICLES = {"van", "von", "de", "der", "den", "da", "di", "du", "la", "le", "del", "al", "el", "bin", "ten", "ter"}
TITLES = {"mr", "mrs", "ms", "dr", "prof"}
FIRMS = {"ltd", "limited", "inc", "llc", "plc", "corp", "company", "co", "gmbh", "ag", "sarl", "group", "holdings", "foundation"}  # what follows the name of an organisation


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """``(pii_type, start, end)`` of what has a form of its own, without overlaps; web addresses, handles and masks as 'web'."""
    out: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def take(kind: str, a: int, b: int) -> None:
        if b > a and not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            out.append((kind, a, b))

    low = text.lower()
    signs = "@" in text or "＠" in text
    for there, how in ((signs, AT_SIGN), ("at)" in low or "at]" in low or "at>" in low or "at}" in low or "(@" in low or "[@" in low, AT_CLOSED), (" dot " in low, AT_SAID)):
        if there:
            for m in how.finditer(text):
                local = LOCAL_BEFORE.search(text, max(0, m.start() - MOST_LOCAL), m.start())
                if local:
                    take("email", local.start(), m.end())
    if signs or "[" in text or "http" in low or "www." in low:
        for m in WEB.finditer(text):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\x02" * (m.end() - m.start())
                out.append(("web", *m.span()))
    if DIGITS.search(text):
        if any(w in low for w in ID_WORDS):
            for m in ID_NUMBER.finditer(text):
                take("id_number", *m.span(m.lastgroup))
        for m in ID_BARE.finditer(text):
            take("id_number", *m.span())
        for m in STREET.finditer(text):
            take("street_address", *m.span())
        for m in STREET_END.finditer(text):
            name = STREET_BEFORE.search(text, max(0, m.start() - MOST_LOCAL), m.start())
            if name:
                take("street_address", name.start(), m.end())
        for m in PHONE.finditer(text):
            take("phone", *m.span())
    return out


DIGITS, LETTERS = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")


def form_of(kind: str, value: str) -> str:
    """The kind and the value with letters and digits as classes."""
    return f"{kind}:{LETTERS.sub('a', DIGITS.sub('9', value))[:40]}"


def near_others(spans: list[tuple[str, int, int]], length: int) -> tuple[list[bool], int]:
    """Whether each span (in order of place) lies within ``NEAR`` characters of another, and how many characters lie that near to any."""
    near, covered, end = [], 0, 0
    for k, (_, a, b) in enumerate(spans):
        near.append(k > 0 and a - spans[k - 1][2] <= NEAR or k + 1 < len(spans) and spans[k + 1][1] - b <= NEAR)
        lo, hi = max(a - NEAR, end), min(b + NEAR, length)
        covered += max(hi - lo, 0)
        end = max(end, hi)
    return near, covered


@lru_cache(4096)
def _gap(g: str) -> int:
    return 1 if GAP.fullmatch(g) else 2 if COMMA.fullmatch(g) else 3 if g[0] == "." and not g[1:].strip(" \t\u00a0") else 0


class Words:
    """The words of one text outside patterns, web addresses and masks, with what is known of them."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]], known: Known) -> None:
        if spans:
            parts, at = [], 0
            for _, a, b in spans:  # in order and without overlaps
                parts += [text[at:a], "0" * (b - a)]
                at = b
            text = "".join(parts) + text[at:]
        self.text = text
        found = list(WORD.finditer(text))
        self.at = [m.span() for m in found]
        self.info = [known[m.group()] for m in found]
        self.n = len(found)
        # words that a listed family name follows within four
        self.ahead = bytearray(self.n)
        for k, i in enumerate(self.info):
            if i[3]:
                self.ahead[max(0, k - 4) : k] = b"\x01" * min(4, k)

    def gap(self, k: int) -> int:
        """Between word ``k`` and the next: 1 blanks, 2 a comma and blanks, 3 a full stop with or without blanks, 0 anything else or nothing."""
        if k < 0 or k + 1 >= self.n:
            return 0
        g = self.text[self.at[k][1] : self.at[k + 1][0]]
        return 1 if g == " " else _gap(g)

    def key(self, k: int) -> str:
        """The word as a term of the given place: capitalised, in lower case behind a word, or in lower case where something begins."""
        low, cap, _, _ = self.info[k]
        return low if cap else ("~" if self.gap(k - 1) == 1 else "^") + low

    def context(self, k: int) -> int:
        """A hash of the word and its neighbours."""
        lo = k - AROUND
        around = [""] * max(0, -lo) + [i[0] for i in self.info[max(0, lo) : k + AROUND + 1]]
        around += [""] * (2 * AROUND + 1 - len(around))
        return xxhash.xxh64_intdigest("\x1f".join(around).encode("utf-8", "surrogatepass")) - (1 << 63)


class Known(dict):
    """``(lower case, capitalised, listed given name, listed family name)`` of words, kept per task."""

    def __init__(self, given: frozenset[str], family: frozenset[str]) -> None:
        self.given, self.family = given, family

    def __missing__(self, w: str) -> tuple[str, bool, bool, bool]:
        if len(self) > 500_000:
            self.clear()
        low = w.lower().replace("’", "'")
        parts = low.split("-") if "-" in low else ()
        has = lambda names: low in names or any(p in names for p in parts)
        got = self[w] = (low, w[0].isupper(), has(self.given), has(self.family))
        return got


def titled_family(ws: Words, k: int) -> int:
    """Where the family name of a listed given name at ``k`` stands if a title or 'Name:' comes before it, else 0."""
    if not k or not ws.info[k][1]:
        return 0
    before, gap = ws.info[k - 1][0], ws.gap(k - 1)
    if not (before in TITLES and gap in (1, 3) or before == "name" and not gap):
        return 0
    for at in range(k + 1, min(k + 5, ws.n)):
        low, cap, giv, _ = ws.info[at]
        g = ws.gap(at - 1)
        if not (g == 1 or g == 3 and len(ws.info[at - 1][0]) == 1) or not cap:
            return 0
        if len(low) > 2 and not giv:  # initials and further given names may stand between
            return 0 if low in PARTICLES else at
    return 0


def places(ws: Words) -> Iterator[tuple[str, int, int]]:
    """``(kind, given word, family word)`` places of the neighbouring words that may be a name: 'pair', or 'titled' behind a title."""
    info, ahead = ws.info, ws.ahead
    for k in range(ws.n - 1):
        _, cap, giv, fam = info[k]
        if not (cap or giv or fam or ahead[k]):
            continue
        if giv and (at := titled_family(ws, k)):
            yield "titled", k, at
        gap = ws.gap(k)
        if gap in (1, 3):
            a, b = k, k + 1
            if gap == 3 or len(info[b][0]) == 1:  # an initial may stand between
                if gap == 3 or ws.gap(b) not in (1, 3):
                    continue
                b += 1
        elif gap == 2 and not (ws.gap(k - 1) in (1, 3) and (info[k - 1][2] or len(info[k - 1][0]) == 1)):
            a, b = k + 1, k
        else:
            continue
        if info[a][1] != info[b][1] or not info[a][1] and not (info[a][2] or info[b][3] and gap != 2):
            continue
        yield "pair", a, b


def name_candidates(ws: Words, family: frozenset[str]) -> Iterator[tuple[int, int, int, int, str]]:
    """``(first word, last word, given word, family word, family name)`` of every place in the shape of a full name."""
    info, ahead = ws.info, ws.ahead
    for k in range(ws.n - 1):
        low, cap, giv, fam = info[k]
        listed_ahead, opened = ahead[k], False
        if not cap:  # in lower case, where something begins
            opened = not info[k + 1][1] and len(low) > 2 and not ws.gap(k - 1)
            if not (giv or fam or listed_ahead or opened):
                continue
        if len(low) < 2:
            continue
        gap = ws.gap(k)
        if gap == 2:
            first, begin = low, k
            if ws.gap(k - 1) == 1 and info[k - 1][0] in PARTICLES:
                first = f"{info[k - 1][0]} {low}"
                if first in family or ws.gap(k - 2) != 1:
                    begin = k - 1
            nxt = info[k + 1]
            if (fam or first in family or nxt[2] or cap and nxt[1]) and (cap or not nxt[1]) and len(low) > 2 and len(nxt[0]) > 1:
                yield begin, k + 1, k + 1, k, first if first in family else low
            continue
        if gap != 1 or low in PARTICLES or not (cap or giv or listed_ahead or opened):
            continue
        at, middles = k + 1, 0
        while at <= k + 4 and at < ws.n:  # given, an initial or middle name, particles, family
            w = info[at]
            joined = w[1] or not cap
            if len(w[0]) > 2 and w[0] not in PARTICLES and joined and (cap or not w[1]):
                two = f"{info[at - 1][0]} {w[0]}"
                whole = info[at - 1][0] in PARTICLES and two in family
                if ws.gap(at) == 1 and info[at + 1][0] in FIRMS:
                    break
                if giv or w[3] or whole or cap or opened and at == k + 1:
                    yield k, at, k, at, two if whole else w[0]
            if len(w[0]) > 1 and w[0] not in PARTICLES:
                middles += 1
                if middles > 1 or not joined:
                    break
            g = ws.gap(at)
            if not (g == 1 or g == 3 and len(w[0]) == 1):
                break
            at += 1


COLUMNS = ["source_table", "record_id", "pii_type", "start_at", "end_at", "term", "other", "listed", "listed_other", "seen"]
SCHEMA = "source_table string, record_id bigint, pii_type string, start_at bigint, end_at bigint, term string, other string, listed boolean, listed_other boolean, seen array<bigint>"
KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]


def _propose(given: frozenset[str], family: frozenset[str]):
    """One pass over the texts: proposed places, and each batch's counts as rows whose type begins with ~."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(given, family)
        for b in batches:
            rows: list[tuple] = []
            seen: dict[tuple, set[int]] = {}
            covered = total = 0
            for s, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = sorted(pattern_spans(t), key=lambda x: x[1])
                near, part = near_others(spans, len(t))
                covered += part
                total += len(t)
                for (kind, a, e), close in zip(spans, near, strict=True):
                    if kind != "web":
                        form = form_of(kind, t[a:e])
                        rows.append((s, i, kind, a, e, form, None, None, None, None))
                        value = xxhash.xxh64_intdigest(t[a:e].encode("utf-8", "surrogatepass")) - (1 << 63)
                        seen.setdefault(("~near" if close else "~far", form, None, True), set()).add(value)
                ws = Words(t, spans, known)
                for kind, g, f in places(ws):
                    key, fam = ws.key(g), ws.info[f][0]
                    at_g, at_f = ws.context(g), ws.context(f)
                    seen.setdefault(("~given", key, None, ws.info[g][2]), set()).add(at_g)
                    seen.setdefault(("~family", fam, None, ws.info[f][3]), set()).add(at_f)
                    if kind == "titled":
                        seen.setdefault(("~titled", fam, None, ws.info[f][3]), set()).add(at_f)
                    if kind == "titled" or ws.info[f][3]:
                        seen.setdefault(("~before", key, None, ws.info[g][2]), set()).add(at_g)
                    if kind == "pair" and ws.info[g][2]:
                        seen.setdefault(("~after", fam, key, ws.info[f][3]), set()).add(at_f)
                for first, last, g, f, name in name_candidates(ws, family):
                    rows.append((s, i, "name", ws.at[first][0], ws.at[last][1], ws.key(g), name, ws.info[g][2], ws.info[f][3] or name in family, None))
            rows += [(None, None, kind, None, None, term, other, listed, None, list(c)) for (kind, term, other, listed), c in seen.items()]
            rows.append((None, None, "~chance", covered, total, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=COLUMNS)

    return run


def _share(k, n, prior):
    """The share ``k`` of ``n`` with ``WEIGHT`` observations of the prior share."""
    return (k + WEIGHT * prior) / (n + WEIGHT)


def find_pii(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``(source_table, record_id, pii_type, start_at, end_at)`` of every piece of personal data.

    ``docs`` holds ``(source_table, record_id, text)``, ``names`` ``(person_name, name_kind)``, a fixed list (one of more than
    ``MOST_SENT`` names is refused). Null or empty texts and null ids give no row; positions count code points; an empty table gives no row.
    """
    listed = names.where("person_name is not null").limit(MOST_SENT + 1).collect()
    if len(listed) > MOST_SENT:
        raise ValueError(f"the name list has more than {MOST_SENT} names")
    fold = lambda kind: frozenset(r["person_name"].lower().replace("’", "'") for r in listed if r["name_kind"] == kind)
    given, family = fold("given"), fold("family")
    texts = spread(docs.where("text <> '' and record_id is not null").select("source_table", F.col("record_id").cast("bigint").alias("record_id"), "text"))
    spans = cut(texts.mapInArrow(_propose(given, family), SCHEMA))
    chance = spans.where("pii_type = '~chance'").agg(F.sum("start_at"), F.sum("end_at")).first()
    # distinct contexts and values of each term
    noted = spans.where("pii_type like '~%' and pii_type <> '~chance'").select("pii_type", "term", "other", "listed", F.explode("seen").alias("at")).distinct()
    counts = cut(noted.groupBy("pii_type", "term", "other", "listed").agg(F.count("*").alias("n")))
    return _decided_forms(spans, counts, (chance[0] or 0) / max(chance[1] or 0, 1)).unionByName(_decided_names(spans, counts))


def _decided_forms(spans: DataFrame, counts: DataFrame, chance: float) -> DataFrame:
    """Values whose form stands near protected values more often than chance."""
    near = F.sum(F.when(F.col("pii_type") == "~near", F.col("n")).otherwise(0))
    forms = counts.where("pii_type in ('~near', '~far')").groupBy("term").agg(near.alias("k"), F.sum("n").alias("n"))
    told = forms.where(_share(F.col("k"), F.col("n"), F.lit(PRIOR)) >= F.lit(chance)).select("term")
    return spans.where("pii_type <> 'name' and pii_type not like '~%'").join(_small(told), "term", "left_semi").select("source_table", "record_id", "pii_type", "start_at", "end_at")


def _small(df: DataFrame) -> DataFrame:
    """Sent to all tasks behind a count, else joined by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def _decided_names(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """Places in the shape of a name whose two words disclose one."""
    of = lambda kind: counts.where(F.col("pii_type") == kind)
    g = of("~given").select("term", "listed", "n").join(of("~before").select("term", F.col("n").alias("k")), "term", "left").na.fill(0, ["k"])
    whole = g.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("listed"), F.col("k"))).alias("k")).first()
    base = min(max(whole["k"] or 0, 1) / max(whole["n"] or 0, 1), BASE_MOST)
    prior = lambda c: F.when(c, F.lit(PRIOR)).otherwise(F.lit(base))
    prior_given = F.when(F.col("listed") & F.col("term").rlike("^[~^]"), F.lit(PRIOR_LOWER)).otherwise(prior(F.col("listed")))
    p_given = _small(g.select("term", _share(F.col("k"), F.col("n"), prior_given).alias("p")))
    bare = F.regexp_replace("other", "^[~^]", "")
    after = of("~after").select(F.col("term").alias("family"), "other", "n").join(p_given.withColumnRenamed("term", "other"), "other")
    by_pair = cut(after.groupBy("family", bare.alias("partner")).agg(F.sum("n").alias("pair_n"), F.sum(F.col("n") * F.col("p")).alias("pair_k")))
    after_sum = by_pair.groupBy("family").agg(F.sum("pair_k").alias("k"))
    titled = of("~titled").select(F.col("term").alias("family"), F.col("n").alias("titled"))
    f = of("~family").select(F.col("term").alias("family"), "n").join(after_sum, "family", "left").join(titled, "family", "left").na.fill(0, ["k", "titled"])
    maybe = spans.where("pii_type = 'name'").select("source_table", "record_id", "start_at", "end_at", "term", F.regexp_replace("term", "^[~^]", "").alias("partner"), F.col("other").alias("family"), "listed", "listed_other")
    maybe = maybe.join(p_given, "term", "left").join(_small(f), "family", "left").join(_small(by_pair), ["family", "partner"], "left").na.fill(0, ["n", "k", "titled", "pair_n", "pair_k"])
    # a word that stands nowhere else in this way of writing has the share that it has when capitalised
    maybe = maybe.join(p_given.select(F.col("term").alias("partner"), F.col("p").alias("p_plain")), "partner", "left")
    p_g = F.coalesce("p", "p_plain", prior_given)
    others = F.greatest(F.col("n") - F.col("pair_n"), F.col("titled"))
    p_f = F.least(_share(F.greatest(F.col("k") - F.col("pair_k"), F.lit(0.0)) + F.col("titled"), others, prior(F.col("listed_other"))), F.lit(1.0))
    bits = lambda p: F.log2(p / F.lit(base))
    content = F.lit(-math.log2(base))
    ok = (bits(p_g) >= GIVEN * content) & (bits(p_g) + bits(p_f) >= DISCLOSED * content)
    accepted = maybe.where(ok).groupBy("source_table", "record_id").agg(F.sort_array(F.collect_set(F.struct("start_at", "end_at"))).alias("at"))
    # of names that overlap the first and longest stays; the names of one text are few
    keep = F.expr("""aggregate(array_sort(at, (x, y) -> case when x.start_at < y.start_at then -1 when x.start_at > y.start_at then 1 when x.end_at > y.end_at then -1 when x.end_at < y.end_at then 1 else 0 end),
        cast(array() as array<struct<start_at: bigint, end_at: bigint>>),
        (out, x) -> case when size(out) = 0 or out[size(out) - 1].end_at <= x.start_at then concat(out, array(x)) else out end)""")
    return accepted.select("source_table", "record_id", F.explode(keep).alias("n")).select("source_table", "record_id", F.lit("name").alias("pii_type"), "n.start_at", "n.end_at")


def masked_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(source_table, record_id, masked_text)`` of all texts: each finding becomes its type in brackets, the rest is unchanged; null stays null."""
    spans = found.groupBy("source_table", "record_id").agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "pii_type"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if t is None or not found:
                    out.append(t)
                    continue
                parts, at = [], 0
                for s in found:
                    parts += [t[at : s["start_at"]], f"[{s['pii_type'].upper()}]"]
                    at = s["end_at"]
                out.append("".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["source_table", "record_id", "masked_text"])

    src = docs.select("source_table", F.col("record_id").cast("bigint").alias("record_id"), "text").join(spans, ["source_table", "record_id"], "left")
    return src.mapInArrow(run, "source_table string, record_id bigint, masked_text string")
