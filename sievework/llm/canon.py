"""Mapping of freely entered values to a reference list, or a report that none is meant.

The words of all reference forms make a symmetric-delete dictionary (the first ``PREFIX`` letters of every word less up to two
of them, which finds every word within two edits however long it is), which is sent to all tasks. A
value is normalised, remarks on level, length or proof of practice are cut off, and each of its words is
looked up: same, shortened, or within the edit bound for its length. A form is meant if its words and the
value's words match one to one in any order, or if both agree within the bound when written without
blanks. Among the forms that match, the least weighted Damerau-Levenshtein cost wins, then the
entry that the data name more often, then the name.

A reference list of more than ``MOST_FORMS`` forms is taken in blocks of that size at most: every distinct value meets
every block, and the best of the blocks' answers is the answer.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import fold

MOST_FORMS = 20_000
MEMO = 1 << 18
PREFIX = 12
# fixed values: words that carry no meaning of their own in a form, and remarks around a value
SMALL = {"of", "in", "the", "and", "for", "a"}
LEVEL = "basic|some|strong|advanced|intermediate|beginner|good|great|excellent|solid|proficient|experienced|expert|skilled|certified|hands on|knowledge|working knowledge|experience|trained|fluent|familiar|competent|very"
LEAD = re.compile(rf"^(?:(?:{LEVEL})(?: (?:in|at|with|of|on))?|(?:over )?\d+ ?(?:years|year|yrs|yr|y|months)(?: (?:of|in|with))?(?: experience)?(?: (?:of|in|with))?)(?= )")
TAIL = re.compile(rf"(?<= )(?:{LEVEL}|skills?|level|\d+ ?(?:years|year|yrs|yr|y|months)|certificate|\d+)$")
LEVEL_ONLY = re.compile(rf"^(?:{LEVEL})(?= )")
VOWELS = set("aeiou")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEAR = {a + b for r in ROWS for a, b in zip(r, r[1:], strict=False)} | {a + b for r in ROWS for b, a in zip(r, r[1:], strict=False)}


def plain(value: str) -> str:
    """Compatibility forms and accents resolved, lower case, everything but letters and digits a blank."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value)).lower()
    s = "".join(c if c.isalnum() else " " for c in s if not unicodedata.combining(c))
    return " ".join(s.split())


def readings(s: str) -> list[str]:
    """The value with fewer and fewer of the words that may be remarks, itself first."""
    out = [s]
    lead = LEAD.sub("", s).strip()
    out += [LEVEL_ONLY.sub("", s).strip(), lead, TAIL.sub("", s).strip()]
    while (t := TAIL.sub("", LEAD.sub("", s)).strip()) and t != s:
        out.append(t)
        s = t
    return [x for x in dict.fromkeys(out) if x]


def deletes(w: str, most: int) -> set[str]:
    """The word less up to ``most`` characters."""
    out = {w}
    for k in range(1, min(most, len(w) - 1) + 1):
        out |= {"".join(c for i, c in enumerate(w) if i not in gone) for gone in map(set, combinations(range(len(w)), k))}
    return out


def edits_allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 5 else 2


def edit_cost(a: str, b: str, most: int) -> float | None:
    """Weighted Damerau-Levenshtein distance, or None beyond ``most`` edits.

    Swapped neighbours, doubled letters, neighbouring keys and vowels for vowels cost less than other edits. Only
    the cells within ``most`` of the diagonal are filled, as no other lies on a path of so few edits.
    """
    if abs(len(a) - len(b)) > most:
        return None
    far = (most + 1, 99.0)
    before: dict[int, tuple[int, float]] = {}
    prev = {j: (j, float(j)) for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: (i, float(i))} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            if x == y:
                best = prev.get(j - 1, far)
            else:
                sub = 0.7 if x + y in NEAR or x in VOWELS and y in VOWELS else 1.0
                e, c = prev.get(j - 1, far)
                best = (e + 1, c + sub)
                e, c = prev.get(j, far)
                best = min(best, (e + 1, c + (0.6 if i > 1 and a[i - 2] == x else 0.9)))
                e, c = row.get(j - 1, far)
                best = min(best, (e + 1, c + (0.6 if j > 1 and b[j - 2] == y else 0.9)))
                if i > 1 and j > 1 and a[i - 2] == y and b[j - 2] == x:
                    e, c = before.get(j - 2, far)
                    best = min(best, (e + 1, c + 0.6))
            row[j] = best
        if not row or min(e for e, _ in row.values()) > most:
            return None
        before, prev = prev, row
    edits, cost = prev.get(len(b), far)
    if edits <= most:
        return cost
    # a letter lost between two swapped ones
    if most == 2 and len(a) + 1 == len(b) and any(edit_cost(a, b[:i] + b[i + 1 :], 1) is not None for i in _lost(a, b)):
        return 2.0
    return None


def _lost(a: str, b: str) -> range:
    """Where the letter may stand that ``a`` lacks: near the first difference."""
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return range(max(1, k - 1), min(k + 3, len(b) - 1))


def least_assignment(cost: list[list[float | None]]) -> float | None:
    """Least total of a one-to-one assignment of rows to columns, None where there is none (None marks a pair that cannot be)."""
    n, none = len(cost), 1e6
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [1e18] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[j0]:
            used[j0] = True
            row, delta, j1 = match[j0], 1e18, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[row - 1][j - 1]
                    d = (none if c is None else c) - u[row] - v[j]
                    if d < least[j]:
                        least[j], way[j] = d, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    picked = [cost[match[j] - 1][j - 1] for j in range(1, n + 1)]
    return None if any(c is None for c in picked) else sum(picked)


def short_cost(w: str, full: str) -> float | None:
    """Cost of reading ``w`` as a shortened ``full``: its start, or a start with some of the consonants after it."""
    if len(w) < 2 or len(w) >= len(full) or w[0] != full[0]:
        return None
    if full.startswith(w):
        return 0.5 if len(w) > 2 else 0.95 if len(full) > 5 else None
    if len(w) > 3 and w[-1] == "s" and full.startswith(w[:-1]):
        return 0.7
    k = next(i for i, (x, y) in enumerate(zip(w, full, strict=False)) if x != y)
    rest = iter(full[k:])
    return 0.8 if len(w) > 2 and not VOWELS & set(w[k:]) and all(c in rest for c in w[k:]) else None


class Matcher:
    """Maps values to canonical names; built once per worker."""

    def __init__(self, forms: list[tuple[str, str]], frequency: dict[str, int]) -> None:
        self.frequency = frequency
        self.exact: dict[str, list[str]] = defaultdict(list)
        self.by_bag: dict[tuple[str, ...], list[str]] = defaultdict(list)
        self.forms: list[tuple[tuple[str, ...], str, str]] = []
        self.with_word: dict[str, set[int]] = defaultdict(set)
        self.word_at: dict[str, list[str]] = defaultdict(list)
        self.joined_at: dict[str, list[int]] = defaultdict(list)
        for form, canonical in forms:
            p = plain(form)
            words = tuple(w for w in p.split() if w not in SMALL) or tuple(p.split())
            k = len(self.forms)
            joined = p.replace(" ", "")
            self.forms.append((words, joined, canonical))
            self.exact[joined].append(canonical)
            self.by_bag[tuple(sorted(words))].append(canonical)
            for w in words:
                self.with_word[w].add(k)
            for d in deletes(joined[:PREFIX], 2):
                self.joined_at[d].append(k)
        self.sizes = {len(words) for words, _, _ in self.forms}
        for w in self.with_word:
            for d in deletes(w[:PREFIX], edits_allowed(len(w))):
                self.word_at[d].append(w)
        self.starts: dict[str, list[str]] = defaultdict(list)
        for w in self.with_word:
            self.starts[w[0]].append(w)
        self.memo: dict[str, tuple | None] = {}
        self.word_memo: dict[str, dict[str, float]] = {}

    def words_within(self, w: str) -> set[str]:
        """Reference words that may lie within the edit bound of ``w``."""
        return {t for d in deletes(w[:PREFIX], 2) for t in self.word_at.get(d, ())}

    def forms_within(self, joined: str) -> set[int]:
        """Reference forms that may lie within two edits of ``joined`` when written without blanks."""
        return {k for d in deletes(joined[:PREFIX], 2) for k in self.joined_at.get(d, ())}

    def words_near(self, w: str) -> dict[str, float]:
        """Reference words that ``w`` may stand for, with their costs."""
        if (got := self.word_memo.get(w)) is not None:
            return got
        out: dict[str, float] = {}
        for t in self.words_within(w):
            if (c := edit_cost(w, t, edits_allowed(len(t)))) is not None:
                out[t] = c
        for t in self.starts.get(w[0], ()):
            if t not in out and (c := short_cost(w, t)) is not None:
                out[t] = c
        if len(self.word_memo) >= MEMO:
            self.word_memo.clear()
        self.word_memo[w] = out
        return out

    def best(self, stage: float, found: dict[str, float]) -> tuple | None:
        """The least of ``(stage, cost, frequency downwards, name)``."""
        return min(((stage, c, -self.frequency.get(name, 0), name) for name, c in found.items()), default=None)

    def rank(self, value: str) -> tuple | None:
        """``(stage, cost, frequency downwards, name)`` of the entry meant, or None; less is better, among blocks of the reference as well."""
        p = plain(value)
        if not p:
            return None
        said = readings(p)
        split = [[w for w in s.split() if w not in SMALL] or s.split() for s in said]
        for at, (s, words) in enumerate(zip(said, split, strict=True)):
            for half, hit in ((0.0, self.exact.get(s.replace(" ", ""))), (0.5, self.by_bag.get(tuple(sorted(words))))):
                if hit:
                    return self.best(at + half, dict.fromkeys(hit, 0.0))
        found: dict[str, float] = {}
        for words in split:
            if len(words) not in self.sizes:
                continue
            near = [self.words_near(w) for w in words]
            if all(near):
                for k in set.intersection(*({k for t in n for k in self.with_word[t]} for n in near)):
                    form, _, name = self.forms[k]
                    if len(form) == len(words) and (c := self._assign(near, form)) is not None:
                        found[name] = min(c, found.get(name, 99.0))
        if found:
            return self.best(1e6, found)
        for s in (said[0], said[-1]):
            joined = s.replace(" ", "")
            if len(joined) >= 6:
                for k in self.forms_within(joined):
                    _, full, name = self.forms[k]
                    if (c := edit_cost(joined, full, 2 if len(full) >= 8 else 1)) is not None:
                        found[name] = min(c, found.get(name, 99.0))
        return self.best(2e6, found)

    def _assign(self, near: list[dict[str, float]], form: tuple[str, ...]) -> float | None:
        """Least cost of matching each value word with its own form word; words out of place may have one edit each, a lone word no two-letter short form."""
        if len(form) == 1:
            return c if (c := near[0].get(form[0])) != 0.95 else None
        cost = [[None if (c := n.get(t)) is None or i != j and c > 1.0 else c + (0.05 if i != j else 0.0) for j, t in enumerate(form)] for i, n in enumerate(near)]
        return least_assignment(cost)

    def ranked(self, value: str) -> tuple | None:
        if value in self.memo:
            return self.memo[value]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        out = self.memo[value] = self.rank(value)
        return out

    def __call__(self, value: str) -> str | None:
        got = self.ranked(value)
        return got[3] if got else None


_BUILT: dict[str, Matcher] = {}


def _matcher(sent) -> Matcher:
    """One matcher per worker and reference block."""
    name, forms, often = sent.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(forms, often)
    return _BUILT[name]


def _sent(lexicon: DataFrame, frequency: DataFrame):
    """Forms and frequencies of a reference list (or block of one) for all tasks."""
    entries = lexicon.select("canonical", F.explode_outer("aliases").alias("alias")).collect()
    forms = sorted({(r["canonical"], r["canonical"]) for r in entries if r["canonical"]} | {(r["alias"], r["canonical"]) for r in entries if r["alias"] and r["canonical"]})
    known = lexicon.select(fold(F.col("canonical")).alias("c"), "canonical")
    often = {r["canonical"]: r["n"] for r in known.join(frequency.select(F.col("canonical").alias("c"), "n"), "c").groupBy("canonical").agg(F.sum("n").alias("n")).collect()}
    return lexicon.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, forms, often))


def map_values(cases: DataFrame, value: str, lexicon: DataFrame, frequency: DataFrame) -> DataFrame:
    """``cases`` with a column ``meant``: the canonical name that the folded column ``value`` means, or 'unmatched'.

    ``lexicon`` holds ``canonical`` and ``aliases``, ``frequency`` ``(canonical, n)``. A null or blank value is unmatched; an
    empty reference list matches nothing. A column ``meant`` that ``cases`` has already is replaced.
    """
    cases = cases.drop("meant")
    total = lexicon.select(F.sum(1 + F.size(F.coalesce("aliases", F.array())))).first()[0] or 0
    if total <= MOST_FORMS:
        sent = _sent(lexicon, frequency)
        columns = cases.columns
        at = columns.index(value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = _matcher(sent)
            for b in batches:
                out = [(match(v) or "unmatched") if v else "unmatched" for v in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*columns, "meant"])

        return cases.mapInArrow(run, cases.withColumn("meant", F.lit("")).schema)
    values = cut(cases.select(F.col(value).alias("_value")).where("_value <> ''").distinct())
    blocks = 2 * -(-total // MOST_FORMS)  # by hash, so that each is well under the bound
    answers = None
    for k in range(blocks):
        part = lexicon.where(F.pmod(F.xxhash64("canonical"), F.lit(blocks)) == k)
        got = cut(values.mapInArrow(_ranks(_sent(part, frequency)), "_value string, stage double, cost double, rare bigint, _meant string"))
        answers = got if answers is None else answers.unionByName(got)
    best = answers.groupBy("_value").agg(F.min(F.struct("stage", "cost", "rare", "_meant")).alias("m")).select("_value", "m._meant")
    out = cases.join(best, F.col(value) == F.col("_value"), "left").drop("_value")
    return out.withColumn("meant", F.coalesce("_meant", F.lit("unmatched"))).drop("_meant")


def _ranks(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(sent)
        for b in batches:
            got = [(v, *r) for v in b.column(0).to_pylist() if (r := match.ranked(v))]
            cols = list(zip(*got, strict=True)) if got else [[]] * 5
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_value", "stage", "cost", "rare", "_meant"])

    return run
