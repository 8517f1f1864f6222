"""Garbled text from wrong decoding: a table of garbled forms, hash-joined with the corpus.

Every distinct word of the corpus that holds a character beyond ASCII is put through all encoding
chains: UTF-8 read as a single-byte code page (once, with and without losses, twice by any two pages, or three times by the
commonest), one code page read as another (and that read wrongly once more), and code-page bytes read as UTF-8 with
replacement characters. The forms and the words they come from make a table, which is joined with the words of each
document by the form. A bitmap of fixed size over the corpus' words, which are all in it, keeps forms out of
the table that no document holds.

A form counts as garbled if reading it back is the only sensible reading (a chain through UTF-8), or, for
chains between two code pages, if its letters are less plausible than those of the word it comes from (a change of script
or case inside the word, a symbol between letters), or, if both are alike, if that word stands in at least ``RATIO`` times
as many distinct texts. A form more plausible than its supposed original never counts, however frequent either is.
Beside whole words, the bare runs of non-ASCII characters and their 2 to 3 character parts are joined
through the UTF-8 chains, which finds damage in words that the corpus has nowhere intact. Replacement characters and C1 controls have no clean
reading; they mark a document even if no original is found (``marks`` counts such words).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import spread

RATIO = 3
SLOTS = 1 << 22  # of the bitmap
MOST_SENT = 100_000  # garbled forms found up to which their table is sent to all tasks; beyond, they are joined by shuffle
UNIT = re.compile("[A-Za-z?]*[\x80-\U0010ffff][A-Za-z?\x80-\U0010ffff]*")
BARE = re.compile("[?\x80-\U0010ffff]*[\x80-\U0010ffff][?\x80-\U0010ffff]*")
LOST = "[\ufffd\x80-\x84\x86-\x9f]"  # replacement character and C1 controls, but not the line end U+0085
MARK = re.compile(LOST)
# fixed values: code pages that text is commonly read with by mistake
COMMON = ("cp1252", "latin_1")
READ_AS = ["cp1252", "latin_1", "cp1250", "iso8859_2", "iso8859_15", "cp1251", "koi8_r", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_latin2"]
WRITTEN_IN = ["cp1252", "cp1250", "iso8859_2", "cp1251", "cp850", "mac_roman", "koi8_r"]


@lru_cache(None)
def _reader(page: str) -> list[str]:
    """Character of each byte; bytes that a page leaves out read as the control of that number."""
    return [bytes([b]).decode(page, "replace") if bytes([b]).decode(page, "ignore") else chr(b) for b in range(256)]


def _read(data: bytes, page: str) -> str:
    table = _reader(page)
    return "".join([table[b] for b in data])


def garbled_forms(word: str) -> dict[str, tuple[str, bool]]:
    """Garbled forms of one clean word: form -> (chain, whether it goes through UTF-8)."""
    out: dict[str, tuple[str, bool]] = {}

    def put(form: str, chain: str, utf8: bool) -> None:
        if form != word and not form.isascii() and form not in out:
            out[form] = (chain, utf8)

    for w, pre in dict.fromkeys([(word, ""), (unicodedata.normalize("NFD", word), "nfd>")]):
        data = w.encode("utf-8", "replace")
        for page in READ_AS:
            once = _read(data, page)
            put(once, f"{pre}utf-8>{page}", True)
            for lossy in COMMON:
                try:
                    put(once.encode(lossy, "replace").decode(lossy), f"{pre}utf-8>{page}>{lossy}?", True)
                except UnicodeDecodeError:
                    pass
            put("".join(c if ord(c) < 0x80 or ord(c) > 0x9F else "?" for c in once), f"{pre}utf-8>{page}>?", True)
            raw = once.encode("utf-8")
            for again in READ_AS:
                twice = _read(raw, again)
                put(twice, f"{pre}utf-8>{page}>utf-8>{again}", True)
                if page in COMMON and again in COMMON:
                    for third in COMMON:
                        put(_read(twice.encode("utf-8"), third), f"{pre}utf-8>{page}>utf-8>{again}>utf-8>{third}", True)
        put(data.decode("ascii", "replace"), f"{pre}utf-8>ascii", True)
    for wrote in WRITTEN_IN:
        raw = word.encode(wrote, "replace")
        exact = raw.decode(wrote, "replace") == word
        for codec in ("utf-8", "ascii"):
            if "\ufffd" in (form := raw.decode(codec, "replace")):  # else it undoes a garbling
                put(form, f"{wrote}>{codec}", True)
        if exact:
            for page in READ_AS:
                if page != wrote:
                    form = _read(raw, page)
                    put(form, f"{wrote}>{page}", False)
                    for again in COMMON:
                        put(_read(form.encode("utf-8"), again), f"{wrote}>{page}>utf-8>{again}", True)
    return out


@lru_cache(4096)
def _kind(c: str) -> str:
    """Script of a letter; 'symbol' of what doesn't stand inside a word, 'low' of opening low quotes, '' of other characters."""
    if c in "ªº":
        return "symbol"
    if c.isalpha():
        return unicodedata.name(c, "?").split(" ")[0].replace("MICRO", "GREEK")
    if c in "‚„":
        return "low"
    return "symbol" if unicodedata.category(c) in ("So", "Sm", "Sc", "Sk", "No", "Po", "Pi", "Pf", "Ps", "Pe", "Cc") and c not in "'’‘·?" else ""


def oddness(word: str) -> int:
    """How many places of a word no clean word has: changes of script, capitals after small letters, small between capitals, symbols between letters."""
    kinds = [_kind(c) for c in word]
    letter = [k not in ("", "symbol", "low") for k in kinds]
    n = max(0, len({k for k, is_letter in zip(kinds, letter, strict=True) if is_letter}) - 1)
    for k, c in enumerate(word):
        before, after = k > 0 and letter[k - 1], k + 1 < len(word) and letter[k + 1]
        if letter[k]:
            n += before and c.isupper() and word[k - 1].islower() and word[k - 1] != "ß"
            n += before and after and c.islower() and c != "ß" and word[k - 1].isupper() and word[k + 1].isupper()
        elif before and kinds[k]:
            end = next((j for j in range(k, len(word)) if letter[j] or not kinds[j]), len(word))
            n += kinds[k] == "low" or end < len(word) and letter[end]
    return int(n)


def text_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, text_key, unit, level)``: the distinct words (0), bare runs (1) and 2 to 3 character parts of bare runs (2) with a non-ASCII character of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, units, level = [], [], [], []
            for i, t, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not t or t.isascii():
                    continue
                words = set(UNIT.findall(t))
                runs = {r for w in words for r in BARE.findall(w)}
                words |= {w.strip("?") for w in words if "?" in w}
                words = {w for w in words if not w.isascii()}
                parts = {r[k : k + n] for r in runs if len(r) > 2 for n in (2, 3) for k in range(len(r) - n + 1)}
                parts = {x for x in parts if not x.isalpha() and "?" not in x}
                for kind, got in enumerate((words, runs - words, parts - runs - words)):
                    ids += [i] * len(got)
                    keys += [key] * len(got)
                    units += got
                    level += [kind] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(units, pa.string()), pa.array(level, pa.int32())], names=["doc", "text_key", "unit", "level"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    return spread(src).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc bigint, text_key bigint, unit string, level int")


def _slot(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass")) % SLOTS


def held_slots(counts: DataFrame) -> np.ndarray:
    """Which slots of the bitmap the corpus' words fill; at most ``SLOTS`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[int] = set()
        for b in batches:
            held.update(map(_slot, b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32())], names=["slot"])

    bits = np.zeros(SLOTS, bool)
    bits[counts.select("unit").mapInArrow(run, "slot int").distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def garbled_table(counts: DataFrame) -> DataFrame:
    """``(form, original, chain, utf8, n, copies)`` of every distinct clean word, bare run and character, for the forms that may stand in the corpus; ``n`` counts the distinct texts that have the original as a word, ``copies`` all documents, which settles ties only."""
    spark = counts.sparkSession
    sent = spark.sparkContext.broadcast(held_slots(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for w, n, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for form, (chain, utf8) in garbled_forms(w).items():
                    at = _slot(form)
                    if bits[at >> 3] >> (at & 7) & 1:
                        rows.append((form, w, chain, utf8, n, copies))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["form", "original", "chain", "utf8", "n", "copies"])

    seen = counts.where("level < 2").where(~F.col("unit").contains("?") & ~F.col("unit").rlike(LOST))
    words = seen.select("unit", *(F.when(F.col("level") == 0, F.col(c)).otherwise(0).alias(n) for c, n in (("unit_texts", "n"), ("unit_docs", "copies"))))
    chars = seen.select(F.explode(F.split("unit", "")).alias("unit"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("copies")).where(F.col("unit") > "\x7f")
    clean = words.unionByName(chars).groupBy("unit").agg(F.max("n").alias("n"), F.max("copies").alias("copies"))
    # by number, so that the few words of a small corpus are still shared among all cores
    return clean.repartition(spark.sparkContext.defaultParallelism, "unit").mapInArrow(run, "form string, original string, chain string, utf8 boolean, n bigint, copies bigint")


def garbled_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, unit, level, original, chain)`` of every garbled unit of every document; ``original`` is null where none is found.

    Null and ASCII texts give no row; each document gives a unit once; an empty table gives no row.
    """
    units = cut(text_units(docs, id_col, text_col))
    counts = cut(units.groupBy("unit", "level").agg(F.countDistinct("text_key").alias("unit_texts"), F.count("*").alias("unit_docs")))
    match = counts.join(garbled_table(counts).hint("merge"), F.col("unit") == F.col("form"))
    lossy = F.col("unit").contains("?") & ~F.col("unit").rlike(r"^â|\?\?")
    sure = F.col("utf8") & ((F.col("level") == 0) | (F.length("form") >= 2) & ((F.col("level") == 1) & ~lossy | (F.length("original") == 1)))
    odd = F.pandas_udf(lambda words: words.map(oddness), "int")
    likely = ~F.col("utf8") & (F.col("level") == 0) & (F.col("n") > 0) & ((F.col("odd_form") > F.col("odd")) | (F.col("odd_form") == F.col("odd")) & (F.col("n") >= RATIO * F.col("unit_texts")))
    match = cut(match.withColumn("odd", odd("original")).withColumn("odd_form", odd("form")).where(sure | likely))
    # an original that is garbled itself is a stage on the way, between two code pages it is none at all; the shorter of two chains is the likelier
    halfway = match.select(F.col("unit").alias("original"), F.lit(True).alias("halfway")).distinct()
    best = Window.partitionBy("unit", "level").orderBy(F.asc_nulls_first("halfway"), F.desc(F.col("n") > 0), F.asc("odd"), F.asc(F.size(F.split("chain", ">"))), F.desc("n"), F.desc("copies"), F.asc("original"), F.asc("chain"))
    known = match.join(halfway, "original", "left").where("utf8 or halfway is null").withColumn("k", F.row_number().over(best)).where("k = 1").select("unit", "level", "original", "chain")
    known = cut(known)
    marked = counts.where((F.col("level") == 0) & F.col("unit").rlike(LOST)).select("unit", "level")
    bad = known.unionByName(marked.join(known, ["unit", "level"], "left_anti"), allowMissingColumns=True)
    bad = cut(bad)
    if bad.count() <= MOST_SENT:
        return units.join(F.broadcast(bad), ["unit", "level"]).select("doc", "unit", "level", "original", "chain")
    # a word that is in very many documents is joined in salts, its row copied to each
    salts = 16
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = units.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    return salted.join(bad.hint("merge"), ["unit", "level", "salt"]).select("doc", "unit", "level", "original", "chain")


def garbled_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, units, recovered, marks)``: documents with garbled words, how many distinct ones, how many of them with an original in the table, and how many that only a replacement character or control shows."""
    found = garbled_units(docs, id_col, text_col)
    out = found.groupBy("doc").agg(F.count("*").alias("units"), F.count("original").alias("recovered"), F.count(F.when(F.col("original").isNull(), 1)).alias("marks"))
    return out.withColumnRenamed("doc", id_col)


def restored_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, restored_text, whole)`` of each garbled document: garbled words are replaced by their originals; ``whole`` tells whether all were."""
    swaps = garbled_units(docs, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("unit", "original")).alias("swaps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, whole = [], []
            for t, pairs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                known = {p["unit"]: p["original"] for p in pairs if p["original"] is not None}

                def word(m: re.Match, known: dict = known) -> str:
                    w = m.group()
                    if w in known:
                        return known[w]
                    core = w.strip("?")
                    if core in known:
                        return w.replace(core, known[core], 1)
                    w = BARE.sub(lambda r: known.get(r.group(), r.group()), w)
                    for part in sorted(known, key=len, reverse=True):
                        if 1 < len(part) < 4 and part in w:
                            w = w.replace(part, known[part])
                    return w

                texts.append(UNIT.sub(word, t))
                whole.append(not MARK.search(texts[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())], names=["doc", "restored_text", "whole"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).join(swaps, "doc")
    return src.mapInArrow(run, "doc bigint, restored_text string, whole boolean").withColumnRenamed("doc", id_col)
