"""Near-duplicate records: exact candidate blocks and bit-sliced distances.

A text becomes the set of its word shingles, equal sets become one class. Comparing all pairs bit-sliced would be
quadratic, so classes that share one of their rarest shingles (``prefix``, exact) form blocks, and within the
blocks the pairs are compared bit-sliced: the exclusive-or of two parity sketches is a lane, 64 lanes share
a word, their bits stand in vertical bit planes, and carry-save counters add the planes of all words at once. Words
of which all 64 lanes have exceeded their radius are abandoned at ``CHECKS``. The radius is exact: a pair of sets
with Jaccard similarity ``t`` or more differs in at most ``(1-t)/(1+t)`` of its summed sizes, and the
sketches' distance is never more than the sets'. What survives is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import member_pairs
from .prefix import candidate_classes, verified

RUN, CHECKS = 1 << 17, (128, 192, 256, 320)


def bit_sliced_within(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` (lanes of 64-bit words) have at most ``radius`` set bits, by carry-save counters over bit planes."""
    keep = np.zeros(len(x), bool)
    for lo in range(0, len(x), RUN):
        keep[lo : lo + RUN] = _run(x[lo : lo + RUN], radius[lo : lo + RUN])
    return keep


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words as planes: ``out[k]`` has bit ``k`` of every row, 64 rows a word; rows are filled up with zeros."""
    n, words = x.shape
    full = np.zeros((-(-n // 64) * 64, words), np.uint64)
    full[:n] = x
    out = np.ascontiguousarray(full.reshape(-1, 64, words).transpose(2, 1, 0))  # word, row in its 64, group of 64
    width = 32
    mask = 0x00000000FFFFFFFF
    while width:
        v = out.reshape(words, 64 // (2 * width), 2, width, -1)
        a, b = v[:, :, 0], v[:, :, 1]
        t = ((a >> np.uint64(width)) ^ b) & np.uint64(mask)
        b ^= t
        a ^= t << np.uint64(width)
        width //= 2
        mask ^= (mask << width) & 0xFFFFFFFFFFFFFFFF
    return out.reshape(words * 64, -1)


def _run(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    n, bits = len(x), x.shape[1] * 64
    planes = bit_planes(x)
    most = bit_planes(np.clip(radius, 0, bits).astype(np.uint64).reshape(-1, 1))[: bits.bit_length()]
    words = np.arange(planes.shape[1])
    counter: list[np.ndarray] = []
    over = np.zeros(planes.shape[1], np.uint64)
    result = np.full(planes.shape[1], ~np.uint64(0))
    for at in range(0, bits, 8):
        _add(counter, planes[at : at + 8])
        if at + 8 in CHECKS or at + 8 == bits:
            over = _exceeds(counter, most)
            gone = over == ~np.uint64(0)
            if at + 8 < bits and gone.any():
                live = ~gone
                planes, most, words = planes[:, live], most[:, live], words[live]
                counter = [c[live] for c in counter]
                over = over[live]
                if not len(words):
                    break
    result[words] = over
    negative = radius < 0
    return ~(np.unpackbits(result.view(np.uint8), bitorder="little")[:n].astype(bool) | negative)


def _exceeds(counter: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Lanes whose count is above their radius, compared plane by plane from the top."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for k in reversed(range(max(len(counter), len(most)))):
        c = counter[k] if k < len(counter) else np.zeros_like(above)
        m = most[k] if k < len(most) else np.zeros_like(above)
        above |= equal & c & ~m
        equal &= ~(c ^ m)
    return above


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _add(counter: list[np.ndarray], p: np.ndarray) -> None:
    """Adds eight planes: carry-save adders make one plane each of weight 1, 2, 4 and 8, which ripple in."""
    t1, s1 = _csa(p[0], p[1], p[2])
    t2, s2 = _csa(p[3], p[4], p[5])
    t3, s3 = p[6] & p[7], p[6] ^ p[7]
    t4, ones = _csa(s1, s2, s3)
    f1, u1 = _csa(t1, t2, t3)
    f2, twos = u1 & t4, u1 ^ t4
    eights, fours = f1 & f2, f1 ^ f2
    for low, carry in enumerate((ones, twos, fours, eights)):
        for k in range(low, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        counter.append(carry)
    while len(counter) > 4 and not counter[-1].any():
        counter.pop()


def near_duplicate_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``members`` holds ``(id, key)`` of every text with enough words, ``pairs`` the linked classes with ``shared`` and ``jaccard``.

    Null ids and texts and texts of fewer than ``min_words`` words belong to no class. Texts with the same
    shingle set share a class, however many they are. The result is exact for every threshold above 0 (others are
    refused); the lower it is, the more pairs are compared. An empty table gives two empty results.
    """
    members, pairs = candidate_classes(docs, id_col, text_col, None, threshold, width, min_words, bit_sliced_within)
    return members.select("id", "key"), verified(pairs, docs, members, id_col, text_col, threshold, width, min_words)


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """``(id_a, id_b)`` with ``id_a < id_b``: every pair of linked texts, exact copies included. Of texts with the same id any may be the linked one."""
    members, pairs = near_duplicate_classes(docs, id_col, text_col, **kw)
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    out = member_pairs(pairs.select("key_a", "key_b").unionByName(several), members, members).where("a < b or (key_a <> key_b and a <> b)")
    return out.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def near_duplicate_rows(docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """``(id, class_id, copies, links)``, one row per text with enough words: the least id with the same shingle set, how many texts have it, and how many other classes it is linked to."""
    members, pairs = near_duplicate_classes(docs, id_col, text_col, **kw)
    classes = members.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    links = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    return members.join(classes.join(links, "key", "left").na.fill(0, ["links"]), "key").select("id", "class_id", "copies", "links")
