"""Frequency of every distinct term: range-partitioned external sort and run-length scan.

``(field, term, record)`` rows are range-partitioned on all three columns and a salt, so a term that
holds a third of all rows is cut into as many ranges as it needs; Spark's external sorter orders each
range, and one scan over the sorted rows counts each run. A run may go on in the next range: each range
reports the records at its two ends by name and only counts those between, and the ends are made
distinct when the few partial rows of a term are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _changes(a: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it (no nulls)."""
    if len(a) < 2:
        return np.ones(len(a), bool)
    return np.r_[True, pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each (field, term) run of one sorted range."""
    names = ["field_name", "term", "occurrences", "inner_records", "first_record", "last_record"]
    held: list | None = None  # the open run: field, term, occurrences, distinct records, first, last
    for b in batches:
        if not b.num_rows:
            continue
        field, term, rec = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        run = _changes(field) | _changes(term)
        new = run | np.r_[True, rec[1:] != rec[:-1]]
        starts = np.flatnonzero(run)
        ends = np.r_[starts[1:], b.num_rows]
        distinct = np.add.reduceat(new.astype(np.int64), starts)
        fs, ts = field.take(pa.array(starts)).to_pylist(), term.take(pa.array(starts)).to_pylist()
        occ, first, last = ends - starts, rec[starts], rec[ends - 1]
        lo = 0
        if held and held[0] == fs[0] and held[1] == ts[0]:
            held[2] += int(occ[0])
            held[3] += int(distinct[0]) - int(held[5] == first[0])
            held[5] = int(last[0])
            lo = 1
        if lo == len(fs):
            continue
        if held:
            yield _row(held, names)
        hi = len(fs) - 1
        held = [fs[hi], ts[hi], int(occ[hi]), int(distinct[hi]), int(first[hi]), int(last[hi])]
        if hi > lo:
            inner = distinct[lo:hi] - 1 - (first[lo:hi] != last[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(fs[lo:hi], pa.string()), pa.array(ts[lo:hi], pa.string()), pa.array(occ[lo:hi]), pa.array(inner), pa.array(first[lo:hi]), pa.array(last[lo:hi])], names=names)
    if held:
        yield _row(held, names)


def _row(h: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
    values = [h[0], h[1], h[2], h[3] - 1 - (h[4] != h[5]), h[4], h[5]]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def term_counts(rows: DataFrame) -> DataFrame:
    """``(field_name, term, occurrences, records)`` of rows ``(field_name, term, record)``.

    Terms are taken as they come (fold them first); rows with a null or empty term or a null record
    are none, and an empty table gives no row.
    """
    src = rows.select("field_name", "term", F.col("record").cast("bigint").alias("record")).where("term <> '' and record is not null")
    # written once: finding the ranges reads the rows as well as sending them does
    src = cut(src.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")))
    ranged = src.repartitionByRange("field_name", "term", "record", "salt").sortWithinPartitions("field_name", "term", "record").drop("salt")
    parts = ranged.mapInArrow(_scan, "field_name string, term string, occurrences bigint, inner_records bigint, first_record bigint, last_record bigint")
    return parts.groupBy("field_name", "term").agg(
        F.sum("occurrences").alias("occurrences"),
        (F.sum("inner_records") + F.size(F.array_union(F.collect_set("first_record"), F.collect_set("last_record")))).cast("bigint").alias("records"),
    )


def term_verdicts(counts: DataFrame, totals: DataFrame, rare_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """Marks each term 'rare' (in at most ``rare_most`` records), else 'common' (in more than ``common_share`` of the field's records), else 'useful'.

    ``totals`` holds ``(field_name, all_records)``, one row a field.
    """
    out = counts.join(F.broadcast(totals), "field_name")
    verdict = F.when(F.col("records") <= rare_most, "rare").when(F.col("records") > F.col("all_records") * common_share, "common").otherwise("useful")
    return out.withColumn("verdict", verdict)
