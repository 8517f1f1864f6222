"""A linear one-against-rest classifier over words, character triples and scaled extra features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import vectors

TERMS = 5000  # fixed value: terms of each vocabulary
MOST_FIT = 2000  # labelled rows that the classifier is fitted on, the first by a hash of their id; vocabularies, weights and scaling use all training rows


def sparse_rows(docs: DataFrame, id_col: str, text_col: str, train_col: str) -> DataFrame:
    """``(id, at, w)``: places and weights of each document, words first, then character triples; each of both blocks has unit length. Vocabularies and weights come from the training rows."""
    n = docs.where(train_col).count()
    blocks = None
    for k, chars in enumerate((0, 3)):
        counts = cut(vectors.term_counts(docs, id_col, text_col, chars=chars))
        seen = counts.join(docs.where(train_col).select(F.col(id_col).alias("id")), "id", "left_semi")
        vocab = vectors.vocabulary(seen, n, 1, most=TERMS)
        places = [(r["term"], r["idf"], k * TERMS + i) for i, r in enumerate(vocab.orderBy("term").collect())]  # at most TERMS
        known = docs.sparkSession.createDataFrame(places, "term string, idf double, at int")
        rows = vectors.weigh(counts, known.select("term", "idf"), sublinear=True).join(F.broadcast(known.select("term", "at")), "term").select("id", "at", "weight")
        blocks = rows if blocks is None else blocks.unionByName(rows)
    return blocks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("x")).select("id", F.transform("x", lambda p: p["at"]).alias("at"), F.transform("x", lambda p: p["weight"]).alias("w"))


def scaling(docs: DataFrame, extra: str, train_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the extra features over the training rows; constant ones have a deviation of 1."""
    each = docs.where(train_col).select(F.posexplode(extra).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()  # one row a feature
    s = np.array([r["s"] or 1.0 for r in each])
    return np.array([r["m"] for r in each]), np.where(s == 0, 1.0, s)


def fit_squared_hinge(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights ``(features + 1, classes)`` that make ``|w|^2 / 2 + c * sum(max(0, 1 - y * f)^2)`` small, by accelerated gradients with restarts; the last row is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (1.0 + 2.1 * c * float(np.linalg.norm(x.T @ (x @ v))))
    w = np.zeros((x.shape[1], y.shape[1]), x.dtype)
    z, t, last = w.copy(), 1.0, np.inf
    for _ in range(rounds):
        gap = np.maximum(0.0, 1.0 - y * (x @ z))
        loss = float((gap**2).sum()) * c + float((z**2).sum()) / 2
        new = z - step * (z - 2 * c * (x.T @ (y * gap)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if loss > last:
            t_new, z = 1.0, new.copy()
        else:
            z = new + (t - 1) / t_new * (new - w)
        w, t, last = new, t_new, loss
    return w


def fit_and_predict(docs: DataFrame, id_col: str, text_col: str, label_col: str, train_col: str, extra: str) -> DataFrame:
    """``(id, label, margin)`` of every row that isn't a training row: the label with the highest decision value, and how far it lies above the second.

    ``train_col`` is a boolean; null labels don't train. With a single label that label is told with margin 0; without training rows there is no result.
    """
    spark = docs.sparkSession
    kind = "id bigint, label string, margin double"
    mean, dev = scaling(docs, extra, train_col)
    if not len(mean):
        return spark.createDataFrame([], kind)
    rows = sparse_rows(docs, id_col, text_col, train_col)
    whole = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(train_col).alias("train"), F.col(extra).alias("extra")).join(rows, "id", "left")
    whole = cut(whole)
    sample = whole.where("train and label is not null").orderBy(F.md5(F.col("id").cast("string"))).limit(MOST_FIT).toPandas()

    def dense(at, w, more) -> np.ndarray:
        out = np.zeros((len(at), 2 * TERMS + len(mean)), np.float32)
        for k, (i, v, e) in enumerate(zip(at, w, more, strict=True)):
            if i is not None and len(i):
                out[k, np.asarray(i)] = v
            out[k, 2 * TERMS :] = (np.asarray(e) - mean) / dev
        return out

    labels = sorted(sample["label"].unique())
    y = np.where(sample["label"].to_numpy()[:, None] == np.array(labels)[None, :], 1.0, -1.0).astype(np.float32)
    sent = spark.sparkContext.broadcast(fit_squared_hinge(dense(sample["at"], sample["w"], sample["extra"]), y) if len(labels) > 1 else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                b = whole.iloc[lo : lo + 500]
                if sent.value is None:
                    yield pd.DataFrame({"id": b["id"], "label": labels[0], "margin": 0.0})
                    continue
                f = dense(b["at"], b["w"], b["extra"]) @ sent.value[:-1] + sent.value[-1]
                top = np.sort(f, axis=1)
                yield pd.DataFrame({"id": b["id"], "label": np.array(labels, dtype=object)[f.argmax(axis=1)], "margin": (top[:, -1] - top[:, -2]).astype(float)})

    return whole.where("not train").select("id", "extra", "at", "w").mapInPandas(run, kind)
