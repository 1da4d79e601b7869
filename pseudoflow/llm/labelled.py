"""Shared by the two classifiers: folds, bounded labelled samples, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudoflow.llm.common import text_or_empty, written

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text",
           label_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) of at most ``per_class`` ids of each class, chosen by hash, outside the held-out fold; and
    how many ids each class has.  Ids with null or contradictory labels are left out; an id that several rows have gives
    its smallest text, so the sample stays within its bound."""
    mine = labels.select(labels[label_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("y in (0, 1)")
    mine = mine.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
    mine = written(mine.select("doc_id", "y"), f"labels-{label}")
    sizes = {r["y"]: r["n"] for r in mine.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [mine.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = written(some[0].unionByName(some[1]), f"sample-{label}").withColumnRenamed("doc_id", "label_id")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    # at most 2 * per_class narrow rows; partial aggregation keeps one text of an id, however many rows have it
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"])
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), sizes


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of the logistic curve 1 / (1 + exp(-(a * margin + b))) that fits weighted labels: Newton steps with
    backtracking, lightly regularised."""
    middle, spread = float(margin.mean()), float(margin.std()) or 1.0
    z = (margin - middle) / spread
    target = np.where(y > 0, 1 - 1e-3, 1e-3)

    def loss(p: np.ndarray) -> float:
        x = p[0] * z + p[1]
        return float((weight * (np.logaddexp(0, x) - target * x)).sum() + 5e-4 * p[0] ** 2)

    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -500, 500)))
        g, h = weight * (p - target), weight * p * (1 - p)
        grad = np.array([(g * z).sum() + 1e-3 * at[0], g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step, now, scale = np.linalg.solve(hess, grad), loss(at), 1.0
        while loss(at - scale * step) > now and scale > 1e-6:
            scale /= 2
        at = at - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    a = max(at[0] / spread, 1e-3)
    return float(a), float(at[1] - a * middle)


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give the sample's classes their shares among all labels."""
    each = {c: sizes.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    w = np.where(y == 1, each[1], each[0])
    return w / max(w.sum(), 1e-12) * len(y)


def score(margin: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
