"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators, and a linear hinge-loss model is
fitted to them by dual coordinate descent.

The n-grams are byte trigrams, five-grams of character classes, and trigrams of "same word as before"
flags, hashed to 2**18 indicators over the whole text.  The model is fitted in one task to at most
``per_class`` labelled rows of each class (a documented bound); every row is scored.

Defined cases: null text counts as empty and scores by the bias alone; without labels of both classes all
scores are the share of label 1 (one half without labels); ids with contradictory labels teach nothing;
repeated rows score alike; an empty table gives an empty result; extra columns are ignored by ``classify``
and kept by ``keep_good``.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.llm import labelled
from pseudoflow.llm.common import fresh, frugal, text_or_empty, written

BITS = 18
SIZE = 1 << BITS
PER_CLASS = 3000
THRESHOLD = 0.3

CLASS = np.full(256, ord("a"), np.uint64)  # letters and all bytes beyond ASCII
for _c in range(128):
    _ch = chr(_c)
    if _ch.isupper():
        CLASS[_c] = ord("A")
    elif _ch.isdigit():
        CLASS[_c] = ord("0")
    elif _ch.isspace():
        CLASS[_c] = ord(" ")
    elif not _ch.isalpha():
        CLASS[_c] = _c
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20


def _hashed(codes: np.ndarray, kind: int) -> np.ndarray:
    h = (codes + np.uint64(kind)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - BITS)).astype(np.int64)


class Featurizer:
    """Indices of a text's indicators, by marks in one reused array."""

    def __init__(self) -> None:
        self.marks = np.zeros(SIZE, bool)

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode()
        for at in range(0, len(raw), BLOCK):
            b = np.frombuffer(raw[max(0, at - 4) : at + BLOCK], np.uint8)
            low = np.frombuffer(raw[max(0, at - 4) : at + BLOCK].lower(), np.uint8).astype(np.uint64)
            c = CLASS[b]
            if len(low) >= 3:
                self.marks[_hashed(low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16), 1 << 60)] = True
            if len(c) >= 5:
                code = c[:-4]
                for k in range(1, 5):
                    code = code | c[k : len(c) - 4 + k] << np.uint64(8 * k)
                self.marks[_hashed(code, 1 << 61)] = True
        words = raw.lower().split()
        same = np.array([x == y for x, y in zip(words, words[1:])], np.uint64)
        if len(same) >= 3:
            self.marks[_hashed(same[:-2] | same[1:-1] << np.uint64(1) | same[2:] << np.uint64(2), 1 << 62)] = True
        found = np.flatnonzero(self.marks)
        self.marks[found] = False
        return found


@dataclass
class Model:
    weights: np.ndarray  # ratio times weight, for each indicator
    ratios: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        return float(self.weights[x].sum() / np.sqrt((r * r).sum() + 1.0)) + self.bias / float(np.sqrt((r * r).sum() + 1.0))


def fit(rows: list[np.ndarray], y: np.ndarray, sizes: dict[int, int], epochs: int = 25, c: float = 4.0, seed: int = 7) -> Model:
    """NB-SVM by dual coordinate descent; a fifth of the rows only calibrates."""
    zero = np.zeros(SIZE)
    if len(set(y.tolist())) < 2:
        share = 0.5 if not sizes else sizes.get(1, 0) / sum(sizes.values())
        return Model(zero, zero, 0.0, 1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    for cls in (0, 1):
        mine = order[y[order] == cls]
        held[mine[: len(mine) // 5]] = True
    train = np.flatnonzero(~held)
    count = {cls: np.ones(SIZE) for cls in (0, 1)}  # smoothing
    for i in train:
        count[int(y[i])][rows[i]] += 1
    ratios = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    sign = np.where(y == 1, 1.0, -1.0)
    norm = {i: float(np.sqrt((ratios[rows[i]] ** 2).sum() + 1.0)) for i in range(len(y))}
    # both classes weigh alike; calibration restores their shares
    cost = {cls: c * len(train) / (2 * max(1, int((y[train] == cls).sum()))) for cls in (0, 1)}
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            x = rows[i]
            r = ratios[x] / norm[i]  # the scaled indicators have length 1 with the bias
            g = sign[i] * (float(w[x] @ r) + bias / norm[i]) - 1
            new = min(max(alpha[i] - g, 0.0), cost[int(y[i])])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * r
                bias += step / norm[i]
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    model = Model((w * ratios).astype(np.float64), ratios, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else train
    margin = np.array([model.margin(rows[i]) for i in check])
    model.a, model.b = labelled.platt(margin, y[check], labelled.class_weights(y[check], sizes))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    rows, sizes = labelled.sample(docs, labels, label, per_class, id_col, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for batch in batches:
            x = [of(t.as_py()).astype("<i4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    found = written(rows.mapInArrow(frugal(features), "doc_id long, y int, x binary"), "features")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, x = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            x += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], x[k]))  # the same model from any order of rows
        model = fit([np.frombuffer(x[k], "<i4") for k in order], np.array([y[k] for k in order], int), sizes)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task: at most 2 * per_class rows of at most 2**18 indices
    return pickle.loads(found.repartition(1).mapInArrow(frugal(fitted), "model binary").first()["model"])


def with_scores(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``docs`` and a double column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = Featurizer(), shared.value
        for batch in batches:
            margin = np.array([m.margin(of(t.as_py() or "")) for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labelled.score(margin, m.a, m.b), pa.float64())], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, label, per_class, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    out = with_scores(rows, model, "text", "score")
    return out.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    model = train(docs, labels, label, per_class, id_col, text_col)
    (name,) = fresh(docs, "score")
    return with_scores(docs, model, text_col, name).where(F.col(name) >= THRESHOLD).select(*[F.col(f"`{x}`") for x in docs.columns])
