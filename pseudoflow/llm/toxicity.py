"""Toxicity: embeddings of subwords, averaged over a window of words, into a linear softmax, trained jointly.

A word's subwords are itself and its character 3- to 5-grams with word ends, hashed to 2**16 vectors, so a
misspelling shares most vectors with the word.  A text's score is that of its worst window of ``WINDOW``
words (windows overlap by half), so a few words in a long text are not averaged away.  Labels hold for
texts, not windows: after two epochs over all windows, only the worst window of a toxic text counts as
toxic.  The model is fitted in one task to at most ``per_class`` labelled rows of each class (documented
bound), to every window of theirs: only word numbers are held, a batch's subwords are looked up when it is
its turn.  Every word of every row is scored.

As the average and the layer are linear, scoring needs one number for each subword, and a word's sum is
kept in the worker.

Defined cases: as for the quality classifier; a text without words scores by the bias alone.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from array import array
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudoflow.llm import labelled
from pseudoflow.llm.common import text_or_empty, written

BUCKETS, DIM, WINDOW = 1 << 16, 4, 6
PER_CLASS = 1500
THRESHOLD = 0.5
CACHE_WORDS, LONG_WORD = 400_000, 64
WORDS = re.compile(r"[^\W_]+")


def subwords(word: str) -> np.ndarray:
    """Buckets of a word and of its 3- to 5-grams."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return np.array([zlib.crc32(g.encode()) % BUCKETS for g in grams], np.int64)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def starts(n: int) -> range:
    """First words of the windows over n words; the last window is whole if the text is long enough."""
    return range(0, max(1, n - WINDOW // 2), WINDOW // 2)


@dataclass
class Model:
    values: np.ndarray  # a number for each subword: its vector times the difference of the softmax rows
    bias: float
    a: float
    b: float


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def word(self, w: str) -> tuple[float, int]:
        got = self.cache.get(w)
        if got is None:
            ids = subwords(w)
            got = float(self.model.values[ids].sum()), len(ids)
            if len(w) <= LONG_WORD:
                self.cache[w] = got
        return got

    def margin(self, text: str) -> float:
        """The worst window's."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found = [self.word(w) for w in words_of(text)]
        if not found:
            return self.model.bias
        sums = np.cumsum(np.vstack([[(0.0, 0)], np.array(found)]), axis=0)
        first = np.array(starts(len(found)))
        last = np.minimum(first + WINDOW, len(found))
        return float(((sums[last, 0] - sums[first, 0]) / (sums[last, 1] - sums[first, 1])).max()) + self.model.bias


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., n[k] numbers for each k, end to end."""
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(first - ends + n, n)


def _firsts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


class Windows:
    """All windows of some texts, as places in one run of word numbers; those of text k are of[k] to of[k + 1]."""

    def __init__(self, texts: list[str]):
        vocabulary: dict[str, int] = {}
        grams, words = array("H"), array("i")
        gram_first, gram_n, first, n, of = array("q"), array("i"), [], [], [0]
        for text in texts:
            at = len(words)
            for w in words_of(text):
                k = vocabulary.setdefault(w, len(vocabulary))
                if k == len(gram_n):
                    ids = subwords(w)
                    gram_first.append(len(grams))
                    gram_n.append(len(ids))
                    grams.frombytes(ids.astype(np.uint16).tobytes())
                words.append(k)
            if len(words) > at:
                lo = np.array(starts(len(words) - at), np.int64) + at
                first.append(lo)
                n.append(np.minimum(WINDOW, len(words) - lo).astype(np.int8))
            of.append(of[-1] + (len(first[-1]) if len(words) > at else 0))
        self.words, self.grams = np.array(words, np.int32), np.array(grams, np.uint16)
        self.gram_first, self.gram_n = np.array(gram_first, np.int64), np.array(gram_n, np.int64)
        self.first, self.n = np.concatenate([np.zeros(0, np.int64), *first]), np.concatenate([np.zeros(0, np.int8), *n])
        self.of = np.array(of)

    def batch(self, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows ``some``: the distinct words' buckets, end to end, and how many each word has; each window
        word's place among the distinct words; how many words and how many buckets each window has."""
        n = self.n[some].astype(np.int64)
        w = self.words[_ranges(self.first[some], n)]
        distinct, place = np.unique(w, return_inverse=True)
        of_word = self.gram_n[distinct]
        ids = self.grams[_ranges(self.gram_first[distinct], of_word)].astype(np.int64)
        return ids, of_word, place, n, np.add.reduceat(of_word[place], _firsts(n))

    def worst(self, text: int, values: np.ndarray) -> int:
        """The window of a text whose subwords have the largest mean of ``values``; of equal ones the first."""
        some = np.arange(self.of[text], self.of[text + 1])
        w = self.words[self.first[some[0]] : self.first[some[-1]] + self.n[some[-1]]]
        n = self.gram_n[w]
        sums = np.add.reduceat(values[self.grams[_ranges(self.gram_first[w], n)]], _firsts(n))
        sums, n = np.r_[0, np.cumsum(sums)], np.r_[0, np.cumsum(n)]
        lo = self.first[some] - self.first[some[0]]
        hi = lo + self.n[some]
        return int(some[np.argmax((sums[hi] - sums[lo]) / (n[hi] - n[lo]))])


def fit(texts: list[str], y: np.ndarray, sizes: dict[int, int], epochs: int = 5, rate: float = 0.25, batch: int = 128, seed: int = 11) -> Model:
    """Vectors and softmax together, by Adagrad on mini-batches."""
    if len(set(y.tolist())) < 2:
        share = 0.5 if not sizes else sizes.get(1, 0) / sum(sizes.values())
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    rng = np.random.default_rng(seed)
    dealt = rng.permutation(len(texts))
    windows = Windows([texts[i] for i in dealt])
    toxic = [k for k, i in enumerate(dealt) if y[i] == 1 and windows.of[k] < windows.of[k + 1]]
    is_toxic = np.repeat(y[dealt] == 1, np.diff(windows.of))
    clean = np.flatnonzero(~is_toxic)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, offset = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    seen_v, seen_l, seen_o = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(epochs):
        if epoch < 2:
            positive = np.flatnonzero(is_toxic)
        else:  # the worst window of each toxic text
            v = vectors @ (layer[:, 1] - layer[:, 0])
            positive = np.array([windows.worst(k, v) for k in toxic], np.int64)
        items = np.r_[positive, clean]
        target = np.r_[np.ones(len(positive), int), np.zeros(len(clean), int)]
        weight = np.where(target == 1, 0.5 / max(1, len(positive)), 0.5 / max(1, len(clean))) * len(items)
        weight = np.minimum(weight, 10.0)
        order = rng.permutation(len(items))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            ids, of_word, place, words, n = windows.batch(items[some])
            sums = np.add.reduceat(vectors[ids], _firsts(of_word), axis=0)
            mean = np.add.reduceat(sums[place], _firsts(words), axis=0) / n[:, None]
            z = mean @ layer + offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), target[some]] -= 1
            p *= weight[some, None]
            g_layer, g_offset = mean.T @ p / len(some), p.mean(axis=0)
            back = (p @ layer.T) / n[:, None]
            row = np.repeat(np.arange(len(some)), words)
            per_word = [np.bincount(place, back[row, d], len(of_word)) for d in range(DIM)]
            touched, at_touched = np.unique(ids, return_inverse=True)
            g = np.column_stack([np.bincount(at_touched, np.repeat(x, of_word), len(touched)) for x in per_word])
            seen_v[touched] += (g**2).mean(axis=1)
            vectors[touched] -= rate * g / np.sqrt(seen_v[touched])[:, None] * 0.2
            seen_l += g_layer**2
            seen_o += g_offset**2
            layer -= 0.05 * g_layer / np.sqrt(seen_l)
            offset -= 0.05 * g_offset / np.sqrt(seen_o)
    model = Model(vectors @ (layer[:, 1] - layer[:, 0]), float(offset[1] - offset[0]), 1.0, 0.0)
    scorer = Scorer(model)
    margin = np.array([scorer.margin(t) for t in texts])
    model.a, model.b = labelled.platt(margin, y, labelled.class_weights(y, sizes))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    rows, sizes = labelled.sample(docs, labels, label, per_class, id_col, text_col)
    rows = written(rows, "toxicity-sample")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, t, k) for batch in batches for i, k, t in zip(*[c.to_pylist() for c in batch.columns]))
        model = fit([t for _, t, _ in found], np.array([k for _, _, k in found], int), sizes)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task: at most 2 * per_class texts
    return pickle.loads(rows.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


@functools.lru_cache(maxsize=1)
def _worker_scorer(packed: bytes) -> Scorer:
    """One for all tasks of a worker process that use this model."""
    return Scorer(pickle.loads(packed))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(docs, labels, label, per_class, id_col, text_col)))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _worker_scorer(shared.value)
        for batch in batches:
            margin = np.array([scorer.margin(t.as_py()) for t in batch.column(1)])
            scores = labelled.score(margin, scorer.model.a, scorer.model.b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
