"""Best-fit packing of token pieces into sequences: a linear grouping scheme over the length histogram.

A length is at most ``capacity``, so the histogram of lengths is all that a plan needs and its size does
not depend on the corpus.  The plan rounds large lengths up within groups of equal cardinality, solves
the few-size problem over configurations (column generation), puts actual documents in the rounded
places, and gives what is left, in falling length, to the fullest sequence that still holds it.  The plan
is a list of runs: items a to b of one length go to sequences from s on, q to each.  Spark numbers
the pieces of a length and looks each one up.

Defined cases: null text counts as empty (one end token); repeated rows are packed like any others; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.llm.common import frugal, text_or_empty, written

CAPACITY = 4096
END_ID = 1
SALTS = 64
#: Words kept with their ids in a worker, and the text that is tokenized at once.
CACHE_WORDS, CHUNK_CHARS, LONG_WORD = 400_000, 1_000_000, 64

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])


#: ASCII punctuation at the end of a word, after a letter or digit: no token crosses that place.  An apostrophe
#: may start a contraction, a bar stands in the special tokens, and U+0130 ends in a mark once in lower case:
#: nothing is split off there.
TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|")


#: Characters that may stand between words that are tokenized together, if the vocabulary has them as words.
MARKS = "^~#%$"


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit integers, from a cache of words.

    The vocabulary's pre-tokenizer drops white space and no token crosses it, so a text's ids are those
    of its words in order.  The vocabulary has lower case only."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        # words and their parts; a full cache becomes the older one, from which what is met again comes back
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # a character that is a word and a token by itself: it stands between words that are tokenized together
        ids = {c: self._ids(c) for c in MARKS}
        self.mark = next((c for c, x in ids.items() if len(x) == 1 and self._ids(f"a {c} b") == self._ids("a") + x + self._ids("b")
                          and self.tok.id_to_token(x[0]) in (c, f"{c}</w>")), None)
        self.mark_id = ids[self.mark][0] if self.mark else None

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _tokenize(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts of words, many of them in one string; those that hold the mark go alone."""
        out: dict[bytes, bytes] = {}
        alone = parts if self.mark is None else [p for p in parts if self.mark.encode() in p]
        many = [] if self.mark is None else [p for p in parts if self.mark.encode() not in p]
        groups = [many[i : i + 1000] for i in range(0, len(many), 1000)]
        between = f" {self.mark} ".encode()
        for some, e in zip(groups, self.tok.encode_batch_fast([between.join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == self.mark_id)
            packed, cuts = ids.tobytes(), (4 * at).tolist()
            out.update(zip(some, [packed[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(packed)])]))
        for p, e in zip(alone, self.tok.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False)):
            out[p] = struct.pack(f"<{len(e)}I", *e.ids)
        return out

    def _learn(self, new: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not in the younger cache: a word is one itself or has known parts, or its parts are tokenized."""
        known, old, tail_of = self.known, self.old, TAIL
        out: dict[bytes, bytes] = {}
        split, ask = [], set()
        for w in new:
            if w in old:
                out[w] = old[w]
                continue
            low = w if b"|" in w else w.lower()
            head = low if b"|" in w else low.rstrip(tail_of)
            n = len(head)
            if n == len(low) or not n or n > LONG_WORD:
                head, tail = low, b""
            else:
                last = head[-1:] if head[-1] < 128 else head.decode()[-1]
                head, tail = (head, low[n:]) if last.isalnum() and last != "\u0130" else (low, b"")
            if not tail and head == w:
                ask.add(w)
                continue
            first = known.get(head) or old.get(head)
            second = (known.get(tail) or old.get(tail)) if tail else b""
            if first is not None and second is not None:
                out[w] = first + second
                continue
            split.append((w, head, tail))
            if first is None:
                ask.add(head)
            if second is None:
                ask.add(tail)
        got = self._tokenize(list(ask))
        got[b""] = b""
        for w, head, tail in split:
            out[w] = b"".join([got[p] if p in got else known.get(p) or old[p] for p in (head, tail)])
        out.update(got)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        words = [t.encode().split() for t in texts]
        found = [list(map(self.known.get, ws)) for ws in words]
        new: set[bytes] = set()
        for ws, ids in zip(words, found):
            if None in ids:
                new.update([w for w, x in zip(ws, ids) if x is None])
        learnt = self._learn(new)
        self.known.update([x for x in learnt.items() if len(x[0]) <= LONG_WORD])
        return [b"".join([learnt[w] if x is None else x for w, x in zip(ws, ids)]) if None in ids else b"".join(ids) for ws, ids in zip(words, found)]


@functools.lru_cache(maxsize=1)
def worker_tokenizer(path: str | None) -> WordTokenizer:
    """One for all tasks of a worker process, so that later tasks find the words of earlier ones."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
             tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, ids (null unless asked for)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    end = struct.pack("<I", end_id)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(k)
                texts.append(x.as_py())
                size += len(texts[-1])
                if size >= CHUNK_CHARS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_tokenizer(tokenizer)
        for ids, texts in chunks(batches):
            out: list[list] = [[] for _ in PIECES]
            for k, packed in zip(ids, words.encode(texts)):
                packed += end
                for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    row = (k, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=PIECES.names,
            )

    return rows.mapInArrow(frugal(run), PIECES)


def best_configuration(sizes: np.ndarray, gains: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` within ``capacity`` that gains most, by number of items and sum."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    levels, most = [], (0.0, np.zeros(len(sizes)))
    for level in range(int(capacity // sizes.min())):
        then, via = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, int)
        for i, s in enumerate(sizes):
            got = best[: capacity + 1 - s] + gains[i]
            better = got > then[s:] + 1e-12
            then[s:][better] = got[better]
            via[s:][better] = i
        levels.append(via)
        best = then
        at = int(best.argmax())
        if best[at] > most[0] + 1e-12:
            counts, c = np.zeros(len(sizes)), at
            for k in range(level, -1, -1):
                i = levels[k][c]
                counts[i] += 1
                c -= int(sizes[i])
            most = (float(best[at]), counts)
    return most


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Few-size packing as a linear programme, by column generation: configurations (columns) and their counts."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        gains = np.linalg.solve(basis.T, np.ones(n))
        value, column = best_configuration(sizes, gains, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return basis.astype(int), x


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 32, large: int | None = None) -> tuple[np.ndarray, int]:
    """Runs (length, first item, items, first sequence, items per sequence) for all lengths below ``capacity``, and the number
    of sequences.  ``counts[n]`` is the number of pieces of length n; lengths from ``large`` on are grouped."""
    large = large or capacity // 8
    runs: list[tuple[int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by what is free: (first sequence, sequences)
    n_seq = 0
    lengths = [n for n in range(capacity - 1, 0, -1) if counts[n]]
    big = [n for n in lengths if n >= large]
    total = int(sum(counts[n] for n in big))
    left: dict[int, list[tuple[int, int]]] = {n: [(0, int(counts[n]))] for n in lengths}

    if total >= 4 * groups:
        # equal cardinality; a length that fills several groups makes one
        each = -(-total // groups)
        queues: dict[int, list[list[int]]] = {}
        filled, size = 0, 0
        for n in big:
            first, todo = 0, int(counts[n])
            while todo:
                if filled % each == 0:
                    size = n
                take = min(todo, each - filled % each)
                queues.setdefault(size, []).append([n, first, take])
                filled, first, todo = filled + take, first + take, todo - take
            del left[n]
        sizes = np.array(list(queues))
        demand = np.array([sum(q[2] for q in queues[s]) for s in sizes], float)
        columns, x = configurations(sizes, demand, capacity)
        for j in range(columns.shape[1]):
            bins = int(x[j] + 1e-6)
            if not bins:
                continue
            free = np.array([[0, capacity]])  # from this sequence on, so much is free
            for i, s in enumerate(sizes):
                for _ in range(columns[i, j]):
                    at = 0
                    while at < bins and queues[int(s)]:
                        item = queues[int(s)][0]
                        take = min(item[2], bins - at)
                        runs.append((item[0], item[1], take, n_seq + at, 1))
                        free = _use(free, at, at + take, item[0], bins)
                        item[1], item[2], at = item[1] + take, item[2] - take, at + take
                        if not item[2]:
                            queues[int(s)].pop(0)
            ends = [*free[1:, 0], bins]
            for (a, f), b in zip(free, ends):
                room[int(f)].append((n_seq + int(a), int(b - a)))
            n_seq += bins
        for q in queues.values():
            for n, first, todo in q:
                left.setdefault(n, []).append((first, todo))

    some = np.array([bool(x) for x in room])
    for n in sorted(left, reverse=True):
        for first, todo in left[n]:
            while todo:
                r = n + int(some[n:].argmax())
                if not some[r]:
                    bins = -(-todo // (capacity // n))
                    room[capacity].append((n_seq, bins))
                    some[capacity] = True
                    n_seq += bins
                    continue
                start, bins = room[r].pop()
                per = r // n
                full = min(bins, todo // per)
                if full:
                    runs.append((n, first, full * per, start, per))
                    room[r - per * n].append((start, full))
                    some[r - per * n] = True
                    first, todo, start, bins = first + full * per, todo - full * per, start + full, bins - full
                if bins and 0 < todo < per:
                    runs.append((n, first, todo, start, todo))
                    room[r - todo * n].append((start, 1))
                    some[r - todo * n] = True
                    todo, start, bins = 0, start + 1, bins - 1
                if bins:
                    room[r].append((start, bins))
                some[r] = bool(room[r])
    return np.array(runs, np.int64).reshape(-1, 5), n_seq


def _use(free: np.ndarray, a: int, b: int, n: int, bins: int) -> np.ndarray:
    """Take n tokens from sequences a to b of a profile of runs."""
    cuts = sorted({*free[:, 0].tolist(), a, b} - {bins})
    at = np.searchsorted(free[:, 0], cuts, "right") - 1
    out = np.column_stack([cuts, free[at, 1]])
    out[(out[:, 0] >= a) & (out[:, 0] < b), 1] -= n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (null unless ``with_ids``)."""
    spark = docs.sparkSession
    pieces = written(tokenize(docs, id_col, text_col, capacity, end_id, tokenizer, with_ids), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))

    # items of a length are numbered within salts, so that a common length is not one task's
    salted = pieces.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    sizes = written(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in sizes.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[n] = c
    runs, _ = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)  # bounded by the capacity, not by the corpus

    def look_up(length: pd.Series, item: pd.Series) -> pd.Series:
        table = shared.value
        key = (table[:, 0] << 44) + table[:, 1]
        at = np.searchsorted(key, (length.to_numpy() << 44) + item.to_numpy(), "right") - 1
        return pd.Series(table[at, 3] + (item.to_numpy() - table[at, 1]) // table[at, 4])

    sequence = F.pandas_udf(look_up, T.LongType())
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most SALTS rows
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.drop("ids").withColumn("rank", F.row_number().over(order))
    ranked = ranked.join(F.broadcast(offsets), ["length", "salt"])  # at most capacity * SALTS rows
    placed = ranked.withColumn("item", F.col("skip") + F.col("rank") - 1).withColumn("sequence_id", sequence("length", "item"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "item")
    so_far = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = full.select(*columns).unionByName(placed.withColumn("offset", so_far).select(*columns))
    if with_ids:
        key = ["doc_id", "piece", "length", "ids_crc32"]
        ids = pieces.select(*[F.col(k).alias(f"k_{k}") for k in key], "ids").dropDuplicates([f"k_{k}" for k in key])
        on = out["doc_id"].eqNullSafe(ids["k_doc_id"])
        for k in key[1:]:
            on = on & (out[k] == ids[f"k_{k}"])
        return out.join(ids, on).select(*columns, "ids")
    return out
