"""Literal and gazetteer tables: which of very many values can occur in a row.

The values are a table, never part of the plan.  Each is known by one anchor: of its n-grams (of the largest of ``LENGTHS``
that it reaches, so that few texts share the anchor of a long value) the one in the fewest documents.  One pass over the texts counts the documents
of all the values' grams, a second one notes the anchors of each row; both look grams up in a bit filter of a fixed
size, whose false hits cost time only.  Rows with anchors meet the values in an equi-join; the exact check
follows (the masking fold, or ``instr``).  Nothing grows with documents x values, and rows without anchors don't move.

For case-insensitive values, texts and values are folded character by character so that all characters that Java's
``(?iu)`` equates fall together (characters whose case changes their number, and sigma, share one place).
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator, Optional

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.session import materialize

#: Gram lengths, in characters; a value uses the largest that isn't longer than itself.
LENGTHS = (1, 2, 3, 4, 5, 8, 16)
#: The gram filter has 2 ** SLOT_BITS words of 64 bits (16 MB), whatever the number of values.
SLOT_BITS = 21
#: Characters of texts that are hashed at once.
HELD = 1 << 17
_P = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _fold_table(fold: bool) -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint64)
    if fold:
        for c in range(0x110000):
            up = chr(c).upper()
            low = up.lower() if len(up) == 1 else ""
            out[c] = ord(low) if len(low) == 1 else 0xFFFF
        for c, to in zip("Kſİı", "ksii"):
            out[ord(c)] = ord(to)
        for c in "σςΣ":
            out[ord(c)] = 0xFFFF
        out = out[out]  # what folds to such a character is one too
    return out


def _gram_length(n: int) -> int:
    return max(k for k in LENGTHS if k <= n)


def _codes(text: str, fold: bool) -> np.ndarray:
    return _fold_table(fold)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h *= np.uint64(_P)
    h ^= h >> np.uint64(29)
    return h


def _windows(codes: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length a hash of each window of so many characters: that of two shorter windows that cover it, put together."""
    powers = {1: _mixed(codes ^ np.uint64(1))}
    for length in lengths:
        if len(codes) < length:
            yield length, np.zeros(0, np.uint64)
            continue
        k = 1
        while 2 * k <= length:
            if 2 * k not in powers:
                h = powers[k]
                powers[2 * k] = _mixed(h[:-k] * np.uint64(3) + h[k:] + np.uint64(2 * k))
            k *= 2
        if k < length:
            h, step = powers[k], length - k
            yield length, _mixed(h[:-step] * np.uint64(5) + h[step:] + np.uint64(length))
        else:
            yield length, powers[k]


def _parts(texts: list[Optional[str]]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about HELD characters (null: empty), each with the number of its first."""
    part: list[str] = []
    first = size = 0
    for k, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= HELD:
            yield first, part
            part, first, size = [], k + 1, 0
    if part:
        yield first, part


def _joined_windows(texts: list[str], lengths: Iterable[int], fold: bool, wanted=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, text number, gram of each window inside a text (of those that ``wanted`` says), the texts hashed as one string."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(texts)), sizes)
    for length, h in _windows(_codes("".join(texts), fold), lengths):
        at = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted(h))
        at = at[at + length <= ends[owner[at]]]
        yield length, owner[at], h[at]


def _place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = h * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (x >> np.uint64(20)) & np.uint64(63)


class _Filter:
    """Bit filter of gram hashes and the gram lengths in use; pickled as its filled words."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray, lengths: list[int], fold: bool):
        self.slots, self.bits, self.lengths, self.fold = slots, bits, lengths, fold
        self._dense: Optional[np.ndarray] = None

    def __getstate__(self):
        return {**self.__dict__, "_dense": None}

    def _has(self, h: np.ndarray) -> np.ndarray:
        slot, bit = _place(h)
        return (self._dense[slot] >> bit & np.uint64(1)).astype(bool)

    def found(self, texts: list[Optional[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and gram, in this order, of the distinct grams of each text that the filter has."""
        if self._dense is None:
            self._dense = np.zeros(1 << SLOT_BITS, np.uint64)
            self._dense[self.slots] = self.bits
        rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first, part in _parts(texts):
            hits = [x for x in _joined_windows(part, self.lengths, self.fold, self._has)]
            if hits:
                row, gram = (np.concatenate([x[k] for x in hits]) for k in (1, 2))
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                rows.append(row[new] + first)
                grams.append(gram[new])
        return np.concatenate(rows), np.concatenate(grams)


def _filter_of(grams: DataFrame, fold: bool) -> _Filter:
    """``grams`` has gram (hash) and length (one of LENGTHS); at most 2 ** SLOT_BITS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, bit = _place(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((np.uint64(1) << bit).view(np.int64)),
                                              pa.array(np.int64(1) << batch.column(1).to_numpy())], names=["slot", "bits", "lengths"])

    placed = grams.select("gram", "length").mapInArrow(run, "slot long, bits long, lengths long")
    words = placed.groupBy("slot").agg(F.bit_or("bits").alias("bits"), F.bit_or("lengths").alias("lengths")).toArrow()
    used = int(np.bitwise_or.reduce(words["lengths"].to_numpy(), initial=0))
    return _Filter(words["slot"].to_numpy(), words["bits"].to_numpy().view(np.uint64), [k for k in LENGTHS if used >> k & 1], fold)


def _value_grams(values: DataFrame, fold: bool) -> DataFrame:
    """id, gram, length: every gram of every value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            reached = np.array([_gram_length(len(v)) for v in values], np.int64)
            for length in np.unique(reached).tolist():
                mine = np.flatnonzero(reached == length)
                for _, row, gram in _joined_windows([values[k] for k in mine], [length], fold):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine[row]]), pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), length))],
                                                     names=["id", "gram", "length"])

    return values.select("id", "value").mapInArrow(run, "id long, gram long, length long")


def _document_counts(texts: DataFrame, known: _Filter) -> DataFrame:
    """gram, df: documents that hold it, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = np.unique(known.found(batch.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "df"])

    return texts.mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def anchors(values: DataFrame, texts: DataFrame, fold: bool) -> DataFrame:
    """id, gram, length: the gram of each value that is in the fewest texts (ties: the least hash)."""
    grams = materialize(_value_grams(values, fold))
    counts = _document_counts(texts, _filter_of(grams, fold))
    rated = grams.join(counts, "gram", "left")
    best = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "length")).alias("best")
    # a value whose rarest gram is in no text can't occur
    return rated.groupBy("id").agg(best).where("best.df > 0").select("id", "best.gram", "best.length")


def candidates(df: DataFrame, values: DataFrame, text_col: str, fold: bool, fields: list[str], out_col: str,
               by: Optional[str] = None) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` with an array ``out_col`` of the values that may occur, rows without any).

    ``values`` has value (not empty) and ``fields``; the array holds structs of ``fields``.  With ``by`` (a column of both) a
    row meets the values of its own group only.  Rows are checkpointed with their anchors.
    """
    group = [by] if by else []
    values = materialize(values.withColumn("id", F.monotonically_increasing_id()))
    own = materialize(anchors(values, df.select(F.col(text_col).cast("string")), fold))
    known = _filter_of(own, fold)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("_grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, gram = known.found(batch.column(at).to_pylist())
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))], names=schema.names)

    # noted once: rows with and without anchors are read from it, the latter as they are
    noted = materialize(df.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    rows = noted.where(F.size("_grams") > 0)
    owned = own.select("id", "gram").join(values.select("id", *group, F.struct(*fields).alias("v")), "id").drop("id")
    listed = rows.select("_row", *group, F.explode("_grams").alias("gram")).join(owned, ["gram", *group]).groupBy("_row").agg(F.collect_list("v").alias(out_col))
    some = rows.drop("_grams").join(listed, "_row", "left").drop("_row")
    return some, noted.where(F.size("_grams") == 0).drop("_grams", "_row")


def with_row_literals(df: DataFrame, literals: DataFrame, text_col: str = "text", value_col: str = "value",
                      order_col: Optional[str] = None, out_col: str = "_literals") -> DataFrame:
    """M2: ``df`` and the literals of the table that may occur in each row, for ``literals_col`` of the masking calls.

    They keep their order (``order_col``, else by value), which breaks ties of length.  Null and empty literals and repeats drop out.
    """
    rank = F.col(order_col) if order_col else F.lit(0)
    values = literals.select(F.col(value_col).cast("string").alias("value"), rank.alias("rank")).where("length(value) > 0")
    values = values.groupBy("value").agg(F.min("rank").alias("rank"))
    some, none = candidates(df, values, text_col, True, ["rank", "value"], out_col)
    in_order: Column = F.transform(F.array_sort(F.coalesce(F.col(out_col), F.array().cast(some.schema[out_col].dataType))), lambda x: x["value"])
    return some.withColumn(out_col, in_order).unionByName(none.withColumn(out_col, F.array().cast("array<string>")))
