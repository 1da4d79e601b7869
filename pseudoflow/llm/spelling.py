"""Spelling variants: words that differ by one character, grouped under the form that is much more frequent.

A gram dictionary says how far a gram reads: two characters, or three or four where the shorter gram stands in
more than ``list_max`` words (frequent grams are pruned away in favour of longer ones, rare ones keep their short
lists).  A word is decomposed into the variable gram at each start.  One edit can only affect the grams that
read the edited place; the most distinct grams that one edit can take from a word is its bound.  So two near
words share an unaffected gram among the bound + 1 rarest of either word, left or right of the edit, and only those
lists are merged.  What lies beyond an unaffected gram is unaffected too, so a list is split by the whole run of
characters from the word's end to the gram.  Every candidate is verified by its edit distance.  Grams are kept at every
start, covered or not: dropping covered ones would carry an edit's effect to grams that don't hold it.

Defined cases: null text has no words; a null id counts as empty in the edit rule; repeated rows count as often as
they stand; ties between near words go to the smallest in code-point order; an empty table gives an empty
result; extra columns are ignored.  Words shorter than ``2 * LONGEST - 1`` characters would have no bound, so
``min_length`` may not be less.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudoflow.llm.common import written

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LONGEST = 2, 4
#: Words or grams that a task counts before it passes them on.
HELD = 400_000
#: The table of list sizes has 2 ** LEVEL_BITS entries of 4 bits (8 MB), whatever the number of words; grams that
#: share an entry take the larger size, which only moves them back in the order.
LEVEL_BITS = 24


def planted(run: str, prefix: int, every: int) -> str:
    """The run, or the run without one character, by the crc32 of id and run."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, every: int | None) -> DataFrame:
    """word, n: occurrences of every run of letters of at least ``min_length``; ``every`` turns on the edit rule."""
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find, total = re.compile(f"[{LETTERS}]{{{min_length},}}").findall, Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                prefix = zlib.crc32(f"{key.as_py()}:".encode())
                lowered = text.as_py().encode().lower().decode()  # bytes: A-Z only
                for word, n in Counter(find(lowered)).items():
                    word = planted(word, prefix, every) if every else word
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                    total.clear()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, n: the number of words that hold each gram of SHORTEST to LONGEST characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                total.update({word[p : p + q] for q in range(SHORTEST, LONGEST + 1) for p in range(len(word) - q + 1)})
                if len(total) > HELD:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    return words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def frequent_grams(counts: DataFrame, list_max: int) -> set[str]:
    """Grams shorter than LONGEST that stand in more than ``list_max`` words.  The alphabet of 90 letters bounds
    them (90 ** 2 + 90 ** 3), however large the corpus."""
    found = counts.where((F.length("gram") < LONGEST) & (F.col("n") > list_max)).select("gram").toArrow()
    return set(found["gram"].to_pylist())


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << LEVEL_BITS) - 1)


def list_levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filled words (16 entries of 4 bits) of the table of binary logarithms of the list sizes; at most
    2 ** (LEVEL_BITS - 4) rows of 16 bytes reach the driver."""
    slot = F.crc32(F.encode("gram", "UTF-8")).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
    levels = counts.groupBy(slot.alias("slot")).agg(F.max(F.least(F.lit(15), F.floor(F.log2("n")))).cast("int").alias("level"))
    place = (F.col("slot").bitwiseAND(F.lit(15)) * 4).cast("int")
    words = levels.where("level > 0").select(F.shiftrightunsigned("slot", 4).alias("word"), F.call_function("shiftleft", F.col("level").cast("long"), place).alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return found["word"].to_numpy(), found["bits"].to_numpy().view(np.uint64)


def decompose(word: str, frequent: set[str]) -> tuple[dict[str, list[int]], int]:
    """Starts of each variable gram of ``word``, and the most grams that one edit can take from it."""
    starts: dict[str, list[int]] = {}
    reads = []
    for p in range(len(word) - SHORTEST + 1):
        end = p + SHORTEST
        while end - p < LONGEST and word[p:end] in frequent and end <= len(word):
            end += 1  # one past the word: the end was read
        gram = word[p : min(end, len(word))]
        starts.setdefault(gram, []).append(p)
        reads.append((gram, end))
    bound = 0
    for i in range(len(word)):
        hit = Counter(reads[p][0] for p in range(max(0, i - LONGEST), min(i + 1, len(reads))) if reads[p][1] > i)
        bound = max(bound, sum(n == len(starts[g]) for g, n in hit.items()))
    return starts, bound


def merged_lists(words: DataFrame, frequent: set[str], filled: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """run (its hash), word: the places of the bound + 1 rarest grams of each word, by the run that holds the gram and all beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def lists(runs: list[str], own: list[str]) -> pa.RecordBatch:
            hashes = np.fromiter((xxh64_intdigest(r.encode()) for r in runs), np.uint64, len(runs))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(own, pa.string())], names=["run", "word"])

        table = np.zeros(1 << (LEVEL_BITS - 4), np.uint64)
        table[filled[0]] = filled[1]
        levels: dict[str, int] = {}

        def rarity(gram: str) -> tuple[int, str]:
            if gram not in levels:
                if len(levels) > HELD:
                    levels.clear()
                slot = _slot(gram)
                levels[gram] = int(table[slot >> 4]) >> (slot & 15) * 4 & 15
            return levels[gram], gram

        for batch in batches:
            runs, own = [], []
            for word in batch.column(0).to_pylist():
                starts, bound = decompose(word, frequent)
                found = set()
                for gram in sorted(starts, key=rarity)[: bound + 1]:
                    for p in starts[gram]:
                        found |= {"<" + word[: p + len(gram)], ">" + word[p:]}
                runs += found
                own += [word] * len(found)
                if len(runs) > 100_000:
                    yield lists(runs, own)
                    runs, own = [], []
            yield lists(runs, own)

    return words.select("word").mapInArrow(run, "run long, word string")


def near_pairs(words: DataFrame, list_max: int = 64) -> DataFrame:
    """a, b (a < b): all pairs of the distinct ``word`` that are one edit apart."""
    counts = written(gram_counts(words), "grams")
    lists = written(merged_lists(words, frequent_grams(counts, list_max), list_levels(counts)), "gram-lists")
    met = lists.withColumnRenamed("word", "a").join(lists.withColumnRenamed("word", "b"), "run")
    met = met.where("a < b AND abs(length(a) - length(b)) <= 1")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2,
          ratio: int = 10, every: int | None = None, list_max: int = 64) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word.

    ``every`` deletes a character from the runs whose crc32 it divides (the contract's test rule; off by default).
    """
    if min_length < 2 * LONGEST - 1:
        raise ValueError(f"min_length is {2 * LONGEST - 1} at least")
    words = written(count_words(docs, id_col, text_col, min_length, every).where(F.col("n") >= min_count), "words")
    pairs = written(near_pairs(words, list_max), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    top = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    out = words.join(top, "word", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "formed")
    # counts grow tenfold a step, so the chains are short; each round doubles the length that is followed
    roots = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
