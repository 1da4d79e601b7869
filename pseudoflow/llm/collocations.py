"""Phrase collocations: phrases of 2 to ``order`` words whose parts occur together more often than alone.

Counting goes by top-order marginalisation.  Inside a task the words of a language lie in one column and its
leads; a row is the longest window that starts at a word, padded where its piece ends.  Only windows are
counted; Spark's ROLLUP then sums them over ever shorter prefixes, so the count of a phrase is that of the
windows that start with it, and no shorter n-gram is ever exploded.  It runs three times: windows of two words give
the counts of words and pairs, windows of three those of triples, windows of ``order`` words all longer ones.  The
second and third time a window ends where a pair (a triple) is rarer than ``min_count``, since no phrase across it
can be frequent.  Frequent ones are known by a bit filter of a fixed size, whose false hits only lengthen
windows.  A task counts equal windows before it passes them on.

Defined cases: null text counts as empty and gives nothing; a null language is ``und``, an empty one is a
language of its own; repeated rows count as often as they stand; ids are not used; an empty table gives an
empty result; extra columns are ignored.  Ties in the order end with the phrase, so ranks are definite.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pseudoflow.llm.common import written

PIECE_MARKS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(bytes(range(65, 91)) + PIECE_MARKS + b"\t", bytes(range(97, 123)) + b"\n" * len(PIECE_MARKS) + b" ")
#: Words that a task holds before it counts them; counted windows that it holds; characters of a text that are split at once.
HELD, HELD_WINDOWS, SLICE = 1 << 19, 1 << 18, 1 << 20
#: The filter of frequent grams has 2 ** SLOT_BITS words of 64 bits (16 MB), whatever the corpus.
SLOT_BITS = 21
MARK, FIRST = 1, 2  # ids: 0 nothing, 1 end of a piece, words from 2


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """Words and marks of ``text``, cut at marks about every SLICE bytes."""
    text, at = text.translate(TABLE), 0
    while at < len(text):
        end = text.find(b"\n", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def _slots(lang: bytes, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place in the filter (word, bit) of each gram of word hashes."""
    import xxhash

    x = np.full(len(words[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for h in words:
        x = (x ^ h) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64), x & np.uint64(63)


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class _Column:
    """The words of one language that a task holds."""

    def __init__(self) -> None:
        self.words = _Vocabulary({b"": 0, b"\n": MARK})
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        for part in _parts(text):
            got = np.fromiter(map(self.words.__getitem__, part), np.int32, len(part))
            self.ids.append(got[got > 0])
            self.size += len(got)
        self.ids.append(np.array([MARK], np.int32))

    def windows(self, lang: bytes, order: int, known: int, filled: np.ndarray | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, distinct padded windows (rows of places in the words) and their counts; only windows of more than
        ``known`` words, all of whose grams of ``known`` words are in the filter (0: every window)."""
        x, words = np.concatenate(self.ids).astype(np.int64), list(self.words)
        size = max(known, 1)
        whole = np.zeros(len(x), bool)  # a gram of ``size`` words starts here, and is frequent
        n = max(len(x) - size + 1, 0)
        whole[:n] = np.all([x[k : k + n] >= FIRST for k in range(size)], axis=0)
        if filled is not None:
            h = _hashes(words)[x]
            slot, bit = _slots(lang, [h[k : k + n] for k in range(size)])
            whole[:n] &= (filled[slot] >> bit & np.uint64(1)).astype(bool)
        at = np.flatnonzero(whole & np.r_[whole[1:], False] if filled is not None else whole)
        last, open_, lead = len(x) - 1, np.ones(len(at), bool), []
        for k in range(order):
            if k >= size:
                open_ &= whole[np.minimum(at + k - size + 1, last)]
            lead.append(np.where(open_, x[np.minimum(at + k, last)], 0))
        rows, n = _distinct(np.column_stack(lead), np.ones(len(at), np.int64), len(words))
        return words, rows, n


def _distinct(rows: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers below ``top`` and the sums of their counts."""
    if not len(rows):
        return rows, n
    key = rows[:, 0]
    for k in range(1, rows.shape[1]):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + rows[:, k]
    _, first, own = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], np.bincount(own, weights=n).astype(np.int64)


class _Counted:
    """Counted windows of one language, merged until they are passed on."""

    def __init__(self, order: int) -> None:
        self.order, self.words = order, _Vocabulary({b"": 0})
        self.rows, self.n = np.zeros((0, order), np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes], rows: np.ndarray, n: np.ndarray) -> None:
        used = np.unique(rows)
        place = np.zeros(len(words), np.int64)
        place[used] = [self.words[words[i]] for i in used]
        self.rows, self.n = _distinct(np.concatenate([self.rows, place[rows]]), np.concatenate([self.n, n]), len(self.words))

    def batch(self, lang: bytes) -> pa.RecordBatch:
        known = pa.array(list(self.words), pa.binary())
        cols = [known.take(pa.array(self.rows[:, k])) for k in range(self.order)]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(self.n), pa.binary()), *cols, pa.array(self.n)], names=["lang", *_names(self.order), "n"])


def _names(order: int) -> list[str]:
    return [f"w{k + 1}" for k in range(order)]


def _dense(filled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(1 << SLOT_BITS, np.uint64)
    out[filled[0]] = filled[1]
    return out


def windows(texts: DataFrame, order: int, known: int = 0, filled: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """lang, w1 .. w<order> (padded with empty), n: counted windows of each task; needs binary ``lang`` and ``text``.

    ``filled`` is the filter of the frequent grams of ``known`` words; shorter windows than ``known`` + 1 are left out then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = None if filled is None else _dense(filled)
        held: dict[bytes, _Column] = {}
        counted: dict[bytes, _Counted] = {}

        def count() -> Iterator[pa.RecordBatch]:
            for key, column in held.items():
                counted.setdefault(key, _Counted(order)).add(*column.windows(key, order, known, dense))
            held.clear()
            if sum(len(c.n) for c in counted.values()) > HELD_WINDOWS:
                yield from rest()

        def rest() -> Iterator[pa.RecordBatch]:
            yield from (c.batch(key) for key, c in counted.items())
            counted.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                mine = held.setdefault(lang.as_py(), _Column())
                before = mine.size
                mine.add(text.as_py())
                size += mine.size - before
                if size > HELD:
                    yield from count()
                    size = 0
        yield from count()
        yield from rest()

    kinds = ", ".join(f"{x} binary" for x in ["lang", *_names(order)])
    return texts.select("lang", "text").mapInArrow(run, f"{kinds}, n long")


def rolled_up(counted: DataFrame, order: int, least: int) -> DataFrame:
    """lang, words (array of 0 to ``order``), f: sums over all prefixes of the windows; beyond no words only f >= least."""
    names = _names(order)
    cols = ", ".join(names)
    sums = counted.sparkSession.sql(
        f"SELECT lang, {cols}, sum(n) AS f, {order} - bit_count(grouping_id()) AS k FROM {{t}} GROUP BY lang, ROLLUP ({cols})", t=counted)
    sums = sums.where((F.col("k") == 0) | (F.col("f") >= least))
    words = F.slice(F.array(*[F.col(x).cast("string") for x in names]), 1, F.col("k"))
    out = sums.select(F.col("lang").cast("string").alias("lang"), words.alias("words"), F.col("f").cast("long").alias("f"))
    return out.where(~F.array_contains("words", F.lit("")))  # a padded prefix is counted as the shorter phrase


def gram_filter(grams: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Filled words of the filter of these grams of ``size`` words: at most 2 ** SLOT_BITS rows of 16 bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, *words = (c.to_pylist() for c in batch.columns)
            hashed, slots, bits = [_hashes(w) for w in words], [], []
            for key in set(lang):
                at = np.array([x == key for x in lang])
                slot, bit = _slots(key, [h[at] for h in hashed])
                slots.append(slot)
                bits.append((np.uint64(1) << bit).view(np.int64))
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots)), pa.array(np.concatenate(bits))], names=["slot", "bits"])

    rows = grams.where(F.size("words") == size).select(F.col("lang").cast("binary"), *[F.col("words")[k].cast("binary").alias(f"w{k}") for k in range(size)])
    found = rows.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    return found["slot"].to_numpy(), found["bits"].to_numpy().view(np.uint64)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 5, min_count: int = 100,
         contained: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    A phrase goes if a longer candidate that holds its words has at least ``contained`` percent of its count.
    """
    if order < 2:
        raise ValueError("a phrase has two words at least")
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).cast("binary").alias("lang"),
                        F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    low = written(rolled_up(windows(texts, 2), 2, min_count), "words-and-pairs")
    known, size = low.where("size(words) > 0"), 2
    for longer in sorted({min(3, order), order} - {2}):
        more = rolled_up(windows(texts, longer, size, gram_filter(known, size)), longer, min_count).where(F.size("words") > size)
        known, size = written(known.unionByName(more), "phrases"), longer
    known = known.select("lang", "words", F.array_join("words", " ").alias("phrase"), "f")
    found = known.where("size(words) > 1")

    def part(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    counts = known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part"))
    cuts = found.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut"))
    cuts = cuts.withColumn("part", part(F.lit(1), F.col("cut"))).join(counts, ["lang", "part"]).withColumnRenamed("of_part", "l")
    cuts = cuts.withColumn("part", part(F.col("cut") + 1, F.size("words"))).join(counts, ["lang", "part"]).withColumnRenamed("of_part", "r")
    totals = low.where("size(words) = 0").select("lang", F.col("f").alias("n"))
    wide = "CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(wide))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    spans = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))")
    inner = found.where("size(words) > 2").select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase"))
    holders = inner.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = best.join(holders, ["lang", "phrase"], "left").where(f"held IS NULL OR 100 * held < {int(contained)} * a")
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order_by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order_by)
    kept = kept.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= top)  # 32 x top rows a language go on
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order_by)).cast("long"))
    return kept.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows with plain n-gram lists.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM listed, (SELECT unnest([1, 2, 3, 4, 5]) AS k) ks WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cands AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cands),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1 : c.k], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT lang, part AS phrase, max(a) AS held FROM (
    SELECT lang, a, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(ws[i : i + j - 1], ' '))) AS part
    FROM cands, (SELECT unnest([2, 3, 4]) AS j) js WHERE j < k) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.held IS NULL OR 100 * h.held < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
