"""Repeated passages: bytes covered by a string of ``length`` bytes that also starts elsewhere are removed.

Shards' sorted suffixes are merged by refining their interleave, block by block, instead of sorting all
suffixes again.  So that one task never needs the whole corpus, strings are dealt by content first: each
string of ``length`` bytes is owned by the smallest hash among its substrings of a fifth of that length
(leftmost if equal), so equal strings have equal owners.  The strings of one owner at one place form a
context of about 560 bytes.  Contexts that are equal throughout need no sorting; the distinct contexts of an owner that has
several go to one bucket, where the transforms of its shards are merged:

* a shard sorts its suffixes by their first eight bytes; the shards' orders are interleaved by block;
* one step stably places the merged suffixes by the block of the h bytes before each (the transform's symbol
  at depth h), which orders the suffixes h further left by 2h bytes without comparing any;
* at full depth, blocks of two or more suffixes are the repeated intervals.

An owner with more than ``crowd`` distinct contexts, such as a passage in a third of all documents, is not
one task's: its strings are counted by digest, with partial aggregation.

Defined cases: null text counts as empty; texts shorter than ``length`` keep all bytes; equal rows are each
other's repeats; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudoflow.llm.common import parted, sieve, text_or_empty, written

LENGTH = 400
BLOCK = 1 << 19  # strings of a text that are looked at together
SHARD_BYTES, BUCKET_BYTES, CROWD = 1 << 20, 3 << 20, 4096
ODD = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2**64."""
    if n not in _POWERS:
        both = []
        for base in (ODD, pow(ODD, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS.clear()
        _POWERS[n] = (both[0], both[1])
    return _POWERS[n]


def owners(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (owner hash, first string, last string), block by block, over all strings of ``length`` bytes."""
    short = max(1, length // 5)
    width = length - short + 1  # short substrings in a string
    up, down = _powers(BLOCK + length)
    for at in range(0, len(data) - length + 1, BLOCK):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, BLOCK + length - 1), at).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        h = (sums[short:] - sums[:-short]) * down[: len(part) - short + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        n = len(h) - width + 1
        keyed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # leftmost of equals
        rows = -(-len(keyed) // width)
        table = np.full(rows * width, ~np.uint64(0))
        table[: len(keyed)] = keyed
        table = table.reshape(rows, width)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        owner = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1]
        yield h[owner[first]].view(np.int64), first + at, np.r_[first[1:], n] - 1 + at


def merged_order(shards: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Interleave shards' positions, each sorted by code: merged by the place of each code among the others'."""
    order = shards[0]
    for other in shards[1:]:
        a, b = codes[order], codes[other]
        out = np.empty(len(a) + len(b), order.dtype)
        to_b = np.searchsorted(a, b, "right") + np.arange(len(b))
        mine = np.ones(len(out), bool)
        mine[to_b] = False
        out[to_b], out[mine] = other, order
        order = out
    return order


def repeated_strings(contexts: list[bytes], places: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Marks, over the joined contexts, of starts of strings that start elsewhere too.  ``places`` is the number
    of places of a context, 1 or more."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    n = int(ends[-1])
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes up to the context's end
    codes = np.zeros(n, np.uint64)
    for k in range(8):
        codes = codes << np.uint64(8) | text[k : n + k]
    depth = min(8, length)
    codes >>= np.uint64(8 * (8 - depth))
    # shards are runs of whole contexts
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= shard_bytes or e == n:
            cuts.append(e)
    shards = []
    for a, b in zip(cuts, cuts[1:]):
        own = np.flatnonzero(left[a:b] >= depth).astype(np.int32) + np.int32(a)
        if len(own):
            shards.append(own[np.argsort(codes[own], kind="stable")])
    marks = np.zeros(n, bool)
    if not shards:
        return marks
    order = merged_order(shards, codes)
    c = codes[order]
    block = np.zeros(n, np.int32)
    block[order] = np.cumsum(np.r_[True, c[1:] != c[:-1]])
    del codes, c
    first = np.repeat(ends - sizes, sizes)
    while depth < length:
        step = min(depth, length - depth)
        # suffixes that have a whole block before them in their context, in merged order
        have = order[order - step >= first[order]]
        symbol = block[have - step]
        placed = np.argsort(symbol, kind="stable")
        symbol, have = symbol[placed], have[placed]
        after = block[have]
        order = have - np.int32(step)
        block = np.zeros(n, np.int32)
        block[order] = np.cumsum(np.r_[True, (symbol[1:] != symbol[:-1]) | (after[1:] != after[:-1])][: len(order)])
        depth += step
    count = np.bincount(block[order], np.repeat(places, sizes)[order])
    marks[order] = count[block[order]] > 1
    return marks


def covered(marks: np.ndarray, length: int = LENGTH) -> list[dict]:
    """Byte ranges covered by the marked strings."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    new = np.r_[True, at[1:] > at[:-1] + length]
    starts = at[new]
    stops = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1]] + length
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts, stops)]


RANGES = "array<struct<a: int, b: int>>"
PA_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _verdicts(contexts: DataFrame, length: int, crowd: int) -> DataFrame:
    """(h, c, ranges) for contexts (h, c, places, n_contexts, context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by owner; whole owners are gathered up to a bucket's size."""

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            marks = repeated_strings([r[3] for r in rows], np.array([r[2] for r in rows]), length)
            ends = np.cumsum([len(r[3]) for r in rows])
            ranges = [covered(marks[e - len(r[3]) : e], length) for e, r in zip(ends, rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(ranges, PA_RANGES)],
                names=["h", "c", "ranges"],
            )

        held, size = [], 0
        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns]):
                if size >= BUCKET_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    few = contexts.where(F.col("n_contexts") <= crowd).select("h", "c", "places", "context")
    dealt = few.repartition("h").sortWithinPartitions("h", "c")
    sorted_out = dealt.mapInArrow(run, f"h long, c long, ranges {RANGES}")

    many = contexts.where(F.col("n_contexts") > crowd)
    strings = many.select("h", "c", "places", F.posexplode(F.expr(
        f"transform(sequence(0, octet_length(context) - {length}), i -> md5(substring(context, i + 1, {length})))")).alias("at", "md5"))
    again = strings.groupBy("h", "md5").agg(F.sum("places").alias("n")).where("n > 1").select("h", "md5")
    marked = strings.join(again, ["h", "md5"]).groupBy("h", "c").agg(F.collect_list("at").alias("ats"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = []
            for ats in batch.column(2):
                marks = np.zeros(max(x := ats.as_py()) + 1, bool)
                marks[x] = True
                ranges.append(covered(marks, length))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranges, PA_RANGES)], names=["h", "c", "ranges"])

    return sorted_out.unionByName(marked.mapInArrow(joined, f"h long, c long, ranges {RANGES}"))


def repeated_ranges(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(key, ranges): what to remove from the texts with this key; needs key (hash of the text) and text."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hs, los, his, cs = [], [], [], [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = x.as_py().encode()
                for h, lo, hi in owners(data, length):
                    keys.append(np.full(len(h), key, np.int64))
                    hs.append(h)
                    los.append(lo)
                    his.append(hi)
                    cs.append(np.array([xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64))
            if keys:
                out = [np.concatenate(v) for v in (keys, hs, cs)] + [np.concatenate(v).astype(np.int32) for v in (los, his)]
                out[2] = out[2].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["key", "h", "c", "lo", "hi"])

    found = written(rows.select("key", "text").where(F.octet_length("text") >= length).mapInArrow(anchors, "key long, h long, c long, lo int, hi int"), "anchors")
    # copies of a row emit the same place twice; their text is repeated, so the key counts as two places
    place = F.struct("key", "lo", "hi")
    alike = found.groupBy("h", "c").agg(F.min(place).alias("p"), F.max(place).alias("q"))
    alike = alike.select("h", "c", "p", F.when(F.col("p") == F.col("q"), 1).otherwise(2).alias("places"))
    per = alike.groupBy("h").agg(F.count(F.lit(1)).alias("n_contexts"), F.max("places").alias("most")).where("n_contexts > 1 or most > 1")
    alike = written(alike.join(per, "h").select("h", "c", "p", "places", "n_contexts"), "contexts")

    alone = alike.where("n_contexts = 1").select(
        "h", "c", F.array(F.struct(F.lit(0).alias("a"), (F.col("p.hi") - F.col("p.lo") + length).alias("b"))).cast(RANGES).alias("ranges")
    )
    # of each distinct context the bytes at one place
    want = alike.where("n_contexts > 1").select(F.col("p.key").alias("want"), F.struct("h", "c", "places", "n_contexts", "p.lo", "p.hi").alias("w"))
    want = written(want.groupBy("want").agg(F.collect_list("w").alias("ws")), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for x, ws in zip(batch.column(0), batch.column(1)):
                data = x.as_py().encode()
                for w in ws.as_py():
                    for column, value in zip(out, (w["h"], w["c"], w["places"], w["n_contexts"], data[w["lo"] : w["hi"] + length])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                names=["h", "c", "places", "n_contexts", "context"],
            )

    # copies of a row give the same contexts; one of each is kept
    some = sieve(rows, rows["key"], want.select("want"))
    bytes_of = some.join(want, some["key"] == want["want"]).select("text", "ws")
    contexts = bytes_of.mapInArrow(cut, "h long, c long, places int, n_contexts long, context binary").dropDuplicates(["h", "c"])
    verdict = written(_verdicts(written(contexts, "bytes"), length, crowd).where("size(ranges) > 0").unionByName(alone), "verdicts")
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["b"] + F.col("lo")).alias("b")))
    # copies of a row emit the same ranges; one of each is kept
    place_of = F.xxhash64("h", "c")
    hits = sieve(found, place_of, verdict.select(place_of.alias("place"))).join(verdict, ["h", "c"]).select("key", moved.alias("ranges")).distinct()
    return hits.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD,
           with_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes, null unless asked for)."""
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    # all of a text is repeated if it stands in two rows
    copies = rows.where(F.octet_length("text") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    copies = copies.select("key", F.array(F.struct(F.lit(0).alias("a"), F.lit((1 << 31) - 1).alias("b"))).alias("ranges"))
    ranges = repeated_ranges(rows, length, crowd).join(copies.select("key"), "key", "left_anti").unionByName(copies)
    ranges = written(ranges, "ranges").withColumnRenamed("key", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, shas, left = [], [], [], [], []
            for x, rs in zip(batch.column(1), batch.column(2)):
                data = x.as_py().encode()
                out, at, removed, n = [], 0, 0, 0
                for a, b in sorted((r["a"], r["b"]) for r in rs.as_py() or []):
                    b = min(b, len(data))
                    if a > at or not n:
                        n += 1
                        out.append(data[at:a])
                        removed += b - a
                        at = b
                    elif b > at:
                        removed += b - at
                        at = b
                kept = b"".join(out) + data[at:]
                sizes.append(len(data))
                gone.append(removed)
                spans.append(n)
                shas.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if with_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.int64()) for v in (sizes, gone, spans)], pa.array(shas, pa.string()), pa.array(left, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    # only texts that hold repeats are shuffled, at any size
    hit, clean = parted(rows, rows["key"], ranges.select("of"))
    joined = hit.join(ranges, hit["key"] == ranges["of"], "left").select("doc_id", "text", "ranges")
    joined = joined.unionByName(clean.select("doc_id", "text", F.lit(None).cast(RANGES).alias("ranges")))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
