"""SimHash near-duplicates: fingerprints, a grid range-join on segment popcounts, exact checks, components.

A fingerprint is embedded as the popcounts of its 32 two-bit segments.  The Manhattan distance of two
embeddings is a lower bound of their bit distance.  The segments fall into five grid axes; two embeddings at
distance 2 or less differ on two axes at most, so they share a cell of one of the ten three-axis grids.
Within a cell, pairs within the lower bound are checked exactly, and only links of a spanning forest leave it.
Cells of more than ``dense`` fingerprints are linked through one-bit neighbours instead of pairs (two
fingerprints are within two bits if and only if they share a neighbour within one bit of both); beyond
``cell_max`` Spark does so, by grouping on the neighbour, of which a group has 65 members at most.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any
other; a null id is never a component's id unless all are null; repeated rows link to each other; an
empty table gives an empty result; extra columns are ignored by ``link`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.llm.common import fresh, frugal, parted, text_or_empty, written

SEED = 42
HALVES = 0x5555555555555555
#: Bits of the five axes: 7, 7, 6, 6 and 6 segments of two bits.
AXES = [sum(3 << (2 * s) for s in range(a, b)) for a, b in ((0, 7), (7, 14), (14, 20), (20, 26), (26, 32))]
GRIDS = [AXES[i] | AXES[j] | AXES[k] for i in range(5) for j in range(i + 1, 5) for k in range(j + 1, 5)]
DENSE, CELL_MAX = 512, 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits; one is set if more than half of the shingles' XXH64 have it set."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and white space as in the contract
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined = b" ".join(words)
    starts = [0, *ends[:-1]]
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        last = min(n, at + 8192)
        hashes = np.array([h(joined[starts[i] : ends[min(i + shingle, len(words)) - 1] - 1], SEED) for i in range(at, last)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def with_fingerprints(docs: DataFrame, text_col: str, name: str, shingle: int = 3) -> DataFrame:
    """``docs`` and a long column ``name``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(x.as_py() or "", shingle)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _embedded(fp: Column) -> Column:
    """Each two-bit segment replaced by its popcount."""
    half, mask = F.shiftrightunsigned(fp, 1), F.lit(HALVES)
    return F.shiftleft(fp.bitwiseAND(half).bitwiseAND(mask), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(mask))


def _embed(x: np.ndarray) -> np.ndarray:
    half, mask = x >> np.uint64(1), np.uint64(HALVES)
    return ((x & half & mask) << np.uint64(1)) | ((x ^ half) & mask)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d, mask = a ^ b, np.uint64(HALVES)
    return np.bitwise_count(d & mask) + 2 * np.bitwise_count((d >> np.uint64(1)) & ~d & mask)


def _lowest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links a-b."""
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def forest(prints: np.ndarray, bits: int, dense: int = DENSE) -> np.ndarray:
    """For each of the sorted, distinct fingerprints of a cell the index of its component's first one."""
    m = len(prints)
    if m <= dense or bits != 2:
        a, b = [], []
        emb = _embed(prints)
        for i in range(m - 1):  # the lower bound prunes, the bit distance decides
            near = np.flatnonzero(_manhattan(emb[i + 1 :], emb[i]) <= bits) + i + 1
            near = near[np.bitwise_count(prints[near] ^ prints[i]) <= bits]
            if len(near):
                a.append(np.full(len(near), i))
                b.append(near)
        if not a:
            return np.arange(m)
        return _lowest(np.arange(m), np.concatenate(a), np.concatenate(b))
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    keys = (prints[:, None] ^ flips[None, :]).ravel()
    order = np.argsort(keys, kind="stable")  # within a neighbour by index
    own = order // 65
    first = np.r_[True, keys[order][1:] != keys[order][:-1]]
    head = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
    return _lowest(np.arange(m), own[own != head], head[own != head])


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def cell_links(prints: DataFrame, bits: int = 2, dense: int = DENSE, cell_max: int = CELL_MAX) -> DataFrame:
    """Links (a, b) that join what the cells show to be near; needs distinct ``fp``."""
    if not 0 <= bits <= 2:
        raise ValueError("the grid finds all pairs up to 2 bits")
    emb = _embedded(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(k).alias("grid"), emb.bitwiseAND(F.lit(_signed(g))).alias("cell")) for k, g in enumerate(GRIDS)])
    rows = prints.select("fp", F.explode(cells).alias("c")).select("c.grid", "c.cell", "fp")
    dealt = rows.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams sorted rows; holds one unfinished cell of at most ``cell_max`` rows."""
        held: np.ndarray = np.zeros((0, 3), np.int64)
        wide = None  # the cell that went over cell_max

        def emit(pairs: list[np.ndarray]) -> pa.RecordBatch:
            done = np.concatenate(pairs)
            lone = done[:, 0] == done[:, 1]  # a wide cell's row: b is null
            return pa.RecordBatch.from_arrays([pa.array(done[:, 0]), pa.array(done[:, 1], mask=lone)], names=LINKS.names)

        def cell(x: np.ndarray) -> np.ndarray:
            p = np.sort(x.view(np.uint64))
            to = forest(p, bits, dense)
            at = np.flatnonzero(to != np.arange(len(p)))
            return np.column_stack([p[at], p[to[at]]]).view(np.int64)

        for batch in batches:
            new = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
            held = np.concatenate([held, new])
            if not len(held):
                continue
            cuts = np.r_[0, np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1, len(held)]
            out = []
            for k in np.flatnonzero(np.diff(cuts)[:-1] > 1) if wide is None else range(len(cuts) - 2):
                x = held[cuts[k] : cuts[k + 1]]
                if wide is not None and tuple(x[0, :2]) == wide:
                    out.append(x[:, [2, 2]])
                    wide = None
                elif len(x) > 1:
                    out.append(cell(np.ascontiguousarray(x[:, 2])))
            held = held[cuts[-2] :]
            if len(held) > cell_max or wide == tuple(held[0, :2]):
                wide = tuple(held[0, :2])
                out.append(held[:, [2, 2]])
                held = held[:0]
            if out and sum(map(len, out)):
                yield emit(out)
        if len(held) > 1:
            last = cell(np.ascontiguousarray(held[:, 2]))
            if len(last):
                yield emit([last])

    found = written(dealt.mapInArrow(frugal(run), LINKS), "links")
    near = found.where("b is not null").distinct()
    wide = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if bits == 0:  # distinct fingerprints are never that near
        return near
    one_off = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)]
    if bits == 1:
        off = wide.select(F.col("fp").alias("a"), F.explode(F.array(*one_off)).alias("b")).where("a > b")
        return near.unionByName(off.join(wide, off["b"] == wide["fp"], "left_semi"))
    flips = F.array(F.col("fp"), *one_off)
    by = wide.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    star = by.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b").distinct()
    return near.unionByName(star)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b): alternating large and small stars until nothing moves."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _classes(prints: DataFrame, bits: int) -> DataFrame:
    """fp, root, component_id; needs doc_id and fp of every row."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-prints")
    members = components(cell_links(distinct.select("fp"), bits))
    named = distinct.join(members, distinct["fp"] == members["node"], "left")
    named = written(named.select("fp", F.coalesce("root", "fp").alias("root"), "least_id"), "members")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return written(named.select("fp", "root").join(ids, "root"), "classes").withColumnRenamed("fp", "class_fp")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    prints = written(with_fingerprints(rows, "text", "fp", shingle).select("doc_id", "fp"), "prints")
    classes = _classes(prints, bits)
    out = prints.join(classes, prints["fp"] == classes["class_fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that with the smallest id."""
    fp, *key = fresh(docs, "fp", "odd_id", "odd_fp", "odd_root", "odd_kept")
    mine = written(with_fingerprints(docs, text_col, fp, shingle), "printed")
    prints = mine.select(mine[f"`{id_col}`"].cast("long").alias("doc_id"), mine[fp].alias("fp"))
    classes = _classes(prints, bits)
    named = prints.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")).join(classes, F.col("fp") == F.col("class_fp"))
    named = written(named.select("doc_id", "fp", "n", "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "named")
    ties = named.where("kept").groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root", F.lit(True).alias("tied"))
    # nearly all rows stay and need no join; the others, and rows that share the id that stays (any one does), are few
    odd = written(named.join(ties, "root", "left").where("not kept or tied").select("doc_id", "fp", "root", "kept"), "odd")
    held, rest = parted(mine, F.xxhash64(mine[f"`{id_col}`"].cast("long"), mine[fp]), odd.select(F.xxhash64("doc_id", "fp").alias("odd")))
    odd = odd.toDF(*key)
    joined = held.join(odd, held[f"`{id_col}`"].cast("long").eqNullSafe(odd[key[0]]) & (held[fp] == odd[key[1]]), "left")
    plain = [joined[f"`{x}`"] for x in docs.columns]
    one = joined.where(F.col(key[3])).dropDuplicates([key[2]]).select(*plain)
    return rest.select(*[rest[f"`{x}`"] for x in docs.columns]).unionByName(joined.where(F.col(key[2]).isNull()).select(*plain)).unionByName(one)
