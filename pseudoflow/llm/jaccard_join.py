"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set is its distinct word shingles.  Equal sets are one class.  Tokens (64-bit shingle hashes) have one
global order, rare ones first: by the binary logarithm of the number of classes that hold them, then by hash.  If
two classes reach the similarity, their l-prefixes (the prefix that leaves fewer tokens than the overlap needed, plus
l - 1) share l tokens, for every l.  Each class takes the l with the least estimated cost, from the sizes of the lists
its prefix would merge: longer prefixes merge more lists but ask for more shared tokens before a pair is verified.
In a pair the larger class's l holds.  Pairs are verified on the texts.

Counting every token would move the corpus, so there are two indexes, and each pair belongs to one.  Classes that share
a min-hash band with another one are *close*; pairs of these are found by an index of all their tokens.  Pairs with
another class are found by an index of all classes whose order starts with a fixed share of the hash range (the pool);
only pooled tokens are counted there.  Bands only decide where a pair is looked for, never whether.

Only components leave the operator, so groups of near copies are not expanded into all pairs.  First close classes
are linked to one hub of each band, then of each list (verified like any pair, and only a head start); then all pairs
whose ends are in different components are found by their prefixes and verified.  A list of one component takes no part, and
in a list of several only pairs across components are made.

Defined cases: null text counts as empty; a text without words has an empty set and links with nothing (its
component is its own id); repeated rows and copies link to each other; a null id is never a component's id unless all
are null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudoflow.llm.common import sieve, without, written
from pseudoflow.llm.simhash import components

#: Share of the hash range that is pooled: half as much again as the longest prefix at 90 %.
POOL = 0.15
#: Largest number of shared prefix tokens asked for.
MOST = 4
#: The table of list sizes has 2 ** LEVEL_BITS entries of 4 bits (8 MB), whatever the corpus; tokens that share
#: an entry take the larger size, which only moves them back in the order.
LEVEL_BITS = 24
#: Cost of verifying a pair, in list entries for each token of the set.
VERIFY = 0.5
#: Bits of the parity map: a set's tokens are dealt to as many bins, a bit tells if a bin got an odd number.  Two maps differ in
#: at most as many bits as the sets in tokens, so a pair whose maps differ in more than it may is none.
PARITY = 256
#: Min-hash bands and rows of a band, for the hubs.
BANDS, BAND_ROWS = 6, 4
#: Rounds in which the lists of close classes link to a hub, before all pairs across components are met.
HUB_ROUNDS = 1
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence where there are fewer words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and white space as in the contract
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.full(n, min(len(words), shingle), np.uint64)
    for k in range(min(len(words), shingle)):
        out = _mixed(out * np.uint64(MULTIPLIERS[k % 3]) + h[k : k + n])
    return np.unique(out)


def needed(n, percent: int):
    """Least overlap of a set of n tokens with any set that is similar enough."""
    return -(-n * percent // 100)


def _bands(tokens: np.ndarray) -> np.ndarray:
    """A hash of each band of BAND_ROWS min-hashes of the tokens."""
    rows = np.arange(BANDS * BAND_ROWS, dtype=np.uint64)
    least = _mixed((tokens * np.uint64(MULTIPLIERS[1]))[:, None] + (rows * np.uint64(MULTIPLIERS[2]))[None, :]).min(axis=0)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        h = _mixed(h * np.uint64(MULTIPLIERS[0]) + least[k::BAND_ROWS])
    return h


def _parity(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(32) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """row, doc_id, loc (hash of the text), n, digest (of the whole set), pool (its first tokens by hash), parity, bands."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("loc"), text.alias("text"))
    edge = np.uint64(int(POOL * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known = _Hashes()
        for batch in batches:
            n, digest, pool, parity, bands = [], [], [], [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py(), shingle, known)
                n.append(len(tokens))
                digest.append(hashlib.sha256(tokens.tobytes()).digest()[:16])
                first = len(tokens) - needed(len(tokens), percent) + MOST
                mine = tokens[: max(int(np.searchsorted(tokens, edge)), first)]
                pool.append(mine.view(np.int64))
                parity.append(_parity(tokens))
                bands.append(_bands(mine).view(np.int64) if len(mine) else mine.view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(x, kind) for x in (pool, parity, bands))],
                names=["doc_id", "loc", "n", "digest", "pool", "parity", "bands"])

    made = rows.mapInArrow(run, "doc_id long, loc long, n long, digest binary, pool array<long>, parity array<long>, bands array<long>")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "sets")


def list_levels(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filled words (16 entries of 4 bits) of the table of binary logarithms of the pooled tokens' list sizes;
    at most 2 ** (LEVEL_BITS - 4) rows of 16 bytes reach the driver.  Tokens of one class have level 0 and no entry."""
    token = F.col("token")  # a hash: its low bits serve as they are
    counted = classes.select(F.explode("pool").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    slot = token.bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
    levels = counted.groupBy(slot.alias("slot")).agg(F.max(F.least(F.lit(15), F.floor(F.log2("c")))).cast("int").alias("level"))
    place = (F.col("slot").bitwiseAND(F.lit(15)) * 4).cast("int")
    words = levels.select(F.shiftrightunsigned("slot", 4).alias("word"), F.call_function("shiftleft", F.col("level").cast("long"), place).alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return found["word"].to_numpy(), found["bits"].to_numpy().view(np.uint64)


def matches_for(n: int, sizes: np.ndarray, percent: int) -> int:
    """The number l of shared prefix tokens with the least cost: entries of the lists that the l-prefix merges, plus
    the candidates to verify; a candidate takes up l entries, so there are sizes / l at most."""
    base = n - needed(n, percent) + 1
    merged = [float(sizes[: base + k].sum()) for k in range(MOST)]
    return 1 + int(np.argmin([m * (1 + VERIFY * n / (k + 1)) for k, m in enumerate(merged)]))


def prefixes(classes: DataFrame, percent: int, filled: tuple[np.ndarray, np.ndarray], share: float) -> DataFrame:
    """token, cls, n, pos, l, parity: the longest prefix of each class in the global order, without tokens of one class only.

    ``share`` of the hash range was counted; other tokens come last."""
    edge = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (LEVEL_BITS - 4), np.uint64)
        table[filled[0]] = filled[1]
        for batch in batches:
            cls, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pool = batch.column(2)
            ends = pool.offsets.to_numpy()
            tokens = pool.values.to_numpy(zero_copy_only=False).view(np.uint64)
            slot = tokens & np.uint64((1 << LEVEL_BITS) - 1)
            level = (table[(slot >> np.uint64(4)).astype(np.int64)] >> ((slot & np.uint64(15)) << np.uint64(2)) & np.uint64(15)).astype(np.int64)
            level = np.where(tokens >= edge, 16, level)  # not counted: last, as if in few lists
            out = []
            for k in range(len(cls)):
                at = np.arange(ends[k], ends[k + 1])
                at = at[np.lexsort((tokens[at], level[at]))][: n[k] - needed(int(n[k]), percent) + MOST]
                sizes = np.where(level[at] == 16, 2, 1 << level[at])
                l = matches_for(int(n[k]), np.where(level[at] == 0, 0, sizes), percent)
                pos = np.flatnonzero(level[at] > 0)
                out.append((at[pos], np.full(len(pos), k), pos, np.full(len(pos), l)))
            if out:
                at, own, pos, l = (np.concatenate(x) for x in zip(*out))
                cols = [pa.array(x) for x in (tokens[at].view(np.int64), cls[own], n[own], pos, l)]
                yield pa.RecordBatch.from_arrays([*cols, batch.column(3).take(pa.array(own))], names=["token", "cls", "n", "pos", "l", "parity"])

    return classes.select("cls", "n", "pool", "parity").mapInArrow(run, "token long, cls long, n long, pos long, l long, parity array<long>")


def _overlap(nx: Column, ny: Column, percent: int) -> Column:
    """Least overlap of two sets of these sizes that are similar enough: percent * union <= 100 * overlap."""
    return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))


def _may_match(nx: Column, px: Column, ny: Column, py: Column, l: Column, percent: int) -> Column:
    """A shared token at px and py may be among the first l that two similar sets share."""
    most = _overlap(nx, ny, percent)
    return (F.lit(percent) * nx <= 100 * ny) & (F.lit(percent) * ny <= 100 * nx) & (px <= nx - most + l - 1) & (py <= ny - most + l - 1)


def fetch_texts(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """cls, text of one document of each class in ``rows`` (cls, doc_id, loc, digest): a sieve keeps other texts from moving."""
    wanted = written(rows.select("cls", F.col("doc_id").alias("want_id"), F.col("loc").alias("want_loc"), "digest"), "wanted")
    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("loc"), text.alias("text"))
    source = sieve(source, F.col("loc"), wanted.select("want_loc"))
    met = source.join(wanted, source["doc_id"].eqNullSafe(wanted["want_id"]) & (source["loc"] == wanted["want_loc"]))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        cache = _Hashes()
        for batch in batches:
            own = [hashlib.sha256(shingle_set(t.as_py(), shingle, cache).tobytes()).digest()[:16] == d.as_py() for t, d in zip(batch.column(1), batch.column(2))]
            yield batch.select([0, 1]).filter(pa.array(own, pa.bool_()))

    return written(met.select("cls", "text", "digest").mapInArrow(known, "cls long, text string").dropDuplicates(["cls"]), "texts")


def all_tokens(texts: DataFrame, shingle: int) -> DataFrame:
    """cls, n, pool, parity: the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle, cache).view(np.int64) for t in batch.column(1)]
            kind = pa.list_(pa.int64())
            parity = pa.array([_parity(x.view(np.uint64)) for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, kind), parity], names=["cls", "n", "pool", "parity"])

    return written(texts.select("cls", "text").mapInArrow(run, "cls long, n long, pool array<long>, parity array<long>"), "tokens")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b of classes) whose texts are similar enough, compared shingle by shingle."""
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")

    def shingles(text: str) -> set[bytes]:
        words = text.encode().lower().split()
        return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = [(None, set()), (None, set())]  # rows come sorted by an end
        for batch in batches:
            ends, good = [batch.column(k).to_pylist() for k in (0, 1)], []
            for k in range(batch.num_rows):
                for side in (0, 1):
                    if ends[side][k] != held[side][0]:
                        held[side] = ends[side][k], shingles(batch.column(2 + side)[k].as_py())
                mine, other = held[0][1], held[1][1]
                common = len(mine & other)
                good.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _across(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """``listed`` with comp and outside, without lists of one component; pairs of two that are not outside are of the
    list's largest component and need not meet."""
    named = written(listed.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root"), "named-lists")
    sizes = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    several = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("m")).where("comps > 1")
    main = several.select("token", F.col("m.comp").alias("main"))
    return written(named.join(main, "token").withColumn("outside", F.col("comp") != F.col("main")).drop("main"), "open-lists")


def hub_pairs(heads: DataFrame) -> DataFrame:
    """(a, b): classes and the hub (the least class) of each band they share with others, hubs with themselves too."""
    rows = heads.select("cls", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "hub")
    return rows.join(hubs, "band").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()


def _possible(met: DataFrame, l: Column, percent: int) -> DataFrame:
    """``met`` has x_ and y_ sides of one list: those whose places, sizes and parity maps allow the similarity, with l."""
    most = _overlap(F.col("x_n"), F.col("y_n"), percent)
    met = met.withColumn("l", F.least(l, most)).where(_may_match(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"), F.col("l"), percent))
    differ = sum((F.bit_count(F.col("x_parity")[k].bitwiseXOR(F.col("y_parity")[k])) for k in range(PARITY // 64)), F.lit(0))
    return met.where(differ <= F.col("x_n") + F.col("y_n") - 2 * most)


SIDE = ("cls", "n", "pos", "l", "comp", "outside", "parity")


def list_hubs(marked: DataFrame, percent: int, seed: int) -> DataFrame:
    """(a, b): classes and one hub of each of their lists, if it is of another component and may be similar.

    The hub has the fewest rare tokens before the list's, so it is near the middle of a crowd; lists have hubs of their own."""
    x = marked.select("token", *[F.col(c).alias(f"x_{c}") for c in SIDE])
    rank = F.struct("pos", F.xxhash64(F.lit(seed), "token", "cls"))
    y = marked.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), *SIDE)).alias("hub")).select("token", *[F.col(f"hub.{c}").alias(f"y_{c}") for c in SIDE])
    met = _possible(x.join(y, "token").where("x_comp <> y_comp"), F.lit(MOST), percent)
    return met.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()


def cross_pairs(marked: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of different components whose prefixes share enough tokens."""
    x = marked.where("outside").select("token", *[F.col(c).alias(f"x_{c}") for c in SIDE])
    y = marked.select("token", *[F.col(c).alias(f"y_{c}") for c in SIDE])
    met = x.join(y, "token").where("x_comp <> y_comp AND (NOT y_outside OR x_cls < y_cls)")
    l = F.when(F.struct("x_n", "x_cls") > F.struct("y_n", "y_cls"), F.col("x_l")).otherwise(F.col("y_l"))
    met = _possible(met, l, percent)
    # a pair's sides depend on the list, its ends don't
    ends = F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")
    return met.groupBy(*ends, "l").agg(F.count(F.lit(1)).alias("c")).where("c >= l").select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and at most 100")
    rows = sets(docs, id_col, text_col, shingle, percent)
    full = rows.where("n > 0")
    classes = written(full.groupBy("digest").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least_id")), "classes")
    copies = full.select("row", "digest").join(classes.select("digest", "cls"), "digest").where("row <> cls").select(F.col("row").alias("copy"))
    heads = without(full, "row", written(copies, "copies")).withColumnRenamed("row", "cls")

    rows_of = heads.select("cls", "doc_id", "loc", "digest")
    hubs = written(hub_pairs(heads), "hub-pairs")
    close = written(hubs.select(F.col("a").alias("cls")).distinct(), "close")
    texts = fetch_texts(rows_of.join(close, "cls"), docs, id_col, text_col, shingle)
    links = written(verified(hubs.where("a <> b"), texts, shingle, percent), "links")

    # pairs of close classes: all their tokens
    tokens = all_tokens(texts, shingle)
    listed = written(prefixes(tokens, percent, list_levels(tokens), 1.0), "close-lists")
    marked = _across(listed, components(links))
    for seed in range(HUB_ROUNDS):  # what is linked now makes no pairs later
        tried = written(list_hubs(marked, percent, seed), "list-hub-pairs")
        links = written(links.unionByName(verified(tried, texts, shingle, percent)), "links")
        marked = _across(listed, components(links))
    pairs = written(cross_pairs(marked, percent), "pairs")
    links = links.unionByName(verified(pairs, texts, shingle, percent))
    # pairs with another class: the pool; close classes count as one component, since their pairs are done
    listed = prefixes(heads, percent, list_levels(heads), POOL)
    pairs = written(cross_pairs(_across(listed, close.select(F.col("cls").alias("node"), F.lit(-1).cast("long").alias("root"))), percent), "pairs")
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    ends = written(ends.join(close, "cls", "left_anti"), "ends")
    more = fetch_texts(rows_of.join(ends, "cls"), docs, id_col, text_col, shingle)
    links = links.unionByName(verified(pairs, texts.unionByName(more), shingle, percent))
    members = components(links).withColumnRenamed("node", "cls")
    named = classes.join(members, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = named.join(ids, "root").select("digest", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(found, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
