"""Operators 3, 4 and 5 against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pseudoflow.llm import exact_dedup, packing, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return tuple((x is None, x) for x in row)


def brute_prints(rows):
    out = []
    for i, t in rows:
        words = [w for w in (t or "").translate(LOW).replace("\n", " ").replace("\t", " ").split(" ") if w]
        sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    return out


def brute_components(prints, bits=2, count=False):
    n, root = len(prints), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    if count:
        return len({find(a) for a in range(n)})
    for a in range(n):
        if prints[a][0] is not None:
            least[find(a)] = min(least.get(find(a), prints[a][0]), prints[a][0])
    return [(i, f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(prints)]


@pytest.mark.parametrize("which", ["docs", "odd", "clash"])
def test_simhash_is_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected = sorted(brute_components(brute_prints(rows)), key=key)
    assert sorted(map(tuple, simhash.link(df).collect()), key=key) == expected
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert kept.count() == brute_components(brute_prints(rows), count=True)


@pytest.mark.parametrize("dense,cell_max", [(512, 1 << 15), (4, 1 << 15), (4, 6)])
def test_links_of_crowded_cells(spark, dense, cell_max):
    """Chains and stars of near fingerprints, by pairs, by neighbours in a task, and by neighbours in Spark."""
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)}
    for x in list(prints)[:8]:
        for _ in range(30):
            x ^= 1 << int(rng.integers(64))
            if rng.integers(2):
                x ^= 1 << int(rng.integers(64))
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = dict(map(tuple, simhash.components(simhash.cell_links(df, 2, dense, cell_max)).collect()))
    expected = brute_components([(k, p) for k, p in enumerate(prints)])
    groups = {}
    for (_, _, c), p in zip(expected, prints):
        groups.setdefault(c, set()).add(found.get(simhash._signed(p), simhash._signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        at = ids.index(keep)
        out += [(i, keep, len(ids), k == at, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda n: F.substring(F.sha2(n.cast("binary"), 256), 1, 1)])
@pytest.mark.parametrize("which", ["docs", "odd", "clash"])
def test_exact_dedup_is_brute_force(request, which, digest):
    """Also with a digest that collides: the full bytes decide."""
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = exact_dedup.groups(df, digest=digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute_dedup(rows), key=key)


@pytest.mark.parametrize("which", ["docs", "odd", "clash"])
def test_exact_dedup_rows(request, which):
    df = request.getfixturevalue(which)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    texts = [(r.text or "").translate(LOW) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(LOW) for r in df.collect()})


def test_stream_goes_on_with_its_state(spark, tmp_path):
    """A second run with the same checkpoint knows what the first one saw."""
    rows = "row_no long, doc_id long, digest string, text_sha256 string, locator struct<file string, n_bytes long>"
    for k, ids in enumerate(([1, 2], [3])):
        spark.createDataFrame([(10 * k + i, i, "d", "s", ("f", 1)) for i in ids], rows).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows).parquet(str(tmp_path / "in"))
        state = exact_dedup.stream_state(stream, str(tmp_path / "state")).collect()
    assert [(s.digest, s.keep_id, s.group_size) for s in state] == [("d", 3, 3)]


@pytest.mark.parametrize("which", ["docs", "odd", "clash"])
def test_packing(request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in df.select("doc_id", "text").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.append((r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = packing.pack(df, with_ids=True).collect()
    assert sorted([tuple(r[:5]) for r in found], key=key) == sorted(expected, key=key)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in found)
    # the plan goes by the histogram of lengths alone, so places don't depend on ids being asked for
    # (full pieces are sequences of their own, numbered by their rows)
    places = [sorted((r.sequence_id if r.length < 4096 else -1, r.offset, r.length) for r in rows) for rows in (found, packing.pack(df).collect())]
    assert places[0] == places[1]
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    bound = -(-sum(x[3] for x in expected) // 4096)
    assert bound <= len(sequences) <= 1.05 * bound + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item(seed):
    rng = np.random.default_rng(seed)
    cap = (64, 4096)[seed % 2]
    lengths = np.clip(rng.lognormal(np.log(cap) * 0.7, 1, 20_000).astype(int), 1, cap - 1)
    lengths[: (0, 12_000)[seed % 3 == 0]] = cap // 3  # a common length
    counts = np.bincount(lengths, minlength=cap + 1)
    runs, n_seq = packing.plan(counts, cap)
    fill, seen = np.zeros(n_seq, int), np.zeros(cap + 1, int)
    for n, first, items, start, per in runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist():
        assert first == seen[n]
        seen[n] += items
        np.add.at(fill, start + np.arange(items) // per, n)
    assert (seen == counts).all() and fill.max() <= cap and fill.min() > 0
    assert n_seq <= 1.04 * -(-lengths.sum() // cap) + 2


def test_empty_tables(odd):
    none = odd.limit(0)
    for f in (exact_dedup.groups, exact_dedup.deduplicate, simhash.link, simhash.deduplicate, packing.pack):
        assert f(none).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("cell_max", [2, 1000])
def test_links_of_wide_cells_keep_the_distance(spark, bits, cell_max):
    prints = [0, 3, 12, 15, 7, 1 << 40, (1 << 40) | (1 << 41), (1 << 63) | 48, 48, 5 << 20]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a cell turns wide where a batch ends inside it
    before = spark.conf.get(size)
    spark.conf.set(size, "1")
    try:
        found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.cell_links(df, bits, cell_max=cell_max).collect()]
    finally:
        spark.conf.set(size, before)

    def groups(links):
        root = {x: x for x in prints}
        for _ in prints:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= bits]
    assert groups(found) == groups(near)
