"""Operators 11, 12 and 13 against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pseudoflow.llm import collocations, common, jaccard_join, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return tuple((x is None, x) for x in row)


# ---------------------------------------------------------------- 11


def brute_phrases(rows, least, order=5, top=2000, contained=100):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        mine = []
        for p, a in cands.items():
            n = len(p)
            if any(len(q) > n and 100 * b >= contained * a and any(q[i : i + n] == p for i in range(len(q) - n + 1)) for q, b in cands.items()):
                continue
            score, cut = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, n))
            mine.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least,order,contained", [(2, 5, 100), (3, 3, 100), (2, 4, 60), (2, 2, 100)])
def test_phrases_are_brute_force(docs, least, order, contained):
    df = docs.limit(60)
    rows = [(r.lang, r.text) for r in df.collect()]
    found = collocations.mine(docs.sparkSession.createDataFrame(df.collect(), docs.schema).repartition(3), min_count=least, order=order, contained=contained, top=300)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, order, 300, contained)


def test_phrases_of_odd_rows(odd, clash):
    rows = [(r.lang, r.text) for r in odd.collect()]
    expected = brute_phrases(rows, 2)
    assert any(r[0] == "und" for r in brute_phrases(rows, 1))
    for df in (odd, clash):
        assert sorted(map(tuple, collocations.mine(df, min_count=2).collect())) == expected
    assert collocations.mine(odd.limit(0)).count() == 0


def test_phrase_ties_pieces_and_long_texts(spark, monkeypatch):
    text = "a b. A B, a\tb;c d:c d! x a b\nc d? a b c d a b c d\r a  b"
    rows = [(k, text * (1 + 40 * (k == 1)), lang, "s", 1) for k, lang in enumerate(["en", "en", None, "und", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    expected = brute_phrases([(r[2], r[1]) for r in rows], 2)
    assert sorted(map(tuple, collocations.mine(df, min_count=2).collect())) == expected
    # small parts and often emptied columns give the same windows
    words = list(collocations._parts(text.encode() * 50))
    monkeypatch.setattr(collocations, "SLICE", 7)
    assert [w for part in collocations._parts(text.encode() * 50) for w in part if w.strip()] == [w for part in words for w in part if w.strip()]


def test_a_full_filter_only_lengthens_windows(docs, monkeypatch):
    df = docs.limit(30)
    plain = sorted(map(tuple, collocations.mine(df, min_count=2).collect()))
    everything = (np.arange(1 << collocations.SLOT_BITS), np.full(1 << collocations.SLOT_BITS, 2**64 - 1, np.uint64))
    monkeypatch.setattr(collocations, "gram_filter", lambda grams, size: everything)
    assert sorted(map(tuple, collocations.mine(df, min_count=2).collect())) == plain


def test_counted_windows_are_merged_and_passed_on(docs, monkeypatch):
    """Columns that are emptied all the time give the same phrases."""
    df = docs.limit(40).coalesce(1)
    plain = sorted(map(tuple, collocations.mine(df, min_count=2).collect()))
    small = collocations.windows.__globals__
    run = {}
    monkeypatch.setitem(small, "HELD", 50)
    monkeypatch.setitem(small, "HELD_WINDOWS", 100)
    run["small"] = sorted(map(tuple, collocations.mine(df, min_count=2).collect()))
    assert run["small"] == plain and len(plain) > 100


def test_windows_grow_with_words_not_with_pairs_of_rows(spark):
    """At most one counted window a word; a group of equal texts gives each task the windows of one text."""
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(list("abcdefghij"), 400)).encode()
    everything = (np.arange(1 << collocations.SLOT_BITS), np.full(1 << collocations.SLOT_BITS, 2**64 - 1, np.uint64))
    made = {}
    for copies, tasks in [(1, 1), (40, 1), (400, 1), (400, 4)]:
        df = spark.createDataFrame([(b"en", text)] * copies, "lang binary, text binary").repartition(tasks)
        for order, known in [(2, 0), (3, 2), (5, 3)]:
            rows = collocations.windows(df, order, known, everything if known else None).collect()
            made[copies, tasks, order] = len(rows)
            assert sum(r.n for r in rows) == copies * (400 - known) and len(rows) <= tasks * 400
    assert all(made[400, 1, k] == made[40, 1, k] == made[1, 1, k] and made[400, 4, k] <= 4 * made[1, 1, k] for k in (2, 3, 5))


def test_scores_beyond_64_bits(spark):
    text = " ".join(["p q"] * 3000 + ["z"] * 4000)
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").withColumn("text", F.col("text"))
    got = collocations.mine(df, min_count=3000, order=2).collect()
    assert [(r.phrase, r.a, r.score) for r in got if r.phrase == "p q"] == [("p q", 3000, 1000 * 3000 * 10_000 // 9_000_000)]
    big = spark.createDataFrame([(9 * 10**15, 10**17, 3, 7)], "a long, n long, l long, r long")
    wide = "CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) div (CAST(l * 10000000000 AS DECIMAL(19, 0)) * CAST(r * 10000000000 AS DECIMAL(19, 0)))"
    assert big.selectExpr(wide).first()[0] == 1000 * 9 * 10**15 * 10**17 // (21 * 10**20)


# ---------------------------------------------------------------- 12


def brute_words(rows, every, least=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n, ratio=10):
    near = defaultdict(set)
    by = defaultdict(set)
    for w in n:  # deletion neighbourhoods find all pairs; the edit is then checked
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=key)


@pytest.mark.parametrize("list_max", [0, 3, 64])
def test_spelling_groups_are_brute_force(docs, list_max):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_groups(brute_words(rows, 31))
    found = spelling.group(docs, every=31, list_max=list_max)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=key) == expected
    assert sum(r[1] is not None for r in expected) > 3


def test_spelling_of_odd_rows(odd, clash):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for df in (odd, clash):
        assert sorted(map(tuple, spelling.group(df, every=31).collect()), key=key) == brute_groups(brute_words(rows, 31))
    assert spelling.group(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group(odd, min_length=6)


def test_no_near_pair_is_lost(spark):
    """Short alphabets make repeated grams, where the bounds are tightest."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list(letters), int(rng.integers(7, 11)))) for letters in ("a", "ab", "abc", "aé÷") for _ in range(150)}
    for w in list(words)[:200]:
        at, c = int(rng.integers(len(w) + 1)), str(rng.choice(list("abcé")))
        words |= {x for x in (w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]) if len(x) >= 7}
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    expected = {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if one_edit(a, b)}
    assert len(expected) > 300
    for list_max in (0, 5, 10_000):
        assert {tuple(sorted(r)) for r in spelling.near_pairs(df, list_max).collect()} == expected


def test_roots_follow_chains_and_ties(spark):
    counts = {"mississippi": 2000, "mississipp": 200, "mississip": 20, "mississi": 2, "abcdefgh": 20, "abcdefgx": 20, "abcdefgy": 2}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.group(df).collect()}
    assert got["mississi"] == ("mississip", "mississippi", 1, 20)
    assert got["abcdefgy"] == ("abcdefgh", "abcdefgh", 2, 20) and got["abcdefgx"] == (None, "abcdefgx", 2, None)


def test_bounds_hold_for_every_edit():
    rng = np.random.default_rng(7)
    frequent = {"".join(rng.choice(list("ab"), int(rng.integers(2, 4)))) for _ in range(7)}
    for _ in range(300):
        w = "".join(rng.choice(list("abc"), int(rng.integers(7, 10))))
        mine, bound = spelling.decompose(w, frequent)
        assert bound < len(mine)
        for at in range(len(w) + 1):
            for x in {w[:at] + "b" + w[at:], w[:at] + w[at + 1 :], w[:at] + "c" + w[at + 1 :]} - {w}:
                other, _ = spelling.decompose(x, frequent)
                aligned = {g for g in mine if g in other and (set(mine[g]) & set(other[g]) or {len(w) - p for p in mine[g]} & {len(x) - p for p in other[g]})}
                assert len(mine) - len(aligned) <= bound


# ---------------------------------------------------------------- 13


def brute_sets(rows):
    out = []
    for i, text in rows:
        words = re.findall("[^ \t-\r]+", (text or "").translate(LOW))
        out.append((i, frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()))
    return out


def brute_links(rows, percent=90):
    docs = brute_sets(rows)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = docs[a][1], docs[b][1]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(docs)), key=key)


@pytest.mark.parametrize("which", ["docs", "odd", "clash"])
def test_jaccard_links_are_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard_join.link(df).collect()), key=key) == brute_links(rows)


def test_jaccard_of_nothing(odd):
    assert jaccard_join.link(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.link(odd, percent=40)


@pytest.mark.parametrize("percent,hubs,bits", [(90, 1, 24), (90, 0, 6), (80, 2, 24), (100, 0, 24)])
def test_crowds_of_near_copies(spark, monkeypatch, percent, hubs, bits):
    """Chains of edits, sizes around the limit, a passage that all share; without list hubs; a crowded table of list sizes."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = list(rng.choice(vocabulary, 30))
    texts = []
    for size in (3, 9, 10, 11, 12, 25, 60, 200):
        base = list(rng.choice(vocabulary, size))
        for _ in range(14):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(len(words)))
                words[at : at + int(rng.integers(0, 2))] = [str(rng.choice(vocabulary))] * int(rng.integers(0, 2))
            texts.append(" ".join(words + shared if rng.integers(3) == 0 else words))
            if rng.integers(2):
                base = words
    rows = [(k, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(jaccard_join, "LEVEL_BITS", bits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute_links(rows, percent)
    assert sorted(map(tuple, jaccard_join.link(df, percent=percent).collect()), key=key) == expected
    if percent < 100:
        assert len({r[2] for r in expected}) < len(rows) - 20


def test_sieve_lets_all_keys_through(spark):
    df = spark.range(20_000).withColumn("slot", F.lit("x"))
    keys = spark.range(0, 20_000, 37)
    for words in (4, 1 << 10):
        got = {r.id for r in common.sieve(df, F.col("id"), keys, words).collect()}
        assert got >= set(range(0, 20_000, 37))
        assert len(got) < 5_000 or words == 4
        rest = common.without(df, "id", keys, words)
        assert rest.columns == df.columns and {r.id for r in rest.collect()} == set(range(20_000)) - set(range(0, 20_000, 37))
    assert common.sieve(df, F.col("id"), keys.limit(0)).count() == 0
    assert common.without(df, "id", keys.limit(0)).count() == 20_000
