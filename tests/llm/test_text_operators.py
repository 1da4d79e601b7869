"""Operators 1, 2, 6, 7, 8, 9 and 10, and the pipeline."""

import hashlib
import re
import zlib
from array import array

import duckdb
import numpy as np
import pytest

from pseudoflow.llm import chat, labelled, pii, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, toxicity

NAMES = ["docs", "odd", "clash"]


def key(row):
    return tuple((x is None, x) for x in row)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- 1

def brute_base(text):
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


@pytest.mark.parametrize("which", NAMES)
def test_pii_base_is_brute_force(request, which):
    df = request.getfixturevalue(which)
    expected = []
    for i, t in rows_of(df):
        b = brute_base(t)
        sha = hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, v in b.items() for x, y in v).encode()).hexdigest()
        expected.append((i, *map(len, b.values()), sha))
    assert sorted((tuple(r)[:6] for r in pii.find(df).collect()), key=key) == sorted(expected, key=key)


def test_pii_base_on_hard_texts():
    rng = np.random.default_rng(1)
    for alphabet in ("a@b.c_-", "01.2 5+-()", "4 1-1@.a+"):
        for _ in range(2000):
            text = "".join(rng.choice(list(alphabet), 60))
            assert pii.base_spans(text) == brute_base(text), text


def test_pii_scores_and_masks():
    text = "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, 123-45-6789 alone, mail é a@b.co call 555-123-4567"
    _, added = pii.spans(text)
    assert [text[a:b] for v in added.values() for a, b in v] == ["DE89 3704 0044 0532 0130 00", "123-45-6789", "123-45-6789", "555-123-4567"]
    assert "DE89" not in pii.masked(text) and "a@b.co" not in pii.masked(text) and "<IBAN>" in pii.masked(text)
    assert not pii.mod97("DE89370400440532013001") and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


VALID_IBANS = [
    "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947",
    "FR14 2004 1010 0505 0001 3M02 606", "GB29 NWBK 6016 1331 9268 19", "PL61109010140000071219812874", "CH93 0076 2011 6238 5295 7",
]


@pytest.mark.parametrize("iban", VALID_IBANS)
@pytest.mark.parametrize("after", ["", " BIC", " EUR 500", " 2024", " ACCOUNT", " AND MORE", " A", ", BIC", " bic", " 1234 5678 9012 3456 7890", " DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("before", ["", "IBAN ", "REF AB12 ", "no. XY99 1234 "])
def test_pii_iban_ends_before_the_next_word(iban, after, before):
    text = before + iban + after
    found = [text[a:b] for a, b in pii.ibans(text)]
    assert found == [iban] + [after.strip()] * (after[1:5] == "DE89")
    if after in ("", " BIC", " EUR 500", ", BIC", " bic"):
        assert iban not in pii.masked(text)


def test_pii_ibans_are_linear_and_bounded():
    assert list(pii.ibans("AB12 " * 100_000)) == []
    assert list(pii.ibans("ES91 2100 0418 4502 0005 1333 BIC, ES91 2100 0418 4502 0005 133")) == []
    text = "ZZ50 1234 5678 BIC"  # no such country: any end
    assert pii.mod97("ZZ37 1234 5678") == (list(pii.ibans(text.replace("50", "37"))) == [(0, 14)])


# ---- 2 and 7: against their SQL

def test_pii_added_spans_never_overlap_kept_ones():
    rng = np.random.default_rng(3)
    parts = ["call 212-555-0187", "+1 212-555-0187", "ssn 123-45-6789", "4111 1111 1111 1111", "378282246310005", "card", "iban DE89 3704 0044 0532 0130 00", "1.2.3.4", " ", ","]
    for _ in range(300):
        text = rng.choice(["", " "]).join(rng.choice(parts, rng.integers(1, 12)))
        base, added = pii.spans(text)
        kept = [x for v in base.values() for x in v]
        for a, b in sorted(x for v in added.values() for x in v):
            assert all(b <= c or d <= a for c, d in kept)
            kept.append((a, b))
    many = "call 212-555-0187, " * 30_000
    assert len(pii.spans(many)[1]["phone_local"]) == 30_000


def test_labelled_sample_keeps_its_bound(spark):
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(ids[0], f"text {k}") for k in range(50)] + [(i, "other") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    rows, sizes = labelled.sample(docs, labels, "quality", 100)
    got = rows.collect()
    assert len(got) == len(ids) == sum(sizes.values())
    assert {r.doc_id: r.text for r in got}[ids[0]] == "text 0"


def against_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=key)


@pytest.mark.parametrize("which", NAMES)
def test_quality_rules(request, which):
    df = request.getfixturevalue(which)
    found = sorted(map(tuple, quality_rules.apply_rules(df).collect()), key=key)
    assert found == against_sql(quality_rules.SQL, documents=df)


def test_frequent_lines_deplete(spark):
    lines = ["Home | About", "  home  |  ABOUT "]
    rows = [(i, f"{lines[i % 2]}\n" + " ".join(f"w{i}x{k}" for k in range(60)), "h") for i in range(40)]
    rows += [(100, "\n".join(["home | about"] * 30), "h"), (101, lines[0] + "\n" + "v " * 3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert found[3].kept and found[3].n_lines_removed == 1 and found[100].n_lines_removed == 30 and found[101].n_lines_removed == 0
    options = quality_rules.RuleOptions(min_docs=5, left_percent=99)
    assert not any(r.kept for r in quality_rules.apply_rules(df, options=options).collect())
    left = dict(map(tuple, quality_rules.remove_lines(df).collect()))
    assert left[100] == "" and left[0].startswith("w0x0") and 101 not in left


@pytest.mark.parametrize("seed", range(3))
def test_chat(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(60):
        rows += [(conv, t, ["user", "assistant"][t % 2], f"t{rng.integers(2)}") for t in range(int(rng.integers(1, 6)))]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (70, 1, "user", "t0"), (70, 1, "user", "t0"), (71, 0, "user", "<|im_end|>")]
    rows += [(80, t, "user", "long") for t in range(1100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "2 AS h1", "3 AS part")
    found = sorted(map(tuple, chat.render(df).collect()), key=key)
    assert found == against_sql(chat.SQL.replace("JOIN k USING (conv_id)", "JOIN k ON r.conv_id IS NOT DISTINCT FROM k.conv_id")
                                .replace("SELECT conv_id, CAST((r.pos", "SELECT r.conv_id, CAST((r.pos").replace("GROUP BY conv_id, (r", "GROUP BY r.conv_id, (r"),
                                conversations=df)
    assert chat.render(df.limit(0)).count() == 0


def test_chat_cuts_hot_conversations(spark):
    turns = [(t // 2, ["assistant", "user"][t % 2], f"same start {'x' * (t % 3)}") for t in range(2000)]
    rows = [(None, *x) for x in turns] + [(None, *x) for x in turns[:100]]
    for conv, n in enumerate([1, 2, 3, 699, 700, 1999, 2000, 2000]):
        rows += [(conv, *x) for x in turns[:n]]
    rows += [(20, *x) for x in turns[:1500]] + [(20, 5000, "user", "other end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sliced = chat.in_slices(df)
        pieces = chat.pieces_of(sliced)
        of_null = [r for r in pieces.collect() if r.conv_id is None]
        assert len(of_null) > 1 and sum(r.n for r in of_null) == 2000 and sum(r.before > 0 for r in pieces.collect()) < 13
        keys = {}
        for r in chat.prefixes(sliced, pieces).collect():
            keys.setdefault(r.conv_id, {})[r.pos] = (r.h1, r.h2, r.h3)
        assert keys[None] == keys[6] == keys[7] and all(keys[6][p] == h for c in range(6) for p, h in keys[c].items())
        assert len(set(keys[6].values())) == 2000 and [p for p, h in keys[20].items() if h != keys[6][p]] == [1501]
        found = sorted(map(tuple, chat.render(df).collect()), key=key)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sql = chat.SQL.replace("JOIN k USING (conv_id)", "JOIN k ON r.conv_id IS NOT DISTINCT FROM k.conv_id")
    sql = sql.replace("SELECT conv_id, CAST((r.pos", "SELECT r.conv_id, CAST((r.pos").replace("GROUP BY conv_id, (r", "GROUP BY r.conv_id, (r")
    assert found == against_sql(sql, conversations=df)


# ---- 6

def brute_repeats(texts, length):
    data = [t.encode() for t in texts]
    seen = {}
    for d in data:
        for s in range(len(d) - length + 1):
            seen[d[s : s + length]] = seen.get(d[s : s + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd,shard", [(4096, 1 << 20), (4096, 300), (2, 1 << 20)])
def test_repeats_are_brute_force(spark, crowd, shard, monkeypatch):
    """Passages inside others, periodic texts, overlaps and copies; also with tiny shards and crowded owners."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [word(120) for _ in range(4)]
    texts = []
    for _ in range(80):
        t = word(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 3))):
            s = shared[int(rng.integers(4))]
            t += s[int(rng.integers(40)) : int(rng.integers(60, 120))] + word(int(rng.integers(0, 60)))
        texts.append(t)
    texts += ["ab" * 100, "x" * 300, texts[3], texts[3], "", None, "é" * 19 + "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS h", "3 AS ranges")
    for length in (40, 41):
        found = [tuple(r)[1:5] for r in sorted(suffix_dedup.remove(df, length=length, crowd=crowd).collect())]
        assert found == brute_repeats([t or "" for t in texts], length)


@pytest.mark.parametrize("which", NAMES)
def test_repeats_of_tables(request, which):
    df = request.getfixturevalue(which)
    rows = [(i, t) for i, t in rows_of(df) if len(t) < 60_000]
    small = df.where("text is null or length(text) < 60000")
    expected = sorted([(i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], 400))], key=key)
    found = suffix_dedup.remove(small, with_bytes=True).collect()
    assert sorted((tuple(r)[:5] for r in found), key=key) == expected
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)


def test_passages_count_by_bytes_not_words(spark):
    """A passage of 60 words stays if it has fewer than 400 bytes; n_bytes is the length of the document in any case."""
    rng = np.random.default_rng(8)
    words = lambda n, size: " ".join("".join(rng.choice(list("abcdefgh"), size)) for _ in range(n))
    short, exact, long = words(60, 5), words(60, 5)[:359] + "k" * 41, words(60, 8)
    assert (len(short), len(exact), len(long)) == (359, 400, 539)
    texts = [f"{words(30, 6)} {i} {x} {9 - i} {words(30, 6)}" for i, x in enumerate([short, short, exact, exact, long, long])] + [words(90, 6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [tuple(r)[1:5] for r in sorted(suffix_dedup.remove(df).collect())]
    assert found == brute_repeats(texts, 400)
    assert [r[0] for r in found] == [len(t) for t in texts]
    assert [r[1] for r in found[:2]] + [found[6][1]] == [0, 0, 0]
    assert all(400 <= r[1] <= 404 for r in found[2:4]) and all(539 <= r[1] <= 543 for r in found[4:6])


def test_merge_keeps_no_place_twice():
    contexts = [b"a" * 30, b"b" * 12, bytes(range(40))]
    marks = suffix_dedup.repeated_strings(contexts, np.array([1, 2, 1]), 10, 25)
    assert marks.tolist() == [True] * 21 + [False] * 9 + [True] * 3 + [False] * 9 + [False] * 40


# ---- 8 and 10

@pytest.mark.parametrize("module", [quality_classifier, toxicity])
@pytest.mark.parametrize("which", NAMES)
def test_classifiers(spark, request, module, which):
    df = request.getfixturevalue(which)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = module.classify(df, labels).collect()
    assert len(found) == df.count()
    for r in found:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
    none = module.classify(df, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5} and module.classify(df.limit(0), labels).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality_classifier.classify(docs.join(labels.select("doc_id"), "doc_id"), labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.97


def test_toxicity_knows_misspellings():
    clean = ["the quiet river runs along the old stone wall near town"] * 2
    rng = np.random.default_rng(0)
    words = ["river", "stone", "wall", "quiet", "town", "along", "near", "runs", "garden", "window", "paper", "simple"]
    texts, y = [], []
    for k in range(400):
        t = list(rng.choice(words, 60))
        if k % 4 == 0:
            t[int(rng.integers(60))] = str(rng.choice(["horrible", "disgusting"]))
        texts.append(" ".join(t))
        y.append(int(k % 4 == 0))
    model = toxicity.fit(texts, np.array(y), {0: 300, 1: 100}, epochs=12)
    scorer = toxicity.Scorer(model)
    p = lambda t: 1 / (1 + np.exp(-(model.a * scorer.margin(t) + model.b)))
    assert p("river stone wall disgustingg town along") > p(clean[0]) and p("quiet horrrible town near runs wall") > p(clean[0])


def long_clean_texts():
    """Clean texts of a kind each, 40,000 windows in all; toxic ones are of the same kinds with one word more."""
    rng = np.random.default_rng(7)
    kinds = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(20)] for _ in range(40)]
    clean = [" ".join(rng.choice(kind, 3000)) for kind in kinds]
    toxic = [" ".join(np.r_[rng.choice(kind, 6), ["scumbag"], rng.choice(kind, 6)]) for kind in kinds for _ in range(3)]
    return clean, toxic


def test_toxicity_learns_from_all_clean_windows():
    clean, toxic = long_clean_texts()
    model = toxicity.fit(clean + toxic, np.array([0] * len(clean) + [1] * len(toxic)), {0: 4000, 1: 400})
    margin = np.array([toxicity.Scorer(model).margin(t) for t in clean + toxic])
    scores = labelled.score(margin, model.a, model.b)
    assert max(scores[: len(clean)]) < 0.5 < min(scores[len(clean) :])


def test_toxicity_windows_are_those_of_the_text():
    texts = ["", "one", "a b c d e f", "a b c d e f g", "un deux un trois " * 50, "?!"]
    windows = toxicity.Windows(texts)
    values = np.random.default_rng(2).normal(size=toxicity.BUCKETS)
    for k, text in enumerate(texts):
        words, some = toxicity.words_of(text), np.arange(windows.of[k], windows.of[k + 1])
        expected = [words[s : s + toxicity.WINDOW] for s in toxicity.starts(len(words))] if words else []
        assert len(some) == len(expected)
        for at, w in zip(some, expected):
            ids, _, place, n, buckets = windows.batch(np.array([at]))
            assert sorted(set(ids)) == sorted({b for x in w for b in toxicity.subwords(x)}) and len(place) == n[0] == len(w)
            assert buckets[0] == sum(len(toxicity.subwords(x)) for x in w)
        if expected:
            means = [np.concatenate([values[toxicity.subwords(x)] for x in w]).mean() for w in expected]
            assert means[windows.worst(k, values) - some[0]] == pytest.approx(max(means))


# ---- 9

def test_codec_is_the_library(docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec = sentencepiece_codec.Codec()
    rng = np.random.default_rng(4)
    texts = [t for _, t in rows_of(docs)][:60] + ["", " ", " " * 50, "x" * 5000, "ab" * 900 + " " * 37 + "q", "\n \n a ▁b", "日本 😀 a😀b é", "\x00\t"]
    texts += ["".join(rng.choice(["the", "ing", " ", " ", "tion", "é", "\n", "x", "日", "▁"], 25)) for _ in range(300)]
    for t in texts:
        ids = codec.encode(t)
        assert array("I", ids).tolist() == sp.encode(t), t
        assert codec.decode(ids) == t.replace("▁", " ")


def test_codec_window_is_bounded():
    codec, held = sentencepiece_codec.Codec(), []
    path = codec.path
    codec.path = lambda last, at: (held.append(len(last)), path(last, at))[1]
    assert len(list(codec.search("thequickbrownfox" * 2000))) > 2000
    assert max(held) < 40 * codec.longest


@pytest.mark.parametrize("which", NAMES)
def test_codec_tables(request, which):
    df = request.getfixturevalue(which)
    found = sentencepiece_codec.encode(df).collect()
    assert len(found) == df.count() and all(r.round_trip for r in found)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df)).collect()
    assert sorted(map(tuple, back), key=key) == sorted(rows_of(df), key=key)
    assert sentencepiece_codec.encode(df.limit(0)).count() == 0 and pii.find(df.limit(0)).count() == 0
    assert suffix_dedup.remove(df.limit(0)).count() == 0 and quality_rules.apply_rules(df.limit(0)).count() == 0


# ---- pipeline

def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then = stage(spark, docs, "/root/testdata/sf0.001")
        assert then.columns == docs.columns, name
        n, docs = docs.count(), spark.createDataFrame(then.collect(), docs.schema)
        assert 0 < docs.count() <= n
    left = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect()} == left
    assert not any(r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii.find(docs).collect())


@pytest.mark.parametrize("which", ["odd", "clash", "empty"])
def test_stages_take_odd_rows(request, spark, odd, which):
    """Nulls, empty and very long texts, repeated rows, one id twice, extra columns, no rows: a stage keeps the columns and loses
    only what it is there to remove."""
    import corpus_pipeline

    df = odd.limit(0) if which == "empty" else request.getfixturevalue(which)
    total = df.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "/root/testdata/sf0.001")
        n = out.count()
        if name != "best_fit_packing":
            assert out.columns == df.columns and n <= total
        texts = {(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for (t,) in df.select("text").collect()}
        if name == "exact_dedup":
            assert n == len(texts)
        if name == "pii":
            assert n == total
        if name == "best_fit_packing":
            assert out.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
