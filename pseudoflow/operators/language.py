"""Language identification with trigram rank profiles (Cavnar & Trenkle 1994).

L1 trains profiles from a labelled table, L2 scores each document against every profile (out-of-place rank
distance), L3 applies the decision ladder, L4 maps codes to packs.  A document is counted, ranked and
compared inside its row: trigrams are packed into longs, sorted and counted by runs in an Arrow batch, so
scoring is one scan without any shuffle.  Profiles are ``languages x top_k`` rows; their number is checked
before they travel with the tasks.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.functions.arrow import give_back, in_pieces
from pseudoflow.operators.segments import trim_js

# Decision constants and the code map of supported packs.
MIN_TEXT_LENGTH = 20
MIN_CONFIDENCE = 0.5
LANGUAGE_CODE_MAP = {"pol": "pl", "eng": "en"}
# ISO 639-1 -> ISO 639-3 for the labels we train from.
ISO3 = {"pl": "pol", "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld"}
DEFAULT_TOP_K = 300
SCORE_DIGITS = 6
#: More languages than this (a profile has ``top_k`` rows) are refused: 48 MB of profiles a task.
MAX_LANGUAGES = 10_000
#: Code points of text that a task counts at once when it trains.
HELD = 1 << 20


def normalized(text: Column) -> Column:
    """Lower case, every non-letter run -> one space, padded with a space at both ends."""
    squeezed = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), squeezed, F.lit(" "))


def _packed(text: str) -> np.ndarray:
    """Every (overlapping) 3-character window as one long; longs order as the windows' strings do."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _unpacked(gram: int) -> str:
    return "".join(chr(gram >> shift & 0x1FFFFF) for shift in (42, 21, 0))


def train_language_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
                            top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """L1: ``code, gram, rank`` (rank 1 = most frequent; ties by gram).  Tasks count first, Spark adds up."""
    label = F.col(lang_col)
    code = F.coalesce(F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])[label], label)
    src = df.where(label.isNotNull()).select(code.alias("code"), normalized(F.col(text_col)).alias("t")).where(F.length("t") >= 3)

    def counted(code: str, grams: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(grams), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([code] * len(gram)), pa.array(gram), pa.array(n)], names=["code", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for code, text in zip(batch.column(0), batch.column(1)):
                grams = _packed(text.as_py())
                held.setdefault(code.as_py(), []).append(grams)
                size += len(grams)
                if size > HELD:
                    yield from (counted(c, g) for c, g in held.items())
                    held, size = {}, 0
        yield from (counted(c, g) for c, g in held.items())
        held = {}
        give_back()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([_unpacked(g) for g in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams, batch.column(2)], names=["code", "gram", "rank"])

    counts = src.mapInArrow(run, "code string, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("code").orderBy(F.col("n").desc(), F.col("gram"))
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return top.select("code", "gram", "rank").mapInArrow(named, "code string, gram string, rank int")


def _profile_arrays(profiles: DataFrame, top_k: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """code, sorted grams, their ranks, for every language; refuses more than MAX_LANGUAGES x top_k rows."""
    most = MAX_LANGUAGES * top_k
    rows = profiles.select("code", "gram", "rank").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"profiles have more than {MAX_LANGUAGES} x {top_k} rows")
    out = []
    code, rank = rows["code"].to_numpy(), rows["rank"].to_numpy().astype(np.int64)
    gram = np.array([_packed(g)[0] for g in rows["gram"].to_pylist()], np.int64)
    for c in sorted(set(code)):
        mine = np.flatnonzero(code == c)
        mine = mine[np.argsort(gram[mine])]
        out.append((str(c), gram[mine], rank[mine]))
    return out


def _distances(df: DataFrame, profiles: DataFrame, text_col: str, top_k: int) -> DataFrame:
    """``df`` without its text, with ``_dist`` (array of distance, code; nearest first; null without three letters or profiles) and ``_chars``."""
    known = _profile_arrays(profiles, top_k)
    text = normalized(F.col(text_col))
    # only the normalized text goes to the tasks' Python
    src = df.withColumn("_chars", F.length(trim_js(F.col(text_col)))).withColumn("_t", F.when(F.length(text) >= 3, text)).drop(text_col)
    at = src.columns.index("_t")
    one = T.StructType([T.StructField("distance", T.LongType()), T.StructField("code", T.StringType())])
    schema = T.StructType([f for f in src.schema.fields if f.name != "_t"] + [T.StructField("_dist", T.ArrayType(one))])

    def distances(text: str) -> list[dict]:
        gram, n = np.unique(_packed(text), return_counts=True)
        gram = gram[np.lexsort((gram, -n))][:top_k]
        place = np.arange(1, len(gram) + 1)
        out = []
        for code, grams, ranks in known:
            i = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            out.append((int(np.where(grams[i] == gram, np.abs(place - ranks[i]), top_k).sum()), code))
        return [{"distance": d, "code": c} for d, c in sorted(out)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("distance", pa.int64()), ("code", pa.string())]))
        found = [distances(t.as_py()) if known and t.is_valid else None for t in batch.column(at)]
        cols = [batch.column(i) for i in range(batch.num_columns) if i != at]
        return pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], names=schema.names)

    return src.mapInArrow(in_pieces(run), schema)


def _scores(top_k: int) -> Column:
    dmin = F.get(F.col("_dist"), 0)["distance"]
    denom = F.col("_chars") * top_k - dmin
    return F.transform("_dist", lambda x: F.struct(
        x["code"].alias("code"), x["distance"].alias("distance"),
        F.round(F.when(denom > 0, 1 - (x["distance"] - dmin) / denom).otherwise(F.lit(0.0)), SCORE_DIGITS).alias("score")))


def score_languages(df: DataFrame, profiles: DataFrame, text_col: str = "text", key_col: str = "doc_id",
                    top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """L2: ``key, scores ARRAY<STRUCT<code, distance, score>>`` best first.

    distance = sum over the document's top-k trigrams of |rank difference|, or top_k when the
    profile lacks the trigram; score = 1 - (d - d_min) / (len(text) * top_k - d_min).
    """
    src = df.select(F.col(key_col), F.col(text_col).alias("_text"))
    return _distances(src, profiles, "_text", top_k).where("_dist IS NOT NULL").select(key_col, _scores(top_k).alias("scores"))


def map_language_code(code: Column) -> Column:
    """L4: ISO 639-3 -> supported pack code (pol -> pl, eng -> en), anything else NULL."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGE_CODE_MAP.items() for x in kv])[code]


def detect_language(df: DataFrame, profiles: DataFrame, text_col: str = "text", key_col: str = "doc_id",
                    top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """L3: ``key, detected, source, raw, confidence`` by the decision ladder, in one scan."""
    short = F.col("_chars") < MIN_TEXT_LENGTH
    src = df.select(F.col(key_col), F.col(text_col).alias("_text"))
    out = _distances(src, profiles, "_text", top_k).select(key_col, short.alias("_short"), _scores(top_k).alias("scores"))
    best = F.get(F.col("scores"), 0)
    raw, conf = best["code"], best["score"]
    mapped = map_language_code(raw)
    fallback = F.struct(F.lit("unknown").alias("detected"), F.lit("fallback").alias("source"),
                        F.lit(None).cast("string").alias("raw"), F.lit(None).cast("double").alias("confidence"))

    def result(detected, source, r, c):
        return F.struct(detected.cast("string").alias("detected"), F.lit(source).alias("source"),
                        r.cast("string").alias("raw"), c.cast("double").alias("confidence"))

    res = (F.when(F.coalesce(F.col("_short"), F.lit(True)) | best.isNull() | (raw == "und"), fallback)
           .when(mapped.isNull(), result(F.lit("unknown"), "text", raw, conf))
           .when(conf < MIN_CONFIDENCE, result(F.lit("unknown"), "fallback", raw, conf))
           .otherwise(result(mapped, "text", raw, conf)))
    return out.select(key_col, res.alias("r")).select(key_col, "r.*")
