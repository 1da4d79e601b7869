"""Sentence splitting and chunking with one-sentence overlap (input for entity extraction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudoflow.functions.hof import let
from pseudoflow.functions.regex import WS_BODY

# Default chunk size and the sentence end ([.!?] then a whitespace run).
DEFAULT_MAX_LEN = 800
SENTENCE_PATTERN = r"(?s).*?[.!?][" + WS_BODY["java"] + r"]+|.+"


def js_length(c: Column) -> Column:
    """Length in UTF-16 code units (what JavaScript's ``.length`` counts)."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def sentences_expr(text: Column) -> Column:
    """Sentences of a text; trailing whitespace stays with its sentence; '' -> ['']."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))
    return F.when(text.isNull(), F.lit(None).cast("array<string>")) \
        .otherwise(let({"s": found}, lambda v: F.when(F.size(v["s"]) == 0, F.array(text)).otherwise(v["s"])))


def chunks_expr(text: Column, max_len: int = DEFAULT_MAX_LEN) -> Column:
    """Greedy chunks of whole sentences; a new chunk starts with the previous sentence."""

    def step(acc: Column, s: Column) -> Column:
        return let({"s": s, "n": js_length(s)}, lambda v: F.when(
            (acc["cur_len"] + v["n"] > max_len) & (acc["cur_len"] > 0),
            F.struct(F.concat(acc["chunks"], F.array(acc["cur"])).alias("chunks"),
                     F.concat(acc["last"], v["s"]).alias("cur"), (acc["last_len"] + v["n"]).alias("cur_len"),
                     v["s"].alias("last"), v["n"].alias("last_len")),
        ).otherwise(
            F.struct(acc["chunks"].alias("chunks"), F.concat(acc["cur"], v["s"]).alias("cur"),
                     (acc["cur_len"] + v["n"]).alias("cur_len"), v["s"].alias("last"), v["n"].alias("last_len"))))

    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"),
                    F.lit(0).alias("cur_len"), F.lit("").alias("last"), F.lit(0).alias("last_len"))
    folded = F.aggregate(sentences_expr(text), init, step,
                         lambda acc: F.when(acc["cur_len"] > 0, F.concat(acc["chunks"], F.array(acc["cur"])))
                         .otherwise(acc["chunks"]))
    # an empty text has no sentence end and no content: one empty chunk
    return F.when(text.isNull(), F.lit(None).cast("array<string>")) \
        .when(F.length(text) == 0, F.array(F.lit(""))).otherwise(folded)


def split_sentences(df: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    return df.select(key_col, F.posexplode(sentences_expr(F.col(text_col))).alias("sentence_no", "sentence"))


def chunk_documents(df: DataFrame, text_col: str = "text", key_col: str = "doc_id",
                    max_len: int = DEFAULT_MAX_LEN) -> DataFrame:
    return df.select(key_col, F.posexplode(chunks_expr(F.col(text_col), max_len)).alias("chunk_no", "chunk"))
