"""Quality rules in column expressions: text measures, and lines that many documents of a host share.

A line is normalised (A-Z lower-cased, white space runs to one space, trimmed) and hashed.  For every
(host, line) the distinct documents are counted, copies of one text once.  Lines above the host's limit
are removed; a document of which too little is left is rejected.

Defined cases: null text has no words and fails the base rule; a null host is a host of its own; rows
that agree in id, host and text get the same verdict; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudoflow.llm.common import WORD, bind, lower_ascii, maybe_broadcast, text_or_empty, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class RuleOptions:
    """``min_docs`` and ``host_percent``: a line is removed if it stands in more than ``min_docs`` distinct
    documents of a host and in more than that share of them.  ``left_percent``: a document that keeps less
    than this share of its characters is rejected."""

    min_docs: int = 20
    host_percent: float = 10.0
    left_percent: float = 30.0


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in ``words`` (an array of strings)."""

    def marked(windows: Column) -> Column:
        by_text = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("p"))))

        def covered(s: Column) -> Column:
            again = lambda i, x: F.coalesce(F.get(s, i).getField("w") == x.getField("w"), F.lit(False))
            at = F.filter(
                F.transform(s, lambda x, i: F.when(again(i - 1, x) | again(i + 1, x), x.getField("p"))), lambda p: p.isNotNull()
            )
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bind(by_text, covered))

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(windows, marked))

    return bind(words, of)


def measures(text: Column) -> dict[str, Column]:
    """Row-local measures of a non-null text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    packed = bind(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")
        ),
    )
    return {
        "_words": packed,
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = text_or_empty(docs, text_col)
    return docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _lines(text: Column) -> Column:
    """Normalised lines that have a word."""
    norm = F.transform(F.split(lower_ascii(text), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    return F.filter(norm, lambda x: x != "")


def frequent_lines(keyed: DataFrame, options: RuleOptions) -> DataFrame:
    """(host, line) above the limit; needs doc_id, host, text, text_key."""
    each = keyed.select("host", "text_key", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("line"))
    # distinct first (with partial aggregation), then counts: a common line never meets in one task
    n_docs = each.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > options.min_docs)
    sizes = keyed.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    sizes = sizes.withColumnRenamed("host", "of")
    above = n_docs.join(sizes, F.col("host").eqNullSafe(F.col("of")))
    return above.where(F.col("n_docs") * 100 > F.col("host_docs") * options.host_percent).select("host", "line")


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", options: RuleOptions = RuleOptions()
) -> DataFrame:
    """One row per document: doc_id, measures, base_failed, n_lines_removed, chars_removed, kept."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    frequent = written(frequent_lines(keyed, options), "frequent-lines").withColumnRenamed("host", "of")
    found = keyed.select("doc_id", "host", "text_key", F.posexplode(_lines(F.col("text"))).alias("pos", "norm"))
    found = found.select("doc_id", "host", "text_key", "pos", F.xxhash64("norm").alias("line"), F.length("norm").alias("chars"))
    narrow = maybe_broadcast(frequent)
    hits = found.join(narrow, found["host"].eqNullSafe(narrow["of"]) & (found["line"] == narrow["line"]), "left_semi")
    hits = hits.dropDuplicates(["doc_id", "host", "text_key", "pos"])  # rows that are logged twice
    lost = hits.groupBy("doc_id", "host", "text_key").agg(F.count(F.lit(1)).alias("n_lines_removed"), F.sum("chars").alias("chars_removed"))
    lost = written(lost.toDF("l_id", "l_host", "l_key", "n_lines_removed", "chars_removed"), "depleted")
    text = F.col("text")
    # the words stay within their row; only numbers go through the join below
    base = keyed.select(
        "doc_id", "host", "text_key", *[v.alias(k) for k, v in measures(text).items()],
        bind(_lines(text), lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + F.length(y))).alias("line_chars"),
    )
    base = base.select("doc_id", "host", "text_key", "n_symbols", "n_dup_lines", "line_chars",
                       *[F.col(f"_words.{x}").cast("long").alias(x) for x in ("n_words", "word_chars", "n_repeat_words")])
    small = maybe_broadcast(lost)
    on = base["doc_id"].eqNullSafe(small["l_id"]) & base["host"].eqNullSafe(small["l_host"]) & (base["text_key"] == small["l_key"])
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    left = F.col("line_chars") - F.coalesce("chars_removed", F.lit(0))
    return base.join(small, on, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left * 100 >= F.col("line_chars") * options.left_percent)).alias("kept"),
        F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        F.coalesce("chars_removed", F.lit(0)).cast("long").alias("chars_removed"),
    )


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 options: RuleOptions = RuleOptions()) -> DataFrame:
    """(doc_id, text): the lines that stay, of every row that has frequent lines (rows without are left out).

    The frequent lines of a row's host come as one small array per (doc_id, host, text)."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    frequent = written(frequent_lines(keyed, options), "frequent-lines").withColumnRenamed("host", "of")
    found = keyed.select("doc_id", "host", "text_key", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("line"))
    narrow = maybe_broadcast(frequent)
    hits = found.join(narrow, found["host"].eqNullSafe(narrow["of"]) & (found["line"] == narrow["line"]), "left_semi")
    gone = hits.groupBy("doc_id", "host", "text_key").agg(F.collect_set("line").alias("gone")).toDF("g_id", "g_host", "g_key", "gone")
    on = keyed["doc_id"].eqNullSafe(gone["g_id"]) & keyed["host"].eqNullSafe(gone["g_host"]) & (keyed["text_key"] == gone["g_key"])
    norm = lambda x: F.xxhash64(F.trim(F.regexp_replace(lower_ascii(x), SPACES, " ")))
    stay = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("gone"), norm(x)))
    return keyed.join(gone, on).select("doc_id", F.array_join(stay, "\n").alias("text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT rid, i AS p, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
        FROM w, unnest(generate_series(1, len(ws) - 2)) AS g(i) WHERE len(ws) >= 4),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS x(o) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
norm AS (SELECT rid, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM raw),
lines AS (SELECT norm.rid, host, text, line FROM norm JOIN d USING (rid) WHERE line <> ''),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY host, line)
         JOIN (SELECT host, count(DISTINCT text) AS m FROM d GROUP BY host) USING (host) WHERE n > 20 AND n * 100 > m * 10.0),
lost AS (SELECT rid, count(*) FILTER (f.line IS NOT NULL) AS n_lines_removed, sum(length(l.line)) AS line_chars,
                coalesce(sum(length(l.line)) FILTER (f.line IS NOT NULL), 0) AS chars_removed
         FROM lines l LEFT JOIN freq f USING (host, line) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed,
             coalesce(chars_removed, 0) AS chars_removed, coalesce(line_chars, 0) AS line_chars
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND (line_chars - chars_removed) * 100 >= line_chars * 30.0 AS kept,
       n_lines_removed, CAST(chars_removed AS BIGINT) AS chars_removed
FROM m
"""
