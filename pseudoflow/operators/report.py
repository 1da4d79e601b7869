"""PII report (re-aim of the privacy-scan workflow): hits, distinct values and rejects per group."""

from __future__ import annotations

from functools import reduce
from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudoflow.session import materialize


def _joined(spans: DataFrame, docs: Optional[DataFrame], group_cols: Sequence[str], key_col: str) -> DataFrame:
    return spans if docs is None else spans.join(docs.select(key_col, *group_cols), key_col)


def pii_report(spans: DataFrame, docs: Optional[DataFrame], group_cols: Sequence[str], key_col: str = "doc_id",
               rollup: bool = False) -> DataFrame:
    """D3: per group and tag — accepted hits, distinct accepted values, rejected candidates, documents.

    ``spans`` comes from ``detect`` (key, tag, value, valid); the group columns are carried by it
    (``detect(..., carry=group_cols)``), or joined from ``docs`` if that is given.  Spans are counted once per (group, tag,
    value, document) and kept; each level of the report (one, or with ``rollup`` one per prefix of the columns) counts that
    table by value and by document, so no row is multiplied (no Expand).
    """
    keys = [*group_cols, "tag"]
    counted = materialize(_joined(spans, docs, group_cols, key_col).groupBy(*keys, "value", F.col(key_col).alias("_doc")).agg(
        F.count(F.when(F.col("valid"), 1)).alias("hits"), F.count(F.when(~F.col("valid"), 1)).alias("rejected")))

    def level(cols: list[str]) -> DataFrame:
        names = ("hits", "distinct_values", "rejected", "documents")
        by_value = counted.groupBy(*cols, "value").agg(F.sum("hits").alias("hits"), F.sum("rejected").alias("rejected"))
        by_doc = counted.groupBy(*cols, "_doc").agg(F.sum("hits").alias("hits"))
        some, none = F.when(F.col("hits") > 0, 1).otherwise(0).cast("long"), F.lit(0).cast("long")
        both = by_value.select(*cols, "hits", some.alias("distinct_values"), "rejected", none.alias("documents")) \
            .unionByName(by_doc.select(*cols, none.alias("hits"), none.alias("distinct_values"), none.alias("rejected"), some.alias("documents")))
        out = both.groupBy(*cols).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in names])
        missing = [F.lit(None).cast(counted.schema[c].dataType).alias(c) for c in keys if c not in cols]
        return out.select(*cols, *missing, *names).select(*keys, *names)

    levels = [keys[:k] for k in range(len(keys), -1, -1)] if rollup else [keys]
    return reduce(lambda a, b: a.unionByName(b), [level(c) for c in levels])


def pii_sketch(spans: DataFrame, docs: Optional[DataFrame], group_cols: Sequence[str], key_col: str = "doc_id", precision: int = 14) -> DataFrame:
    """D3 as a table that adds up: counts, and HLL sketches of the accepted values and their documents.

    Write one a day (the day among ``group_cols``); ``merge_sketches`` makes the report of any span of days."""
    joined = _joined(spans, docs, group_cols, key_col)
    return joined.groupBy(*group_cols, "tag").agg(
        F.count(F.when(F.col("valid"), 1)).alias("hits"), F.count(F.when(~F.col("valid"), 1)).alias("rejected"),
        F.hll_sketch_agg(F.when(F.col("valid"), F.col("value")), precision).alias("values_sketch"),
        F.hll_sketch_agg(F.when(F.col("valid"), F.col(key_col).cast("string")), precision).alias("documents_sketch"))


def merge_sketches(sketches: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Report per ``group_cols`` and tag from any tables of ``pii_sketch``; distinct counts are estimates (about 1 % at precision 14)."""
    return sketches.groupBy(*group_cols, "tag").agg(
        F.sum("hits").alias("hits"), F.sum("rejected").alias("rejected"),
        F.hll_sketch_estimate(F.hll_union_agg("values_sketch")).alias("distinct_values"),
        F.hll_sketch_estimate(F.hll_union_agg("documents_sketch")).alias("documents"))
