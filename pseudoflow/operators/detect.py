"""Detection: spans of every rule (independent) and spans actually masked (sequential)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudoflow.functions.hof import let, sums_before
from pseudoflow.functions.rules import Rule
from pseudoflow.functions.validators import strip_whitespace
from pseudoflow.operators.segments import prefilter_pattern

SPAN_COLS = ("rule_id", "tag", "hit_no", "value", "valid")


HITS_DDL = "array<struct<value:string,start:bigint>>"


def _hits(text: Column, rule: Rule, with_offsets: bool) -> Column:
    """Hits of one rule; a hit starts after the gaps and hits before it, which are summed inside the row."""
    pat = F.lit(rule.java)
    found = F.regexp_extract_all(text, pat, F.lit(0))
    if not with_offsets:
        hits = F.transform(found, lambda h: F.struct(h.alias("value"), F.lit(None).cast("bigint").alias("start")))
    else:
        def pieces(v: Column) -> Column:
            gaps = F.transform(F.slice(v["g"], F.lit(1), F.size(v["h"])), F.length)
            return let({"h": v["h"], "gaps": gaps, "hits": F.transform(v["h"], F.length)}, summed)

        def summed(v: Column) -> Column:
            before = sums_before(F.zip_with(v["gaps"], v["hits"], lambda g, h: (g + h).cast("bigint")))
            start = F.zip_with(before, v["gaps"], lambda b, g: b + g)
            return F.zip_with(v["h"], start, lambda h, s: F.struct(h.alias("value"), s.alias("start")))

        hits = let({"h": found, "g": F.split(text, rule.java, -1)}, pieces)
    return F.when(F.regexp(text, pat), hits).otherwise(F.array().cast(HITS_DDL))


def detect(df: DataFrame, rules: Sequence[Rule], text_col: str = "text", key_col: str = "doc_id",
           strict: bool = True, with_offsets: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Every rule matched independently on the original text (one scan of the input, no shuffle).

    Output: key, carried columns, rule_rank, rule_id, tag, hit_no (0-based per rule), value, valid [, start, end].
    ``valid`` is the rule's validator on the hit with whitespace removed (true without validator
    or when ``strict`` is off).
    """
    text = F.col(text_col)
    per_rule = [F.struct(F.lit(rank).alias("rule_rank"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.tag).alias("tag"),
                         _hits(text, r, with_offsets).alias("hits")) for rank, r in enumerate(rules)]
    hint = prefilter_pattern(rules)
    src = df.filter(F.regexp(text, F.lit(hint))) if hint else df
    exploded = src.select(key_col, *carry, F.explode(F.array(*per_rule)).alias("r")) \
        .filter(F.size("r.hits") > 0) \
        .select(key_col, *carry, "r.rule_rank", "r.rule_id", "r.tag", F.posexplode("r.hits").alias("hit_no", "hit")) \
        .select(key_col, *carry, "rule_rank", "rule_id", "tag", "hit_no", "hit.value", "hit.start")
    valid = F.lit(True)
    if strict:
        checks = [(r.rule_id, r.validate(strip_whitespace(F.col("value")))) for r in rules
                  if r.validator is not None or r.custom_validator is not None]
        if checks:
            expr = F.lit(True)
            for rid, chk in reversed(checks):
                expr = F.when(F.col("rule_id") == rid, chk).otherwise(expr)
            valid = expr
    out = exploded.withColumn("valid", valid)
    if with_offsets:
        start = F.col("start").cast("int")
        return out.select(key_col, *carry, "rule_rank", *SPAN_COLS, start.alias("start"),
                          (start + F.length("value")).cast("int").alias("end"))
    return out.select(key_col, *carry, "rule_rank", *SPAN_COLS)


def detect_sequential(seg_df: DataFrame, key_col: str = "doc_id", segs_col: str = "segs") -> DataFrame:
    """The spans the masking pass actually replaced, with character offsets in the original text.

    Offsets are running sums of piece lengths inside the row; only hit pieces leave it.
    """

    def hits(v: Column) -> Column:
        placed = F.zip_with(
            v["s"], sums_before(F.transform(v["s"], lambda s: F.length(s["txt"]).cast("bigint"))),
            lambda s, at: F.struct(s["pass_no"].alias("pass_no"), s["tag"].alias("tag"), s["txt"].alias("value"), at.alias("start")))
        numbered = F.transform(placed, lambda p, i: F.struct(
            i.alias("idx"), p["pass_no"].alias("pass_no"), p["tag"].alias("tag"), p["value"].alias("value"),
            p["start"].cast("int").alias("start")))
        return F.filter(numbered, lambda p: p["tag"].isNotNull())

    found = let({"s": F.col(segs_col)}, hits)
    return seg_df.select(key_col, F.explode(found).alias("p")).select(key_col, "p.idx", "p.pass_no", "p.tag", "p.value", "p.start")
