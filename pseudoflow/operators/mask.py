"""Masking: rules -> literals -> entities over a documents DataFrame.

``segment`` builds the segment column (narrow, no shuffle).  ``mask_rows`` numbers tokens inside
each row (every row its own session, no shuffle).  ``mask_sessions`` numbers tokens across the
rows of a session: only the distinct (session, tag, value) triples are shuffled; the text is
joined back only for rows that contain hits, by a row number of its own, so keys may repeat or be null.
``mask_with_extractor`` runs an entity extractor on text that the rules and literals have already masked.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudoflow.functions.rules import Rule, rules_for_language
from pseudoflow.operators import segments as S
from pseudoflow.operators import tokens as T
from pseudoflow.options import MaskOptions
from pseudoflow.session import materialize

# Pass numbers are longs: rules, literals, entities and (``mask_columns``) columns never share one.
LITERAL_PASS_BASE = 1 << 32
ENTITY_PASS_BASE = 1 << 34
COLUMN_PASS_BASE = 1 << 40


@dataclass
class MaskResult:
    masked: DataFrame
    mapping: DataFrame
    #: Only the mapping rows that an existing mapping didn't have (``mapping`` if there was none).
    added: Optional[DataFrame] = None

    def checkpoint(self) -> "MaskResult":
        """Cut lineage of both outputs (what writing them does in a job) before several readers use them."""
        return MaskResult(materialize(self.masked), materialize(self.mapping))


def _rules_expr(text: Column, lang: Optional[str], lang_col: Optional[str],
                rules: Optional[Sequence[Rule]], strict: bool) -> Column:
    if rules is not None:
        return S.rule_passes(text, list(rules), strict)
    if lang_col is not None:
        # M5: per-row pack; only the chosen branch is evaluated for a row
        return F.when(F.col(lang_col) == "pl", S.rule_passes(text, rules_for_language("pl"), strict)) \
            .otherwise(S.rule_passes(text, rules_for_language("en"), strict))
    return S.rule_passes(text, rules_for_language(lang), strict)


def segment(df: DataFrame, text_col: str = "text", *, options: MaskOptions = MaskOptions(engines="regex"),
            lang_col: Optional[str] = None, rules: Optional[Sequence[Rule]] = None,
            literals_col: Optional[str] = None, entities_col: Optional[str] = None,
            out_col: str = "segs") -> DataFrame:
    """Add the segment column: rules (regex / hybrid), literals (always), entities (llm / hybrid)."""
    text = F.col(text_col)
    if options.engines in ("regex", "hybrid"):
        segs = _rules_expr(text, options.lang, lang_col, rules, options.strict_validation)
    else:
        segs = S.initial_segments(text)
    config_lits = [F.lit(x) for x in options.custom_literals if x]
    lits: Optional[Column] = None
    if config_lits and literals_col:
        lits = F.concat(F.array(*config_lits), F.coalesce(F.col(literals_col), F.array().cast("array<string>")))
    elif config_lits:
        lits = F.array(*config_lits)
    elif literals_col:
        lits = F.coalesce(F.col(literals_col), F.array().cast("array<string>"))
    if lits is not None:
        segs = S.literal_passes(segs, lits, LITERAL_PASS_BASE)
    if entities_col and options.engines in ("llm", "hybrid"):
        ents = F.coalesce(F.col(entities_col), F.array().cast("array<struct<type:string,value:string>>"))
        return S.with_entity_passes(df.withColumn(out_col, segs), out_col, ents, ENTITY_PASS_BASE)
    return df.withColumn(out_col, segs)


def mask_rows(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", *,
              options: MaskOptions = MaskOptions(engines="regex"), session_col: Optional[str] = None,
              keep_cols: Sequence[str] = (), persist: bool = False, run_id: str = "run", **seg_kwargs) -> MaskResult:
    """Row-local masking (T8): each row is its own session; no shuffle at all.

    Rows are numbered from 1 each, so a row's session id comes from ``run_id``, its key and its text; a
    ``session_id`` column of the input, which several rows may share, is not used.  Give each run its own
    (secret) ``run_id``, or two runs may give one token two meanings.

    Masked text and the row's mapping come from one evaluation of the fold; with ``persist`` that
    row table is checkpointed so that both outputs can be read without recomputing it.
    """
    seg_df = segment(df, text_col, options=options, **seg_kwargs)
    if session_col is None:
        seg_df = T.with_session_id(seg_df.drop("session_id"), key_col, run_id=run_id, text_col=text_col)
        session_col = "session_id"
    base = seg_df.select(F.col(key_col), F.col(session_col).alias("session_id"), *keep_cols,
                         S.masked_and_numbering(F.col("segs")).alias("mn"))
    if persist:
        base = materialize(base)
    masked = base.select(key_col, "session_id", *keep_cols, F.col("mn.masked_text").alias("masked_text"))
    mapping = base.select("session_id", F.explode("mn.numbered").alias("m")) \
        .select("session_id", F.col("m.tag").alias("tag"), F.col("m.n").alias("n"), F.col("m.txt").alias("value"))
    mapping = mapping.select("session_id", "tag", "n", S.token_text(F.col("tag"), F.col("n")).alias("token"), "value")
    return MaskResult(masked, mapping)


def mask_sessions(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", *,
                  session_col: str = "session_id", order_col: Optional[str] = None,
                  options: MaskOptions = MaskOptions(engines="regex"), strategy: str = "range",
                  existing_mapping: Optional[DataFrame] = None, keep_cols: Sequence[str] = (),
                  run_id: str = "run", **seg_kwargs) -> MaskResult:
    """Session masking (T1-T3): numbering shared by all rows of a session, in ``order_col`` order.

    Rows that share a place are taken by key (null first), then by the digest of their text.  A row without a
    session gets one of its own, from ``run_id``, key and text.  Rows with accepted hits feed both outputs (their
    hits are numbered, their text is rebuilt with tokens), so only those rows are checkpointed, with a row
    number that alone ties tokens to texts.  Rows without hits keep their text; re-deriving them costs the
    exact pre-check for almost all of them.
    """
    seg_df = segment(df, text_col, options=options, **seg_kwargs)
    cand = candidate_expr(F.col(text_col), options, seg_kwargs.get("lang_col"), seg_kwargs.get("rules"),
                          bool(seg_kwargs.get("literals_col")), bool(seg_kwargs.get("entities_col")))
    sid = F.coalesce(F.col(session_col).cast("string"), T.own_session(F.col(key_col), F.col(text_col), run_id))
    keep = list(dict.fromkeys([key_col, *([order_col] if order_col else []), *keep_cols]))
    seg_df = seg_df.select(*keep, sid.alias("session_id"), F.col(text_col).alias("_text"), "segs", cand.alias("_cand"))
    # rows that pass the exact pre-check carry the real work: fold once, keep the result
    cand_rows = seg_df.filter("_cand").drop("_cand")
    masked, mapping, added = _number_rows(cand_rows, key_col, order_col, keep_cols, strategy, existing_mapping)
    # every other row keeps its text; for them the fold is never evaluated (column pruned)
    plain_rows = seg_df.filter(~F.col("_cand")).select(key_col, "session_id", *keep_cols, F.col("_text").alias("masked_text"))
    masked = masked.select(key_col, "session_id", *keep_cols, S.render(F.col("segs")).alias("masked_text"))
    return MaskResult(masked.unionByName(plain_rows), mapping, added)


def _number_rows(rows: DataFrame, key_col: str, order_col: Optional[str], keep_cols: Sequence[str], strategy: str,
                 existing: Optional[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (key, session_id, order, keep_cols, _text, segs) with tokens in ``segs``, the mapping, its new part."""
    hit = F.coalesce(F.exists("segs", lambda s: s["tag"].isNotNull() & (s["pass_no"] >= 0)), F.lit(False))
    rows = rows.withColumn("_hit", hit).withColumn("_tie", F.when(F.col("_hit"), F.sha2("_text", 256))).drop("_text")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    hit_rows = rows.filter("_hit")
    # done hits (pass_no -1) are text as far as numbering goes; positions stay
    values = T.row_values(hit_rows.withColumn("segs", S.only_new_hits(F.col("segs"))), key_col, order_col, "_row", "_tie")
    if existing is None:
        added = mapping = T.assign_tokens(values, strategy)
    else:
        added = materialize(T.added_tokens(existing, values, strategy))
        mapping = existing.select(*T.MAPPING_COLS).unionByName(added)
    tokens = values.select("_row", "session_id", "tag", "value", "places").join(mapping.select("session_id", "tag", "value", "token"), ["session_id", "tag", "value"])
    tokens = tokens.groupBy("_row").agg(F.collect_list(F.struct("places", "token")).alias("_tokens"))
    done = hit_rows.join(tokens, "_row")
    keep = list(dict.fromkeys([key_col, "session_id", *([order_col] if order_col else []), *keep_cols]))
    token_of = S.segments_with(S.only_new_hits(F.col("segs")), F.col("_tokens"))
    # earlier done hits stay marked as such
    marked = F.transform(F.arrays_zip(F.col("segs").alias("old"), token_of.alias("new")), lambda x: F.when(x["old"]["pass_no"] == -1, x["old"]).otherwise(x["new"]))
    out = done.select(*keep, marked.alias("segs")).unionByName(rows.filter(~F.col("_hit")).select(*keep, "segs"))
    return out, mapping, added


def mask_with_extractor(df: DataFrame, extractor, text_col: str = "text", key_col: str = "doc_id", *,
                        options: MaskOptions = MaskOptions(engines="hybrid"), session_col: Optional[str] = None,
                        order_col: Optional[str] = None, existing_mapping: Optional[DataFrame] = None,
                        strategy: str = "range", max_len: Optional[int] = None, run_id: str = "run",
                        keep_cols: Sequence[str] = (), **seg_kwargs) -> MaskResult:
    """N1 + M4: rules, literals, extraction on the masked text, entities, status.

    The extractor gets chunks of text in which every rule and literal hit is a token already (with its final
    number), so no such value ever reaches it; what it finds is put back into the plain pieces only, longest
    value first, so a token is never searched.  Chunks are cut over the masked text; entities are values, and
    each is replaced wherever it stands.  Without ``session_col`` everything stays in the row: no shuffle.  With it, rule
    and literal hits are numbered first, and the entities' numbers extend that mapping.  Texts and results of the
    extractor are checkpointed, so that no call is made twice.  ``masked`` has a column ``ner_status``.
    """
    from pseudoflow.operators.chunks import DEFAULT_MAX_LEN
    from pseudoflow.operators.entities import extract_in_rows

    max_len = max_len or DEFAULT_MAX_LEN
    if options.engines == "regex":
        raise ValueError("engines='regex' runs no extractor")
    keep_cols = list(keep_cols)
    first = segment(df, text_col, options=options, **seg_kwargs)
    sid = T.own_session(F.col(key_col), F.col(text_col), run_id)
    if session_col is not None:
        sid = F.coalesce(F.col(session_col).cast("string"), sid)
    # a literal pass and a rule pass number their hits; entities come later
    keep = list(dict.fromkeys([key_col, *([order_col] if order_col else []), *keep_cols]))
    first = first.select(*keep, sid.alias("session_id"), F.col(text_col).alias("_text"), "segs")
    known = None
    if session_col is None:
        numbered = first.withColumn("_n", S.pieces_and_numbering(F.col("segs")))
        done = F.transform(F.arrays_zip(F.col("segs").alias("old"), F.col("_n.pieces").alias("txt")), lambda x: F.struct(
            x["old"]["tag"].alias("tag"), x["txt"].alias("txt"), F.when(x["old"]["tag"].isNotNull(), F.lit(-1).cast("long")).alias("pass_no")))
        numbered = numbered.withColumn("segs", done).withColumn("_numbered", F.col("_n.numbered")).drop("_n")
    else:
        texts, known, _ = _number_rows(first, key_col, order_col, keep_cols, strategy, existing_mapping)
        known = materialize(known)
        numbered = texts
    numbered = numbered.withColumn("_text", S.render(F.col("segs")))
    asked = materialize(extract_in_rows(numbered, extractor, "_text", max_len))
    asked = S.with_entity_passes(asked, "segs", F.col("_entities"), ENTITY_PASS_BASE)
    segs = F.col("segs")
    out_cols = [key_col, "session_id", *keep_cols]
    if session_col is None:
        final = asked.withColumn("_n", S.pieces_and_numbering(S.only_new_hits(segs)))
        masked = final.select(*out_cols, F.array_join("_n.pieces", "").alias("masked_text"), "ner_status")
        # a custom rule may share a tag with the entities: its numbers come first
        both = F.concat(F.col("_numbered"), F.col("_n.numbered"))
        mapping = final.select("session_id", F.explode(both).alias("m")).select("session_id", "m.tag", "m.n", S.token_text(F.col("m.tag"), F.col("m.n")).alias("token"), F.col("m.txt").alias("value"))
        return MaskResult(masked, mapping)
    rows, mapping, added = _number_rows(asked, key_col, order_col, [*keep_cols, "ner_status"], strategy, known)
    masked = rows.select(*out_cols, S.render(F.col("segs")).alias("masked_text"), "ner_status")
    return MaskResult(masked, mapping, added)


def candidate_expr(text: Column, options: MaskOptions, lang_col: Optional[str], rules: Optional[Sequence[Rule]],
                   has_row_literals: bool, has_entities: bool) -> Column:
    """Exact pre-check: false only when no pass can produce a hit in ``text``."""
    if options.custom_literals or has_row_literals or (has_entities and options.engines in ("llm", "hybrid")):
        return F.lit(True)
    if options.engines not in ("regex", "hybrid"):
        return F.lit(False)
    if rules is not None:
        ruleset = list(rules)
    elif lang_col is not None:
        ruleset = rules_for_language("pl") + rules_for_language("en")
    else:
        ruleset = rules_for_language(options.lang)
    hint = S.prefilter_pattern(ruleset)
    if hint is None:
        return F.lit(True)
    return F.coalesce(F.regexp(text, F.lit(hint)), F.lit(False))


def pseudonymize(df: DataFrame, options: MaskOptions, text_col: str = "text", key_col: str = "doc_id", *,
                 session_col: Optional[str] = None, order_col: Optional[str] = None,
                 entities: Optional[DataFrame] = None, ner_status: Optional[DataFrame] = None,
                 **kwargs) -> MaskResult:
    """M4: orchestrate regex / literal / entity phases by ``options.engines``.

    ``entities`` is a table (key, type, value) from any extractor (N1, N5); its merged list is
    attached per row with a join on the row key.  ``ner_status`` (key, ner_status) is joined too;
    without it the status is 'disabled'.
    """
    src = df
    ent_col = None
    if entities is not None and options.engines in ("llm", "hybrid"):
        from pseudoflow.operators.entities import entity_lists
        lists = entity_lists(entities, key_col)
        src = src.join(lists, key_col, "left")
        ent_col = "entities"
    if session_col is None:
        res = mask_rows(src, text_col, key_col, options=options, entities_col=ent_col, **kwargs)
    else:
        res = mask_sessions(src, text_col, key_col, session_col=session_col, order_col=order_col,
                            options=options, entities_col=ent_col, **kwargs)
    masked = res.masked
    if ner_status is not None and options.engines in ("llm", "hybrid"):
        masked = masked.join(ner_status.select(key_col, "ner_status"), key_col, "left") \
            .withColumn("ner_status", F.coalesce("ner_status", F.lit("disabled")))
    else:
        masked = masked.withColumn("ner_status", F.lit("disabled"))
    return MaskResult(masked, res.mapping)


def mask_columns(df: DataFrame, cols: Sequence[str], key_col: str, *, options: MaskOptions = MaskOptions(engines="regex"),
                 session_col: Optional[str] = None, order_col: Optional[str] = None, strategy: str = "range",
                 existing_mapping: Optional[DataFrame] = None, keep_cols: Sequence[str] = (), run_id: str = "run",
                 **seg_kwargs) -> MaskResult:
    """M6: several text columns of a row share one session; call order = column order.

    Each row is its own session unless ``session_col`` says otherwise; then rows of a session are numbered
    together, in ``order_col`` order, and the columns of a row one after the other.  The segments of all columns lie in one
    array, so a row is masked as one text, and the columns are cut out again by their segment counts.
    Keys may repeat or be null; a null column stays null.
    """
    no_segs = F.array().cast(S.SEG_DDL)
    work, parts = df, [f"_segs_{i}" for i in range(len(cols))]
    for i, c in enumerate(cols):
        own = F.col(c).cast("string")
        work = segment(work.withColumn("_one", own), "_one", options=options, out_col=parts[i], **seg_kwargs).drop("_one")
    shifted = [F.transform(F.coalesce(F.col(p), no_segs), lambda s, i=i: F.struct(
        s["tag"].alias("tag"), s["txt"].alias("txt"), (s["pass_no"] + F.lit(i * COLUMN_PASS_BASE)).alias("pass_no"))) for i, p in enumerate(parts)]
    text = F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))
    sid = T.own_session(F.col(key_col), text, run_id)
    if session_col is not None:
        sid = F.coalesce(F.col(session_col).cast("string"), sid)
    keep = list(dict.fromkeys([key_col, *([order_col] if order_col else []), *keep_cols]))
    sizes = F.array(*[F.when(F.col(p).isNull(), F.lit(-1)).otherwise(F.size(p)) for p in parts])
    rows = work.select(*keep, sid.alias("session_id"), text.alias("_text"), F.concat(*shifted).alias("segs"), sizes.alias("_sizes"))
    if session_col is None:
        done = rows.select(*keep, "session_id", "_sizes", S.pieces_and_numbering(F.col("segs")).alias("_n"))
        pieces = F.col("_n.pieces")
        mapping = done.select("session_id", F.inline("_n.numbered")).select(
            "session_id", "tag", "n", S.token_text(F.col("tag"), F.col("n")).alias("token"), F.col("txt").alias("value"))
        added = mapping
    else:
        done, mapping, added = _number_rows(rows, key_col, order_col, [*keep_cols, "_sizes"], strategy, existing_mapping)
        pieces = F.transform("segs", lambda s: s["txt"])
    out, before = [], F.lit(0)
    for i, c in enumerate(cols):
        size = F.col("_sizes")[i]
        out.append(F.when(size >= 0, F.array_join(F.slice(pieces, before + 1, size), "")).alias(c))
        before = before + F.greatest(size, F.lit(0))
    return MaskResult(done.select(key_col, "session_id", *keep_cols, *out), mapping, added)
