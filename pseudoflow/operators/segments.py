"""The segment IR and the masking fold.

A text is held as ``ARRAY<STRUCT<tag STRING, txt STRING, pass_no INT>>``: plain pieces have
``tag = NULL``; hit pieces carry the tag and the number of the pass that produced them.
A pass (one rule, one literal, one entity) splits every plain piece with the pass' pattern:

* ``h = regexp_extract_all(txt, re)`` (the hits, leftmost, non-overlapping) and
  ``p = split(txt, re, -1)`` (the gaps, ``size(p) = size(h) + 1``);
* hits rejected by the validator are glued back to their neighbours, so a later pass can match
  across them; accepted hits become hit pieces that later passes never look into.

Everything but the entity passes is a built-in higher-order function, evaluated in the JVM.  ``let`` binds an
intermediate array once (Spark does not share sub-expressions inside lambdas).
"""

from __future__ import annotations

import re
from typing import Callable, Iterable, Optional

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.functions.arrow import in_pieces
from pseudoflow.functions.hof import let
from pseudoflow.functions.regex import LITERAL_META_CLASS, TOKEN_PATTERN
from pseudoflow.functions.rules import Rule
from pseudoflow.functions.validators import strip_whitespace

SEG_DDL = "array<struct<tag:string,txt:string,pass_no:bigint>>"
KEY_SEP = "\u0000"


def plain_seg(txt: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("tag"), txt.alias("txt"), F.lit(None).cast("long").alias("pass_no"))


def hit_seg(tag: Column, txt: Column, pass_no: Column) -> Column:
    return F.struct(tag.cast("string").alias("tag"), txt.alias("txt"), pass_no.cast("long").alias("pass_no"))


def initial_segments(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(None).cast(SEG_DDL)).otherwise(F.array(plain_seg(text)))


def _non_empty(segs: Column) -> Column:
    return F.filter(segs, lambda s: s["tag"].isNotNull() | (F.length(s["txt"]) > 0))


def _split_plain(txt: Column, pat: Column, tag: Column, pass_no: Column,
                 accept: Optional[Callable[[Column], Column]]) -> Column:
    """Split one plain string into plain / hit pieces for one pass."""

    def with_hits(v: Column) -> Column:
        h, p = v["h"], v["p"]
        n = F.size(h)
        if accept is None:
            # every hit accepted: p0 h0 p1 h1 ... pn
            return _non_empty(F.flatten(F.transform(
                F.sequence(F.lit(0), n),
                lambda i: F.when(i < n, F.array(plain_seg(F.get(p, i)), hit_seg(tag, F.get(h, i), pass_no)))
                .otherwise(F.array(plain_seg(F.get(p, i)))),
            )))

        def with_accepted(w0: Column) -> Column:
            # accepted-hit bounds, bound once (read for every group below)
            bounds0 = F.concat(F.array(F.lit(-1)), w0["acc"], F.array(n))
            return let({"pieces": w0["pieces"], "acc": w0["acc"], "bounds": bounds0}, with_bounds)

        def with_bounds(w: Column) -> Column:
            pieces, acc, bounds = w["pieces"], w["acc"], w["bounds"]
            m = F.size(acc)

            def group(g: Column) -> Column:
                a = F.get(bounds, g)
                b = F.get(bounds, g + 1)
                # pieces 2a+2 .. 2b (0-based) = text between accepted hits a and b
                plain = F.array_join(F.slice(pieces, a * 2 + 3, b * 2 - a * 2 - 1), "")
                return F.when(g < m, F.array(plain_seg(plain), hit_seg(tag, F.get(h, b), pass_no))) \
                    .otherwise(F.array(plain_seg(plain)))

            return _non_empty(F.flatten(F.transform(F.sequence(F.lit(0), m), group)))

        pieces = F.concat(
            F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(p, i), F.get(h, i)))),
            F.array(F.get(p, n)),
        )
        acc = F.filter(F.sequence(F.lit(0), n - 1), lambda i: accept(F.get(h, i)))
        return let({"pieces": pieces, "acc": acc}, with_accepted)

    return let({"h": F.regexp_extract_all(txt, pat, F.lit(0)), "p": F.split(txt, pat, -1)}, with_hits)


def apply_pass(segs: Column, pattern, tag, pass_no,
               accept: Optional[Callable[[Column], Column]] = None) -> Column:
    """One masking pass over every plain piece of ``segs``."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    tag_c = F.lit(tag) if isinstance(tag, str) else tag
    pass_c = F.lit(pass_no) if isinstance(pass_no, int) else pass_no
    return F.flatten(F.transform(
        segs,
        lambda s: F.when(s["tag"].isNull() & F.regexp(s["txt"], pat),
                         _split_plain(s["txt"], pat, tag_c, pass_c, accept))
        .otherwise(F.array(s)),
    ))


def rule_accept(rule: Rule, strict: bool) -> Optional[Callable[[Column], Column]]:
    """Validator applied to a hit (whitespace removed first), or None when no check applies."""
    if not strict or (rule.validator is None and rule.custom_validator is None):
        return None
    return lambda hit: rule.validate(strip_whitespace(hit))


def prefilter_pattern(rules: Iterable[Rule]) -> Optional[str]:
    """Regex true for any text in which at least one of ``rules`` could match, or None without such a pattern."""
    hints = {r.hint for r in rules}
    return None if None in hints else "|".join(sorted(hints))


def rule_passes(text: Column, rules: list[Rule], strict: bool = True, first_pass: int = 0) -> Column:
    """Segments of ``text`` after the ordered rule passes (pass numbers first_pass, first_pass+1, ...)."""
    segs = initial_segments(text)
    for k, rule in enumerate(rules):
        segs = apply_pass(segs, rule.java, rule.tag, first_pass + k, rule_accept(rule, strict))
    hint = prefilter_pattern(rules)
    if hint is None or not rules:
        return segs
    return F.when(text.isNull(), F.lit(None).cast(SEG_DDL)) \
        .when(F.regexp(text, F.lit(hint)), segs) \
        .otherwise(F.array(plain_seg(text)))


def escape_literal(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(LITERAL_META_CLASS), F.lit(r"\\$0"))


def sorted_by_length_desc(values: Column, length_of: Callable[[Column], Column] = F.length) -> Column:
    """Stable sort by length, longest first: ``array<struct<k, i, v>>`` ordered on (-length, index)."""
    keyed = F.transform(values, lambda v, i: F.struct((-length_of(v)).alias("k"), i.alias("i"), v.alias("v")))
    return F.array_sort(keyed)


# Characters that Java's (?iu) equates with ASCII letters, and their ASCII fold.
ASCII_FOLD_FROM = "\u212a\u017f\u0130\u0131ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_FOLD_TO = "ksiiabcdefghijklmnopqrstuvwxyz"


def _full_text(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["txt"]), "")


def literal_passes(segs: Column, literals: Column, first_pass: Column | int) -> Column:
    """Case-insensitive literal passes (tag CUSTOM), longest literal first, blanks dropped.

    Pass numbers follow the full sorted list; a literal that cannot occur in the row is skipped
    before the fold by an exact, regex-free check (``instr`` on an ASCII case fold of the text for
    ASCII literals; other literals always run), so long literal lists cost a scan, not a pass each.
    """
    lits = F.filter(literals, lambda x: x.isNotNull() & (F.length(x) > 0))
    # each literal's pattern is built once here, not again for every piece it is tried on
    ordered = F.transform(sorted_by_length_desc(lits), lambda x, j: F.struct(
        x["v"].alias("v"), j.alias("j"), F.concat(F.lit("(?iu)"), escape_literal(x["v"])).alias("re")))
    base = F.lit(first_pass) if isinstance(first_pass, int) else first_pass

    def run(v: Column) -> Column:
        folded = F.translate(_full_text(v["segs"]), ASCII_FOLD_FROM, ASCII_FOLD_TO)
        return let({"folded": folded}, lambda w: F.aggregate(
            F.filter(ordered, lambda x: ~x["v"].rlike("^[\\x00-\\x7F]*$")
                     | (F.instr(w["folded"], F.lower(x["v"])) > 0)),
            v["segs"],
            lambda acc, x: apply_pass(acc, x["re"], "CUSTOM", base + x["j"]),
        ))

    return let({"segs": segs}, run)


def with_entity_passes(df: DataFrame, segs_col: str, entities: Column, first_pass: int) -> DataFrame:
    """``df`` with case-sensitive entity passes done in ``segs_col``, sorted by untrimmed length (longest first), value
    trimmed.  The other columns pass through as Arrow data; nothing is shuffled."""
    ents = F.filter(entities, lambda e: F.length(trim_js(e["value"])) > 0)
    keyed = F.transform(ents, lambda e, i: F.struct((-F.length(e["value"])).alias("k"), i.alias("i"),
                                                    e["type"].alias("type"), trim_js(e["value"]).alias("v")))
    ordered = F.transform(F.array_sort(keyed), lambda x, j: F.struct(
        x["type"].alias("tag"), x["v"].alias("txt"), (j + first_pass).cast("long").alias("pass_no")))
    at, width = df.columns.index(segs_col), len(df.columns)
    schema = T.StructType([T.StructField(f.name, T.DataType.fromDDL(SEG_DDL)) if i == at else f for i, f in enumerate(df.schema.fields)])
    kind = pa.list_(pa.struct([("tag", pa.string()), ("txt", pa.string()), ("pass_no", pa.int64())]))

    def row(segs: list[dict] | None, ents: list[dict] | None) -> list[dict] | None:
        return None if segs is None or ents is None else _with_entities(segs, ents) if ents else segs

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(i) for i in range(width)]
        cols[at] = pa.array([row(s.as_py(), e.as_py()) for s, e in zip(cols[at], batch.column(width))], kind)
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select("*", ordered.alias("_ordered_entities")).mapInArrow(in_pieces(run), schema)


# A mark is three surrogates: no text holds them, so no entity can match in one.
MARK_BASE = 0x800
_MARK = re.compile("([\ud800-\udfff]{3})")


def _mark(n: int) -> str:
    return chr(0xD800 + n // MARK_BASE ** 2) + chr(0xD800 + n // MARK_BASE % MARK_BASE) + chr(0xD800 + n % MARK_BASE)


def _with_entities(segs: list[dict], ents: list[dict]) -> list[dict]:
    """The passes of one row: the text is one string in which hits stand as marks, so a pass is one ``replace``.

    Mark 0 parts two plain pieces; mark k stands for the k-th of the row's pieces and entities.
    """
    known = [None, *segs, *ents]
    text = "".join(_mark(k) if s["tag"] is not None or not s["txt"] else s["txt"] + _mark(0) for k, s in enumerate(segs, 1))
    for k, e in enumerate(ents, len(segs) + 1):
        # a hit without a type stays plain text, in a piece of its own
        text = text.replace(e["txt"], _mark(k) if e["tag"] is not None else _mark(0) + e["txt"] + _mark(0))
    out: list[dict] = []
    for i, part in enumerate(_MARK.split(text)):
        if i % 2 == 0:
            if part:
                out.append({"tag": None, "txt": part, "pass_no": None})
        else:
            a, b, c = (ord(x) - 0xD800 for x in part)
            if k := (a * MARK_BASE + b) * MARK_BASE + c:
                out.append(known[k])
    return out


def trim_js(c: Column) -> Column:
    """JavaScript ``trim()``: strip all (Unicode) whitespace at both ends."""
    from pseudoflow.functions.regex import WS_BODY
    ws = WS_BODY["java"]
    return F.regexp_replace(c, F.lit(f"^[{ws}]+|[{ws}]+$"), F.lit(""))


# ---------------------------------------------------------------- reading segments back

def hit_entries(segs: Column) -> Column:
    """Hits in first-replacement order: ``array<struct<pass_no, idx, tag, txt>>``."""
    hits = F.filter(
        F.transform(segs, lambda s, i: F.struct(s["pass_no"].alias("pass_no"), i.alias("idx"),
                                                s["tag"].alias("tag"), s["txt"].alias("txt"))),
        lambda x: x["tag"].isNotNull(),
    )
    return F.array_sort(hits)


def token_text(tag: Column, n: Column) -> Column:
    return F.concat(F.lit("["), tag, F.lit(":"), n.cast("string"), F.lit("]"))


def value_key(tag: Column, txt: Column) -> Column:
    return F.concat(tag, F.lit(KEY_SEP), txt)


def _plain_pieces(segs: Column) -> Column:
    """``array<struct<idx, txt>>`` of the plain pieces, keyed by their position."""
    return F.transform(
        F.filter(F.transform(segs, lambda s, i: F.struct(i.alias("idx"), s["txt"].alias("txt"), s["tag"].alias("tag"))),
                 lambda x: x["tag"].isNull()),
        lambda x: F.struct(x["idx"].alias("idx"), x["txt"].alias("txt")))


def _merge_by_idx(plains: Column, tokens: Column) -> Column:
    """Pieces of text from plain pieces and token pieces ``(idx, txt)``: one sort by position, no lookups."""
    return F.transform(F.array_sort(F.concat(plains, tokens)), lambda x: x["txt"])


def masked_and_numbering(segs: Column) -> Column:
    """``struct<masked_text, numbered>`` from one evaluation of ``segs`` (row-local tokens)."""
    return let({"r": pieces_and_numbering(segs)}, lambda v: F.struct(
        F.array_join(v["r"]["pieces"], "").alias("masked_text"), v["r"]["numbered"].alias("numbered")))


def pieces_and_numbering(segs: Column) -> Column:
    """``struct<pieces, numbered>``: the text of every segment, hits as row-local tokens, and the numbering.

    O(h log h) in the row's hits h, without map lookups (Spark map lookups scan linearly):
    hits sorted by value key -> the first hit of each key -> numbers by (tag, first replacement)
    -> each number repeated over its key's hits (``array_repeat`` + ``flatten``) -> tokens and plain
    pieces merged by position with one sort.
    """
    empty_num = F.array().cast("array<struct<tag:string,txt:string,n:bigint>>")

    def with_sorted(w: Column) -> Column:
        srt, h = w["S"], F.size(w["S"])
        starts = F.filter(F.sequence(F.lit(0), h - 1),
                          lambda q: (q == 0) | (F.get(srt, q - 1)["key"] != F.get(srt, q)["key"]))
        return let({"S": srt, "starts": starts}, lambda u: with_starts(u, w["plains"]))

    def with_starts(u: Column, plains: Column) -> Column:
        srt, starts = u["S"], u["starts"]
        h, g = F.size(srt), F.size(starts)
        firsts = F.transform(starts, lambda st: F.get(srt, st))
        return let({"S": srt, "starts": starts, "F": firsts}, lambda z: finish(z, plains, h, g))

    def finish(z: Column, plains: Column, h: Column, g: Column) -> Column:
        srt, starts, firsts = z["S"], z["starts"], z["F"]
        tags = F.array_distinct(F.transform(firsts, lambda f: f["tag"]))
        # bound once: an expression read inside a lambda is evaluated again for every element
        less = F.map_from_arrays(tags, F.transform(tags, lambda t: F.size(F.filter(firsts, lambda f: f["tag"] < t))))
        return let({"S": srt, "starts": starts, "F": firsts, "less": less}, lambda zz: rank(zz, plains, h, g))

    def rank(zz: Column, plains: Column, h: Column, g: Column) -> Column:
        srt, starts, firsts, less = zz["S"], zz["starts"], zz["F"], zz["less"]
        by_tag = F.array_sort(F.transform(firsts, lambda f, r: F.struct(f["tag"].alias("tag"), f["p"].alias("p"), r.alias("r"))))
        numbers = F.transform(
            F.array_sort(F.transform(by_tag, lambda x, q: F.struct(
                x["r"].alias("r"), (q + 1 - F.element_at(less, x["tag"])).cast("long").alias("n")))),
            lambda x: x["n"])
        return let({"S": srt, "starts": starts, "F": firsts, "N": numbers}, lambda y: spread(y, plains, h, g))

    def spread(y: Column, plains: Column, h: Column, g: Column) -> Column:
        srt, starts, numbers = y["S"], y["starts"], y["N"]
        full = F.flatten(F.transform(F.sequence(F.lit(0), g - 1), lambda r: F.array_repeat(
            F.get(numbers, r), F.coalesce(F.get(starts, r + 1), h) - F.get(starts, r))))
        return let({"S": srt, "F": y["F"], "N": numbers, "full": full}, lambda x: emit(x, plains, h, g))

    def emit(y: Column, plains: Column, h: Column, g: Column) -> Column:
        srt, firsts, numbers, full = y["S"], y["F"], y["N"], y["full"]
        tokens = F.transform(F.sequence(F.lit(0), h - 1), lambda q: F.struct(
            F.get(srt, q)["idx"].alias("idx"), token_text(F.get(srt, q)["tag"], F.get(full, q)).alias("txt")))
        numbered = F.transform(F.sequence(F.lit(0), g - 1), lambda r: F.struct(
            F.get(firsts, r)["tag"].alias("tag"),
            F.substring(F.get(firsts, r)["key"], F.length(F.get(firsts, r)["tag"]) + 2, 1 << 30).alias("txt"),
            F.get(numbers, r).alias("n")))
        return F.struct(_merge_by_idx(plains, tokens).alias("pieces"), numbered.alias("numbered"))

    def body(v: Column) -> Column:
        ents = hit_entries(v["segs"])
        keyed = F.transform(ents, lambda x, p: F.struct(value_key(x["tag"], x["txt"]).alias("key"), p.alias("p"),
                                                         x["idx"].alias("idx"), x["tag"].alias("tag")))
        no_hits = F.struct(F.transform(v["segs"], lambda s: s["txt"]).alias("pieces"), empty_num.alias("numbered"))
        return F.when(F.size(ents) == 0, no_hits).otherwise(
            let({"S": F.array_sort(keyed), "plains": _plain_pieces(v["segs"])}, with_sorted))

    null_row = F.struct(F.lit(None).cast("array<string>").alias("pieces"), empty_num.alias("numbered"))
    n_hits = lambda v: F.size(F.filter(v["segs"], lambda x: x["tag"].isNotNull()))
    # the null check reads the bound value: ``segs`` (the whole fold) is evaluated once.  Rows with
    # few hits (the usual case) take the direct path; rows with many take the O(h log h) path.
    return let({"segs": segs}, lambda v: F.when(v["segs"].isNull(), null_row)
               .when(n_hits(v) <= SMALL_ROW_HITS, _small_row(v["segs"]))
               .otherwise(body(v)))


# Rows with at most this many hits are numbered directly (quadratic in hits, cheapest when small).
SMALL_ROW_HITS = 64


def _small_row(segs: Column) -> Column:
    """``struct<pieces, numbered>`` for a row with few hits: distinct values in first-replacement
    order, n = rank among earlier values of the same tag, tokens looked up in a small map."""

    def number(v: Column) -> Column:
        keys = v["keys"]
        return F.transform(keys, lambda k, j: F.struct(
            k["tag"].alias("tag"), k["txt"].alias("txt"),
            F.size(F.filter(F.slice(keys, 1, j + 1), lambda q: q["tag"] == k["tag"])).cast("long").alias("n")))

    keys = F.array_distinct(F.transform(hit_entries(segs), lambda x: F.struct(x["tag"].alias("tag"), x["txt"].alias("txt"))))

    def render(w: Column) -> Column:
        tokmap = F.map_from_entries(F.transform(w["numbered"], lambda x: F.struct(
            value_key(x["tag"], x["txt"]).alias("key"), token_text(x["tag"], x["n"]).alias("value"))))
        return let({"segs": w["segs"], "numbered": w["numbered"], "tokmap": tokmap}, lambda u: F.struct(
            F.transform(u["segs"], lambda s: F.when(s["tag"].isNull(), s["txt"])
                        .otherwise(F.element_at(u["tokmap"], value_key(s["tag"], s["txt"])))).alias("pieces"),
            u["numbered"].alias("numbered")))

    return let({"segs": segs, "numbered": let({"keys": keys}, number)}, render)


def render_local(segs: Column) -> Column:
    """Masked text with row-local tokens."""
    return masked_and_numbering(segs)["masked_text"]


def local_numbering(segs: Column) -> Column:
    """Row-local dense numbering per tag by first replacement: ``array<struct<tag, txt, n>>``."""
    return masked_and_numbering(segs)["numbered"]


def grouped_hits(segs: Column) -> Column:
    """Distinct values of a row: ``array<struct<tag, txt, pass_no, idx, places>>``; (pass_no, idx) is the first
    replacement, ``places`` all positions.  One sort of the row's hits, so repeated values leave the row once."""

    def groups(v: Column) -> Column:
        srt, starts = v["S"], v["starts"]

        def one(st: Column, r: Column) -> Column:
            mine = F.slice(srt, st + 1, F.coalesce(F.get(starts, r + 1), F.size(srt)) - st)
            return let({"m": mine}, lambda w: F.struct(
                F.get(w["m"], 0)["tag"].alias("tag"), F.get(w["m"], 0)["txt"].alias("txt"),
                F.get(w["m"], 0)["pass_no"].alias("pass_no"), F.get(w["m"], 0)["idx"].alias("idx"),
                F.transform(w["m"], lambda x: x["idx"]).alias("places")))

        return F.transform(starts, one)

    def with_sorted(v: Column) -> Column:
        starts = F.filter(F.transform(v["S"], lambda x, q: q), lambda q: (q == 0) | (
            value_key(F.get(v["S"], q - 1)["tag"], F.get(v["S"], q - 1)["txt"]) != value_key(F.get(v["S"], q)["tag"], F.get(v["S"], q)["txt"])))
        return let({"S": v["S"], "starts": starts}, groups)

    keyed = F.transform(hit_entries(segs), lambda x: F.struct(x["tag"].alias("tag"), x["txt"].alias("txt"), x["pass_no"].alias("pass_no"), x["idx"].alias("idx")))
    return let({"S": F.array_sort(keyed)}, with_sorted)


def places_of(values: Column) -> Column:
    """Distinct strings of an array with their positions: ``array<struct<value, places>>``, by one sort."""

    def groups(v: Column) -> Column:
        srt, starts = v["S"], v["starts"]
        return F.transform(starts, lambda st, r: let({"m": F.slice(srt, st + 1, F.coalesce(F.get(starts, r + 1), F.size(srt)) - st)}, lambda w: F.struct(
            F.get(w["m"], 0)["v"].alias("value"), F.transform(w["m"], lambda x: x["i"]).alias("places"))))

    def with_sorted(v: Column) -> Column:
        starts = F.filter(F.transform(v["S"], lambda x, q: q), lambda q: (q == 0) | (F.get(v["S"], q - 1)["v"] != F.get(v["S"], q)["v"]))
        return let({"S": v["S"], "starts": starts}, groups)

    return let({"S": F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))}, with_sorted)


def segments_with(segs: Column, tokens: Column) -> Column:
    """Segments whose hits hold their token; ``tokens`` = ``array<struct<places, token>>``.  Done hits have
    pass_no -1 and are never searched again."""
    placed = F.flatten(F.transform(tokens, lambda t: F.transform(t["places"], lambda i: F.struct(i.alias("idx"), t["token"].alias("txt")))))

    def body(v: Column) -> Column:
        merged = _merge_by_idx(_plain_pieces(v["segs"]), placed)
        return F.transform(F.arrays_zip(v["segs"], merged.alias("out")), lambda x: F.struct(
            x["segs"]["tag"].alias("tag"), x["out"].alias("txt"), F.when(x["segs"]["tag"].isNotNull(), F.lit(-1).cast("long")).alias("pass_no")))

    return let({"segs": segs}, body)


def only_new_hits(segs: Column) -> Column:
    """Segments in which done hits (their text is a token) count as plain text."""
    return F.transform(segs, lambda s: F.when(s["pass_no"] == -1, plain_seg(s["txt"])).otherwise(s))


def render(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["txt"]), "")


def has_token_shape(text: Column) -> Column:
    return F.regexp(text, F.lit(TOKEN_PATTERN))
