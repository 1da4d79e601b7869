"""DuckDB SQL text for the correctness oracle (independent of the Spark implementation).

DuckDB runs RE2: ASCII ``\\b`` and no look-around.  Two rules need a rewrite:

* ``pl.pesel`` ``(?<!\\+)\\b\\d{11}\\b`` -> match ``\\+?\\b\\d{11}\\b`` and drop hits starting with '+';
* ``pl.phone`` alternative 1 ends in ``\\d(?!\\d)`` -> ``\\d(?:\\D|$)``; the extra character is cut
  from the hit and given back to the text after it.

Masking uses one alternation of the pack's patterns (in pack order), classifies each hit by the
first rule that matches it whole, validates, numbers distinct values by first replacement and
glues gaps and tokens back together.  This equals the sequential passes when hits of different
rules do not overlap, which holds for the shipped tables and the generated notes.
"""

from __future__ import annotations

from typing import Sequence

from pseudoflow.functions.regex import WS_BODY
from pseudoflow.functions.rules import Rule, rule_by_id
from pseudoflow.functions.validators import VALIDATORS_SQL

WS_RE2 = f"[{WS_BODY['re2']}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2_of(rule: Rule) -> str:
    """RE2 pattern for a rule (look-around rewritten as described above)."""
    if rule.rule_id == "pl.pesel":
        return r"\+?\b\d{11}\b"
    pat = rule.re2
    if rule.rule_id == "pl.phone":
        pat = pat.replace(r"\d(?!\d)", r"\d(?:\D|$)")
    return pat


def hit_fix(rule: Rule, x: str) -> tuple[str, str, str]:
    """(keep-condition, core value, tail given back) SQL for a raw RE2 hit ``x`` of ``rule``."""
    if rule.rule_id == "pl.pesel":
        return f"({x})[1] <> '+'", x, "''"
    if rule.rule_id == "pl.phone":
        ends = f"regexp_matches({x}, '\\D$')"
        return "true", f"(CASE WHEN {ends} THEN left({x}, length({x}) - 1) ELSE {x} END)", \
            f"(CASE WHEN {ends} THEN right({x}, 1) ELSE '' END)"
    return "true", x, "''"


def valid_sql(rule: Rule, x: str, strict: bool = True) -> str:
    if not strict or rule.validator is None:
        return "true"
    return VALIDATORS_SQL[rule.validator](f"regexp_replace({x}, {q(WS_RE2)}, '', 'g')")


def detect_sql(src: str, key: str, text: str, rule: Rule, strict: bool = True) -> str:
    """D1 for one rule: key, hit_no, value, valid."""
    keep, core, _ = hit_fix(rule, "x")
    hits = f"list_transform(list_filter(regexp_extract_all({text}, {q(re2_of(rule))}), lambda x: {keep}), lambda x: {core})"
    return f"""
SELECT {key}, hit_no, value, {valid_sql(rule, 'value', strict)} AS valid FROM (
  SELECT {key}, generate_subscripts(h, 1) - 1 AS hit_no, unnest(h) AS value
  FROM (SELECT {key}, {hits} AS h FROM ({src}) s)
) t"""


def _classify(rules: Sequence[Rule], hit: str) -> str:
    parts = []
    for k, r in enumerate(rules):
        keep, _, _ = hit_fix(r, hit)
        core = hit_fix(r, hit)[1]
        parts.append(f"WHEN {keep} AND regexp_full_match({core}, {q(re2_of(r))}) THEN {k}")
    return "CASE " + " ".join(parts) + " END"


def _case(rules: Sequence[Rule], rk: str, fn) -> str:
    return "CASE " + " ".join(f"WHEN {rk} = {k} THEN {fn(r)}" for k, r in enumerate(rules)) + " END"


def masked_hits_sql(src: str, key: str, text: str, packs: dict[str, Sequence[Rule]], lang_expr: str = "'en'",
                    strict: bool = True, extra_cols: dict[str, str] | None = None) -> str:
    """CTE body producing per-hit rows: k, lang, i, rk, tag, core, tail, ok (+ extra cols) and the gap pieces.

    Returns SQL defining CTEs ``parts``, ``acc`` (the caller appends more CTEs and a final SELECT).
    ``packs`` maps a language value to its ordered rules; ``lang_expr`` picks the pack per row.
    """
    langs = list(packs)
    alt = {lg: "|".join(f"(?:{re2_of(r)})" for r in packs[lg]) for lg in langs}

    def per_lang(fn) -> str:
        if len(langs) == 1:
            return fn(langs[0])
        return "CASE " + " ".join(f"WHEN lg = {q(lg)} THEN {fn(lg)}" for lg in langs[:-1]) + f" ELSE {fn(langs[-1])} END"

    h = per_lang(lambda lg: f"regexp_extract_all(t, {q(alt[lg])})")
    p = per_lang(lambda lg: f"regexp_split_to_array(t, {q(alt[lg])})")
    rk = per_lang(lambda lg: _classify(packs[lg], "hit"))
    tag = per_lang(lambda lg: _case(packs[lg], "rk", lambda r: q(r.tag)))
    core = per_lang(lambda lg: _case(packs[lg], "rk", lambda r: hit_fix(r, "hit")[1]))
    tail = per_lang(lambda lg: _case(packs[lg], "rk", lambda r: hit_fix(r, "hit")[2]))
    ok = per_lang(lambda lg: _case(packs[lg], "rk", lambda r: valid_sql(r, hit_fix(r, "hit")[1], strict)))
    extra_cols = extra_cols or {}
    ex = "".join(f", {a}" for a in extra_cols)
    ex_def = "".join(f", {e} AS {a}" for a, e in extra_cols.items())
    return f"""
parts AS (SELECT k, lg, t{ex}, {h} AS h, {p} AS p FROM (SELECT {key} AS k, {lang_expr} AS lg, {text} AS t{ex_def} FROM ({src}) s0) s1),
hits0 AS (SELECT k, lg{ex}, generate_subscripts(h, 1) AS i, unnest(h) AS hit FROM parts),
hits1 AS (SELECT *, {rk} AS rk FROM hits0),
acc AS (SELECT *, {tag} AS tag, {core} AS core, {tail} AS tail, coalesce({ok}, false) AS ok FROM hits1)"""


def render_sql(numbered_join: str) -> str:
    """Final CTEs: ``rep`` from acc joined with a numbering CTE ``num(k, tag, core, n)``; output k, masked_text."""
    return f"""
rep AS (SELECT a.k, a.i, CASE WHEN a.ok THEN '[' || a.tag || ':' || CAST(n.n AS VARCHAR) || ']' || a.tail ELSE a.hit END AS r
        FROM acc a LEFT JOIN {numbered_join} n ON a.k = n.k AND a.tag = n.tag AND a.core = n.core AND a.ok),
pieces AS (SELECT k, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM parts),
allp AS (SELECT k, 2 * i - 1 AS o, piece AS s FROM pieces UNION ALL SELECT k, 2 * i AS o, r AS s FROM rep),
masked AS (SELECT k, string_agg(s, '' ORDER BY o) AS masked_text FROM allp GROUP BY k)"""


def mask_rows_sql(src: str, key: str, text: str, packs: dict[str, Sequence[Rule]], lang_expr: str = "'en'",
                  strict: bool = True) -> str:
    """Row-local masking: key, masked_text."""
    return f"""
WITH {masked_hits_sql(src, key, text, packs, lang_expr, strict)},
firsts AS (SELECT k, tag, core, min(rk * 100000000 + i) AS f FROM acc WHERE ok GROUP BY k, tag, core),
num AS (SELECT k, tag, core, row_number() OVER (PARTITION BY k, tag ORDER BY f) AS n FROM firsts),
{render_sql('num')}
SELECT k AS {key}, masked_text FROM masked"""


def session_cte_sql(src: str, key: str, text: str, packs: dict[str, Sequence[Rule]], lang_expr: str,
                    session: str, order: str, strict: bool = True, batch_expr: str = "0") -> str:
    """CTEs up to ``snum(sid, tag, core, n)`` and ``masked`` for session numbering."""
    return f"""
WITH {masked_hits_sql(src, key, text, packs, lang_expr, strict, extra_cols={"sid": session, "cs": order, "bt": batch_expr})},
sfirst AS (SELECT sid, tag, core, min(bt * 1000000000000000 + cs * 1000000000 + rk * 100000000 + i) AS f
           FROM acc WHERE ok GROUP BY sid, tag, core),
snum AS (SELECT sid, tag, core, row_number() OVER (PARTITION BY sid, tag ORDER BY f) AS n FROM sfirst),
num AS (SELECT a.k, a.tag, a.core, s.n FROM (SELECT DISTINCT k, sid, tag, core FROM acc WHERE ok) a
        JOIN snum s ON a.sid = s.sid AND a.tag = s.tag AND a.core = s.core),
{render_sql('num')}"""
