"""Checksum validators as Spark column expressions.

Each validator receives the hit with whitespace already removed (as the masking pass
does) and returns a boolean column.  The digit string is bound once, the checksum is a
fixed-length sum of ``substr`` terms (no per-digit loop).
The same arithmetic is available as DuckDB SQL text for the oracle (``*_sql``).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

from pseudoflow.functions.hof import let
from pseudoflow.functions.regex import WS_BODY

# Polish tax-id weights.
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
# Card numbers have 13 to 19 digits.
CARD_MIN_DIGITS, CARD_MAX_DIGITS = 13, 19

_SEP_CLASS = f"[{WS_BODY['java']}\\-]"


def _digit(s: Column, pos) -> Column:
    return F.substring(s, pos, 1).try_cast("int") if isinstance(pos, int) else F.substr(s, pos, F.lit(1)).try_cast("int")


def strip_whitespace(c: Column) -> Column:
    """Remove every JavaScript-whitespace character (the masking pass does this before validating)."""
    return F.regexp_replace(c, F.lit(f"[{WS_BODY['java']}]"), F.lit(""))


def ssn_valid(c: Column) -> Column:
    return let({"c": F.regexp_replace(c, F.lit(_SEP_CLASS), F.lit(""))}, lambda v: _ssn_body(v["c"]))


def _ssn_body(clean: Column) -> Column:
    shape = clean.rlike(r"^\d{9}\z")
    area = F.substring(clean, 1, 3).try_cast("int")
    group = F.substring(clean, 4, 2).try_cast("int")
    serial = F.substring(clean, 6, 4).try_cast("int")
    ok = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    return F.when(shape, ok).otherwise(F.lit(False))


def luhn_valid(c: Column) -> Column:
    return let({"d": F.regexp_replace(c, F.lit(_SEP_CLASS), F.lit(""))}, lambda v: _luhn_body(v["d"]))


def _luhn_body(digits: Column) -> Column:
    shape = digits.rlike(r"^\d{%d,%d}\z" % (CARD_MIN_DIGITS, CARD_MAX_DIGITS))
    n = F.length(digits)
    terms = []
    for k in range(1, CARD_MAX_DIGITS + 1):  # k-th digit counted from the right
        d = _digit(digits, n - F.lit(k - 1))
        v = (d * 2 - F.when(d >= 5, 9).otherwise(0)) if k % 2 == 0 else d
        terms.append(F.when(n >= k, v).otherwise(F.lit(0)))
    total = reduce(lambda a, b: a + b, terms)
    return F.when(shape, (total % 10) == 0).otherwise(F.lit(False))


def nip_valid(c: Column) -> Column:
    return let({"d": F.regexp_replace(c, F.lit(r"\D"), F.lit(""))}, lambda v: _nip_body(v["d"]))


def _nip_body(digits: Column) -> Column:
    shape = F.length(digits) == 10
    total = reduce(lambda a, b: a + b, [_digit(digits, i + 1) * w for i, w in enumerate(NIP_WEIGHTS)])
    check = total % 11
    return F.when(shape, (check != 10) & (check == _digit(digits, 10))).otherwise(F.lit(False))


VALIDATORS = {"ssn": ssn_valid, "luhn": luhn_valid, "nip": nip_valid}


def python_validator(fn):
    """Wrap a Python ``str -> bool`` check as an Arrow-batched pandas UDF usable as
    ``Rule(custom_validator=...)``.  Built-in expressions above are preferred (they stay in the JVM);
    this is for checks that cannot be written as column expressions.  Note: inside the masking
    fold a Python UDF cannot run within a lambda, so custom Python validators apply to ``detect``.
    """
    @F.pandas_udf("boolean")
    def _check(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bool(fn(v)) if v is not None else False)

    return _check


# ---------------------------------------------------------------- DuckDB SQL text (oracle)

_RE2_SEP = "[" + WS_BODY["re2"] + r"\-]"


def ssn_valid_sql(x: str) -> str:
    c = f"regexp_replace({x}, '{_RE2_SEP}', '', 'g')"
    return (
        f"(CASE WHEN regexp_full_match({c}, '\\d{{9}}') THEN "
        f"(CAST(substr({c},1,3) AS INT) NOT IN (0, 666) AND CAST(substr({c},1,3) AS INT) < 900 "
        f"AND CAST(substr({c},4,2) AS INT) <> 0 AND CAST(substr({c},6,4) AS INT) <> 0) ELSE false END)"
    )


def luhn_valid_sql(x: str) -> str:
    c = f"regexp_replace({x}, '{_RE2_SEP}', '', 'g')"
    terms = []
    for k in range(1, CARD_MAX_DIGITS + 1):
        d = f"CAST(substr({c}, length({c}) - {k - 1}, 1) AS INT)"
        v = f"({d} * 2 - CASE WHEN {d} >= 5 THEN 9 ELSE 0 END)" if k % 2 == 0 else d
        terms.append(f"(CASE WHEN length({c}) >= {k} THEN {v} ELSE 0 END)")
    total = " + ".join(terms)
    return (
        f"(CASE WHEN regexp_full_match({c}, '\\d{{{CARD_MIN_DIGITS},{CARD_MAX_DIGITS}}}') "
        f"THEN ({total}) % 10 = 0 ELSE false END)"
    )


def nip_valid_sql(x: str) -> str:
    c = f"regexp_replace({x}, '\\D', '', 'g')"
    total = " + ".join(f"CAST(substr({c},{i + 1},1) AS INT) * {w}" for i, w in enumerate(NIP_WEIGHTS))
    return (
        f"(CASE WHEN length({c}) = 10 THEN (({total}) % 11 <> 10 AND ({total}) % 11 = CAST(substr({c},10,1) AS INT)) "
        f"ELSE false END)"
    )


VALIDATORS_SQL = {"ssn": ssn_valid_sql, "luhn": luhn_valid_sql, "nip": nip_valid_sql}
