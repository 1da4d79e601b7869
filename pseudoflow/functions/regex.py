"""Regex dialect helpers.

Rule patterns are kept in their original JavaScript spelling (see ``rules.py``) and
rewritten here for the two engines that run them:

* ``java``  — Spark's ``rlike`` / ``regexp_extract_all`` / ``split`` (java.util.regex);
* ``re2``   — DuckDB, used only by the SQL oracle in ``__spark_entry__.py``.

Differences handled (JavaScript semantics are the target):

* ``\\b`` is ASCII in JavaScript; Java's is Unicode aware, so it is spelled out with
  look-around over ``[A-Za-z0-9_]``.  RE2's ``\\b`` is already ASCII.
* ``\\s`` covers Unicode spaces in JavaScript but only ASCII in Java / RE2, so it becomes an
  explicit class (also inside character classes).
* ``[`` inside a character class is literal in JavaScript and opens a nested class in Java.
"""

from __future__ import annotations

# JavaScript's \s = ASCII whitespace plus these code points.
JS_EXTRA_SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Body of a character class equal to JavaScript's \s, per dialect.
WS_BODY = {
    "java": r"\s" + JS_EXTRA_SPACES,
    "re2": r"\t\n\x0B\f\r " + JS_EXTRA_SPACES,
}

_WORD = "[A-Za-z0-9_]"
# ASCII word boundary for Java.
JAVA_B = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# The token shape written by masking and recognised by restore.
TOKEN_PATTERN = r"\[[A-Z_]+:\d+\]"

# Metacharacters escaped when a literal string is turned into a pattern.
LITERAL_META_CLASS = r"[.*+?^${}()|\[\]\\]"


def translate(js_pattern: str, dialect: str = "java") -> str:
    """Rewrite a JavaScript regex source for ``dialect`` ('java' or 're2')."""
    if dialect not in WS_BODY:
        raise ValueError(f"unknown dialect {dialect!r}")
    out: list[str] = []
    in_class = False
    i = 0
    n = len(js_pattern)
    while i < n:
        ch = js_pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = js_pattern[i + 1]
            if nxt == "s":
                out.append(WS_BODY[dialect] if in_class else f"[{WS_BODY[dialect]}]")
            elif nxt == "b" and not in_class:
                out.append(JAVA_B if dialect == "java" else r"\b")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
                out.append(ch)
            elif ch == "[":
                out.append(r"\[")
            else:
                out.append(ch)
        else:
            if ch == "[":
                in_class = True
                out.append(ch)
                # a leading ']' or '^]' is literal in neither dialect; nothing to do
            else:
                out.append(ch)
        i += 1
    return "".join(out)


def with_flags(pattern: str, flags: str) -> str:
    """Prefix inline flags ('i' → case-insensitive)."""
    return f"(?{flags}){pattern}" if flags else pattern


def java_ws_class() -> str:
    return f"[{WS_BODY['java']}]"
