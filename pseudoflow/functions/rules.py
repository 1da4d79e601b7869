"""The rule catalogue, language packs and level presets.

A rule is one detection operator over a text column: a pattern, the tag its hits get,
the locales and levels it belongs to and an optional validator (a Column -> Column
function, see ``validators.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Callable, Optional

from pyspark.sql import Column

from pseudoflow.functions import validators as V
from pseudoflow.functions.regex import translate, with_flags

LEVELS = ("balanced", "strict", "paranoid")
LOCALES = ("pl", "en")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    tag: str
    pattern: str  # JavaScript source spelling
    locales: Optional[tuple[str, ...]]  # None = global
    levels: tuple[str, ...]
    description: str
    validator: Optional[str] = None  # name in validators.VALIDATORS
    flags: str = ""
    custom_validator: Optional[Callable[[Column], Column]] = field(default=None, compare=False)
    hint: Optional[str] = None  # pattern found in every text that has a hit; None = unknown, all texts are searched

    @property
    def java(self) -> str:
        return with_flags(translate(self.pattern, "java"), self.flags)

    @property
    def re2(self) -> str:
        return with_flags(translate(self.pattern, "re2"), self.flags)

    def validate(self, cleaned: Column) -> Optional[Column]:
        """Validator expression over the hit with whitespace removed, or None."""
        if self.custom_validator is not None:
            return self.custom_validator(cleaned)
        if self.validator is None:
            return None
        return V.VALIDATORS[self.validator](cleaned)

    def applies_to_locale(self, locale: str) -> bool:
        return self.locales is None or locale in self.locales


B, S, P = "balanced", "strict", "paranoid"

# The catalogue in its canonical order, patterns in JavaScript spelling.
RULES: tuple[Rule, ...] = (
    Rule("global.email", "EMAIL", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
         None, (B, S, P), "e-mail address"),
    Rule("global.phone", "PHONE", r"\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?(?:[\s.\-]?\d{1,4}){2,4}\b",
         None, (S, P), "international phone number with a + country code"),
    Rule("global.iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b",
         None, (S, P), "IBAN-shaped account number, any country, compact"),
    Rule("global.ipv4", "IP",
         r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)\b",
         None, (S, P), "IPv4 address"),
    Rule("global.ipv6", "IP", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b",
         None, (P,), "IPv6 address, hex groups with colons"),
    Rule("global.url", "URL", r'https?:\/\/[^\s<>"{}\\|^[\]]+',
         None, (P,), "http(s) URL"),
    Rule("pl.pesel", "PESEL", r"(?<!\+)\b\d{11}\b",
         ("pl",), (B, S, P), "Polish national id, 11 digits"),
    Rule("pl.iban", "IBAN", r"\bPL\s*\d{2}\s*(?:\d{4}\s*){6}\b|\b\d{2}(?:\s\d{4}){6}\b|\b\d{26}\b",
         ("pl",), (B, S, P), "Polish account number, PL-prefixed or 26 digits", flags="i"),
    Rule("pl.phone", "PHONE",
         r"(?:\+48|0048)[\s\-]?(?:\d[\s\-]?){8}\d(?!\d)|\b[4-8]\d{2}[\s\-]?\d{3}[\s\-]?\d{3}\b"
         r"|\(\d{2}\)[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}|\b[1-9]\d[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
         ("pl",), (B, S, P), "Polish phone number"),
    Rule("pl.nip", "NIP", r"(?:NIP[\s:]+)?\b\d{3}-\d{3}-\d{2}-\d{2}\b",
         ("pl",), (S, P), "Polish tax id with hyphens", validator="nip"),
    Rule("pl.postal-code", "POSTAL_CODE", r"\b\d{2}-\d{3}\b",
         ("pl",), (P,), "Polish postal code"),
    Rule("en.ssn", "SSN", r"\b\d{3}-\d{2}-\d{4}\b",
         ("en",), (B, S, P), "US social security number", validator="ssn"),
    Rule("en.credit-card", "CREDIT_CARD", r"\b(?:\d[ \-]*?){13,19}\b",
         ("en",), (B, S, P), "payment card number, Luhn checked", validator="luhn"),
    Rule("en.phone", "PHONE", r"(?:\+1[\s.\-]?)?\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b",
         ("en",), (B, S, P), "North American phone number"),
    Rule("en.zip-code", "ZIP_CODE", r"\b\d{5}(?:-\d{4})?\b",
         ("en",), (P,), "US ZIP or ZIP+4"),
)
# What every hit of a built-in rule contains, a digit unless listed.
HINTS = {"global.email": "@", "global.url": "://", "global.ipv6": ":"}
RULES = tuple(replace(r, hint=HINTS.get(r.rule_id, "[0-9]")) for r in RULES)

# Language packs (rule ids, in pack order).
PACKS: dict[str, tuple[str, ...]] = {
    "en": ("en.ssn", "en.credit-card", "global.email", "en.phone"),
    "pl": ("pl.pesel", "pl.iban", "global.email", "pl.phone", "pl.nip"),
}

_BY_ID = {r.rule_id: r for r in RULES}
if len(_BY_ID) != len(RULES):  # pragma: no cover - catalogue invariant
    raise AssertionError("duplicate rule ids")


def rule_by_id(rule_id: str) -> Rule:
    return _BY_ID[rule_id]


def rules_for_language(lang: str | None) -> list[Rule]:
    """Ordered pack for ``lang``; any unknown language falls back to English."""
    pack = PACKS.get(lang or "", PACKS["en"])
    return [_BY_ID[i] for i in pack]


def rules_for_level(level: str) -> list[Rule]:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    return [r for r in RULES if level in r.levels]


def rules_for_locale(locale: str) -> list[Rule]:
    return [r for r in RULES if r.applies_to_locale(locale)]


def catalog_rows() -> list[tuple]:
    """Catalogue as rows (rule_rank, rule_id, tag, pattern, locales, levels, description, validator)."""
    return [
        (i, r.rule_id, r.tag, r.pattern, list(r.locales) if r.locales is not None else None,
         list(r.levels), r.description, r.validator)
        for i, r in enumerate(RULES)
    ]


CATALOG_SCHEMA = (
    "rule_rank INT, rule_id STRING, tag STRING, pattern STRING, locales ARRAY<STRING>, "
    "levels ARRAY<STRING>, description STRING, validator STRING"
)


def rule_catalog(spark):
    """The catalogue as a small DataFrame (15 rows, a bounded dimension table)."""
    return spark.createDataFrame(catalog_rows(), CATALOG_SCHEMA)
