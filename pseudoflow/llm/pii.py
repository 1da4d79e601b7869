"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds (email, ip, card, phone) are always kept once confirmed.  Scored kinds add spans: iban (mod-97),
ssn, card_short (13 to 15 digits, Luhn) and phone_local; each starts from a prior, gains by its checksum
and by context words in the 40 characters before it, and is kept from ``min_score`` on.  A proposal that
overlaps a kept span of another kind is not added.

Offsets are code points, end exclusive.  Every pattern runs in time linear in the text.  Defined cases:
null text counts as empty; an empty table gives an empty result; repeated rows get equal results; extra
columns are ignored by ``find`` and passed through by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudoflow.llm.common import frugal, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "card_short", "phone_local")

# The contract's patterns.  Runs are possessive and start where a run starts, which finds
# the same matches without rescanning long runs.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})")
IBAN_GROUP = re.compile(r" ?[A-Z0-9]{4}")
IBAN_REST = re.compile(r" ?[A-Z0-9]{1,3}(?![A-Za-z0-9])")
IBAN_END = re.compile(r"(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
PHONE_LOCAL = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")

#: Characters of an IBAN by country (SWIFT's register).
IBAN_CHARS = {x[:2]: int(x[2:]) for x in """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18
    FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20
    LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24
    SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}  # fmt: skip

#: prior, gain by a passed checksum, context words (looked for in the text before the span)
SCORED = {
    "iban": (0.3, 0.4, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    "ssn": (0.4, 0.0, ("ssn", "social", "security", "tax")),
    "card_short": (0.1, 0.2, ("card", "credit", "visa", "amex", "karte", "carte", "tarjeta")),
    "phone_local": (0.4, 0.0, ("phone", "tel", "call", "fax", "mobile", "telefon", "appel")),
}
CONTEXT_CHARS, CONTEXT_GAIN, MIN_SCORE = 40, 0.4, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    rest = 0
    for ch in plain[4:] + plain[:4]:
        v = int(ch, 36)
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1


def iban_ends(text: str, at: int) -> list[int]:
    """Where an IBAN whose first four characters end at ``at`` may end, longest first: after 2 to 7 groups of four
    and up to three characters more, never inside a word."""
    ends = []
    for k in range(1, 8):
        m = IBAN_GROUP.match(text, at)
        if not m:
            break
        at = m.end()
        if k > 1:
            rest = IBAN_REST.match(text, at)
            ends += [x for x, ok in ((at, IBAN_END.match(text, at)), (rest and rest.end(), rest)) if ok]
    return ends[::-1]


def ibans(text: str) -> list[tuple[int, int]]:
    """Confirmed IBANs, disjoint.  A following word or number may look like groups of the number, and a word before it like
    its start: spans of their country's length come first, then others by their longest end (for countries that are not in
    the register also by a shorter one) where they don't overlap those."""
    exact: list[tuple[int, int]] = []
    other: list[tuple[int, int]] = []
    for m in IBAN_START.finditer(text):
        start, ends, chars = m.start(), iban_ends(text, m.end()), IBAN_CHARS.get(m[0][:2])
        own = [x for x in ends if len(text[start:x].replace(" ", "")) == chars and mod97(text[start:x])]
        end = next((x for x in (ends[:1] if chars else ends) if mod97(text[start:x])), None)
        if own and (not exact or start >= exact[-1][1]):
            exact.append((start, own[0]))
        elif not own and end is not None:
            other.append((start, end))
    kept, done = [], 0
    for start, end in other:
        at = bisect.bisect_right(exact, start, key=lambda x: x[1])  # the first exact one that ends after this one starts
        if start >= done and (at == len(exact) or end <= exact[at][0]):
            kept.append((start, end))
            done = end
    return sorted(exact + kept)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, from one @ to the next."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


def scored_spans(text: str, taken: list[tuple[int, int]], min_score: float = MIN_SCORE) -> dict[str, list[tuple[int, int]]]:
    """Spans that the method adds to the base ones."""
    proposed: list[tuple[float, str, int, int]] = []

    def propose(kind: str, start: int, end: int, confirmed: bool) -> None:
        prior, gain, words = SCORED[kind]
        before = text[max(0, start - CONTEXT_CHARS) : start].lower()
        near = any(w in words for w in re.findall(r"[^\W\d_]+", before))
        score = prior + gain * confirmed + CONTEXT_GAIN * near
        if score >= min_score:
            proposed.append((-score, kind, start, end))

    for start, end in ibans(text):
        propose("iban", start, end, True)
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            propose("ssn", *m.span(), False)
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 15 and luhn(digits):
                propose("card_short", *m.span(), True)
    for m in PHONE_LOCAL.finditer(text):
        propose("phone_local", *m.span(), False)
    kept: dict[str, list[tuple[int, int]]] = {k: [] for k in ADDED_KINDS}
    # disjoint: of the kept spans, those that overlap are joined (a span overlaps one if and only if it overlaps the join)
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for _, kind, start, end in sorted(proposed):
        at = bisect.bisect_right(ends, start)  # the first kept span that ends after this one starts
        if at == len(starts) or end <= starts[at]:
            starts.insert(at, start)
            ends.insert(at, end)
            kept[kind].append((start, end))
    return {k: sorted(v) for k, v in kept.items()}


ANY_PROPOSAL = re.compile(r"[0-9@]")


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    if not ANY_PROPOSAL.search(text):
        return {k: [] for k in BASE_KINDS}, {}
    base = base_spans(text)
    return base, scored_spans(text, sorted(x for v in base.values() for x in v))


def _joined(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, v in found.items() for a, b in v)


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_<base kind>, base_sha256 and all spans as kind:start:end."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            hashes, joined = [], []
            for x in batch.column(1):
                base, added = spans(x.as_py())
                for out, kind in zip(counts, BASE_KINDS):
                    out.append(len(base[kind]))
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined({k: v for k, v in (base | added).items() if v}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(joined, pa.string())],
                names=RESULT.names,
            )

    return rows.mapInArrow(frugal(run), RESULT)


def masked(text: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets; spans that overlap become one."""
    base, added = spans(text)
    todo = sorted((a, -b, kind) for kind, v in (base | added).items() for a, b in v)
    if not todo:
        return text
    out, done = [], 0
    for a, minus_b, kind in todo:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, -minus_b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans masked in ``text_col`` (null stays null); other columns pass through."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else masked(t) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(frugal(run), docs.schema)
