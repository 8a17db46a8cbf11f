"""Personal data in texts (operator 1): patterns propose, checksums confirm, context words move the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_row, pick, unpacked

#: Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
#: Score from which a span counts; what a context word adds; how far it may stand before or behind, in code points.
THRESHOLD, CONTEXT, WINDOW = 0.5, 0.35, 48
#: Score of a proposal before checks and context. The base kinds are certain once their checks pass.
PROPOSED = {"email": 1.0, "ip": 0.8, "card": 0.8, "phone": 0.9, "iban": 0.6, "ssn": 0.25, "local_phone": 0.25}
#: Words whose presence nearby raises a kind's score (fixed values).
WORDS = {
    "email": "mail email e-mail contact correo courriel",
    "ip": "ip address host server adresse",
    "card": "card credit visa mastercard amex payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon telefono",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "local_phone": "phone tel call mobile cell fax",
}
_CONTEXT = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, v.split())) + r")(?![^\W_])", re.I) for k, v in WORDS.items()}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod_97(code: str) -> bool:
    """The check of international account numbers (blanks allowed)."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


#: Lengths of account numbers by country (fixed values of the public registry).
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Runs cut where a word of theirs ends: at the country's length, else whole, else (country unknown) at the last end that checks."""
    at = 0
    while m := _IBAN.search(text, at):
        run, at = m[0], m.start() + 1
        ends = [e for e in range(15, len(run) + 1) if (e == len(run) or run[e] == " ") and mod_97(run[:e])]
        length = IBAN_LENGTHS.get(run[:2])
        good = [e for e in ends if e - run.count(" ", 0, e) == length] or [e for e in ends if length is None or e == len(run)]
        if good:
            at = m.start() + good[-1]
            yield m.start(), at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, sought from each ``@``: one holds exactly one, so no start is tried twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Each four numbers of a dotted chain are a match; those with a part over 255 go."""
    for chain in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p := m[0].lstrip("0")) < 4 and int(p or 0) <= 255 for m in four):
                yield four[0].start(), four[3].end()


def _proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans whose own checks hold; ``text`` is a whole text."""
    for a, b in _emails(text):
        yield a, b, "email"
    if not _DIGIT.search(text):
        return
    for a, b in _ips(text):
        yield a, b, "ip"
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield *m.span(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield *m.span(), "phone"
    for a, b in _ibans(text):
        yield a, b, "iban"
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield *m.span(), "ssn"
    for m in _LOCAL_PHONE.finditer(text):
        yield *m.span(), "local_phone"


class _Taken:
    """Places that spans have. Asked once per proposal: sorted anew only when another kind begins to ask."""

    def __init__(self):
        self.places: list[tuple[int, int]] = []
        self.kind, self.starts, self.tops = None, [], []

    def add(self, start: int, end: int) -> None:
        self.places.append((start, end))

    def meets(self, start: int, end: int, kind: str) -> bool:
        if kind != self.kind:  # spans of one kind don't overlap each other
            self.kind = kind
            self.places.sort()
            self.starts = [a for a, _ in self.places]
            self.tops = list(accumulate((b for _, b in self.places), max))
        before = bisect_left(self.starts, end)
        return before > 0 and self.tops[before - 1] > start


def find(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text by start, then kind. Base kinds always count; others need ``threshold`` and no base span there."""
    if not text:
        return []
    spans, taken = [], _Taken()
    for start, end, kind in _proposals(text):
        if kind not in BASE and taken.meets(start, end, kind):
            continue
        score = PROPOSED[kind]
        if score < 1 and (_CONTEXT[kind].search(text, max(0, start - WINDOW), start) or _CONTEXT[kind].search(text, end, end + WINDOW)):
            score = min(1.0, score + CONTEXT)
        if kind in BASE or score >= threshold:
            spans.append(Span(start, end, kind, score))
            taken.add(start, end)
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def told(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones together) replaced by its kind, as ``<EMAIL>``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a count of each base kind, base_spans and spans (kind:start:end, code points) and their scores.

    One pass without an exchange; every pattern is linear in the text. Defined results: null and empty texts have no
    spans; null doc_ids and repeated rows are rows like others; an empty table gives no rows; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, threshold) for t in batch.column(1).to_pylist()]
            counts = {f"n_{k}": pa.array([sum(s.kind == k for s in x) for x in found], pa.int64()) for k in BASE}
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64())} | counts | {
                "base_spans": pa.array([told([s for s in x if s.kind in BASE]) for x in found], pa.string()), "spans": pa.array([told(x) for x in found], pa.string()),
                "scores": pa.array([[s.score for s in x] for x in found], pa.list_(pa.float64())),
            })

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_spans string, spans string, scores array<double>"
    return pick(docs, "doc_id", "text").mapInArrow(rows, schema)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind and ``n_chars`` (if there) brought into line.

    Defined results: null texts stay null and empty ones empty; every row stays, whatever its doc_id; other columns stay.
    """
    kind = docs.schema["text"].dataType
    packed, columns = packed_row(docs, "text")

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, find(t, threshold)), na_action="ignore")

    out = unpacked(packed.withColumn("__row", packed["__row"].withField(f"__c{columns.index('text')}", clean("__k_text").cast(kind))), columns)
    if "n_chars" in columns:
        i, j = columns.index("n_chars"), columns.index("text")
        numbered = out.toDF(*[f"__c{k}" for k in range(len(columns))])
        out = numbered.withColumn(f"__c{i}", F.length(f"__c{j}").cast(docs.schema["n_chars"].dataType)).toDF(*columns)
    return out
