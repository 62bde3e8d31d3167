"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

Work is per row and linear in the text, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans that start together are listed. The first four are the base
# kinds: their valid spans always stay. The others need a score of at least THRESHOLD.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.5
WINDOW = 40  # characters before and after a span that are searched for context words

# Score of a confirmed span, before its context is looked at.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BONUS, MALUS = 0.3, 0.3
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social security", "tax"),
}
AGAINST = {
    "ip": ("version", "release", "section"),
    "card": ("order", "tracking", "serial", "isbn"),
    "phone": ("isbn", "serial"),
    "iban": (), "email": (), "ssn": ("part", "serial", "order"),
}
CONTEXT_RE = {k: re.compile(r"\b(?:%s)" % "|".join(map(re.escape, w)), re.I) for k, w in CONTEXT.items()}
AGAINST_RE = {k: re.compile(r"\b(?:%s)" % "|".join(map(re.escape, w)), re.I) for k, w in AGAINST.items() if w}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN_RE = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED_RE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD_RE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_RE = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+))")
# Characters of an account number by country (ISO 13616 registry).
IBAN_LENGTHS = {
    country: length for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
SSN_RE = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    """Checksum of payment card numbers."""
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Checksum of bank account numbers (ISO 13616): the rearranged number leaves 1."""
    compact = iban.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in compact[4:] + compact[:4])
    return int(number) % 97 == 1


def _octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The domain is found first and the local part read backwards from it, down to the end of the
    # match before: the leftmost match, without trying every start of a long run.
    end = 0
    for match in DOMAIN_RE.finditer(text):
        start = at = match.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = match.end()
            yield start, end


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    # A run of dotted numbers holds one match for every four of its parts.
    for match in DOTTED_RE.finditer(text):
        parts, start = match.group().split("."), match.start()
        for at in range(0, len(parts) - 3, 4):
            four = parts[at:at + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield start, end
            start = end + 1


def _matches(pattern: re.Pattern, low: int, high: int, valid=None):
    def find(text: str) -> Iterator[tuple[int, int]]:
        for match in pattern.finditer(text):
            digits = NOT_DIGITS.sub("", match.group())
            if low <= len(digits) <= high and (valid is None or valid(digits)):
                yield match.span()
    return find


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    # A match runs on over upper-case words and numbers behind the account number. Its end is where
    # the country's length says; in countries that are not listed, the last end of a group that
    # confirms. What is behind an accepted end, or inside a match without one, is looked at again.
    done = 0
    for match in IBAN_RE.finditer(text):
        start = match.start()
        if start < done:
            continue
        run = match.group(1)
        ends = [at + 1 for at, char in enumerate(run) if char != " "]
        length = IBAN_LENGTHS.get(run[:2])
        for count in (length,) if length else range(len(ends), 14, -1):
            if count > len(ends):
                continue
            end = start + ends[count - 1]
            after = text[end:end + 1]
            if not (after.isascii() and after.isalnum()) and mod97(run[:ends[count - 1]]):
                yield start, end
                done = end
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for match in SSN_RE.finditer(text):
        yield match.span()


FINDERS = {
    "email": _emails, "ip": _addresses, "card": _matches(CARD_RE, 14, 19, luhn),
    "phone": _matches(PHONE_RE, 10, 15), "iban": _ibans, "ssn": _ssns,
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, raised and lowered by the words around the span."""
    around = text[max(0, start - WINDOW):start] + "\n" + text[end:end + WINDOW]
    value = PRIOR[kind]
    if CONTEXT_RE[kind].search(around):
        value += BONUS
    if kind in AGAINST_RE and AGAINST_RE[kind].search(around):
        value -= MALUS
    return round(min(1.0, max(0.0, value)), 3)


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind: (kind, start, end, score), in code points."""
    if not text:
        return []
    found = []
    for at, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            value = score(text, kind, start, end)
            if kind in BASE or value >= THRESHOLD:
                found.append((start, at, end, value))
    return [(KINDS[at], start, end, value) for start, at, end, value in sorted(found)]


def masked(text: str | None, spans: list[Span]) -> str | None:
    """Text with every span replaced by its kind in angle brackets; overlapping spans are one,
    named after the first."""
    if text is None:
        return None
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


SPANS = "array<struct<kind string, start int, end int, score double>>"


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: [
        {"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in spans_of(text)])


def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: masked(text, spans_of(text)))


def spans(text: Column) -> Column:
    """Array of (kind, start, end, score) of a text column. A null or empty text has none; texts
    of any length are read whole."""
    return F.pandas_udf(_spans, SPANS)(text)


def mask(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Same rows and columns with personal data replaced; null texts stay null. Other columns, of
    whatever name, are not touched, and repeated rows are treated alike."""
    return docs.withColumn(text_column, F.pandas_udf(_masked, "string")(F.col(text_column)))


def count(found: str, kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
