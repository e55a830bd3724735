"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds (email, ip, card, phone) are confirmed by their own rule alone and always kept.
Further kinds start from a prior, gain from a validator (mod-97 for IBANs) and from context
words within CONTEXT code points, and are kept at THRESHOLD.

Defined results: a null text is an empty text and has no span; ties cannot occur, as spans of one
kind never overlap; repeated rows get equal results; an empty table gives an empty table; other
columns stay behind in find() and are kept by redact(); any length of text is scanned whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, memo, small_batches, text_of

#: Order of kinds in every digest and list of spans.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "aws_key", "api_key", "password", "local_phone", "mac")
BASE = KINDS[:4]
CONTEXT = 48
THRESHOLD = 0.6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins; saying so keeps long runs from being read once for each digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Country lengths of IBANs (ISO 13616).
IBAN_LENGTH = {"AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}


# The characters after the two letters and two digits are as many as the country has, so that what follows is left out.
_IBAN = "|".join(f"{country}[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for country, length in IBAN_LENGTH.items())


class Rule(NamedTuple):
    """A further kind: its pattern, the score before any evidence, and the words that add to it."""

    pattern: re.Pattern
    prior: float
    words: tuple[str, ...]


RULES = {
    "iban": Rule(re.compile(rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])"), 0.2, ("iban", "bank", "account", "konto", "compte", "cuenta")),
    "ssn": Rule(re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.5, ("ssn", "social", "security", "tax", "insurance")),
    "aws_key": Rule(re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), 0.9, ("aws", "key", "access")),
    "api_key": Rule(re.compile(r"(?<![A-Za-z0-9])(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"), 0.9, ("key", "token", "secret")),
    "password": Rule(re.compile(r"(?i:password|passwd|pwd|secret|token|api_?key)[ \t]?[=:][ \t]?[^\s,;]{6,}"), 0.7, ("login", "user", "password")),
    "local_phone": Rule(re.compile(r"(?<![0-9+.)-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"), 0.45, ("phone", "tel", "call", "mobile", "fax", "cell")),
    "mac": Rule(re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"), 0.65, ("mac", "device", "address")),
}
# One quick test tells whether any further kind can be in a text at all.
_HINT = re.compile(r"[0-9]{2}|[=:]|sk-|xox|A[KS]IA|AIza|gh[pousr]_")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        doubled = digit << (place & 1)
        total += doubled - 9 if doubled > 9 else doubled
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    if IBAN_LENGTH.get(plain[:2]) != len(plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        if found:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = found.end()
                yield start, done
                at = text.find("@", done)
                continue
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    plain = part.lstrip("0")
    return len(plain) < 4 and int(plain or "0") <= 255


def _ips(text: str):
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                yield m.span()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield m.span()


def _context(text: str, start: int, end: int, words: tuple[str, ...]) -> float:
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    tokens = set(re.findall(r"[a-z]+", near))
    return 0.25 if tokens.intersection(words) else 0.0


def _matches(kind: str, text: str):
    """Spans of a further kind's pattern. After an IBAN that fails its check, the search goes on behind its first letter."""
    pattern, at = RULES[kind].pattern, 0
    while m := pattern.search(text, at):
        good = kind != "iban" or mod97(m.group())
        at = m.end() if good else m.start() + 1
        if good:
            yield m.span()


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind as in KINDS, then by start; code points, end exclusive."""
    if not text:
        return []
    spans = [Span("email", a, b, 1.0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [Span("ip", a, b, 1.0) for a, b in _ips(text)]
        spans += [Span("card", a, b, 1.0) for a, b in _cards(text)]
        spans += [Span("phone", a, b, 1.0) for a, b in _phones(text)]
    if _HINT.search(text):
        taken = bytearray(len(text))
        for s in spans:
            taken[s.start : s.end] = b"\x01" * (s.end - s.start)
        for kind, rule in RULES.items():
            for start, end in _matches(kind, text):
                if taken.find(1, start, end) >= 0:
                    continue
                score = rule.prior + (0.6 if kind == "iban" else 0.0) + _context(text, start, end, rule.words)
                if score >= THRESHOLD:
                    spans.append(Span(kind, start, end, min(score, 1.0)))
                    taken[start:end] = b"\x01" * (end - start)
    return spans


def replace(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in capitals."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, and the spans of its text with their scores."""

    def run(batch):
        found = [find(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "spans": [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in row] for row in found]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans; one row for each row of docs."""
    fields = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"]

    def run(batch):
        out = {name: [] for name in fields[1:]}
        for text in batch.column(1).to_pylist():
            found = find(text)
            for kind in BASE:
                out[f"n_{kind}"].append(sum(s.kind == kind for s in found))
            listed = [f"{s.kind}:{s.start}:{s.end}" for s in sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))]
            base = ",".join(x for x in listed if x.split(":", 1)[0] in BASE)
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(",".join(listed))
            out["n_spans"].append(len(listed))
        return {"doc_id": batch.column(0), **out}

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced; a null text stays null. n_chars, if there, follows."""
    place = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo("spans", dict)
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).to_pylist()
            clean = [t if not t or not (f := find(t)) else replace(t, f) for t in texts]
            columns = list(batch.columns)
            columns[place] = pa.array(clean, pa.string()).cast(columns[place].type)
            if chars is not None:
                columns[chars] = pa.array([n if t is None else len(t) for t, n in zip(clean, columns[chars].to_pylist(), strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
