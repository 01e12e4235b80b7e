"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

Base kinds (email, ip, card, phone) are kept whenever their pattern and check pass.  The further kinds (iban, ssn, secret)
start from a score of their own; a passing mod-97 check or context words nearby raise it, words that speak against
personal data lower it; a span is kept from THRESHOLD on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "secret")
THRESHOLD = 0.6
#: Characters looked at on either side of a span for context words.
REACH = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive, and only from the start of a run of digits: the same matches, without trying each start of a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,64})(?![A-Za-z0-9_])")
#: What may not stand right before a span.
_NOT_AFTER = {"iban": re.compile(r"[A-Za-z0-9]"), "ssn": re.compile(r"[0-9-]"), "secret": re.compile(r"[A-Za-z0-9_]")}
_CONTEXT = {
    "iban": re.compile(r"(?i)\b(iban|account|konto|compte|cuenta|bank|banque|banco)\b"),
    "ssn": re.compile(r"(?i)\b(ssn|social|security|insurance|taxpayer)\b"),
    "secret": re.compile(r"(?i)\b(key|token|secret|password|api|aws|credential)"),
}
_AGAINST = re.compile(r"(?i)\b(example|sample|test|dummy|invoice|isbn|version|part)\b")
#: Score before any evidence, for a checksum that passes, for a context word, against.
_SCORES = {"iban": (0.1, 0.6, 0.2, -0.15), "ssn": (0.5, 0.0, 0.4, -0.2), "secret": (0.3, 0.5, 0.4, -0.1)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check digits of an account number: letters count as 10 to 35, the first four characters go to the end."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass their check; groups that only follow one are cut off again from the right."""
    at = 0
    while m := _IBAN.search(text, at):
        s = m[0]
        while not mod97(s) and " " in s:
            s = s.rsplit(" ", 1)[0]
        after = m.start() and _NOT_AFTER["iban"].match(text, m.start() - 1)
        if mod97(s) and not after:
            yield m.start(), m.start() + len(s)
            at = m.start() + len(s)
        else:
            at = m.start() + 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of local part, at sign, domain: looks only around at signs."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """By kind in their order, then by start; ends are exclusive."""
    for s, e in _emails(text):
        yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 13 <= len(m[0]) <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for kind, pattern in zip(MORE_KINDS, (_IBAN, _SSN, _SECRET), strict=True):
        start, check, context, against = _SCORES[kind]
        found = _ibans(text) if kind == "iban" else (m.span() for m in pattern.finditer(text) if not (m.start() and _NOT_AFTER[kind].match(text, m.start() - 1)))
        for s, e in found:
            span = text[s:e]
            if kind == "ssn" and (span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000"):
                continue
            # the check of a secret is its issuer's prefix; bare hexadecimal digits need a word nearby
            score = start + check * (kind == "iban" or kind == "secret" and not re.fullmatch("[0-9a-f]+", span))
            around = text[max(0, s - REACH) : s] + " " + text[e : e + REACH]
            score += context * bool(_CONTEXT[kind].search(around)) + against * bool(_AGAINST.search(around))
            if score >= THRESHOLD:
                yield kind, s, e


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and further ones."""
    return list(base_spans(text)), list(more_spans(text))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; where spans overlap, the first and longest counts."""
    base, more = find(text)
    out, at = [], 0
    for kind, s, e in sorted(base + more, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
        elif e > at:  # what reaches beyond the one before it goes too
            at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row's whole text.

    Spans are kind:start:end in code points, by kind (base kinds as listed, then further ones), then start, joined by
    commas; none gives the empty text.  A null text counts as empty; null ids stay null; repeated rows are scanned each;
    other columns are left aside.  One scan, no shuffle.
    """

    def kernel():
        def f(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            shas, spans = [], []
            for t in texts:
                base, more = find(t)
                kinds = [k for k, _, _ in base]
                for k in BASE_KINDS:
                    counts[k].append(kinds.count(k))
                listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
                shas.append(hashlib.sha256(listed.encode()).hexdigest())
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in base + more))
            cols = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(shas), pa.array(spans)]
            return pa.record_batch(cols, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

        return f

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def redact_column(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced; a null stays null."""
    replaced = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else redact(t)), "string")
    return docs.withColumn(column, replaced(column))
