"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are always reported when their rule holds. The method adds
`iban` (ISO 13616, mod-97), national numbers `ssn` (area, group and serial rules) and
scores every span: a base score for its kind, which a checksum has raised, raised again or lowered by
whole context words on either side. Added kinds are reported only from `least` on.

Defined results: null text counts as empty; an empty or clean text gives zero counts and the digest
of ''; texts are scanned whole, in time linear in their length; repeated rows give repeated rows;
other columns are ignored by `find` and carried through by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import text_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits can only match from its first digit on, and possessive parts need no second try
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a span by kind before its context is looked at.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
#: Words that raise the score when they stand within WINDOW characters of the span, and words that lower it.
FOR = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "payment", "pay"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "tax"),
}
AGAINST = {
    "email": ("example", "sample"),
    "ip": ("version", "release", "section"),
    "card": ("order", "tracking", "isbn", "serial"),
    "phone": ("order", "score", "isbn"),
    "iban": ("example", "sample"),
    "ssn": ("part", "order", "serial", "model", "invoice"),
}
WINDOW, BOOST = 48, 0.3


def any_word(words: tuple[str, ...]) -> re.Pattern:
    """One of the words, whole or with a plural s."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})s?(?!\w)")


CONTEXT = {k: (any_word(FOR[k]), any_word(AGAINST[k])) for k in KINDS}


def adjusted(kind: str, score: float, near: str) -> float:
    """A span's score in view of the (lower-case) text around it."""
    up, down = CONTEXT[kind]
    return min(1.0, max(0.0, score + BOOST * bool(up.search(near)) - BOOST * bool(down.search(near))))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email rule, found from each '@' outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Accounts from left to right: of each place where the pattern holds the longest run of groups that passes mod-97.

    A match may have taken groups that follow the account; what it took too much is looked at again.
    """
    m = IBAN.search(text)
    while m:
        end = m.end()
        while end > m.start():
            account = text[m.start() : end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
        m = IBAN.search(text, max(end, m.start() + 1))


def spans_of(text: str, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of KINDS and then of start."""
    found: list[tuple[str, int, int, float]] = []
    low = ""

    def add(kind: str, start: int, end: int, score: float) -> None:
        nonlocal low
        low = low or text.lower()
        around = low if len(low) == len(text) else text
        score = adjusted(kind, score, f"{around[max(0, start - WINDOW) : start]} {around[end : end + WINDOW]}")
        if kind in BASE or score >= least:
            found.append((kind, start, end, round(score, 3)))

    for start, end in emails(text):
        add("email", start, end, PRIOR["email"])
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            add("ip", *m.span(), PRIOR["ip"])
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            add("card", *m.span(), PRIOR["card"])
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                add("phone", *m.span(), PRIOR["phone"])
    for start, end in ibans(text):
        add("iban", start, end, PRIOR["iban"])
    for m in SSN.finditer(text):
        add("ssn", *m.span(), PRIOR["ssn"])
    return found


def redacted(text: str, least: float = 0.5) -> str:
    """Spans replaced by their kind in brackets; overlapping spans become one, of the longest one's kind."""
    parts, last, end, longest, name = [], 0, -1, 0, ""
    for kind, a, b, _ in sorted(spans_of(text, least), key=lambda s: (s[1], -s[2])):
        if a < end:
            end = max(end, b)
            if b - a > longest:
                longest, name = b - a, kind
            continue
        if end >= 0:
            parts.append(f"[{name.upper()}]")
            last = end
        parts.append(text[last:a])
        end, longest, name = b, b - a, kind
    return "".join([*parts, f"[{name.upper()}]", text[end:]]) if parts else text


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, top_score."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            counts: list[list[int]] = [[] for _ in BASE]
            digests, joined, added, top = [], [], [], []
            for text in texts:
                spans = spans_of(text, least)
                names = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
                n_base = 0
                for kind, to in zip(BASE, counts):
                    to.append(sum(s[0] == kind for s in spans))
                    n_base += to[-1]
                digests.append(hashlib.sha256(",".join(names[:n_base]).encode()).hexdigest())
                joined.append(",".join(names))
                added.append(len(spans) - n_base)
                top.append(max((s[3] for s in spans), default=0.0))
            columns = [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(joined), pa.array(added, pa.int64()), pa.array(top, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "top_score"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(
        scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, top_score double"
    )


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind and `n_chars`, where there is one, brought up to date."""
    names = docs.columns

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices([batch]):
                null = rows.column("text").is_null().to_pylist()
                new = [None if n else redacted(t, least) for t, n in zip(texts, null)]
                columns = [pa.array(new, pa.string()) if c == "text" else rows.column(c) for c in names]
                if "n_chars" in names:
                    old = rows.column("n_chars")
                    kind = old.type
                    changed = [b if a is None or x == a else len(a) for a, b, x in zip(new, old.to_pylist(), texts)]
                    columns[names.index("n_chars")] = pa.array(changed, kind)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(scan, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
