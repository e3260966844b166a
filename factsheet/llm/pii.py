"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are found leftmost and without overlap, each kind on its own: e-mail, IP address, payment
card (Luhn) and phone number. The method adds account numbers (IBAN, mod 97), and gives every span a
score: what its pattern and checksum alone are worth, moved up or down by the words around it.
Base spans stay whatever their score; an added span must reach ``least`` to count, which words that
speak against it prevent unless others speak for it. An account number ends where its country's
length says, or else at the last space or end of its capitals and digits where the checksum holds.

Defined cases: null and empty texts have no span; offsets are code points, ends exclusive; repeated
rows get equal results; empty tables give empty results; other columns are never read. Texts without
a digit, an @ or a plus sign never leave the JVM, as no pattern can match there.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsheet.llm.common import picked

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start alone: what begins inside one can't end otherwise.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of account numbers by country.
IBAN_LENGTH = {
    code: int(n)
    for n, codes in (line.split(":") for line in (
        "15:NO", "16:BE", "18:DK FI FO GL NL FK SD", "19:MK SI", "20:AT BA EE KZ LT LU XK MN", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
        "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV", "29:BR EG PS QA UA",
        "30:JO KW MU", "31:MT SC", "32:LC", "33:RU",
    ))
    for code in codes.split()
}
NEAR = 40
#: Worth of a span by its pattern and checksum alone.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7}
#: Words that speak for a kind, and words that speak against all number kinds.
FOR = {
    "email": re.compile(r"(?i)\b(e-?mail|contact|write|reach|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|addr|login|from)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|debit|cvv|tarjeta|carte|karte)\b"),
    "phone": re.compile(r"(?i)\b(phone|call|tel|mobile|fax|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"),
    "iban": re.compile(r"(?i)\b(iban|account|bank|transfer|konto|cuenta|compte)\b"),
}
AGAINST = re.compile(r"(?i)\b(version|release|build|isbn|order|invoice|serial|sku|example|test|checksum)\b")


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][0::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in even)) % 10 == 0


def mod97(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """What the pattern finds, reached from each @ instead of from each letter."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain, start = DOMAIN.match(text, at + 1), at
        if domain:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), unordered."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        number = digits(m.group())
        if 12 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


def ibans(text: str):
    """Start and end of account numbers; what follows one in capitals or digits isn't part of it."""
    m = IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        ends = [m.end(), *(k for k in range(m.end() - 1, start, -1) if text[k] == " ")]
        size = IBAN_LENGTH.get(text[start : start + 2])
        # The end that gives the country's length first, then from long to short.
        for end in sorted(ends, key=lambda e: (len(text[start:e].replace(" ", "")) != size, -e)):
            if mod97(text[start:end]):
                yield start, end
                at = end
                break
        m = IBAN.search(text, at)


def score(text: str, kind: str, start: int, end: int) -> float:
    """Worth of a span in its surroundings, 0 to 1."""
    left, right = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    value = WORTH[kind]
    if FOR[kind].search(left) or FOR[kind].search(right):
        value += 0.2
    if kind != "email" and AGAINST.search(left):
        value -= 0.3
    return round(min(1.0, max(0.0, value)), 2)


def spans(text: str, least: float = 0.5) -> list[tuple[int, int, int, float]]:
    """All spans of a text as (start, number of the kind, end, score), by start, then kind."""
    found = [(a, k, b, score(text, KINDS[k], a, b)) for a, k, b in base_spans(text)]
    for a, b in ibans(text):
        if (value := score(text, "iban", a, b)) >= least:
            found.append((a, 4, b, value))
    return sorted(found)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, spans array of (kind, start, end, score)."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.when(F.col("text").rlike("[0-9@+]"), F.col("text")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def find(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans(t, least)] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return rows.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Each document's text with every span replaced by its kind in angle brackets; null stays null."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text"))

    def mask(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for a, k, b, _ in spans(t, least):
            if a >= at:
                out += [t[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(mask, batch.column(1).to_pylist()), pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, rows.schema)
