"""Personal data in texts: patterns propose, checksums confirm, words nearby decide.

Regular expressions propose spans of each kind. Validators confirm them: Luhn for
cards, mod-97 for IBANs, octets for addresses, digit counts for phones, reserved
blocks for social security numbers. A confirmed span starts from its kind's score;
context words within ``window`` code points before or after raise it, words that
speak for another meaning lower it. The base kinds (email, ip, card, phone) are
reported once confirmed, whatever their score; the others from ``least`` on.

Spans are in code points, the end exclusive; those of one kind don't overlap, those of
different kinds may. Null and empty texts have none. Every row is read by itself:
repeated rows and ids have a row each, an empty table gives an empty result, columns of
any other name don't matter. Every pattern reads a text in linear time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
WINDOW, LEAST = 40, 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behinds start a match at the first digit of a run only: what fails there fails further on too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|[0-9a-f]{16,64}(?![A-Za-z0-9]))")

#: Starting score of a confirmed span, and what a word nearby adds.
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
FOR = {
    "email": r"mail|contact|write|@",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|amex|credit|debit|payment",
    "phone": r"phone|tel|call|mobile|fax|whatsapp",
    "iban": r"iban|bank|account|konto|swift|bic",
    "ssn": r"\bssn\b|social security|tax id",
    "secret": r"password|passwd|token|secret|api[_ -]?key|aws|akia|credential",
}
AGAINST = {
    "email": r"example only",
    "ip": r"version|release|section",
    "card": r"order|invoice|isbn|serial",
    "phone": r"order|invoice|serial",
    "iban": r"part no|model",
    "ssn": r"part no|order|invoice|serial",
    "secret": r"commit|checksum|md5|sha1|sha256|revision",
}
_FOR = {k: re.compile(v, re.IGNORECASE) for k, v in FOR.items()}
_AGAINST = {k: re.compile(v, re.IGNORECASE) for k, v in AGAINST.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _card(text: str) -> bool:
    digits = _digits(text) if len(text) < 64 else ""
    return 13 <= len(digits) <= 19 and luhn(digits)


def _octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in text.split("."))


def _social(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def emails(text: str):
    """Matches of local@domain: each @ is tried once, with all local characters right before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _matches(pattern: re.Pattern, check):
    return lambda text: ((m.start(), m.end()) for m in pattern.finditer(text) if check(m.group()))


#: No kind matches a text without any of these.
_SOME = re.compile("[0-9@]|AKIA|[a-f]{16}")
PROPOSE = {
    "email": emails,
    "ip": _matches(_IP, _octets),
    "card": _matches(_CARD, _card),
    "phone": _matches(_PHONE, lambda x: 9 <= len(_digits(x)) <= 15),
    "iban": _matches(_IBAN, mod97),
    "ssn": _matches(_SSN, _social),
    "secret": _matches(_SECRET, lambda x: len(set(x)) > 4),
}


def score(kind: str, text: str, start: int, end: int, window: int = WINDOW) -> float:
    """The kind's starting score, changed by the words around the span."""
    around = text[max(0, start - window) : start] + " " + text[end : end + window]
    value = START[kind] + (0.35 if _FOR[kind].search(around) or (kind == "secret" and text.startswith("AKIA", start)) else 0) - (0.35 if _AGAINST[kind].search(around) else 0)
    return min(1.0, max(0.0, round(value, 2)))


def find(text: str | None, least: float = LEAST) -> list[dict]:
    """The spans of a text, by kind and start."""
    if not text or not _SOME.search(text):
        return []
    out = []
    for kind in KINDS:
        for start, end in PROPOSE[kind](text):
            value = score(kind, text, start, end)
            if kind in BASE_KINDS or value >= least:
                out.append({"kind": kind, "start": start, "end": end, "score": value})
    return out


SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, spans) for every row, written to the shared folder."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                spans = [find(text, least) for text in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(spans, _ARROW)], names=["id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut(source.mapInArrow(run, f"id long, spans {SPANS}"), "spans").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans as text, their number, and counts of the other kinds."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *(count(k) for k in KINDS if k not in BASE_KINDS))
