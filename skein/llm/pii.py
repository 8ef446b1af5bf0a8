"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds and their patterns are fixed; further kinds (iban, ssn, key, secret,
local_phone) come from the method and never replace a base span.  Every span has
a score: what its kind begins with (``PRIOR``), more where a word that goes with
the kind stands near it, less where a word says that it is made up.  A span of a
further kind counts from ``ACCEPT`` on, a base span always.  Offsets are
code points, ends exclusive.  Null texts count as empty and give no spans.
Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import texts
from skein.llm.textops import by_size

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "local_phone", "key", "secret")
ACCEPT = 0.5  # least score of a span outside the base kinds
REACH = 48  # code points on either side in which context words count

_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive groups: what follows each can't be taken from it, so no match is lost and long runs stay linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i:password|passwd|secret|token|api_key|apikey)\x20?[=:]\x20?(\"?)([A-Za-z0-9_+/-]{8,128})\1")
CONTEXT = {
    "email": "mail email e-mail contact write",
    "ip": "ip address host server client",
    "card": "card visa mastercard amex credit debit payment",
    "phone": "phone tel call mobile fax contact whatsapp",
    "iban": "iban account bank konto cuenta compte transfer",
    "ssn": "ssn social",
    "local_phone": "phone tel call mobile fax contact",
    "key": "key access aws credentials",
    "secret": "password passwd secret token api login",
}
MADE_UP = "example sample dummy placeholder fake invalid test"
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.7, "ssn": 0.4, "local_phone": 0.4, "key": 0.7, "secret": 0.6}
GAIN = 0.3
#: Words near a span: letters alone, not parts of addresses or names.
_WORD = re.compile(r"(?<![\w@.-])[a-z]+(?:-[a-z]+)?(?![\w@])")


def luhn(digits: str) -> bool:
    """The Luhn check of card numbers."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The mod-97 check of international account numbers."""
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    # every match holds exactly one '@' right behind its local part, so only the surroundings of each '@' are read
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and _LOCAL.match(text, first - 1):
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((first, m.end()))
            done = m.end()
            at = text.find("@", done)
            continue
        done = max(done, at + 1) if first == at else done
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed spans, by kind and then by start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans with a right checksum; words that follow an IBAN may look like more of it, so each shorter end is tried."""
    out, at = [], 0
    while (m := _IBAN.search(text, at)) is not None:
        end = m.end()
        while end > 0 and not (_IBAN.fullmatch(text, m.start(), end) and mod97(text[m.start() : end])):
            end = text.rfind(" ", m.start(), end)
        if end > 0:
            out.append((m.start(), end))
        at = max(end, m.start() + 1)
    return out


def score(kind: str, text: str, start: int, end: int, own: int | None = None) -> float:
    """How likely a span is what its kind says, from the words within REACH on either side; what its pattern took from ``own`` on is no context."""
    start = start if own is None else own
    near = _WORD.findall(text[max(0, start - REACH) : start].lower()) + _WORD.findall(text[end : end + REACH].lower())
    good, bad = _CONTEXT[kind].intersection(near), _MADE_UP.intersection(near)
    return round(min(1.0, max(0.0, PRIOR[kind] + (GAIN if good else 0) - (GAIN if bad else 0))), 6)


_CONTEXT = {kind: frozenset(ws.split()) for kind, ws in CONTEXT.items()}
_MADE_UP = frozenset(MADE_UP.split())


def more_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans of further kinds with their scores; none overlaps a base span or an accepted one before it."""
    found: list[tuple[str, int, int, float]] = []
    taken = bytearray()  # by code point; made when something is proposed

    def propose(kind: str, start: int, end: int, own: int | None = None) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
            for _, s, e in base:
                taken[s:e] = b"\x01" * (e - s)
        if taken.find(1, start, end) < 0:
            p = score(kind, text, start, end, own)
            if p >= ACCEPT:
                found.append((kind, start, end, p))
                taken[start:end] = b"\x01" * (end - start)

    if _DIGIT.search(text):
        for start, end in ibans(text):
            propose("iban", start, end)
        for m in _SSN.finditer(text):
            if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000":
                propose("ssn", m.start(), m.end())
        for m in _LOCAL_PHONE.finditer(text):
            propose("local_phone", m.start(), m.end())
    if "AKIA" in text:
        for m in _KEY.finditer(text):
            propose("key", m.start(), m.end())
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if any(c.isdigit() for c in m.group(2)):
                propose("secret", m.start(2), m.end(2), m.start())
    return sorted(found, key=lambda f: (MORE.index(f[0]), f[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for b in by_size(batches, "text"):
        rows = []
        for text in b.column(1).to_pylist():
            base = base_spans(text) if text else []
            more = more_spans(text, base) if text else []
            rows.append([{"kind": k, "start": s, "end": e, "score": score(k, text, s, e)} for k, s, e in base] + [{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in more])
        yield pa.record_batch([b.column(0), pa.array(rows, kinds)], ["doc_id", "found"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and found: an array of (kind, start, end, score), base kinds first."""
    rows = texts(docs)
    return rows.mapInArrow(_scan, "doc_id long, found array<struct<kind: string, start: long, end: long, score: double>>")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    is_base = lambda s: s["kind"].isin(*BASE)
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.filter("found", is_base)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~is_base(s))).cast("long").alias("n_more"),
        F.size("found").cast("long").alias("n_spans"),
    )
