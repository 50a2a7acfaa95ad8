"""Operator 1: personal data. Regular expressions propose spans, checksums confirm them
and context words nearby adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "short_card", "national_id", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

#: Fixed patterns of the base kinds. An email is looked for from its @, which no other part of it
#: can hold: the local part is what its characters reach to the left, so any text takes linear time.
_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of a country's account number (ISO 13616 registry).
_IBAN_LENGTHS = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}
_NATIONAL_ID = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")

#: Fixed context words by kind, in the corpus's four languages.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "visa", "amex", "credit", "karte", "carte", "tarjeta"),
    "national_id": ("ssn", "social", "security", "id", "ausweis", "identité", "identidad"),
    "local_phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
}
#: Score of a confirmed span without context; a context word within reach adds CONTEXT_BONUS.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "short_card": 0.5, "national_id": 0.5, "local_phone": 0.45}
CONTEXT_BONUS = 0.3
REACH = 40  # code points on either side


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 13616: the rearranged number leaves 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _EMAIL_HOST.finditer(text):
        a = at = m.start()
        while a > done and text[a - 1] in _EMAIL_LOCAL:
            a -= 1
        if a < at:
            done = m.end()
            yield a, done


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The pattern runs on into words that follow, so every end at a space is tried, the longest first;
    of a known country only its length counts. What fails is looked at again from its next word."""
    m = _IBAN.search(text)
    while m:
        a, found = m.start(), m.group()
        length = _IBAN_LENGTHS.get(found[:2])
        for b in [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] == " ")]:
            account = found[:b].replace(" ", "")
            if (len(account) >= 15 if length is None else len(account) == length) and mod97(account):
                yield a, a + b
                a += b - 1
                break
        m = _IBAN.search(text, a + 1)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, leftmost and non-overlapping within a kind."""
    for a, b in _emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            yield "ip", *m.span()
    cards = [(m.span(), _digits(m.group())) for m in _CARD.finditer(text)]
    for (a, b), d in cards:
        if 16 <= len(d) <= 19 and luhn(d):
            yield "card", a, b
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield "phone", *m.span()
    for a, b in _ibans(text):
        yield "iban", a, b
    for (a, b), d in cards:
        if 13 <= len(d) <= 15 and d[0] in "3456" and luhn(d):
            yield "short_card", a, b
    for m in _NATIONAL_ID.finditer(text):
        yield "national_id", *m.span()
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()


def scan(text: str | None, accept: float = 0.75) -> list[Span]:
    """Spans of a whole text, by kind as in ``KINDS`` and then by start.

    Base spans stay whatever their score; an added one needs ``accept`` and may not overlap
    a span found before it."""
    out: list[Span] = []
    if not text:
        return out
    order, begins, reach = None, [], []  # spans of earlier kinds by start, and how far those up to each reach
    for kind, a, b in _proposals(text):
        if kind not in BASE_KINDS and kind != order:
            spans = sorted((s.start, s.end) for s in out)
            order, begins, reach = kind, [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
        near = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", f"{text[max(0, a - REACH) : a]} | {text[b : b + REACH]}".lower())
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * any(w in CONTEXT[kind] for w in near))
        before = bisect_left(begins, b)
        if kind not in BASE_KINDS and (score < accept or before and reach[before - 1] > a):
            continue
        out.append(Span(kind, a, b, score))
    return out


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = 0.75) -> DataFrame:
    """``key`` and ``spans`` (array of kind, start, end, score, matched text) per row of ``docs``.

    Offsets count code points, ends are exclusive. Whole texts are read; null counts as
    empty. Rows with null or repeated keys each give their own row, an empty table none; no other column is read or
    returned, whatever its name. Spans come by kind, then by start; of added spans that overlap, the kind that comes first stays.
    Nothing is shuffled, memory is that of one Arrow batch, and a text's time is n log n in its spans."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("match", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # every kind has a digit or an @: other texts needn't be looked at again
            maybe = pc.fill_null(pc.match_substring_regex(batch.column(1), "[0-9@]"), False).to_pylist()
            rows = []
            for i, yes in enumerate(maybe):
                t = batch.column(1)[i].as_py() if yes else None
                rows.append([{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score, "match": t[s.start : s.end]} for s in scan(t, accept)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], ["id", "spans"])

    shape = f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,match:string>>"
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, shape).select(F.col("id").alias(key), "spans")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a SHA-256 of the base spans, all spans and their scores as strings, and their number."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE_KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"), F.size("spans").cast("long").alias("n_spans"))
