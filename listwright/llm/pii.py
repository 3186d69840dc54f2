"""Personal data and secrets: patterns propose spans, checksums and forms confirm them, context words nearby adjust the score."""

from __future__ import annotations

import base64
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, column, in_arrow, texts

KINDS = ("email", "ip", "card", "phone", "iban", "national_phone", "national_id", "secret")
BASE_KINDS = KINDS[:4]
CONTEXT = 40  # code points before a span
LEAST_SCORE = 0.5

# Context words of each kind.
CONTEXT_WORDS = {
    "email": "email e-mail mail contact",
    "ip": "ip address host server",
    "card": "card credit visa mastercard payment",
    "phone": "phone tel telephone call mobile fax",
    "iban": "iban account bank",
    "national_phone": "phone tel telephone call mobile fax",
    "national_id": "ssn social security id passport",
    "secret": "token key apikey api_key secret password passwd pwd bearer authorization credential credentials",
}
# Score before context; what context adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_phone": 0.3, "national_id": 0.3, "secret": 0.3}
BONUS = 0.25

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Stretches that hold whole any match of the three number patterns: they begin with + or a digit.
_ZONE = re.compile(r"[+0-9][0-9+().\x20-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b")
# A word that could be a key: long, letters and digits, perhaps in parts.
_KEY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_-]{20,}(?:\.[A-Za-z0-9_-]{10,}){0,2}={0,2}(?![A-Za-z0-9+/_-])")
# Beginnings of keys that services give out, with the form of the rest.
_ISSUED = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
)
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
# Bits a character of a random key of digits a-f, of 20 characters and more; prose and names with digits have fewer.
LEAST_ENTROPY = 2.8
_CONTEXT = {kind: re.compile(r"\b(?:" + "|".join(map(re.escape, words.split())) + r")\b", re.I) for kind, words in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def entropy(word: str) -> float:
    """Bits a character, by the word's own frequencies."""
    n = len(word)
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values())


def signed_token(word: str) -> bool:
    """Whether it is three parts of which the first decodes to a header that names an algorithm."""
    parts = word.split(".")
    if len(parts) != 3:
        return False
    try:
        header = json.loads(base64.urlsafe_b64decode(parts[0] + "=" * (-len(parts[0]) % 4)))
    except ValueError:
        return False
    return isinstance(header, dict) and "alg" in header


def secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score before context) of keys and tokens: such in a form that tells, or random in letters and digits."""
    for m in _PRIVATE_KEY.finditer(text):
        yield m.start(), m.end(), 1.0
    for m in _KEY.finditer(text):
        word = m.group()
        if _ISSUED.fullmatch(word) or signed_token(word):
            yield m.start(), m.end(), 0.9
        elif any("0" <= c <= "9" for c in word) and any(c.isalpha() for c in word) and entropy(word) >= LEAST_ENTROPY:
            yield m.start(), m.end(), PRIOR["secret"]


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from the @ signs on: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > done and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ip_holds(span: str) -> bool:
    return all(len(p) < 4 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in span.split(".")))


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in the order of kinds, then places. Base kinds stay whatever their score."""
    found = [("email", *span) for span in emails(text)]
    for zone in _ZONE.finditer(text):
        part, at = zone.group(), zone.start()
        if len(part) < 7:
            continue
        checks = (
            ("ip", _IP, _ip_holds),
            ("card", _CARD, lambda s: 13 <= len(d := _digits(s)) <= 19 and luhn(d)),
            ("phone", _PHONE, lambda s: 9 <= len(_digits(s)) <= 15),
        )
        for kind, shape, holds in checks:
            found += [(kind, at + m.start(), at + m.end()) for m in shape.finditer(part) if holds(m.group())]
    base = set(found)
    taken = sorted((start, end) for _, start, end in found)
    starts = [start for start, _ in taken]
    reach = list(accumulate((end for _, end in taken), max))  # how far the spans up to each one go

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    prior = dict.fromkeys(found, 0.0)
    if any(c.isdigit() for c in text):
        found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod_97(m.group())]
        for kind, shape in (("national_phone", _NATIONAL_PHONE), ("national_id", _NATIONAL_ID)):
            found += [(kind, m.start(), m.end()) for m in shape.finditer(text) if free(m.start(), m.end())]
    for start, end, score in secrets(text):
        if free(start, end) and not _IBAN.fullmatch(text, start, end):
            found.append(("secret", start, end))
            prior["secret", start, end] = score
    out = []
    for span in found:
        kind, start, end = span
        score = prior.get(span) or PRIOR[kind]
        if _CONTEXT[kind].search(text, max(0, start - CONTEXT), start):
            score = min(1.0, score + BONUS)
        if span in base or score >= LEAST_SCORE:
            out.append((kind, start, end, score, span in base))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def _found(batches) -> Iterator[pa.RecordBatch]:
    out = Buffer(pa.schema([("doc_id", pa.int64()), ("found", pa.list_(_SPAN))]))
    names = [field.name for field in _SPAN]
    for batch in batches:
        for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
            rows = [dict(zip(names, span)) for span in spans(body.decode())]
            yield from out.add((doc_id, rows), 80 * len(rows))
    yield from out.flush()


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, found), a row per row of ``docs``: spans of the whole text in code points, end exclusive, with scores.

    Null or empty texts have no spans, an empty table no rows; repeated rows have theirs each. Texts of any length are read
    whole, in time linear in the text and its spans but for sorting them. Base spans (email, ip, card, phone) need their
    pattern and check alone; the others need a score of one half: an IBAN by its checksum, a national phone or identity
    number by a context word before it, a key by the form its issuer gives it, or by being random and a context word.
    """
    return in_arrow(
        texts(docs), _found, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"
    )


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of base spans, all spans as text; how many spans and how many secrets there are."""

    def joined(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    rows = personal_data(docs)
    base = F.filter("found", lambda s: s["base"])
    counts = [count(kind) for kind in BASE_KINDS]
    secret = F.filter("found", lambda s: s["kind"] == "secret")
    more = [F.size("found").cast("long").alias("n_spans"), F.size(secret).cast("long").alias("n_secret")]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), *more)
