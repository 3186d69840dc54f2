"""Periodic run detection: stretches of words that repeat themselves four times or more, each found once and exactly.

A run is seeded by Kruskal on the suffix tree without the tree: neighbours in the suffix array are united by decreasing LCP,
each class keeps its positions in order, and where a union puts two positions side by side whose distance is at most the
LCP, the words between them go on repeating. Two neighbours p and p + q of a class at level l tell that the stretch from p has
period q for q + l words and no longer; if the word before breaks it too, it is a run. Positions between p and p + q would
have joined earlier, so q is the smallest period.

Runs need a length of at least 6 and 4 periods, so unions below an LCP of 5 are never made, and texts in which no five words
come twice are done at once.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from listwright.llm.common import Buffer, column, in_arrow, texts, window_hashes, words_of

LEAST_LENGTH = 6
LEAST_PERIODS = 4
# The LCP of the first two periods of any run: its length less its period.
LEAST_LCP = LEAST_LENGTH - 1

Run = tuple[int, int, int]  # start, length, period


def repeated(words: list, doc_id: int | None) -> list:
    """The words as looked at: of documents whose crc32 is divisible by ten, all from one place on repeat what stands there."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    times, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    start = times % n
    period = 1 + (n - start) // (3 + times % 8)
    return words[:start] + (words[start : start + period] * (-(-(n - start) // period)))[: n - start]


def _numbered(words: list) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict = {}
    return np.fromiter((known.setdefault(word, len(known)) for word in words), np.int64, len(words))


def _levels(numbers: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words, until no two are equal; shorter suffixes come first."""
    n = len(numbers)
    levels, width = [numbers.astype(np.int32)], 1
    while width < n:
        rank = levels[-1].astype(np.int64)
        then = np.zeros(n, np.int64)
        then[: n - width] = rank[width:] + 1
        values, rank = np.unique(rank * (n + 1) + then, return_inverse=True)
        levels.append(rank.astype(np.int32))
        width *= 2
        if len(values) == n:
            break
    return levels


def neighbours(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are neighbours in the suffix array, and their LCP, by decreasing LCP, of those with LEAST_LCP or more."""
    n = len(numbers)
    levels = _levels(numbers)
    order = np.argsort(levels[-1], kind="stable")
    left, right = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    some = levels[min(2, len(levels) - 1)]
    near = some[left] == some[right]  # four words in common at least, before any more is counted
    left, right = left[near], right[near]
    lcp = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        at = np.nonzero(np.maximum(left, right) + lcp < n)[0]
        at = at[levels[level][left[at] + lcp[at]] == levels[level][right[at] + lcp[at]]]
        lcp[at] += 1 << level
    far = np.nonzero(lcp >= LEAST_LCP)[0]
    far = far[np.argsort(-lcp[far], kind="stable")]
    return left[far], right[far], lcp[far]


def _meetings(big: list[int], small: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Put ``small`` into ``big``; (position, distance) where one of either now stands beside the other, no further than ``most``."""
    if 8 * len(small) > len(big):
        inside = set(small) if len(small) > 1 else small
        big += small
        big.sort()
        for p, q in zip(big, big[1:]):
            if q - p <= most and (p in inside) != (q in inside):
                yield p, q - p
        return
    for p in small:
        insort(big, p)
    inside = set(small)
    for p in small:
        at = bisect_left(big, p)
        if at and big[at - 1] not in inside and p - big[at - 1] <= most:
            yield big[at - 1], p - big[at - 1]
        if at + 1 < len(big) and big[at + 1] not in inside and big[at + 1] - p <= most:
            yield p, big[at + 1] - p


def runs(words: list) -> list[Run]:
    """All runs, by start, then period."""
    if len(words) < LEAST_LENGTH:
        return []
    numbers = _numbered(words)
    hashes = window_hashes(numbers.view(np.uint64), LEAST_LCP)
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():
        return []
    found = []
    parent: dict[int, int] = {}
    classes: dict[int, list[int]] = {}

    def root(p: int) -> int:
        while (above := parent.setdefault(p, p)) != p:
            parent[p] = p = parent[above]
        return p

    for left, right, lcp in zip(*(of.tolist() for of in neighbours(numbers))):
        left, right = root(left), root(right)
        big, small = classes.get(left) or [left], classes.pop(right, None) or [right]
        if len(big) < len(small):
            big, small = small, big
        for p, period in _meetings(big, small, lcp // (LEAST_PERIODS - 1)):
            if p == 0 or numbers[p - 1] != numbers[p + period - 1]:
                found.append((p, lcp + period, period))
        parent[right] = left
        classes[left] = big
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list, found: list[Run]) -> list:
    """The words that no run holds after its first period."""
    if not found:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [word for word, depth in zip(words, accumulate(change)) if not depth]


_RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _each_run(batches) -> Iterator[pa.RecordBatch]:
    out = Buffer(_RUNS)
    for batch in batches:
        for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
            for run in runs(words_of(body)):
                yield from out.add((doc_id, *run))
    yield from out.flush()


def document_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text as it is; positions are word numbers from 0.

    Null, empty and short texts have no runs; repeated rows have theirs each. Edge cases as in ``run_digests``.
    """
    return in_arrow(texts(docs), _each_run, "doc_id long, start long, length long, period long")


def _collapsed_text(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        new = []
        for text in column(batch, "text"):
            words = words_of((text or "").encode())
            found = runs(words)
            new.append(b" ".join(collapsed(words, found)).decode() if found else text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))


def without_runs(docs: DataFrame) -> DataFrame:
    """``docs``, all columns; texts with runs are words with one space between, each run cut to its first period."""
    return in_arrow(docs, _collapsed_text, docs.schema)


_DIGESTS = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
_DIGESTS_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(words: list[bytes]) -> tuple:
    found = runs(words)
    longest = min(found, key=lambda run: (-run[1], run[0], run[2]), default=(None, None, None))
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in found)
    return (
        len(found),
        *longest,
        1000 * longest[1] // longest[2] if found else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(),
    )


def _digests(batches) -> Iterator[pa.RecordBatch]:
    out = Buffer(_DIGESTS)
    for batch in batches:
        for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
            yield from out.add((doc_id, *digest(repeated(words_of(body), doc_id))))
    yield from out.flush()


def run_digests(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: its runs, the longest (ties: least start, then period), digests of all and of the text without.

    Words are maximal ``[^\\x20\\x09-\\x0D]+``, compared exactly. Null, empty and wordless texts have no runs and digests of
    nothing. A row without doc_id is looked at as it stands. Repeated rows give repeated rows, an empty table none, other
    columns play no part. A text is one task's work, whole: it takes about 4 * log2(n) bytes a word for n words.
    """
    return in_arrow(texts(docs), _digests, _DIGESTS_SQL)
