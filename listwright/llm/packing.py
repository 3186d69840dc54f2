"""Packing: token windows filled by few documents' ends, chosen by non-negative least squares.

A document's ids are cut into whole windows and one end. Only the histogram of lengths (a number for each length up to
the window) passes the driver: there, non-negative least squares finds how often each combination of two or three
lengths that fills a window is used, the counts are rounded, and what is left is laid end to end and cut at window edges.
A piece's place follows from its rank among the pieces of its length, which is counted per task while tokens are made.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from listwright.llm.common import BATCH_BYTES, Buffer, column, in_arrow, record_batch, texts
from listwright.session import materialise

WINDOW = 1024
END = 0
SPECIAL = "<|endoftext|>"


def tokenizer(path: str | None = None):
    """The byte-level BPE of ``path`` (ranks; the same vocabulary as byte_bpe_50k.json), one special token."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)}
    )


# Runs of white space that are longer do not fit the stack of the pattern's engine.
LONG_SPACE = re.compile(r"\s{10000}")


@lru_cache(maxsize=1)
def file_tokenizer():
    """The tokenizer file of the same vocabulary: slower, but it takes any text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(coder, text: str) -> np.ndarray:
    """The text's ids and the id 0."""
    if LONG_SPACE.search(text):
        ids = file_tokenizer().encode(text, add_special_tokens=False).ids
    else:
        ids = coder.encode_to_numpy(text, allowed_special="all")
    return np.append(ids, END).astype("<u4")


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    + [("task", pa.int64()), ("rank", pa.int64()), ("ids", pa.binary())]
)
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long, ids binary"


def _cut(path: str | None, window: int, all_ids: bool):
    def pieces(batches) -> Iterator[pa.RecordBatch]:
        coder, ranks, out = tokenizer(path), np.zeros(window + 1, np.int64), Buffer(_PIECES)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
                ids = token_ids(coder, body.decode())
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    held, n = piece.tobytes(), len(piece)
                    kept = held if all_ids or n < window else None
                    row = (doc_id, start, n, zlib.crc32(held), len(ids), task, int(ranks[n]), kept)
                    ranks[n] += 1
                    yield from out.add(row, len(kept or b""))
        yield from out.flush()

    return pieces


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of three lengths (the first may be 0) of those given that sum to the window, ascending."""
    found = []
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    for a in [0, *lengths.tolist()]:
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        b = b[present[b] & present[window - a - b]]
        found.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(found).astype(np.int64) if found else np.empty((0, 3), np.int64)


# The solver stops when no repeat count can improve the fit by more than this share of the largest count.
GAP = 1e-3
MOST_STEPS = 4000


def least_squares(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - h|^2, A holding a combination a column: accelerated projected gradients.

    The distance that a projected gradient step still goes tells how far x is from the optimum; it starts afresh
    where the momentum points uphill.
    """
    window = len(histogram)
    weight = histogram.astype(float)
    weight[0] = 0

    def times(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, i], weights=x, minlength=window) for i in range(3))
        out[0] = 0
        return out

    def gradient(x: np.ndarray) -> np.ndarray:
        rest = times(x) - weight
        rest[0] = 0
        return rest[combos].sum(axis=1)

    # The largest row sum of A A^T bounds its largest eigenvalue.
    bound = float((times(np.ones(len(combos)))[combos].sum(axis=1)).max())
    x = y = np.zeros(len(combos))
    t = 1.0
    for step in range(MOST_STEPS):
        slope = gradient(y)
        new = np.maximum(0, y - slope / bound)
        if step % 20 == 0 and optimality_gap(x, gradient(x)) <= GAP * max(1.0, weight.max()):
            break
        if slope @ (new - x) > 0:
            t, faster = 1.0, 1.0
        else:
            faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / faster * (new - x), new, faster
    return x


def optimality_gap(x: np.ndarray, slope: np.ndarray) -> float:
    """How far the conditions of the optimum are missed: no slope where x > 0, none downhill where x = 0."""
    return float(np.abs(x - np.maximum(0, x - slope)).max(initial=0))


def repeat_counts(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used, within the histogram (a count for each length below the window).

    The least squares solution is rounded down and, from the largest rest on, up while the histogram allows.
    """
    combos = combinations(len(histogram), np.nonzero(histogram)[0])
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    x = least_squares(combos, histogram)
    counts = np.floor(x).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    order = np.argsort(-(x - counts), kind="stable")
    for add in (False, True):
        for k in order.tolist() if add else np.argsort(-counts, kind="stable").tolist():
            need: dict[int, int] = {}
            for length in combos[k].tolist():
                if length:
                    need[length] = need.get(length, 0) + 1
            room = min(left[length] // times_used for length, times_used in need.items())
            # Rounded up, a combination may go on as long as its lengths last: they have no better use planned.
            use = int(room) if add else int(min(room, counts[k]))
            counts[k] = counts[k] + use if add else use
            for length, times_used in need.items():
                left[length] -= use * times_used
    used = counts > 0
    return combos[used], counts[used]


class Plan:
    """Where each rank of each length goes. Size: a few numbers for each combination in use."""

    def __init__(self, histogram: np.ndarray, window: int):
        """``histogram``: a count for each length up to and with the window."""
        full = int(histogram[window])
        combos, counts = repeat_counts(histogram[:window])
        used: dict[int, int] = {}
        places: dict[int, list] = {}
        base = full
        for combo, count in zip(combos.tolist(), counts.tolist()):
            offset = 0
            for length in reversed(combo):
                if length:
                    places.setdefault(length, []).append((used.get(length, 0), base, offset))
                    used[length] = used.get(length, 0) + count
                    offset += length
            base += count
        self.window, self.stream_base = window, base
        self.first = {n: np.array([p[0] for p in of], np.int64) for n, of in places.items()}
        self.sequence = {n: np.array([p[1] for p in of], np.int64) for n, of in places.items()}
        self.offset = {n: np.array([p[2] for p in of], np.int64) for n, of in places.items()}
        self.planned = used
        self.stream = {}  # where the lengths' rests begin in the stream of what is left
        at = 0
        for length in range(window - 1, 0, -1):
            self.stream[length] = at
            at += (int(histogram[length]) - used.get(length, 0)) * length
        self.left = at

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """Sequence and offset; ranks beyond the plan get a place in the stream, which may need a cut."""
        if length == self.window:
            return rank, 0
        beyond = rank - self.planned.get(length, 0)
        if beyond < 0:
            k = int(np.searchsorted(self.first[length], rank, side="right")) - 1
            return int(self.sequence[length][k] + rank - self.first[length][k]), int(self.offset[length][k])
        sequence, offset = divmod(self.stream[length] + beyond * length, self.window)
        return self.stream_base + sequence, offset


_PLACED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PLACED_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _place(plan: Plan, all_ids: bool):
    def placed(batches) -> Iterator[pa.RecordBatch]:
        out = Buffer(_PLACED)
        for batch in batches:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "before", "ids")
            for doc_id, start, length, crc, n, rank, before, ids in zip(*(column(batch, name) for name in names)):
                sequence, offset = plan.place(length, before + rank)
                cut = plan.window - offset
                if length <= cut:
                    kept = ids if all_ids else None
                    yield from out.add((doc_id, start, length, crc, n, sequence, offset, kept), len(kept or b""))
                else:
                    for first, size, where in ((0, cut, (sequence, offset)), (cut, length - cut, (sequence + 1, 0))):
                        part = ids[4 * first : 4 * (first + size)]
                        row = (doc_id, start + first, size, zlib.crc32(part), n, *where, part if all_ids else None)
                        yield from out.add(row, len(part) if all_ids else 0)
        yield from out.flush()

    return placed


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, all_ids: bool = False) -> DataFrame:
    """Pieces of documents and their places: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A document's ids are those of its text (null: empty) and the id 0; each lies in exactly one piece. All sequences
    but at most one are full. Texts of any length, runs of white space too, are read whole. ``ids`` holds a piece's ids as little-endian 32-bit numbers with ``all_ids``, else null.
    Rows without an id or with one that repeats are documents like others. An empty table gives no rows.
    """
    pieces = materialise(in_arrow(texts(docs), _cut(path, window, all_ids), _PIECES_SQL), "pieces")
    tasks = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for row in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row a length
        histogram[row["length"]] = row["n"]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return in_arrow(pieces.join(before, ["length", "task"]), _place(Plan(histogram, window), all_ids), _PLACED_SQL)
