"""Benchmark decontamination by template: numbers, names and units become typed placeholders, so a question asked
again with other values still meets its template; the values that fill the slots must then map one to one. A capitalised
word within a sentence is a name; one that begins a sentence is read both as a name and as it is.

Windows of five template words join on their hash. Document windows first pass a bitmap of the benchmark's windows, whose
size is fixed, so that only likely hits are shuffled; the join itself works for a benchmark of any size.

Hits are settled by occurrence: a hit's diagonal is its place in the document less its place in the item, and a copy's hits
lie on one diagonal, or on near ones where words were put in or left out. Diagonals are cut into spans, so that what a task
holds is bounded by the item's length, not the text's. Windows of slots only, which any table of numbers is full of, are
checked on the diagonals of other windows' hits alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, bitmap, column, hashed_rows, in_arrow, in_bitmap, texts, window_hashes, words_of
from listwright.session import materialise

WIDTH = 5
PERCENT = 75
# Diagonals that are settled together; those within an item's slack of an edge go to both sides.
SPAN = 2048

# Units of measure and number words.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers"
    b" mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres"
    b" s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    b" km/h mph dollar dollars cent cents euro euros percent".split()
)
NUMBER_WORDS = frozenset(
    b"one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    b" seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split()
)

_EDGES = b".,;:!?()[]{}\"'"
_NUMBER = re.compile(rb"[$+-]?[0-9][0-9.,/:]*%?")
_QUANTITY = re.compile(rb"[0-9][0-9.,]*([A-Za-z/]+)")
_PLAIN, _NUMBER_SLOT, _UNIT_SLOT, _QUANTITY_SLOT, _NAME_SLOT = range(5)
_SLOT_HASH = np.array([0] + [xxhash.xxh3_64_intdigest(b"\0slot%d" % i) for i in range(1, 5)], np.uint64)


class Templates(dict):
    """What a word is in a template, remembered: its slot (0: none), its hash, whether capitalised, whether it ends a sentence."""

    most = 400_000

    def __init__(self):
        super().__init__()
        self.slot = np.zeros(self.most, np.int8)
        self.hash = np.zeros(self.most, np.uint64)
        self.capital = np.zeros(self.most, bool)
        self.ends = np.zeros(self.most, bool)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        bare = word.strip(_EDGES)
        low = bare.lower()
        quantity = _QUANTITY.fullmatch(low)
        if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            slot = _NUMBER_SLOT
        elif low in UNITS:
            slot = _UNIT_SLOT
        elif quantity and quantity.group(1) in UNITS:
            slot = _QUANTITY_SLOT
        else:
            slot = _PLAIN
        self.slot[at] = slot
        self.hash[at] = xxhash.xxh3_64_intdigest(low)
        text = bare.decode(errors="replace")
        self.capital[at] = slot == _PLAIN and text[:1].isupper() and not text[1:].isupper()
        self.ends[at] = word.rstrip(b")]\"'")[-1:] in (b".", b"!", b"?", b":")
        return at

    def _some(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        if len(self) + len(words) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.slot[at], self.hash[at], self.capital[at], self.ends[at]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot and template hash of each word, and where a capitalised word begins a sentence. Within one it is a name."""
        parts = [self._some(words[at : at + self.most // 2]) for at in range(0, len(words) or 1, self.most // 2)]
        slot, hashes, capital, ends = (np.concatenate(column) for column in zip(*parts))
        starts = np.append(True, ends[:-1])[: len(ends)]
        slot = np.where(capital & ~starts, np.int8(_NAME_SLOT), slot)
        return slot, np.where(slot > 0, _SLOT_HASH[slot], hashes), capital & starts


class Windows:
    """All readings of a text's windows.

    A capitalised word that begins a sentence may be a name or not, so a window with k of them has 2^k readings. First come
    the windows with none taken for a name, then those where some are: ``at`` is a window's place, ``names`` has a bit for
    each of its words that is taken for one.
    """

    def __init__(self, body: bytes, templates: Templates):
        self.words = words_of(body)
        self.slot, hashes, maybe = templates.of(self.words)
        self.width = min(WIDTH, len(self.words))
        windows = window_hashes(hashes, WIDTH)
        self.count = len(windows)
        self.at, self.names, self.hash = np.arange(self.count), np.zeros(self.count, np.uint8), windows
        if not maybe.any():
            return
        held = _holding(np.nonzero(maybe)[0], len(self.words), self.width)
        at = np.nonzero(held)[0]
        names = np.zeros(len(at), np.uint8)
        for i in range(self.width):
            some = np.nonzero(maybe[at + i])[0]
            at = np.concatenate([at, at[some]])
            names = np.concatenate([names, names[some] | np.uint8(1 << i)])
        at, names = at[names > 0], names[names > 0]
        read = np.empty((self.width, len(at)), np.uint64)
        for i in range(self.width):
            read[i] = np.where(names >> i & 1, _SLOT_HASH[_NAME_SLOT], hashes[at + i])
        self.at, self.names = np.concatenate([self.at, at]), np.concatenate([self.names, names])
        self.hash = np.concatenate([windows, hashed_rows(read)])

    def bare(self, some: np.ndarray) -> np.ndarray:
        """Which of some windows are of slots only."""
        plain = np.zeros(len(some), bool)
        for i in range(self.width):
            plain |= (self.slot[self.at[some] + i] == _PLAIN) & (self.names[some] >> i & 1 == 0)
        return ~plain

    def values(self, one: int) -> list[str]:
        """What fills the slots of a window: kind and value of each."""
        at, names = int(self.at[one]), int(self.names[one])
        slots = [_NAME_SLOT if names >> i & 1 else self.slot[at + i] for i in range(self.width)]
        return [f"{slot}{self.words[at + i].strip(_EDGES).lower().decode(errors='replace')}" for i, slot in enumerate(slots) if slot]


def _holding(places: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which windows of ``width`` of n words hold any of the places."""
    sums = np.zeros(n + 1, np.int64)
    sums[places + 1] = 1
    sums = sums.cumsum()
    return sums[width:] > sums[: n - width + 1]


def _digest(body: bytes) -> int:
    """Tells apart texts that share an id."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(body))))


_ITEMS = pa.schema(
    [
        *((name, pa.int64()) for name in ("window", "item_id", "item", "pos", "item_windows")),
        ("item_slots", pa.list_(pa.string())),
        ("bare", pa.bool_()),
        ("tabular", pa.bool_()),
    ]
)
_ITEMS_SQL = "window long, item_id long, item long, pos long, item_windows long, item_slots array<string>, bare boolean, tabular boolean"
_LIKELY = pa.schema([*((name, pa.int64()) for name in ("window", "doc_id", "body", "at")), ("doc_slots", pa.list_(pa.string())), ("bare", pa.bool_())])
_LIKELY_SQL = "window long, doc_id long, body long, at long, doc_slots array<string>, bare boolean"


def _item_windows(batches) -> Iterator[pa.RecordBatch]:
    templates, out = Templates(), Buffer(_ITEMS)
    for batch in batches:
        for item_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
            windows = Windows(body, templates)
            digest = _digest(body)
            bare = windows.bare(np.arange(len(windows.at)))
            # So few windows of such an item have a plain word that those alone may not lead to it.
            tabular = bool(100 * len(np.unique(windows.at[bare])) >= PERCENT * windows.count)
            for i, (pos, window) in enumerate(zip(windows.at.tolist(), windows.hash.view(np.int64).tolist())):
                row = (window, item_id, digest, pos, windows.count, windows.values(i), bool(bare[i]), tabular)
                yield from out.add(row, 64)
    yield from out.flush()


def _likely(packed: bytes):
    def likely(batches) -> Iterator[pa.RecordBatch]:
        has = in_bitmap(packed)
        templates, out = Templates(), Buffer(_LIKELY)
        for batch in batches:
            for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
                windows = Windows(body, templates)
                hits = np.nonzero(has(windows.hash))[0]
                if not len(hits):
                    continue
                digest = _digest(body)
                for i, at, window, no_word in zip(
                    hits.tolist(), windows.at[hits].tolist(), windows.hash.view(np.int64)[hits].tolist(), windows.bare(hits).tolist()
                ):
                    yield from out.add((window, doc_id, digest, at, windows.values(i), no_word), 64)
        yield from out.flush()

    return likely


_KEY = ("doc_id", "body", "item_id", "item")
_FOUND = pa.schema([*((name, pa.int64()) for name in (*_KEY, "item_windows", "count")), ("same", pa.bool_()), ("verbatim", pa.list_(pa.int64()))])
_FOUND_SQL = "doc_id long, body long, item_id long, item long, item_windows long, count long, same boolean, verbatim array<long>"

Row = tuple[int, list[str], list[str]]


def _settled(rows: list[Row]) -> tuple[set[int], dict[str, str]]:
    """Of windows (place in the item, item's values, document's values): the places that agree on what each item value
    became, and what it became. The most frequent mapping decides, ties to the value as it was, then to the one that sorts
    first."""
    votes: dict[str, Counter] = {}
    for _, mine, theirs in rows:
        for a, b in zip(mine, theirs):
            votes.setdefault(a, Counter())[b] += 1
    became = {a: min(of.items(), key=lambda kv: (-kv[1], kv[0] != a, kv[0]))[0] for a, of in votes.items()}
    taken = Counter(became.values())
    # Two item values may not become one, unless that is what all windows say of a value left as it was.
    wrong = {a for a, b in became.items() if taken[b] > 1 and a != b}
    good = {
        place
        for place, mine, theirs in rows
        if all(became[a] == b and a not in wrong for a, b in zip(mine, theirs))
    }
    return good, became


def _consistent(rows: list[Row]) -> tuple[int, bool]:
    """How many places agree, and whether any value changed."""
    good, became = _settled(rows)
    return len(good), any(a != b for a, b in became.items())


def slack(item_windows):
    """How far apart the diagonals of one occurrence may lie."""
    return 2 * item_windows + 128


def _occurrence(diagonals: dict[int, list[Row]], anchor: int, near: list[int]) -> tuple[int, bool]:
    """How many places the occurrence around a diagonal has, and whether its values are the item's.

    The anchor's own windows settle the mapping; other diagonals, from near to far, only add places that agree with it.
    So text farther off takes nothing away.
    """
    good, _ = _settled(diagonals[anchor])
    became, taken = {}, {}

    def fits(mine, theirs):
        return all(became.get(a, b) == b and taken.get(b, a) == a for a, b in zip(mine, theirs))

    def take(mine, theirs):
        for a, b in zip(mine, theirs):
            became[a] = b
            taken[b] = a

    rows = [row for row in diagonals[anchor] if row[0] in good]
    places = set()
    for diagonal in sorted(near, key=lambda d: (abs(d - anchor), d)):
        for place, mine, theirs in rows if diagonal == anchor else diagonals[diagonal]:
            if place not in places and fits(mine, theirs):
                # A window may not tie two of its own slots together either.
                if len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs)):
                    places.add(place)
                    take(mine, theirs)
    return len(places), all(a == b for a, b in became.items())


def _best(rows: list[tuple], span: int, total: int) -> tuple[int, bool]:
    """The best occurrence anchored in the span, if it reaches the share; rows are (diagonal, *Row), by diagonal."""
    diagonals: dict[int, list[Row]] = {}
    for row in rows:
        diagonals.setdefault(row[0], []).append(row[1:])
    order = list(diagonals)
    sums = [0, *accumulate(len(diagonals[d]) for d in order)]
    best = (0, True)
    for anchor in sorted(order, key=lambda d: (-len(diagonals[d]), d)):
        if anchor // SPAN != span:
            continue
        first, last = bisect_left(order, anchor - slack(total)), bisect_right(order, anchor + slack(total))
        least = max(best[0], -(-PERCENT * total // 100))
        if sums[last] - sums[first] < least:
            continue
        near = order[first:last]
        if len({row[0] for d in near for row in diagonals[d]}) >= least:
            best = max(best, _occurrence(diagonals, anchor, near))
            if best == (total, True):
                break
    return best


def _decide(batches) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (key, span, diagonal): the best occurrence of each span and the places held word for word."""
    out, key, rows, total = Buffer(_FOUND), None, [], 0

    def decided():
        count, same = _best(rows, key[-1], total)
        verbatim = sorted({place for _, place, mine, theirs in rows if mine == theirs})
        yield from out.add((*key[:-1], total, count, same, verbatim), 64 + 8 * len(verbatim))

    names = (*_KEY, "span", "item_windows", "diagonal", "pos", "item_slots", "doc_slots")
    for batch in batches:
        for row in zip(*(column(batch, name) for name in names)):
            if row[:5] != key:
                if key is not None:
                    yield from decided()
                key, rows, total = row[:5], [], row[5]
            rows.append(row[6:])
    if key is not None:
        yield from decided()
    yield from out.flush()


def _hits(likely: DataFrame, items: DataFrame) -> DataFrame:
    """Document windows with the item windows they meet.

    Windows with a plain word meet all items that have them. Those of slots only meet an item's on a diagonal that such
    a hit has opened: at most one document window for each of the item's. A tabular item, whose windows of slots only would
    do by themselves, also meets windows of slots only that hold its very values.
    """
    columns = (*_KEY, "item_windows", "diagonal", "pos", "item_slots", "doc_slots")
    diagonal = (F.col("at") - F.col("pos")).alias("diagonal")
    word, bare = items.filter("NOT bare").drop("bare", "tabular"), items.filter("bare").drop("bare")
    word_likely, bare_likely = likely.filter("NOT bare").drop("bare"), likely.filter("bare").drop("bare")
    opened = word_likely.join(word, "window").select("*", diagonal).select(*columns)
    of_values = bare.filter("tabular").withColumnRenamed("window", "_window")
    same = (F.col("window") == F.col("_window")) & (F.col("doc_slots") == F.col("item_slots"))
    valued = bare_likely.join(of_values, same).select("*", diagonal).select(*columns)
    ways = opened.select(*_KEY, "diagonal").union(valued.select(*_KEY, "diagonal")).distinct()
    asked = ways.join(bare.drop("tabular"), ["item_id", "item"]).withColumn("at", F.col("diagonal") + F.col("pos"))
    beside = bare_likely.join(asked, ["doc_id", "body", "at", "window"]).select(*columns)
    return opened.union(beside)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, percent, renamed): documents that hold at least 75 % of an item's template windows.

    The share is that of the best occurrence, or of the windows held word for word anywhere in the text; so text beside an
    occurrence never clears a document. An item nearly all numbers and names is found by its own values, not by others'. Of texts or items that share an id, each is looked at by itself.
    ``renamed`` tells that slots hold other values than the item's. Words are split at white space, lower-cased (A-Z),
    punctuation at their ends dropped. Null, empty or wordless texts and items, and rows without an id, are in no
    pair. An item of fewer than five words has one window, found in documents that are nothing else. Repeated rows
    change nothing.
    """
    held = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").alias("doc_id"), "text")
    items = materialise(in_arrow(texts(held), _item_windows, _ITEMS_SQL).distinct(), "item-windows")
    bodies = texts(docs.filter("doc_id IS NOT NULL"))
    likely = materialise(in_arrow(bodies, _likely(bitmap(items.select("window"))), _LIKELY_SQL).distinct(), "likely-windows")
    hits = _hits(likely, items)
    edges = (F.floor((F.col("diagonal") + sign * slack(F.col("item_windows"))) / SPAN) for sign in (-1, 1))
    hits = hits.withColumn("span", F.explode(F.sequence(*edges)))
    hits = hits.repartition(*_KEY, "span").sortWithinPartitions(*_KEY, "span", "diagonal", "pos")
    found = in_arrow(hits, _decide, _FOUND_SQL)
    found = found.groupBy(*_KEY, "item_windows").agg(
        F.max(F.struct("count", "same")).alias("one"), F.size(F.array_distinct(F.flatten(F.collect_list("verbatim")))).alias("verbatim")
    )
    found = found.select("doc_id", "item_id", "item_windows", F.greatest("one", F.struct(F.col("verbatim").cast("long").alias("count"), F.lit(True).alias("same"))).alias("one"))
    found = found.filter(100 * F.col("one.count") >= PERCENT * F.col("item_windows"))
    percent = 100.0 * F.col("one.count") / F.col("item_windows")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(percent.alias("percent"), F.col("one.same").alias("same"))).alias("one"))
    return best.select("doc_id", "item_id", "one.percent", (~F.col("one.same")).alias("renamed"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated document: doc_id, the items it holds, the largest share, whether any is re-parameterised."""
    return (
        contaminations(docs, benchmark)
        .groupBy("doc_id")
        .agg(
            F.sort_array(F.collect_set("item_id")).alias("item_ids"),
            F.max("percent").alias("percent"),
            F.max("renamed").alias("renamed"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the contaminated ones."""
    bad = contaminations(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
