"""SimHash near-dedup: fingerprints within a few bits of each other are found by BK-trees, one for each shard.

Distinct fingerprints are cut into BLOCKS blocks of bits. Two that differ in at most RADIUS bits agree in two whole blocks
at least, whichever they are; so a shard is a pair of blocks with the bits that stand there, and each fingerprint is in one
shard for each pair of blocks. Within a shard, a BK-tree's children are keyed by their integer Hamming distance to the
parent, and a search follows only the edges within the radius.

Shards are dealt by ranges of (shard, fingerprint). A shard that lies within a task has its tree built and searched there. Of
one that goes on in a neighbour, or is larger than a tree may be, the task gives out packed parts; each part's tree is then
sent to all parts of the same shard, and to no others: that is the broadcast, by the shard, since all trees together grow
with the data and may not pass the driver.

A shard's links come out as a forest that spans them, so a group of near copies does not emit all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, column, in_arrow, numbers, record_batch, texts, words_of
from listwright.llm.components import components
from listwright.session import materialise

WIDTH = 4
SEED = 42
RADIUS = 4
BITS = 64
BLOCKS = RADIUS + 2
# Fingerprints in one tree at most; larger shards are cut.
TREE = 1 << 15
# Steps through trees that are held at a time.
HELD = 1 << 21

_EDGES = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
_U = np.uint64


def fingerprint(body: bytes) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes. Only A-Z is lower-cased."""
    words = words_of(body.lower())
    n = len(words)
    if n == 0:
        return 0
    width = min(WIDTH, n)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: n - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), 1 << 15):
        some = [digest(whole[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])]
        rows = np.array(some, "<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(ends), bitorder="little").view("<u8")[0])


_CODES = pa.schema([("doc_id", pa.int64()), ("code", pa.int64())])


def _codes(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.array([fingerprint(body) for body in column(batch, "body")], np.uint64)
        yield record_batch(_CODES, batch.column(batch.schema.get_field_index("doc_id")), codes.view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code): a row per row of ``docs``; the code of a null or wordless text is 0."""
    return in_arrow(texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), _codes, "doc_id long, code long")


def _block(at: int) -> Column:
    low, high = _EDGES[at], _EDGES[at + 1]
    return F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _shard(number: int, pair: tuple[int, int]) -> Column:
    """A number for the pair of blocks and the bits there."""
    first, second = pair
    wide = max(b - a for a, b in zip(_EDGES, _EDGES[1:]))
    return F.lit(number << (2 * wide)).cast("long") + F.shiftleft(_block(first).cast("long"), wide) + _block(second)


class Trees:
    """BK-trees over sorted groups of codes, in flat arrays. A node's children stand after it, by their distance to it."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes = codes
        n = len(codes)
        parent_edge = np.full(n, -1, np.int64)
        cell, at = group.astype(np.int64), np.arange(n)
        parent = np.full(n, -1, np.int64)
        self.roots = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0][: n or 0]
        # Each cell's first code becomes a node; the others go on to the cells of their distance to it.
        while len(at):
            first = np.append(True, cell[1:] != cell[:-1])
            pivot = at[first][np.cumsum(first) - 1]
            at, pivot = at[~first], pivot[~first]
            edge = np.bitwise_count(codes[at] ^ codes[pivot]).astype(np.int64)
            parent[at] = pivot
            cell = pivot * (BITS + 1) + edge
            parent_edge[at] = cell
            order = np.argsort(cell, kind="stable")
            cell, at = cell[order], at[order]
        # Only the last parent a code was given is its own; a node keeps the cell in which it came first.
        held = np.nonzero(parent >= 0)[0]
        order = np.argsort(parent_edge[held], kind="stable")
        self.children, self.edges = held[order], parent_edge[held][order]

    def within(self, codes: np.ndarray, start: np.ndarray, before: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked, node): for each code, the nodes within RADIUS in the tree from ``start``.

        With ``before`` only nodes that stand before that place: a node's descendants all stand after it.
        """
        asked, node = np.arange(len(codes)), start
        while len(asked):
            apart = np.bitwise_count(codes[asked] ^ self.codes[node]).astype(np.int64)
            near = apart <= RADIUS
            if near.any():
                yield asked[near], node[near]
            low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(apart - RADIUS, 0), side="left")
            high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(apart + RADIUS, BITS), side="right")
            count = high - low
            asked = np.repeat(asked, count)
            node = self.children[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            if before is not None:
                earlier = node < before[asked]
                asked, node = asked[earlier], node[earlier]


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least place that links a-b reach from each place, beside those known before."""
    while True:
        old = label
        label = old.copy()
        low = np.minimum(old[a], old[b])
        for end in (a, b):
            np.minimum.at(label, end, low)
            np.minimum.at(label, old[end], low)
        label = label[label]
        if np.array_equal(label, old):
            return label


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of queries whose trees have about HELD nodes in all; of at least one query."""
    whole = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(whole, (whole[at - 1] if at else 0) + HELD, side="right")))
        yield slice(at, end)
        at = end


def _united(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place that the links found reach; many links are held at a time, never all."""
    label, held, count = np.arange(n), [], 0
    for a, b in found:
        held.append((a, b))
        count += len(a)
        if count > HELD:
            label = _forest(*map(np.concatenate, zip(*held)), label)
            held, count = [], 0
    return _forest(*map(np.concatenate, zip(*held)), label) if held else label


def linked_within(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For codes sorted by group: the least place in the group that links reach."""
    trees = Trees(codes, group)
    tree = np.searchsorted(trees.roots, np.arange(len(codes)), side="right") - 1
    sizes = np.diff(np.append(trees.roots, len(codes)))

    def found():
        for some in _slices(sizes[tree]):
            places = np.arange(some.start, some.stop)
            for asked, node in trees.within(codes[some], trees.roots[tree[some]], places):
                yield asked + some.start, node

    return _united(len(codes), found())


def linked_across(trees: Trees, codes: np.ndarray) -> np.ndarray:
    """For the nodes of one tree, then ``codes``: the least place that links between the two reach."""
    n = len(trees.codes)

    def found():
        for some in _slices(np.full(len(codes), n)):
            for asked, node in trees.within(codes[some], np.zeros(some.stop - some.start, np.int64)):
                yield asked + (n + some.start), node

    return _united(n + len(codes), found())


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), ("codes", pa.binary())])
_FOUND_SQL = "a long, b long, shard long, part long, codes binary"


def _search(batches) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (shard, code): links (a, b) within shards, and packed parts of shards that may go on elsewhere.

    The first and the last shard of a range may have begun before it or go on after it.
    """
    out = Buffer(_FOUND)
    shards, codes = np.empty(0, np.int64), np.empty(0, np.int64)
    opened = None  # the shard that parts went out of: the range's first, or one that was cut

    def links(shard, code):
        """Of whole shards."""
        same = shard[1:] == shard[:-1]
        met = np.append(same, False) | np.append(False, same)
        shard, code = shard[met], code[met].view(np.uint64)
        if len(shard):
            label = linked_within(code, shard)
            for i in np.nonzero(label != np.arange(len(label)))[0].tolist():
                a, b = int(code[label[i]].view(np.int64)), int(code[i].view(np.int64))
                yield from out.add((min(a, b), max(a, b), None, None, None))

    def part(shard, code):
        """A part's links are its own task's work; only what may link with other parts goes on."""
        yield from links(np.full(len(code), shard), code)
        yield from out.add((None, None, int(shard), int(code[0]), code.tobytes()), code.nbytes)

    def taken(upto: int, shard, code):
        """Rows before ``upto``: the opened shard as parts, the others whole."""
        own = int(np.searchsorted(shard, opened, side="right"))
        for at in range(0, min(own, upto), TREE):
            yield from part(opened, code[at : min(own, upto, at + TREE)])
        if own < upto:
            yield from links(shard[own:upto], code[own:upto])

    for batch in batches:
        if not batch.num_rows:
            continue
        shards = np.concatenate([shards, numbers(batch, "shard")])
        codes = np.concatenate([codes, numbers(batch, "code")])
        if len(shards) < 8 * TREE:
            continue
        opened = int(shards[0]) if opened is None else opened
        last = int(np.searchsorted(shards, shards[-1], side="left"))  # the last shard may go on in the next batch
        if len(shards) - last >= TREE:
            yield from taken(last, shards, codes)
            opened = int(shards[-1])
            whole = last + (len(shards) - last) // TREE * TREE
            yield from taken(whole - last, shards[last:], codes[last:])
            last = whole
        else:
            yield from taken(last, shards, codes)
        shards, codes = shards[last:], codes[last:]
    if len(shards):
        opened = int(shards[0]) if opened is None else opened
        last = int(np.searchsorted(shards, shards[-1], side="left"))
        yield from taken(last, shards, codes)
        opened = int(shards[-1])
        yield from taken(len(shards) - last, shards[last:], codes[last:])
    yield from out.flush()


def _cross(batches) -> Iterator[pa.RecordBatch]:
    """Rows of (tree's part, asked part) of one shard: links across them."""
    out = Buffer(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        own, trees = None, None
        for left, right in zip(column(batch, "tree"), column(batch, "codes")):
            if left != own:
                own = left
                nodes = np.frombuffer(left, np.uint64)
                trees = Trees(nodes, np.zeros(len(nodes), np.int64))
            asked = np.frombuffer(right, np.uint64)
            label = linked_across(trees, asked)
            both = np.concatenate([nodes, asked]).view(np.int64)
            for i in np.nonzero(label != np.arange(len(label)))[0].tolist():
                a, b = int(both[label[i]]), int(both[i])
                yield from out.add((min(a, b), max(a, b)))
    yield from out.flush()


def _across(parts: DataFrame) -> DataFrame:
    """Links between parts of one shard: each part's tree goes to every part of the shard that stands after it."""
    lists = parts.groupBy("shard").agg(F.collect_set("part").alias("all")).filter(F.size("all") > 1)
    cells = parts.join(lists, "shard").select("shard", "part", "codes", F.explode("all").alias("other")).filter("part <> other")
    cells = cells.withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
    tree = cells.filter("part = left").select("shard", "left", "right", F.col("codes").alias("tree"))
    asked = cells.filter("part = right").select("shard", "left", "right", "codes")
    met = tree.join(asked, ["shard", "left", "right"]).select("tree", "codes")
    return in_arrow(met, _cross, "a long, b long")


def code_links(codes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``code``) that join all that differ in at most RADIUS bits, and only them.

    Not all pairs: in each shard a forest that spans them. Null codes link nothing.
    """
    pairs = list(combinations(range(BLOCKS), 2))
    shards = F.explode(F.array(*(_shard(i, pair) for i, pair in enumerate(pairs)))).alias("shard")
    keyed = codes.filter("code IS NOT NULL").select("code").distinct().select(shards, "code")
    ranged = keyed.repartitionByRange("shard", "code").sortWithinPartitions("shard", "code")
    found = materialise(in_arrow(ranged, _search, _FOUND_SQL), "shard-links")
    own = found.filter("a IS NOT NULL").select("a", "b")
    parts = found.filter("shard IS NOT NULL").select("shard", "part", "codes")
    return own.unionByName(_across(parts)).distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of ``docs``.

    ``component_id`` is the least doc_id that links reach. Equal fingerprints link, that of null, empty and wordless texts
    (zero) like any other, so repeated rows and copies are together. Rows without doc_id have a fingerprint and link
    others, but are no component's least. Texts of any length are read whole, 32,768 shingles at a time. An empty table
    gives no rows; other columns play no part.
    """
    held = materialise(fingerprints(docs), "fingerprints")
    codes = materialise(held.groupBy("code").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    comps = components(code_links(codes))
    rooted = codes.join(comps, F.col("code") == F.col("node"), "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    rooted = materialise(rooted, "rooted-fingerprints")
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = materialise(rooted.join(first, "root").select(F.col("code").alias("_code"), "component_id"), "fingerprint-components")
    out = held.join(of_code, F.col("code") == F.col("_code"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without documents that reach one with a smaller id. Rows that share an id stay together."""
    chosen = near_components(docs).filter("component_id = doc_id OR doc_id IS NULL").select(F.col("doc_id").alias("_chosen")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_chosen"]), "left_semi")
