"""Exact similarity join of documents on word shingles, as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set and a column for each shingle. Two sets link
when 100 * overlap >= 75 * union, so the overlap is at least 75 % of either size and two linked sets share one
of their ``prefix`` columns, whatever order columns are put in. Columns are put from rare to common by a sketch of
counts, of fixed size, so that common columns fall out of nearly all prefixes.

1. ``_sets``: a row per document (size, hash and parity bitmap of its set) and the sketch.
2. ``_incidence``: prefix entries, dealt by column; ``_shared`` streams each column and keeps those with two sets.
3. Each set in a column is first paired with the column's smallest set of like size, not with all (a star).
4. Size bounds on overlaps discard pairs: the parity bitmaps of two sets, whose width follows the size, differ in at
   most as many bits as the sets differ in members, which loses no pair. The rest is counted exactly.
5. Sets that a star put in one component need no more pairs. For the others, columns are cut into blocks, blocks are
   multiplied (bitmap against bitmap), and the best pairs between components are counted exactly, until no pair that
   the bounds let through is left between two components. So no group emits all its pairs, and no link
   between components is lost.

Those are the components. ``links`` is the join itself: blocked products of the whole incidence add up the overlap of each
pair of sets, and the size bounds discard. Its result has all pairs of a group, so components are not made from it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, WordHashes, bitmap, column, in_arrow, in_bitmap, numbers, record_batch, texts, window_hashes, words_of
from listwright.llm.components import components
from listwright.session import materialise

WIDTH = 5
PERCENT = 75
SKETCH_BITS = 20
LEAST_PARITY_BITS = 512
PARTS = 16
BLOCK = 1024
PART = 256

_U = np.uint64


def shingles(body: bytes, hashes: WordHashes) -> np.ndarray:
    """The document's set as sorted 64-bit hashes. Only A-Z is lower-cased."""
    return np.unique(window_hashes(hashes.of(words_of(body.lower())), WIDTH))


def set_hash(members: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes()))))


def parity(members: np.ndarray) -> bytes:
    """Bit i: whether an odd number of members falls to i.

    There are eight bits a member at least, four in sets of over a thousand, a power of two in all; so the width grows
    with the size, and sets that may link have the same width or one twice the other's.
    """
    n = len(members)
    bits = max(LEAST_PARITY_BITS, 1 << ((8 if n <= 1024 else 4) * n - 1).bit_length())
    at = (members & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def folded(rows: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes, or two or four times that, as those of ``size`` bytes of the same sets."""
    out = np.empty((len(rows), size // 8), np.uint64)
    for i, row in enumerate(rows):
        whole = np.frombuffer(row, np.uint64).reshape(-1, size // 8)
        out[i] = whole[0] if len(whole) == 1 else np.bitwise_xor.reduce(whole, axis=0)
    return out


def least_overlap(n, m):
    """The smallest overlap at which sets of n and m members link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _differ(n, m):
    """The most members in one set only, at which sets of n and m members link."""
    return n + m - 2 * least_overlap(n, m)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
_SETS_SQL = "doc_id long, n long, set_id long, part int, counts binary"


def _cells(members: np.ndarray) -> np.ndarray:
    return (members >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _sets(batches) -> Iterator[pa.RecordBatch]:
    """A row a document, then this task's column counts in PARTS rows."""
    hashes, out = WordHashes(), Buffer(_SETS)
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        gathered, held = [], 0
        for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
            members = shingles(body, hashes)
            n = len(members)
            yield from out.add((doc_id, n, set_hash(members) if n else None, None, None))
            gathered.append(members)
            held += n
            if held > 500_000:
                counts += np.bincount(_cells(np.concatenate(gathered)), minlength=len(counts)).astype(np.uint32)
                gathered, held = [], 0
        if gathered:
            counts += np.bincount(_cells(np.concatenate(gathered)), minlength=len(counts)).astype(np.uint32)
    if counts.any():
        for part, some in enumerate(np.split(counts, PARTS)):
            packed = zlib.compress(some.tobytes(), 1)
            yield from out.add((None, None, None, part, packed), len(packed))
    yield from out.flush()


def _sum_counts(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(column(batch, "part"), column(batch, "counts")):
            some = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
            sums[part] = sums[part] + some if part in sums else some
    for part, some in sums.items():
        yield record_batch(schema, [part], [some.tobytes()])


def _ranks(sets: DataFrame) -> np.ndarray:
    """How common each sketch cell is, on a log scale, a byte each; fixed size, so it may pass the driver."""
    sums = in_arrow(
        sets.filter("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part"), _sum_counts, "part int, counts binary"
    ).collect()
    counts = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint64)
    for row in sums:
        counts[row["part"]] += np.frombuffer(row["counts"], np.uint64)
    return np.minimum(8 * np.log2(counts.reshape(-1) + 1.0), 255).astype(np.uint8)


_ENTRIES = pa.schema([("shingle", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64())])


def _incidence(ranks: np.ndarray | None):
    """Entries of each set's prefix; without ``ranks``, of the whole set."""

    def entries(batches) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            columns, ids, sizes = [], [], []
            for body in column(batch, "body"):
                members = shingles(body, hashes)
                n = len(members)
                key = set_hash(members)
                if not n or (n, key) in seen:  # copies within a task go in once
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add((n, key))
                prefix = n - (-(-PERCENT * n // 100)) + 1
                if ranks is not None and prefix < n:
                    rank = ranks[_cells(members)]
                    order = np.lexsort((members, rank))[:prefix]
                    members = members[order]
                columns.append(members)
                ids.append(key)
                sizes.append(n)
            if columns:
                lengths = [len(c) for c in columns]
                all_columns = np.concatenate(columns).view(np.int64)
                all_ids, all_sizes = np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
                for at in range(0, len(all_columns), 100_000):
                    yield record_batch(_ENTRIES, *(x[at : at + 100_000] for x in (all_columns, all_ids, all_sizes)))

    return entries


_SHARED = pa.schema([*_ENTRIES, ("lead", pa.int64()), ("lead_n", pa.int64())])


def _shared(batches) -> Iterator[pa.RecordBatch]:
    """Stream columns sorted by (shingle, n, set_id): entries of columns with two sets, each with its star's centre.

    The centre is the first set of the column, and again the first one too large to link with the centre before.
    """
    last = lead = None  # the latest distinct entry and whether it went out; its star's centre
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, set_id, n = (numbers(batch, name) for name in ("shingle", "set_id", "n"))
        same = shingle[1:] == shingle[:-1]
        # Most entries have no neighbour of their column; only the others are looked at one by one.
        met = np.append(same, True)
        met[1:] |= same
        met[0] |= last is not None and last[0] == shingle[0]
        out = Buffer(_SHARED, 1 << 30)
        for i in np.nonzero(met)[0].tolist():
            entry = (int(shingle[i]), int(set_id[i]), int(n[i]))
            if last is None or last[0] != entry[0]:
                lead, last = entry, (*entry, False)
            elif last[1] != entry[1]:
                if not last[3]:
                    out.rows.append((*last[:3], *lead[1:]))
                if 100 * lead[2] < PERCENT * entry[2]:
                    lead = entry
                out.rows.append((*entry, *lead[1:]))
                last = (*entry, True)
        yield from out.flush()


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b), those that the bitmaps let through, and how far apart they are at least."""
    one = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p_a"))
    two = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("p_b"))

    def passing(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.float64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (numbers(batch, name) for name in ("a", "b", "n_a", "n_b"))
            p_a, p_b = column(batch, "p_a"), column(batch, "p_b")
            size = np.array([min(len(x), len(y)) for x, y in zip(p_a, p_b)])
            apart = np.empty(len(a), np.int64)
            for width in np.unique(size).tolist():
                some = np.nonzero(size == width)[0]
                x, y = (folded([p[i] for i in some], width) for p in (p_a, p_b))
                apart[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = apart <= _differ(n_a, n_b)
            yield record_batch(schema, a[ok], b[ok], (apart / (n_a + n_b))[ok])

    return in_arrow(pairs.join(one, "a").join(two, "b"), passing, "a long, b long, apart double")


_MEMBERS = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("members", pa.binary())])


def _members(packed: bytes, as_parity: bool = False):
    """The sets, or their parity bitmaps, of documents that may be asked for."""

    def members(batches) -> Iterator[pa.RecordBatch]:
        hashes, out, has = WordHashes(), Buffer(_MEMBERS), in_bitmap(packed)
        for batch in batches:
            for at in np.nonzero(has(numbers(batch, "hash")))[0].tolist() if batch.num_rows else ():
                row = batch.slice(at, 1)
                found = shingles(column(row, "body")[0], hashes)
                if len(found):
                    held = parity(found) if as_parity else found.tobytes()
                    yield from out.add((column(row, "doc_id")[0], set_hash(found), held), len(held))
        yield from out.flush()

    return members


def _overlaps(batches) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (centre, part, role): a centre's own set comes before those it is to be compared with."""
    out, centre, own = Buffer(pa.schema([("a", pa.int64()), ("b", pa.int64())])), None, None
    for batch in batches:
        for a, role, b, members in zip(*(column(batch, name) for name in ("centre", "role", "set_id", "members"))):
            other = np.frombuffer(members, np.uint64)
            if role == 0:
                centre, own = a, other
            elif centre == a:
                overlap = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * overlap >= PERCENT * (len(own) + len(other) - overlap):
                    yield from out.add((a, b))
    yield from out.flush()


def _asked_for(docs: DataFrame, asked: DataFrame, holder: str, as_parity: bool = False) -> DataFrame:
    """(doc_id, set_id, members) of the documents that stand in a column of ``asked`` and of few others: not of all texts."""
    likely = bitmap(asked.select(F.xxhash64(holder)))
    bodies = texts(docs, F.xxhash64("doc_id").alias("hash"))
    return in_arrow(bodies, _members(likely, as_parity), "doc_id long, set_id long, members binary")


def _with_parity(docs: DataFrame, sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(set_id, n, doc_id, parity) of the sets that stand in a shared column; the others never need a bitmap."""
    met = materialise(sets.join(shared.select("set_id").distinct(), "set_id"), "sets-that-meet")
    made = _asked_for(docs, met, "doc_id", as_parity=True).withColumnRenamed("members", "parity").dropDuplicates(["doc_id", "set_id"])
    return materialise(met.join(made, ["doc_id", "set_id"]).select("set_id", "n", "doc_id", "parity"), "set-bitmaps")


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of (a, b), the pairs whose overlap, counted exactly, links them.

    Each b is sent to its a; a centre with many is sent to several parts, so none gathers in one task. Where rows share an id
    a pair may come out again.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    others = pairs.join(parts, "a").select(
        F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("wanted")
    )
    centres = parts.select(
        F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("wanted")
    )
    asked = others.unionByName(centres).join(sets.select(F.col("set_id").alias("wanted"), F.col("doc_id").alias("holder")), "wanted")
    asked = materialise(asked, "asked")
    members = _asked_for(docs, asked, "holder")
    same = (F.col("doc_id") == F.col("holder")) & (F.col("set_id") == F.col("wanted"))
    sent = members.join(asked, same).select("centre", "part", "role", "set_id", "members")
    sent = sent.repartition("centre", "part").sortWithinPartitions("centre", "part", "role")
    return in_arrow(sent, _overlaps, "a long, b long")


_BEST = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.int64())])


def _multiply(most: int):
    """Blocks of a column: the ``most`` nearest pairs between any two components; ``more`` is the column, if there are others."""

    def product(shingle: int, rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r[2])
        comp, ids, n, block = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 4))
        sizes = np.array([len(r[3]) for r in rows])
        mixed = len(set(block.tolist())) > 1
        best: dict[tuple[int, int], list] = {}
        for size in np.unique(sizes).tolist():
            # Sets that link with one of this size and are not smaller have bitmaps of this size or twice it.
            own = np.nonzero((sizes == size) | (sizes == 2 * size))[0]
            bits = folded([rows[i][3] for i in own], size)
            n_own, comp_own, block_own, ids_own = n[own], comp[own], block[own], ids[own]
            ends = np.searchsorted(n_own, 100 * n_own // PERCENT, side="right")
            for i in range(int((sizes[own] == size).sum())):
                rest = slice(i + 1, int(ends[i]))
                ok = comp_own[rest] != comp_own[i]
                if mixed:  # two blocks: only pairs across them; each block has a product of its own
                    ok &= block_own[rest] != block_own[i]
                at = np.nonzero(ok)[0] + i + 1
                if not len(at):
                    continue
                slack = _differ(n_own[i], n_own[at]) - np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
                for j, s in zip(at[slack >= 0].tolist(), slack[slack >= 0].tolist()):
                    key = (min(comp_own[i], comp_own[j]), max(comp_own[i], comp_own[j]))
                    found = best.setdefault(key, [])
                    found.append((-s / (n_own[i] + n_own[j]), min(ids_own[i], ids_own[j]), max(ids_own[i], ids_own[j])))
                    if len(found) > 4 * most + 64:
                        found.sort()
                        found[most + 1 :] = []
        for found in best.values():
            found.sort()
            for at, (_, a, b) in enumerate(found[:most]):
                yield int(a), int(b), shingle if at == 0 and len(found) > most else None

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        out, key, rows = Buffer(_BEST), None, []
        names = ("comp", "set_id", "n", "parity", "block")
        for batch in batches:
            for group in zip(*(column(batch, name) for name in ("shingle", "left", "right", *names))):
                if group[:3] != key:
                    for pair in product(key[0], rows) if len(rows) > 1 else ():
                        yield from out.add(pair)
                    key, rows = group[:3], []
                rows.append(group[3:])
        for pair in product(key[0], rows) if len(rows) > 1 else ():
            yield from out.add(pair)
        yield from out.flush()

    return blocks


def _across(shared: DataFrame, sets: DataFrame, comps: DataFrame, most: int) -> DataFrame:
    """(a, b, more): near pairs between components within columns of three or more sets."""
    placed = shared.join(comps, F.col("set_id") == F.col("node"), "left").select(
        "shingle", "set_id", F.coalesce("root", "set_id").alias("comp")
    )
    lists = (
        placed.groupBy("shingle")
        .agg(
            F.count("*").alias("size"),
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.bit_xor(F.xxhash64("set_id")).alias("x"),
            F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"),
        )
        .filter("size > 2 AND low < high")
        .groupBy("size", "x", "y")  # columns with the same sets need one product
        .agg(F.min("shingle").alias("shingle"))
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .select("shingle", "blocks")
    )
    block = F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("block")
    cut = placed.join(lists, "shingle").select("shingle", "set_id", "comp", "blocks", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = cut.select("shingle", "set_id", "comp", "block", other).select(
        "shingle", "set_id", "comp", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    )
    cut = cut.join(sets.select("set_id", "n", "parity"), "set_id")
    cut = cut.repartition("shingle", "left", "right").sortWithinPartitions("shingle", "left", "right", "set_id")
    return in_arrow(cut, _multiply(most), "a long, b long, more long")


def _roots(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the roots of both ends; a set without links is its own."""
    for end in ("a", "b"):
        of_end = comps.select(F.col("node").alias(end), F.col("root").alias("found"))
        pairs = pairs.join(of_end, end, "left").withColumn(f"root_{end}", F.coalesce("found", end)).drop("found")
    return pairs


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their set, and the components of sets.

    (doc_id, n, set_id) has a row per row of ``docs``; set_id is null where the set is empty. (node, root) holds
    the sets that some link reaches. A set is known by its size and a 64-bit hash.
    """
    docs = docs.select("doc_id", "text")
    found = materialise(in_arrow(texts(docs), _sets, _SETS_SQL), "shingle-sets")
    placed = found.filter("part IS NULL").select("doc_id", "n", "set_id")
    ranks = _ranks(found)
    sets = materialise(
        placed.filter("n > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id", "n")
        .agg(F.min("doc_id").alias("doc_id")),
        "distinct-sets",
    )
    entries = in_arrow(texts(docs.filter("doc_id IS NOT NULL")), _incidence(ranks), "shingle long, set_id long, n long")
    entries = entries.repartition("shingle").sortWithinPartitions("shingle", "n", "set_id")
    shared = materialise(in_arrow(entries, _shared, "shingle long, set_id long, n long, lead long, lead_n long"), "shared-columns")
    sets = _with_parity(docs, sets, shared)
    stars = shared.filter("lead <> set_id").select(F.col("lead").alias("a"), F.col("set_id").alias("b")).distinct()
    stars = materialise(_near(stars, sets), "near-stars")
    # First each set with its nearest centre; then the pairs of stars that this leaves in two components.
    first = stars.groupBy("b").agg(F.min(F.struct("apart", "a"))["a"].alias("a")).select("a", "b")
    links = materialise(_links(docs, sets, first), "links")
    comps = components(links)
    apart = _roots(stars.select("a", "b"), comps).filter("root_a <> root_b").select("a", "b")
    apart = materialise(apart.join(first, ["a", "b"], "left_anti"), "stars-apart")
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not apart.isEmpty():
        links = links.unionByName(materialise(_links(docs, sets, apart), "links"))
        comps = components(links)
    most, columns = 4, shared
    while True:
        best = materialise(_across(columns, sets, comps, most), "best-pairs")
        new = materialise(best.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "new-pairs")
        if not new.isEmpty():
            links = links.unionByName(materialise(_links(docs, sets, new), "links"))
            tested = tested.unionByName(new)
            comps = components(links)
        # A column all of whose near pairs went out is done: components only grow.
        more = materialise(best.select(F.col("more").alias("shingle")).dropna().distinct(), "columns-left")
        if more.isEmpty():
            break
        columns, most = shared.join(more, "shingle"), 16 * most
    return placed, comps


_PRODUCT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64()), ("both", pa.int64())])


def _add_up(batches) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (shingle, left, right, n): pairs of a block whose sizes let them link, with the columns they stand for."""

    def product(mixed: bool, rows: list[tuple]) -> Iterator[tuple]:
        ids, n, block = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        ends = np.searchsorted(n, 100 * n // PERCENT, side="right")
        for i in range(len(rows)):
            at = np.arange(i + 1, int(ends[i]))
            if mixed:  # pairs of one block are in that block's own product
                at = at[block[at] != block[i]]
            if len(at):
                low, high = np.minimum(ids[at], ids[i]), np.maximum(ids[at], ids[i])
                yield low, high, np.full(len(at), rows[0][3]), n[at] + n[i]

    def flushed(parts):
        return record_batch(_PRODUCT, *(np.concatenate(of) for of in zip(*parts)))

    def groups():
        key, rows = None, []
        names = ("shingle", "left", "right", "set_id", "n", "block", "weight")
        for batch in batches:
            for row in zip(*(column(batch, name) for name in names)):
                if row[:3] != key:
                    yield key, rows
                    key, rows = row[:3], []
                rows.append(row[3:])
        yield key, rows

    parts, held = [], 0
    for key, rows in groups():
        for part in product(key[1] != key[2], rows) if len(rows) > 1 else ():
            parts.append(part)
            held += len(part[0])
            if held >= 50_000:
                yield flushed(parts)
                parts, held = [], 0
    if parts:
        yield flushed(parts)


def links(docs: DataFrame) -> DataFrame:
    """(a, b, overlap, n_a_and_b): all pairs of distinct sets that link, a < b, with their overlap and the sum of their sizes.

    A row for each pair: a group of k near copies has up to k * (k - 1) / 2. Columns that hold the same sets go through one
    product, counted as often as there are such columns; long columns are cut into blocks.
    """
    entries = in_arrow(texts(docs.filter("doc_id IS NOT NULL")), _incidence(None), "shingle long, set_id long, n long")
    entries = entries.repartition("shingle").sortWithinPartitions("shingle", "n", "set_id")
    shared = in_arrow(entries, _shared, "shingle long, set_id long, n long, lead long, lead_n long").drop("lead", "lead_n")
    shared = materialise(shared, "whole-columns")
    lists = (
        shared.groupBy("shingle")
        .agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"))
        .groupBy("size", "x", "y")
        .agg(F.min("shingle").alias("shingle"), F.count("*").alias("weight"))
        .select("shingle", "weight", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("block")
    cut = shared.join(lists, "shingle").select("shingle", "set_id", "n", "weight", "blocks", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = cut.select("*", other).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    cut = cut.repartition("shingle", "left", "right").sortWithinPartitions("shingle", "left", "right", "n", "set_id")
    pairs = in_arrow(cut, _add_up, "a long, b long, overlap long, both long")
    summed = pairs.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("both").alias("n_a_and_b"))
    return summed.filter(100 * F.col("overlap") >= PERCENT * (F.col("n_a_and_b") - F.col("overlap")))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id): which documents have which set. Rows without an id or with an empty set are in none."""
    found = in_arrow(texts(docs.filter("doc_id IS NOT NULL").select("doc_id", "text")), _sets, _SETS_SQL)
    return found.filter("part IS NULL AND n > 0").select("doc_id", "set_id").distinct()


def link_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n_links): how many other documents each one links with; those with an equal set are among them."""
    held = materialise(members(docs), "members")
    copies = held.groupBy("set_id").agg(F.count("*").alias("copies"))
    pairs = materialise(links(docs).select("a", "b"), "all-links")
    both = pairs.union(pairs.select("b", "a")).toDF("set_id", "other")
    far = both.join(copies.toDF("other", "linked"), "other").groupBy("set_id").agg(F.sum("linked").alias("linked"))
    counted = copies.join(far, "set_id", "left")
    n_links = (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    return held.join(counted, "set_id").select("doc_id", "set_id", n_links)


def document_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``.

    A set is the distinct five-word shingles of the text, A-Z lower-cased; of fewer words, the whole sequence.
    Null or empty texts and such without words have an empty set and are linked with nothing: component_id is
    doc_id. Equal sets are linked. Rows without an id link nothing and have no component_id.
    """
    placed, comps = similar_sets(docs)
    placed = placed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("set_id")))
    least = (
        placed.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"))
        .join(comps, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = materialise(least, "set-least")
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = least.join(roots, "root").select(F.col("node").alias("_node"), "component_id")
    out = placed.join(of_set, F.col("node") == F.col("_node"), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without documents that reach one with a smaller id. Rows that share an id stay together."""
    chosen = document_components(docs).filter("component_id = doc_id OR doc_id IS NULL").select("doc_id").distinct()
    chosen = chosen.withColumnRenamed("doc_id", "_chosen")
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_chosen"]), "left_semi")
