"""Filter interaction audit: which of five filters removes what, in every order of the filters.

Four filters look at a document alone. The fifth (E) asks whether a smaller doc_id has the same text: a left-semi join on
the text's hash, the text itself and a smaller doc_id. Its ids are put together with those of the other failures, and only
counts of bit combinations go on: a filter order is then arithmetic on at most 32 counts a part.

Only documents whose hash stands at two doc_ids send their text to the join; a bitmap of fixed size tells which. What a text
meets there is one row, its least holder, so that a group of copies makes no pairs. Everything is DataFrame work.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.session import materialise

FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}

# Fixed values of the filters.
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITAL_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"

# Cells of the bitmap of repeated hashes: two megabytes, whatever the table's size.
CELLS = 1 << 24


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return docs.select("doc_id", part, F.xxhash64(_text()).alias("hash"), *more)


def own_failures() -> Column:
    """The bits of the filters that a text fails by itself."""
    words = F.array_remove(F.split(_text(), SPACES), "")
    capitals = F.length(F.regexp_replace(_text(), "[^A-Z]+", ""))
    fails = {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("long") > MOST_CAPITAL_PERCENT * F.length(_text()).cast("long"),
        "D": _text().rlike(SYMBOLS),
    }
    bits = [F.when(fail, BIT[letter]).otherwise(0) for letter, fail in fails.items()]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def _cell(value: Column) -> Column:
    return F.pmod(value, F.lit(CELLS)) + 1


def _in_bitmap(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` whose ``hash`` falls to a cell that ``hashes`` marks: all that are in it, and few others.

    The bitmap has CELLS bits and no more, so it may be sent to every task.
    """
    cells = hashes.select(_cell(F.col("hash")).alias("cell"))
    marked = cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")
    )
    at = F.bitmap_bit_position(_cell(F.col("hash")))
    asked = rows.withColumns({"bucket": F.bitmap_bucket_number(_cell(F.col("hash"))), "at": at})
    byte = F.expr("CAST(conv(hex(substring(bits, CAST(at DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    held = asked.join(F.broadcast(marked), "bucket").filter(F.call_function("shiftright", byte, F.expr("CAST(at % 8 AS INT)")) % 2 == 1)
    return held.drop("bucket", "bits", "at")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of documents whose text a smaller doc_id has; a row for each such row of ``docs``."""
    holders = _keyed(docs).filter("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    repeated = materialise(holders.filter("low < high").select("hash"), "repeated-hashes")
    # Written, since the optimizer would move the join below the bitmap and send all texts to it.
    asked = materialise(_in_bitmap(_keyed(docs.filter("doc_id IS NOT NULL"), _text().alias("body")), repeated), "asked-texts")
    first = asked.groupBy("hash", "body").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    first = materialise(first.filter("first_doc < last_doc").select("hash", "body", "first_doc"), "first-holders")
    first = first.select(F.col("hash").alias("_hash"), F.col("body").alias("_body"), "first_doc")
    same = (F.col("hash") == F.col("_hash")) & (F.col("body") == F.col("_body")) & (F.col("doc_id") > F.col("first_doc"))
    return asked.join(first, same, "left_semi").select("doc_id", "part", "hash")


def _labelled(failing: DataFrame, labels: DataFrame) -> DataFrame:
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    return failing.join(flags, F.col("doc_id") == F.col("_doc"), "left").fillna(0, ["good", "toxic"])


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): how many documents of a part fail just the filters of ``mask``.

    The row with mask 0 has all documents of the part, failing or not.
    """
    # Rows that share id, part and text fail alike: each side counts them.
    own = _keyed(docs, own_failures().alias("bits")).filter("bits > 0").select("*", F.lit(1).alias("own"), F.lit(0).alias("copy"))
    same = copies(docs).select("*", F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("own"), F.lit(1).alias("copy"))
    failing = own.unionByName(same).groupBy("doc_id", "part", "hash").agg(
        F.bit_or("bits").alias("mask"), F.greatest(F.sum("own"), F.sum("copy")).alias("n")
    )
    counted = _labelled(materialise(failing, "failures"), labels).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic")
    )
    zero = F.lit(0).cast("long")
    whole = _keyed(docs).groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(0).alias("mask"), "n", zero.alias("n_good"), zero.alias("n_toxic"))
    return counted.unionByName(whole)


def _steps(combos: DataFrame) -> DataFrame:
    """Each combination at each step of each order: the step's own bit and the bits of the filters before it."""
    orders = F.array(*(F.lit("".join(order)) for order in permutations(FILTERS)))
    stepped = combos.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {letter: F.instr("filter_order", letter) for letter in FILTERS}
    before = sum((F.when(place[letter] < F.col("step"), bit).otherwise(0) for letter, bit in BIT.items()), F.lit(0))
    here = sum((F.when(place[letter] == F.col("step"), bit).otherwise(0) for letter, bit in BIT.items()), F.lit(0))
    return stepped.withColumns({"before": before, "here": here})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step: what is kept, removed here, redundant, failing this filter
    alone, which removed ones are good or toxic, and the filter's removals over all orders (120 times its Shapley value).

    Documents are rows. Null texts and langs are empty. A row without doc_id is never a copy, nor is anything a copy of it,
    and it has no label; rows that share a doc_id are no copies of each other. A document is good (toxic) if any of its label
    rows has quality (toxic) 1; null labels say nothing. Texts of any length are counted whole, each within one row's work.
    No documents, no rows; no labels, zeros. Other columns of either table are not looked at.
    """
    steps = _steps(combinations(docs, labels))
    fails, gone = F.expr("mask & here <> 0"), F.expr("mask & before <> 0")
    removed = fails & ~gone

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    share = F.expr("n * (120 DIV bit_count(mask))")
    return steps.groupBy("part", "filter_order", "step").agg(
        (total(F.col("mask") == 0) - total(fails | gone)).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("here")).alias("unique_fails"),
        total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )
