"""Choose websites from a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import urls as U

# Bits of the filter made from a denylist, at least and at most: it goes into the plan, a megabyte at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 23
BITS_A_LABEL = 16
# Bits of one row of the bitmap that the aggregate makes.
_ROW = 1 << 15


def allowed_links(links: DataFrame, url: str = "url", denied: list[str] | None = None) -> DataFrame:
    """Links with a host none of whose labels is denied."""
    return links.filter(U.has_host(F.col(url)) & ~U.is_denied(F.col(url), denied))


def label_filter(denied: DataFrame) -> bytes:
    """A bitmap of the hashes of ``denied`` (label): sixteen bits a label, from 8 KB to 1 MB whatever the table's size.

    Beyond half a million labels it lets more and more through; what it stops is never in the table.
    """
    labels = denied.select("label").dropna().distinct()
    bits = LEAST_BITS
    count = labels.count()
    while bits < MOST_BITS and bits < BITS_A_LABEL * count:
        bits *= 2
    cell = F.pmod(F.xxhash64("label"), F.lit(bits)) + 1
    rows = labels.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("held")
    )
    whole = bytearray(bits // 8)
    for row in rows.collect():  # at most bits / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * _ROW // 8
        whole[at : at + _ROW // 8] = row["held"][: _ROW // 8]
    return bytes(whole)


def _may_hold(filter_bits: bytes, label: Column) -> Column:
    cell = F.pmod(F.xxhash64(label), F.lit(8 * len(filter_bits)))
    byte = F.conv(F.hex(F.substring(F.lit(filter_bits), F.shiftright(cell, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (cell % 8).cast("int")) % 2 == 1


def allowed_links_by_table(links: DataFrame, denied: DataFrame, url: str = "url") -> DataFrame:
    """Links with a host none of whose labels is in ``denied`` (label), a table of any size.

    Most links are let through by the filter where they are read. Only the rest are shuffled: their distinct addresses
    meet the table exactly, then those found go out. Null addresses, and such without a host, are no links; null labels
    and repeated ones change nothing.
    """
    bits = label_filter(denied)
    hosted = links.filter(U.has_host(F.col(url)))
    doubtful = F.exists(U.host_labels(F.col(url)), lambda label: _may_hold(bits, label))
    doubted = hosted.filter(doubtful)
    labels = doubted.select(F.col(url).alias("_bad")).distinct().select("_bad", F.explode(U.host_labels(F.col("_bad"))).alias("label"))
    bad = labels.join(denied.select("label").dropna(), "label", "left_semi").select("_bad").distinct()
    return hosted.filter(~doubtful).unionByName(doubted.join(bad, F.col(url) == F.col("_bad"), "left_anti"))


def root_links(links: DataFrame, url: str = "url") -> DataFrame:
    return links.filter(U.is_root_url(F.col(url)))


def first_links(links: DataFrame, key: str, url: str = "url", pos: str = "pos") -> DataFrame:
    """First link by position of every key; combined before the shuffle."""
    return links.groupBy(key).agg(F.min_by(url, pos).alias("website"))
