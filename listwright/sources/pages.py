"""Page snapshots: what stands in for fetching a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.schemas import PAGES


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def one_per_key(pages: DataFrame, *keys: str, order: str = "page_id") -> DataFrame:
    """First page of every key. Each task keeps one row per key before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(order)
    return (
        pages.dropna(subset=list(keys))
        .withColumn("_place", F.row_number().over(first))
        .filter("_place = 1")
        .drop("_place")
    )


def spread_key(needed: Column, key: Column, *row_id: str) -> Column:
    """Join key of rows that need a lookup; the others get keys of their own, which match
    nothing and keep them spread over all tasks."""
    own = F.concat_ws("\x1f", F.lit("\x1fnone"), *[F.col(c).cast("string") for c in row_id])
    return F.when(needed & key.isNotNull(), key).otherwise(own)


def look_up(rows: DataFrame, pages: DataFrame, key: str, prefix: str) -> DataFrame:
    """Left join of ``rows`` with ``pages``, a written table with one row per ``key``; rows
    without a page stay. The page columns come back with ``prefix``.

    Both sides are scans, so adaptive execution can split a key that many rows ask for.
    """
    renamed = pages.select(
        F.col(key), *[F.col(c).alias(prefix + c) for c in pages.columns if c != key]
    )
    return rows.join(renamed, key, "left")
