"""List files: text, one name per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.functions.text import split_lines


def list_name(path: Column) -> Column:
    """Name of a list for display: its file name without extension. Lists may share it."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def decoded_path(path: Column) -> Column:
    """A file's path as the scan gives it, with its percent signs decoded: the key of a list."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def number_lines(lines: DataFrame) -> DataFrame:
    """(list_id, line_no, line) from lines of a text scan with ``path``, ``block``, ``line``.

    A line's number is the line count of the earlier blocks of its file plus its place in
    its own block. Only the per-block counts are brought together, so a file of any size is
    numbered by all tasks that read it.
    """
    placed = lines.withColumn("place", F.monotonically_increasing_id())
    blocks = placed.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("place").alias("first_place")
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.withColumn(
        "first_line", F.coalesce(F.sum("lines").over(earlier), F.lit(0))
    ).drop("lines")
    return placed.join(starts, ["path", "block"]).select(
        decoded_path(F.col("path")).alias("list_id"),
        (F.col("first_line") + F.col("place") - F.col("first_place")).alias("line_no"),
        "line",
    )


def scanned_lines(text: DataFrame, *more: Column) -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
        *more,
    )


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, line_no, line) of all list files under ``path``; line numbers from 0.
    ``list_id`` is the whole path, so files of one name in two folders, or with and without
    an extension, are lists of their own."""
    return number_lines(scanned_lines(spark.read.text(path)))


def lines_of_texts(texts: DataFrame, list_id: str, text: str) -> DataFrame:
    """(list_id, line_no, line) of a table that holds one list per row."""
    return texts.select(
        F.col(list_id).alias("list_id"),
        F.posexplode(split_lines(F.col(text))).alias("line_no", "line"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
