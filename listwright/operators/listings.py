"""From list lines to listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions.text import clean_name, is_header

CHUNK_LINES = 100_000


def clean_lines(lines: DataFrame) -> DataFrame:
    """Add ``search_name``: trimmed, '&' spelled out."""
    return lines.withColumn("search_name", clean_name(F.col("line")))


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("search_name") != "")


def drop_headers(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_header(F.col("search_name")))


def carry_forward(df: DataFrame, value: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Replace NULLs of ``value`` by the last one before, by ``list_id`` and ``line_no``.

    A list is filled chunk by chunk and only the last value of each chunk is carried on, so
    no task ever holds a whole list.
    """
    chunked = df.withColumn("_chunk", F.expr(f"line_no div {chunk_lines}"))
    carried = (
        chunked.groupBy("list_id", "_chunk")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line_no"))).alias("_last"))
        .withColumn(
            "_before",
            F.last("_last", ignorenulls=True).over(
                Window.partitionBy("list_id")
                .orderBy("_chunk")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("list_id", "_chunk", "_before")
    )
    inside = F.last(value, ignorenulls=True).over(
        Window.partitionBy("list_id", "_chunk").orderBy("line_no")
    )
    return (
        chunked.join(carried, ["list_id", "_chunk"])
        .withColumn(value, F.coalesce(inside, "_before"))
        .drop("_chunk", "_before")
    )


def listings(lines: DataFrame, sections: bool = True, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(list_id, line_no, section, search_name); blank and header lines are gone.

    ``section`` is the header a name stands under. Repeated names are kept.
    """
    named = drop_blank(clean_lines(lines))
    header = F.when(is_header(F.col("search_name")), F.regexp_replace("search_name", ":+$", ""))
    if sections:
        named = carry_forward(named.withColumn("section", header), "section", chunk_lines)
    else:
        named = named.withColumn("section", F.lit(None).cast("string"))
    return drop_headers(named).select("list_id", "line_no", "section", "search_name")
