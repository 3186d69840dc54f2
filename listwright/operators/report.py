"""Reports and measures over enriched listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.fixed_values import PRINTED_ATTRIBUTES, RTF_CLOSE, RTF_HEADER
from listwright.functions.rtf import listing_block
from listwright.operators.matching import needs_review, score_pairs

HEADER_LINE = -1
CLOSING_LINE = (1 << 63) - 1
PART_LINES = 1_000


def attributes_long(enriched: DataFrame) -> DataFrame:
    """(list_id, line_no, ordinal, attribute, value) of the printed attributes, filled ones only."""
    printed = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(name).alias("attribute"), F.col(name).alias("value")
            )
            for i, name in enumerate(PRINTED_ATTRIBUTES)
        ]
    )
    return enriched.select("list_id", "line_no", F.inline(printed)).filter("value is not null")


def report_blocks(enriched: DataFrame) -> DataFrame:
    """(list_id, line_no, block)"""
    block = listing_block(F.col("search_name"), F.col("found_name"), F.col("needs_review"))
    return enriched.select("list_id", "line_no", block.alias("block"))


def document_rows(blocks: DataFrame) -> DataFrame:
    """(list_id, line_no, text): the blocks with a header and a closing row per list."""
    lists = blocks.select("list_id").distinct()
    frame = F.array(
        F.struct(F.lit(HEADER_LINE).cast("bigint").alias("line_no"), F.lit(RTF_HEADER).alias("text")),
        F.struct(F.lit(CLOSING_LINE).cast("bigint").alias("line_no"), F.lit(RTF_CLOSE).alias("text")),
    )
    return blocks.select("list_id", "line_no", F.col("block").alias("text")).unionByName(
        lists.select("list_id", F.inline(frame))
    )


def document_parts(rows: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """(list_id, part_no, text): the document in parts of bounded length; header and close
    are parts of their own. The parts in order are the document."""
    part = F.when(F.col("line_no") < 0, -1).otherwise(F.expr(f"line_no div {part_lines}"))
    text = F.expr("listagg(text, '') within group (order by line_no)")
    return rows.groupBy("list_id", part.alias("part_no")).agg(text.alias("text"))


def profile_list_rows(names: DataFrame, profile: str) -> DataFrame:
    """(list_id, line_no, text): name, profile if any, blank line."""
    text = F.concat_ws("\n", "search_name", F.col(profile), F.lit("\n"))
    return names.select("list_id", "line_no", text.alias("text"))


def fill_rates(enriched: DataFrame) -> DataFrame:
    """Names, filled attributes, mean score and flagged names per list."""
    filled = [F.count(c).alias(c) for c in PRINTED_ATTRIBUTES]
    return enriched.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("names"),
        *filled,
        F.avg("score").alias("mean_score"),
        F.count_if("needs_review").alias("flagged"),
    )


def review_agreement(golden: DataFrame) -> DataFrame:
    """Agreement of the review flag with known ones (search_name, found_name, flagged)."""
    scored = score_pairs(golden, "search_name", "found_name")
    agrees = needs_review(F.col("score")) == F.col("flagged")
    return scored.agg(
        F.count(F.lit(1)).alias("names"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(agrees).alias("agreeing"),
    )
