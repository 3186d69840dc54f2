"""List files and a page table in, enriched listings and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listwright.fixed_values import PROFILE_LIST_SUFFIX, REPORT_SUFFIX
from listwright.operators.facts import lookup_facts, page_facts
from listwright.operators.listings import listings
from listwright.operators.merge import enrich
from listwright.operators.report import document_rows, fill_rates, profile_list_rows, report_blocks
from listwright.session import materialise
from listwright.sources.lists import read_lists
from listwright.sources.pages import read_pages
from listwright.sources.reports import write_named_documents


def enrich_lists(
    spark: SparkSession, list_path: str, pages_path: str, profile_above: float | None = None, both_sides: bool = False
) -> DataFrame:
    """Enriched rows of all lists under ``list_path``; for the options see :func:`listwright.operators.merge.enrich`.

    The facts are written once: five lookups read them, the HTML is read a single time.
    """
    facts = materialise(lookup_facts(page_facts(read_pages(spark, pages_path))), "page-facts", "source")
    return enrich(listings(read_lists(spark, list_path)), facts, profile_above, both_sides)


def report_lists(spark: SparkSession, list_path: str, pages_path: str, out: str) -> DataFrame:
    """Write enriched rows, reports and profile lists under ``out``; fill rates come back."""
    path = out.rstrip("/")
    enrich_lists(spark, list_path, pages_path).write.mode("overwrite").parquet(f"{path}/enriched")
    enriched = spark.read.parquet(f"{path}/enriched")
    write_named_documents(document_rows(report_blocks(enriched)), f"{path}/reports", REPORT_SUFFIX)
    write_named_documents(profile_list_rows(enriched, "twitter"), f"{path}/profiles", PROFILE_LIST_SUFFIX)
    return fill_rates(enriched)
