"""Phones of pages and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.phones import phone_format, phones_all
from listwright.functions.text import trim_blanks


def source_phones(df: DataFrame, source_id: str, text: str) -> DataFrame:
    """(source_id, phone): every phone of every text, formatted."""
    found = df.select(F.col(source_id).alias("source_id"), F.explode(phones_all(F.col(text))).alias("raw"))
    return found.select("source_id", phone_format(trim_blanks(F.col("raw"))).alias("phone"))


def phone_counts(phones: DataFrame) -> DataFrame:
    """Mentions of every phone; counted before the shuffle, so a popular one is no burden."""
    return phones.groupBy("phone").agg(F.count(F.lit(1)).alias("mentions"))
