"""Standardise an address column.

The work per address is a handful of array expressions, cheaper than the two shuffles of a
distinct-and-join-back, and a popular address weighs on no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.addresses import standard_address


def standardise_addresses(
    df: DataFrame, raw: str = "address_raw", directions: dict[str, str] | None = None
) -> DataFrame:
    """Add ``address`` and ``address_error`` (an address was given but could not be read).

    ``directions`` replaces the dictionary of direction words, e.g. to know English ones.
    """
    return df.withColumn("address", standard_address(F.col(raw), directions)).withColumn(
        "address_error", F.col(raw).isNotNull() & F.col("address").isNull()
    )
