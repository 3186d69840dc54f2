"""Page versions: what a page said when it was asked for, from a table of crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_SECONDS = 86_400


def _span(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000))


def version_at(
    asked: DataFrame,
    versions: DataFrame,
    key: str,
    time: str,
    order: str,
    prefix: str = "found_",
    span_seconds: int = SPAN_SECONDS,
) -> DataFrame:
    """``asked`` with the columns of the latest version of its ``key`` that is not after its ``time``; NULL where none is.

    Both tables have ``key`` and ``time``. Of versions of one key and time the one with the greatest ``order`` counts. Rows of
    both tables meet in spans of time of a key, so that a page asked for or crawled very often is dealt to many
    tasks; only the last version of each span is carried on to later ones. Rows without key or time find nothing,
    versions without them are left out, repeated rows of ``asked`` stay.
    """
    kept = [c for c in versions.columns if c not in (key, time)]
    version = F.struct(F.col(time), *kept)
    dated = versions.dropna(subset=[key, time]).groupBy(key, time).agg(F.max_by(version, order).alias("_version"))
    dated = dated.select(F.col(key).alias("_key"), F.col(time).alias("_time"), "_version")
    rows = asked.withColumns({"_key": F.col(key), "_time": F.col(time)})
    whole = F.struct(*asked.columns)
    asks = rows.filter("_key IS NOT NULL AND _time IS NOT NULL").select("_key", "_time", whole.alias("_row"))
    both = asks.unionByName(dated, allowMissingColumns=True).withColumn("_span", _span(F.col("_time"), span_seconds))
    # At one time versions come first: they are not after it.
    in_span = Window.partitionBy("_key", "_span").orderBy("_time", F.col("_version").isNull())
    seen = both.withColumn("_own", F.last("_version", ignorenulls=True).over(in_span)).filter("_row IS NOT NULL")
    spans = both.groupBy("_key", "_span").agg(F.max_by("_version", F.when(F.col("_version").isNotNull(), F.col("_time"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select("_key", "_span", "_carried")
    met = seen.join(carried, ["_key", "_span"]).select("_row", F.coalesce("_own", "_carried").alias("_found"))
    without = rows.filter("_key IS NULL OR _time IS NULL").select(whole.alias("_row"), F.lit(None).cast(met.schema["_found"].dataType).alias("_found"))
    found = [F.col(f"_found.{c}").alias(prefix + c) for c in (time, *kept)]
    return met.unionByName(without).select("_row.*", *found)
