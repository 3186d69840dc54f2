"""Measures of many runs: counts, distinct phones and score quantiles by section, list and in total, out of mergeable sketches.

A day's run leaves one small row for each section, each list and the total. Rows of any days add up to the row that one run over
all of them would have left (distinct counts within their error), so a report over a year reads no listing again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed_values import PRINTED_ATTRIBUTES

LG_K = 14  # registers of a distinct count, as a power of two: an error of about 0.8 %
BINS = 1000  # of scores between 0 and 1: quantiles are right to a thousandth
LEVELS = ("section", "list", "total")
KEYS = ("level", "list_id", "section")
COUNTS = ("names", *PRINTED_ATTRIBUTES, "flagged", "scored")


def _binned(score: Column) -> Column:
    return F.least(F.floor(score * BINS), F.lit(BINS)).cast("int")


def _at_levels(rows: DataFrame) -> DataFrame:
    """Every row once for its section, its list and the total, as keys that tell a missing section from all of them."""
    total, blank = F.lit("total"), F.lit(None).cast("string")
    keys = (
        F.struct(F.lit("section").alias("level"), F.col("list_id"), F.col("section")),
        F.struct(F.lit("list").alias("level"), F.col("list_id"), blank.alias("section")),
        F.struct(total.alias("level"), blank.alias("list_id"), blank.alias("section")),
    )
    others = [c for c in rows.columns if c not in ("list_id", "section")]
    return rows.select(F.explode(F.array(*keys)).alias("key"), *others).select("key.*", *others)


def _with_bins(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """``rows`` with the counts of their bins, at most BINS + 1 of them, in order."""
    listed = bins.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEYS]
    met = rows.alias("l").join(listed.alias("r"), same[0] & same[1] & same[2], "left")
    none = F.array().cast("array<struct<bin:int,n:bigint>>")
    return met.select("l.*", F.coalesce("r.bins", none).alias("bins"))


def sketches(enriched: DataFrame) -> DataFrame:
    """A row for each section of each list, each list and the total: counts, a sketch of the distinct phones, binned scores.

    Rows are combined before they are shuffled, so the total is no large group. Null scores are in no bin and null phones
    in no sketch; listings without a section are a section of their own. No listings, no rows.
    """
    rows = _at_levels(enriched.select("list_id", "section", "needs_review", "score", *PRINTED_ATTRIBUTES))
    counted = rows.groupBy(*KEYS).agg(
        F.count("*").alias("names"),
        *[F.count(c).alias(f"n_{c}") for c in PRINTED_ATTRIBUTES],
        F.count_if("needs_review").alias("flagged"),
        F.count("score").alias("scored"),
        F.hll_sketch_agg("phone", LG_K).alias("phones"),
    )
    counted = counted.withColumnsRenamed({f"n_{c}": c for c in PRINTED_ATTRIBUTES})
    bins = rows.filter("score IS NOT NULL").groupBy(*KEYS, _binned(F.col("score")).alias("bin")).agg(F.count("*").alias("n"))
    return _with_bins(counted, bins)


def merged(days: DataFrame) -> DataFrame:
    """The sketches of several runs as those of one: counts and bins are equal, distinct phones within the sketch's error."""
    added = days.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.hll_union_agg("phones").alias("phones"))
    bins = days.select(*KEYS, F.inline("bins")).groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))
    return _with_bins(added, bins)


def quantile(bins: Column, share: float) -> Column:
    """The lower edge of the bin in which the given share of scores is reached; NULL without scores."""
    whole = F.aggregate(bins, F.lit(0).cast("bigint"), lambda sum_, b: sum_ + b["n"])
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bin"))

    def step(state: Column, b: Column) -> Column:
        seen = state["seen"] + b["n"]
        reached = state["bin"].isNull() & (seen >= F.greatest(F.ceil(whole * F.lit(share)), F.lit(1)))
        return F.struct(seen.alias("seen"), F.when(reached, b["bin"]).otherwise(state["bin"]).alias("bin"))

    return F.aggregate(bins, start, step, lambda state: state["bin"]) / BINS


def measured(sketched: DataFrame, *shares: float) -> DataFrame:
    """Sketches as figures: counts, about how many distinct phones, and quantiles of the score (``score_50`` for 0.5)."""
    quantiles = [quantile(F.col("bins"), share).alias(f"score_{round(100 * share)}") for share in shares]
    return sketched.select(*KEYS, *COUNTS, F.hll_sketch_estimate("phones").alias("distinct_phones"), *quantiles)
