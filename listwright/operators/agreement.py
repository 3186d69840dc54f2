"""Agreement between sources: which value of an attribute is right, and how far each source can be trusted.

The merge's fixed order of trust takes the first source that says anything. Where many sources name a value for the same
attribute of the same listing, as with phones found on many pages, they can be compared: a value is as likely as the sources
that claim it are reliable, and a source is as reliable as its values are likely. Both are estimated in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import materialise, materialise_bucketed

ROUNDS = 5
KEY = ("listing", "attribute")


def _claims(claims: DataFrame) -> DataFrame:
    """Distinct claims, written in buckets by attribute of a listing; a null or empty value claims nothing.

    They are shuffled once: all that follows on an attribute's values reads its bucket.
    """
    given = claims.select(*KEY, "value", "source").dropna().filter(F.col("value") != "")
    return materialise_bucketed(given, "claims", *KEY, distinct=True, order=("value",))


def _shares(claims: DataFrame, reliability: DataFrame) -> DataFrame:
    """(listing, attribute, value, votes, sources, share): the reliability behind each value, as a share of all values'."""
    votes = claims.join(reliability, "source").groupBy(*KEY, "value").agg(
        F.sum("reliability").alias("votes"), F.count("*").alias("sources")
    )
    whole = F.sum("votes").over(Window.partitionBy(*KEY))
    return votes.withColumn("share", F.when(whole > 0, F.col("votes") / whole).otherwise(0.0))


def source_reliability(claims: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(source, claims, reliability): the mean share of a source's values, after a fixed number of rounds from equal trust.

    A round is a join of the claims with the sources' reliability, two windows within their buckets and an aggregate; only a
    row a source goes on to the next one. A source with very many claims is summed up before it is shuffled.
    """
    return _rounds(_claims(claims), rounds)


def _rounds(held: DataFrame, rounds: int) -> DataFrame:
    reliability = held.groupBy("source").agg(F.count("*").alias("claims"), F.lit(1.0).alias("reliability"))
    reliability = materialise(reliability, "reliability")
    # Both windows take their rows in one order, so that they are sorted once.
    of_value = F.sum("reliability").over(Window.partitionBy(*KEY, "value"))
    ordered = Window.partitionBy(*KEY).orderBy("value")
    of_all = F.sum("reliability").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    for _ in range(rounds):
        voted = held.join(reliability.select("source", "reliability"), "source").select(
            "source", of_value.alias("votes"), of_all.alias("whole")
        )
        share = F.when(F.col("whole") > 0, F.col("votes") / F.col("whole")).otherwise(0.0)
        rated = voted.groupBy("source").agg(F.count("*").alias("claims"), F.avg(share).alias("reliability"))
        reliability = materialise(rated, "reliability")
    return reliability


def agreed_values(claims: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(listing, attribute, value, share, sources, values): the likeliest value of every attribute of every listing.

    ``share`` is its part of the reliability of all sources that claim a value, ``sources`` how many claim it, ``values`` how
    many values are claimed. Ties, to nine places, go to more sources, then to the value that sorts first. ``claims`` has
    listing, attribute, value and source; nulls, empty values and repeated claims add nothing.
    """
    held = _claims(claims)
    shares = _shares(held, _rounds(held, rounds).select("source", "reliability"))
    order = F.struct((-F.round("share", 9)).alias("s"), (-F.col("sources")).alias("n"), F.col("value").alias("v"))
    best = F.min_by(F.struct("value", "share", "sources"), order).alias("best")
    return shares.groupBy(*KEY).agg(best, F.count("*").alias("values")).select(*KEY, "best.*", "values")


def claims_of(facts: DataFrame, key: str, source: str, *attributes: str) -> DataFrame:
    """Claims out of a wide table: a row for each filled attribute."""
    each = F.array(*[F.struct(F.lit(name).alias("attribute"), F.col(name).cast("string").alias("value")) for name in attributes])
    long = facts.select(F.col(key).cast("string").alias("listing"), F.col(source).cast("string").alias("source"), F.inline(each))
    return long.filter("value IS NOT NULL AND value <> ''")
