"""A kept index of names: written once, bucketed, and asked with new names without moving the old ones.

``best_matches`` reads both tables anew. Where many names stay and few come, the work on those that stay is kept: the
similarity keys of their words, the words through which each name is met, and the names themselves, each as a table bucketed by
what it is joined on. A join with new names then shuffles the new side only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.fixed_values import ACCEPT_ABOVE
from listwright.functions.similarity import token_ratio
from listwright.operators import matching as M
from listwright.session import materialise

# Tables of the index: what each is bucketed by, and its columns.
_TABLES = {
    "keys": ("key", "key string, token string"),
    "postings": ("token", "token string, places bigint, name_key string"),
    "met": ("token", "token string, need double, name_key string"),
    "names": ("name_key", "name_key string, page_id bigint, page_name string"),
}


@dataclass
class NameIndex:
    """The tables of an index and the score its matches must exceed."""

    tables: dict[str, DataFrame]
    threshold: float

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self.tables[name]
        raise AttributeError(name)


def _table_name(path: str, table: str) -> str:
    return f"name_index_{hashlib.sha256(path.encode()).hexdigest()[:12]}_{table}"


def _buckets(spark: SparkSession, buckets: int | None) -> int:
    """As many as a shuffle has partitions: of fewer, Spark would deal the bucketed side anew."""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets


def open_name_index(spark: SparkSession, path: str, threshold: float = ACCEPT_ABOVE, buckets: int | None = None) -> NameIndex:
    """An index that was written under ``path``, with the same threshold and number of buckets, by default the session's shuffle
    partitions. A session with more of those than the index has buckets gets the same rows, but deals the index anew."""
    buckets, tables = _buckets(spark, buckets), {}
    for table, (by, columns) in _TABLES.items():
        name = _table_name(path, table)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
            f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'"
        )
        spark.catalog.refreshTable(name)
        tables[table] = spark.table(name)
    return NameIndex(tables, threshold)


def write_name_index(
    page_names: DataFrame, path: str, threshold: float = ACCEPT_ABOVE, buckets: int | None = None
) -> NameIndex:
    """Index ``page_names`` (page_id, page_name) under ``path``, a folder that is not there yet; then open it.

    Of names with the same words the lowest page counts; names without words are left out.
    """
    spark = page_names.sparkSession
    buckets = _buckets(spark, buckets)
    floor = M.pair_floor(threshold)
    names = materialise(M.page_keys(page_names), "page-names")
    counts = materialise(M.word_counts(names.select("name_key")), "index-words")
    keys = M.similarity_key_rows(counts, floor, left=False)
    # A name is met through the rarer half of its words: whichever new name scores over the threshold meets one of them.
    words = names.select("name_key").withColumn("beat", F.lit(threshold))
    reach = counts.select("token", F.array(*[F.col("places")] * M.LEVELS).alias("reach"))
    written = {
        "keys": keys.select("key", "token"),
        "postings": M.word_places(names.select("name_key")).join(counts, "token").select("token", "places", "name_key"),
        "met": M.meeting_words(words, reach, threshold, floor).select("token", "need", "name_key"),
        "names": names.select("name_key", F.col("page_id").cast("bigint").alias("page_id"), "page_name"),
    }
    for table, (by, _) in _TABLES.items():
        rows = written[table].repartition(buckets, by).sortWithinPartitions(by)
        rows.write.bucketBy(buckets, by).sortBy(by).option("path", f"{path}/{table}").saveAsTable(_table_name(path, table))
    return open_name_index(spark, path, threshold, buckets)


def match_new(listings: DataFrame, index: NameIndex) -> DataFrame:
    """Best page of every listing among the index's, or none: the rows of ``best_matches`` (see there) for the same pages.

    The index is scanned, never shuffled; all exchanges are of the new names, their words and the pairs they make.
    """
    threshold, floor = index.threshold, M.pair_floor(index.threshold)
    keyed = M.with_name_key(listings, "search_name")
    new = materialise(keyed.select("name_key").filter("name_key IS NOT NULL").distinct(), "new-names")
    words = materialise(M.word_counts(new), "new-words")
    asked = M.similarity_key_rows(words, floor, left=True).withColumnRenamed("token", "tok_a")
    met = asked.join(index.keys.withColumnRenamed("token", "tok_b"), "key").select("tok_a", "tok_b").distinct()
    pairs = met.withColumn("ratio", token_ratio(F.col("tok_a"), F.col("tok_b"))).filter(F.col("ratio") > floor)
    pairs = materialise(pairs, "new-token-pairs")
    # How many places each partner has is known from any of its postings.
    partners = pairs.select(F.col("tok_b").alias("token")).distinct()
    places = partners.join(index.postings, "token").groupBy("token").agg(F.first("places").alias("places"))
    reach = M.word_reach(pairs, "tok_a", "tok_b", floor, places)
    opened = M.meeting_words(new.withColumn("beat", F.lit(threshold)), reach, threshold, floor)
    from_new = (
        opened.join(pairs, (opened["token"] == pairs["tok_a"]) & (pairs["ratio"] > opened["need"]))
        .select(F.col("name_key").alias("key_a"), F.col("tok_b").alias("token"))
        .join(index.postings, "token")
        .select("key_a", F.col("name_key").alias("key_b"))
    )
    holders = M.word_places(new).select(F.col("name_key").alias("key_a"), F.col("token").alias("tok_a"))
    asked = pairs.withColumnRenamed("tok_b", "token").join(index.met, "token").filter(F.col("ratio") > F.col("need"))
    from_old = asked.select("tok_a", F.col("name_key").alias("key_b")).join(holders, "tok_a").select("key_a", "key_b")
    scored = M.scored_pairs(from_new.unionByName(from_old).distinct(), threshold)
    pages = index.names.withColumnRenamed("name_key", "key_b")
    order = F.struct(
        (-F.col("score")).alias("s"), (F.col("key_a") != F.col("key_b")).alias("k"), F.col("page_id").alias("p")
    )
    best = scored.join(pages, "key_b").groupBy(F.col("key_a").alias("name_key")).agg(
        F.min_by(F.struct("page_id", "page_name", "score"), order).alias("best")
    )
    return keyed.join(best.select("name_key", "best.*"), "name_key", "left").drop("name_key")
