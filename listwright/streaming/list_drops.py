"""Take newly dropped list files, each file once: as listings, or as what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listwright.operators.facts import lookup_facts, page_facts
from listwright.operators.listings import listings
from listwright.operators.merge import enrich
from listwright.session import materialise
from listwright.sources.lists import decoded_path, number_lines, scanned_lines
from listwright.sources.pages import read_pages

# What a listing is known by, and what says where it stood: all other columns are its content.
KEY = "search_name"
PLACE = ("list_id", "line_no", "section")


def ingest_list_drops(
    spark: SparkSession, path: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Process the list files that came since the last run, then stop.

    Every batch writes a folder named by its number, so a batch repeated after a failure
    replaces its own output.
    """

    def write_batch(lines: DataFrame, batch: int) -> None:
        listings(number_lines(lines)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        scanned_lines(spark.readStream.text(path))
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _digest(rows: DataFrame) -> Column:
    content = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns if c not in (KEY, *PLACE, "dropped")]
    return F.sha2(F.concat_ws("\x1f", *content), 256)


def latest_rows(enriched: DataFrame) -> DataFrame:
    """The row of each listing that stands in the list dropped last, then in the list that sorts last, then in its last line.

    Tasks keep one row a listing before the shuffle, so a listing in a third of all lines makes no large group.
    """
    order = F.struct("dropped", "list_id", "line_no")
    whole = F.struct(*[c for c in enriched.columns if c != KEY])
    return enriched.groupBy(KEY).agg(F.max_by(whole, order).alias("row")).select(KEY, "row.*")


def changed_rows(latest: DataFrame, changes: DataFrame | None) -> DataFrame:
    """Of the latest rows, those that are new or say something else than the last change of their listing.

    ``changes`` are all rows that came out so far, with ``batch``: the state is the last one of each listing. Only the
    listings that ``latest`` asks for are looked up in it.
    """
    rows = latest.withColumn("digest", _digest(latest))
    if changes is None:
        return rows.withColumn("kind", F.lit("new"))
    asked = changes.join(rows.select(KEY), KEY, "left_semi")
    state = asked.groupBy(KEY).agg(F.max_by("digest", "batch").alias("known"))
    met = rows.join(state, KEY, "left").withColumn("kind", F.when(F.col("known").isNull(), "new").otherwise("changed"))
    return met.filter(F.col("known").isNull() | (F.col("known") != F.col("digest"))).drop("known")


def _changes_before(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    return spark.read.parquet(out).filter(F.col("batch") < batch) if batch else None


def follow_list_drops(spark: SparkSession, path: str, pages_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Enrich the listings of the list files that came since the last run, write what is new or changed, then stop.

    Every batch writes its changes to a folder named by its number. They are the state as well: a batch repeated after
    a failure reads those of earlier batches only and replaces its own. The pages are read as they are at the time.
    """

    def write_batch(lines: DataFrame, batch: int) -> None:
        dropped = lines.groupBy(decoded_path(F.col("path")).alias("list_id")).agg(F.max("dropped").alias("dropped"))
        facts = materialise(lookup_facts(page_facts(read_pages(lines.sparkSession, pages_path))), "page-facts", "source")
        rows = enrich(listings(number_lines(lines.drop("dropped"))), facts).join(dropped, "list_id")
        latest = materialise(latest_rows(rows), "latest-rows")
        changed_rows(latest, _changes_before(lines.sparkSession, out, batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        scanned_lines(spark.readStream.text(path), F.col("_metadata.file_modification_time").alias("dropped"))
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_listings(changes: DataFrame) -> DataFrame:
    """The last change of every listing: what is known of it now."""
    whole = F.struct(*[c for c in changes.columns if c not in (KEY, "batch")])
    return changes.groupBy(KEY).agg(F.max_by(whole, "batch").alias("row")).select(KEY, "row.*")
