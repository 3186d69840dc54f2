"""Dated drops of lists: only new and changed listings come out; drops in sequence equal one run over all."""

import os

from pyspark.sql import functions as F
from test_enrich import PROFILE, REVIEW, REVIEW_SEARCH, SEARCH

from listwright.functions.text import lookup_key
from listwright.schemas import PAGES
from listwright.streaming.list_drops import changed_rows, current_listings, follow_list_drops, latest_rows


def write_pages(spark, path, review=REVIEW):
    rows = [
        (1, "search", "Atelier", "search", None, SEARCH),
        (2, "review_search", "Kazu", "review", None, REVIEW_SEARCH),
        (3, "review", None, None, "https://www.yelp.com/biz/kazu", review),
        (7, "profile", "Kazü", "profile", None, PROFILE),
    ]
    df = spark.createDataFrame(rows, "page_id long, source string, name string, kind string, url string, html string")
    key = F.lit(None).cast("string")
    for kind in ("search", "review", "profile"):
        key = F.when(F.col("kind") == kind, lookup_key(F.col("name"), kind)).otherwise(key)
    df.withColumn("lookup_key", key).select(PAGES.names).write.mode("overwrite").parquet(path)


def drop(folder, name, text, day):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (86_400 * day, 86_400 * day))


def state(spark, out):
    """What is known of every listing, without where and when it came up."""
    where = ("list_id", "line_no", "section", "dropped", "kind")
    return sorted((tuple(r) for r in current_listings(spark.read.parquet(out)).drop(*where).collect()), key=repr)


def test_drops_in_sequence_equal_one_run(spark, tmp_path):
    pages = str(tmp_path / "pages")
    write_pages(spark, pages)

    def run(name):
        out = str(tmp_path / f"out-{name}")
        follow_list_drops(spark, str(tmp_path / name), pages, out, str(tmp_path / f"check-{name}")).awaitTermination(180)
        return out

    def came(out, batch):
        return {(r["search_name"], r["kind"]) for r in spark.read.parquet(out).filter(f"batch = {batch}").collect()}

    one, two = ("june6.txt", "Places:\nKazu\nNobody\nKazu\n", 1), ("june14.txt", "Atelier\nKazu\nNobody\n", 2)
    drop(tmp_path / "each", *one)
    out = run("each")
    assert came(out, 0) == {("Kazu", "new"), ("Nobody", "new")}
    drop(tmp_path / "each", *two)
    out = run("each")
    assert came(out, 1) == {("Atelier", "new")}
    for name, text, day in (one, two):
        drop(tmp_path / "both", name, text, day)
    both = run("both")
    assert state(spark, out) == state(spark, both) and len(state(spark, both)) == 3
    # The page about one of them changes, and both come again: only that one comes out.
    write_pages(spark, pages, REVIEW.replace("937-2333", "937-9999"))
    drop(tmp_path / "each", "july1.txt", "Kazu\nAtelier\n", 3)
    out = run("each")
    assert came(out, 2) == {("Kazu", "changed")}
    phones = {r["search_name"]: r["phone"] for r in current_listings(spark.read.parquet(out)).collect()}
    assert phones["Kazu"] == "514.937.9999" and len(phones) == 3
    assert run("each") and spark.read.parquet(out).select("batch").distinct().count() == 3


def test_latest_and_changed(spark):
    schema = "list_id string, line_no long, section string, search_name string, phone string, dropped long"
    rows = [("a", 1, None, "x", "1", 5), ("b", 0, None, "x", "2", 6), ("b", 7, None, "x", "3", 6), ("a", 2, "s", "y", None, 5)]
    latest = latest_rows(spark.createDataFrame(rows, schema))
    assert {(r["search_name"], r["phone"]) for r in latest.collect()} == {("x", "3"), ("y", None)}
    first = changed_rows(latest, None).withColumn("batch", F.lit(0))
    assert {r["kind"] for r in first.collect()} == {"new"}
    assert changed_rows(latest, first).count() == 0
    other = latest_rows(spark.createDataFrame([("c", 1, None, "y", "4", 9), ("c", 2, "t", "x", "3", 9)], schema))
    assert [(r["search_name"], r["kind"]) for r in changed_rows(other, first).collect()] == [("y", "changed")]
