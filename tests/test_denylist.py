"""A denylist as a table: the rows of the literal form, filters of every size, hot addresses."""

import pytest
from pyspark.sql import functions as F

from listwright.operators import links as K


@pytest.fixture(scope="module")
def links(spark):
    hosts = [f"www.h{i}.com" for i in range(300)] + ["a.b.c", "xb.c", "", "a..c", "é.test"]
    urls = [f"http://{h}/x?{i}" for i, h in enumerate(hosts)] + ["no scheme", None, "http://hot.test/"]
    rows = [(i, u, "w") for i, u in enumerate(urls)] + [(9000 + i, "http://hot.test/", "w") for i in range(500)] + [(1, urls[1], "w")]
    return spark.createDataFrame(rows, "page_id long, url string, label string")


@pytest.mark.parametrize("denied", [[], ["b"], ["hot"], ["com"], ["h7", "h8", "h299", "é", ""], ["nobody"]])
def test_table_equals_literal(spark, links, denied):
    table = spark.createDataFrame([(d, 1) for d in [*denied, *denied, None]], "label string, n int")
    got = K.allowed_links_by_table(links, table)
    assert got.columns == links.columns
    want = K.allowed_links(links, "url", denied or ["\0"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("count", "size"), [(0, 1 << 13), (10_000, 1 << 15), (100_000, 1 << 18), (2_000_000, 1 << 20)])
def test_filter_size_is_bounded(spark, count, size):
    denied = spark.range(count).select(F.concat(F.lit("d"), "id").alias("label"))
    bits = K.label_filter(denied)
    assert len(bits) == size
    probes = spark.range(1000).select(F.concat(F.lit("d"), "id").alias("inside"), F.concat(F.lit("other"), "id").alias("outside"))
    held = probes.select(K._may_hold(bits, F.col("inside")).alias("i"), K._may_hold(bits, F.col("outside")).alias("o"))
    row = held.agg(F.count_if("i").alias("i"), F.count_if("o").alias("o")).first()
    assert row["i"] == min(count, 1000) or count == 0
    assert row["o"] < (150 if count <= 100_000 else 400)
