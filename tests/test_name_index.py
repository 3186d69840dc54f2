"""The kept index: the same matches as a full run, and no exchange over its tables."""

import re

import pytest
from test_matching import names

from listwright.operators import matching as M
from listwright.operators import name_index as I


def tables(spark, seed, count):
    listed = names(count, seed) + ["Le De", "cafe union", "UNION Café", "", None]
    paged = names(count, seed + 1) + ["restaurant", "cafe union", "union cafe", "au"]
    listings = spark.createDataFrame([("l", i, n) for i, n in enumerate(listed)], "list_id string, line_no long, search_name string")
    pages = spark.createDataFrame([(i, n) for i, n in enumerate(paged)], "page_id long, page_name string")
    return listings, pages


def rows(df):
    return sorted((tuple(r) for r in df.select("list_id", "line_no", "search_name", "page_id", "page_name", "score").collect()), key=repr)


@pytest.mark.parametrize(("seed", "threshold"), [(3, 0.75), (21, 0.6)])
def test_equals_a_full_run(spark, tmp_path, seed, threshold):
    listings, pages = tables(spark, seed, 100)
    path = str(tmp_path / "index")
    index = I.write_name_index(pages, path, threshold, buckets=4)
    want = rows(M.best_matches(listings, pages, threshold))
    assert rows(I.match_new(listings, index)) == want
    again = I.open_name_index(spark, path, threshold, buckets=4)
    assert rows(I.match_new(listings.limit(9), again)) == rows(M.best_matches(listings.limit(9), pages, threshold))
    assert I.match_new(listings.limit(0), again).count() == 0


def ancestors(plan):
    """For each scan of a plan's text, the nodes above it up to the first join."""
    lines = [(len(re.match(r"[\s:+\-|]*", line)[0]), line) for line in plan.splitlines() if line.strip()]
    for at, (depth, line) in enumerate(lines):
        if "name_index" not in line or "Scan" not in line:
            continue
        above = []
        for other_depth, other in reversed(lines[:at]):
            if other_depth < depth:
                depth = other_depth
                if "Join" in other:
                    break
                above.append(other)
        yield line, above


def test_the_index_is_not_moved(spark, tmp_path):
    listings, pages = tables(spark, 5, 60)
    index = I.write_name_index(pages, str(tmp_path / "index"))
    plans = []
    write = M.materialise

    def watched(df, label, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, *by)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(I, "materialise", watched)
            out = I.match_new(listings, index)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [found for plan in plans for found in ancestors(plan)]
    assert len(scans) >= 4
    for scan, above in scans:
        assert not any("Exchange" in node for node in above), (scan, above)
