"""Hand-written pages of every kind through the whole run."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from listwright.fixed_values import RTF_CLOSE, RTF_HEADER
from listwright.functions import html as H
from listwright.functions.text import lookup_key
from listwright.operators.facts import anchors, page_facts
from listwright.operators.matching import needs_review, score_pairs
from listwright.operators.report import document_parts, document_rows, report_blocks
from listwright.plans.enrich_lists import enrich_lists, report_lists
from listwright.schemas import ENRICHED, PAGE_FACTS, PAGES
from listwright.sources.pages import look_up
from listwright.sources.reports import write_documents

SEARCH = """<html><script>var x = '<a class="spell">wrong</a>';</script>
<a class="spell" href="/s?q=x"><b>L&#8217;Atelier</b></a>
<p>514-273-7442</p>
<a class="gb1" href="/url?q=http://www.facebook.com/skipped&amp;sa=U">+</a>
<a href="/url?q=https://www.facebook.com/t%25C3%25AAte&amp;sa=U">f</a>
<a href="/url?q=http://www.yellowpages.ca/atelier&amp;sa=U">y</a>
<table><tr><td><img src="/mapfiles/marker-noalpha.png"></td><td>5308, Boul Saint-Laurent (514) 273-7443</td></tr></table>
<div id="search"><h3 class="r"><a href="/url?q=http://www.yelp.ca/atelier&amp;sa=U">denied</a></h3>
<h3 class="r"><a href="/url?q=http://deep.test/a/b&amp;sa=U">deep</a></h3>
<h3 class="r"><a href="/search?q=more">own</a></h3>
<h3 class="r"><a href="/url?q=http://restaurantlatelier.test/&amp;sa=U">root</a></h3>
<h3 class="r"><a href="/url?q=http://second.test/&amp;sa=U">root</a></h3></div></html>"""

REVIEW_SEARCH = '<a class="biz-name x" href="/biz/kazu#hrid:1">Kazu</a><a class="biz-name" href="/biz/no">no</a>'
REVIEW = """<h1 itemprop="name" class="biz-page-title embossed-text"> Kaz&uuml; </h1>
<div class="biz-website"><span>w</span><a href="/biz_redir?url=http%3A%2F%2Fkazu.test%2F&amp;src_bizid=1">k</a></div>
<span class="biz-phone"> (514) 937-2333 </span><address>first one</address>
<address>near <span itemprop="streetAddress">1862 Rue Sainte-Catherine O</span></address>"""
OTHER_REVIEW = '<h1 class="biz-page-title">Something Else</h1><span class="biz-phone">(514) 000-0000</span>'
DIRECTORY = """<h1 itemprop="name">Atelier in the directory</h1>
<address itemprop="address"><span itemprop="streetAddress">1 Rue Autre</span></address>
<li class="phone">(514) 111-1111</li>
<li class="website"><a href="#">m</a><a itemprop="url" href="http://www.listed.test">w</a></li>"""
PROFILE = '<a class="account js-user-profile-link" href="/kazu_mtl">k</a>'


@pytest.fixture(scope="module")
def crawl(spark, tmp_path_factory):
    rows = [
        (1, "search", "Atelier", "search", None, SEARCH),
        (2, "review_search", "Kazu", "review", None, REVIEW_SEARCH),
        (3, "review", None, None, "https://www.yelp.com/biz/kazu", REVIEW),
        (4, "review_search", "Union", "review", None, REVIEW_SEARCH.replace("kazu", "union")),
        (5, "review", None, None, "https://www.yelp.com/biz/union", OTHER_REVIEW),
        (6, "directory", None, None, "http://www.yellowpages.ca/atelier", DIRECTORY),
        (7, "profile", "Kazü", "profile", None, PROFILE),
        (8, "profile", "Kazü", "profile", None, PROFILE.replace("kazu", "later")),
        (9, "search", "Broken", "search", None, "<p><b>unclosed <a href='x'"),
    ]
    df = spark.createDataFrame(rows, "page_id long, source string, name string, kind string, url string, html string")
    key = F.lit(None).cast("string")
    for kind in ("search", "review", "profile"):
        key = F.when(F.col("kind") == kind, lookup_key(F.col("name"), kind)).otherwise(key)
    path = str(tmp_path_factory.mktemp("crawl") / "pages")
    df.withColumn("lookup_key", key).select(PAGES.names).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def lists(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lists")
    (folder / "june.txt").write_text("Places:\nAtelier\nKazu\nUnion\n\nBroken\nKazu\n")
    return str(folder)


def test_page_facts(spark, crawl):
    facts = page_facts(spark.read.parquet(crawl))
    assert sorted(facts.columns) == sorted(PAGE_FACTS.names)
    by_id = {r.page_id: r for r in facts.collect()}
    search = by_id[1]
    assert search.name == "L’Atelier"
    assert search.phone == "(514) 273-7443"
    assert search.address_raw == "5308, Boul Saint-Laurent "
    assert search.facebook == "https://www.facebook.com/t%25C3%25AAte"
    assert search.yellowpages == "http://www.yellowpages.ca/atelier"
    assert search.website == "http://restaurantlatelier.test/"
    assert by_id[2].link == "https://www.yelp.com/biz/kazu"
    review = by_id[3]
    assert (review.name, review.phone) == ("Kazü", "(514) 937-2333")
    assert (review.website, review.address_raw) == ("http://kazu.test/", "1862 Rue Sainte-Catherine O")
    directory = by_id[6]
    assert (directory.name, directory.phone) == ("Atelier in the directory", "(514) 111-1111")
    assert (directory.website, directory.address_raw) == ("listed.test", "1 Rue Autre")
    assert by_id[7].link == "twitter.com/kazu_mtl"
    assert {v for k, v in by_id[9].asDict().items() if k not in ("page_id", "source", "lookup_key")} == {None}


def test_review_page_without_marked_address(spark):
    html = "<address>x</address><address>12 Rue <b>B</b>\n</address>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.review_address(F.col("h"))).first()[0] == "12 Rue B"


def test_character_references(spark):
    cases = {
        "a &amp; b&eacute;&#233;&#xE9;&#128512;": "a & bééé😀",
        "&bogus; & x &; &#;": "&bogus; & x &; &#;",
        "&#99999999999999999999; &#xFFFFFFFFFFFF;": "&#99999999999999999999; &#xFFFFFFFFFFFF;",
        "&#55296; &#1114112; &#0000000065;": "&#55296; &#1114112; A",
        "plain": "plain",
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r.s: r.x for r in df.select("s", H.decode_references(F.col("s")).alias("x")).collect()}
    assert got == cases


def test_anchors(spark):
    html = "<!-- <a href='no'>n</a> --><A HREF=/x?a=1&amp;b=2 class='c'><i>T</i></A><a name='n'>no</a><a href=\"it's\">y</a>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [tuple(r) for r in anchors(df).orderBy("pos").collect()]
    assert got == [(1, 0, "/x?a=1&b=2", "T", True), (1, 2, "it's", "y", False)]


def _one(spark, html, column):
    return spark.createDataFrame([(html,)], "h string").select(column(F.col("h"))).first()[0]


@pytest.mark.parametrize(
    ("html", "column", "wanted"),
    [
        ('<div class="biz-website"><div>w</div><a href="/x">k</a></div>', lambda h: H.first_link_within(h, "div", "biz-website"), "/x"),
        ('<div class="biz-website"><div>w</div></div><a href="/x">k</a>', lambda h: H.first_link_within(h, "div", "biz-website"), None),
        ('<address itemprop="address"><span itemprop="streetAddress"><span>12</span> Rue X</span> y</address>', H.directory_address, "12 Rue X"),
        ('<address>a <div itemprop="streetAddress"><div>12</div> Rue <b>X</b></div> y</address>', H.review_address, "12 Rue X"),
        ('<ul><li class="phone">514-555-1234<li class="website">w</ul>t', lambda h: H.first_element_text(h, "li", "class", "phone"), "514-555-1234"),
        ('<ul><li class="phone">514<li class="website">w</ul>t', lambda h: H.first_element_text(h, "li", "class", "website"), "w"),
        ('<li class="phone">a<ul><li>b</li></ul>c</li>d', lambda h: H.first_element_text(h, "li", "class", "phone"), "abc"),
        ('<h1 title="a>b" itemprop="name">N</h1>', lambda h: H.first_element_text(h, "h1", "itemprop", "name"), "N"),
        ('<h1 title="x itemprop=name">no</h1><h1 itemprop=name>N', lambda h: H.first_element_text(h, "h1", "itemprop", "name"), "N"),
        ("<h1 title=it's itemprop='x name'>N</h1>", lambda h: H.first_element_text(h, "h1", "itemprop", "name"), "N"),
        ("<div class=q><diva>1</diva><DIV >2</div\n>3</Div>4", lambda h: H.first_element_text(h, "div", "class", "q"), "123"),
        ("<div class=q>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "y</div>z", lambda h: H.first_element_text(h, "div", "class", "q"), "xy"),
        ("<p>", lambda h: H.first_element_text(h, "p"), ""),
        ("", lambda h: H.first_element_text(h, "p"), None),
        (None, lambda h: H.first_element_text(h, "p"), None),
        ('<td><img src="/mapfiles/marker-noalpha.png"><td>5 Rue X<tr><td>no', H.marker_cell, "5 Rue X"),
        ('<td><img src="/mapfiles/marker-noalpha.png"></td></tr><tr><td>no</td>', H.marker_cell, None),
        ('<div id=search><div><h3 class=r><a href=/1>1</a></h3></div><h3 class=r><a href=/2>2</div><h3 class=r><a href=/ad>3</a></h3>', H.result_links, ["/1", "/2"]),
        ('<a title="see href=bad class=z" href="/url?q=1">t</a>', lambda h: H.anchors(h)[0]["href"], "/url?q=1"),
        ('<a title="see href=bad class=z" href="/url?q=1">t</a>', lambda h: H.anchors(h)[0]["has_class"], False),
        ('<a href=/f>one <a href=/t>two</a><a href=/l>last', lambda h: F.transform(H.anchors(h), lambda a: a["href"]), ["/f", "/t", "/l"]),
    ],
)
def test_broken_markup(spark, html, column, wanted):
    assert _one(spark, html, column) == wanted


def test_enriched_rows(spark, crawl, lists):
    enriched = enrich_lists(spark, lists, crawl)
    assert set(ENRICHED.names) <= set(enriched.columns)
    rows = {r.line_no: r for r in enriched.collect()}
    assert sorted(rows) == [1, 2, 3, 5, 6]

    atelier = rows[1]
    assert (atelier.section, atelier.found_name) == ("Places", "L’Atelier")
    assert atelier.address == "5308 Saint-Laurent Boulevard"
    assert atelier.phone == "514.273.7443"
    # The directory is asked because no website is known yet; it outranks the search results.
    assert atelier.website == "listed.test"
    assert not atelier.needs_review and atelier.name_changed

    kazu = rows[2]
    assert (kazu.found_name, kazu.yelp) == ("Kazü", "https://www.yelp.com/biz/kazu")
    assert (kazu.phone, kazu.website) == ("514.937.2333", "http://kazu.test/")
    assert kazu.address == "1862 Sainte-Catherine Street West"
    assert (kazu.twitter, kazu.score) == ("twitter.com/kazu_mtl", 1.0)
    assert rows[6].asDict() | {"line_no": 2} == kazu.asDict()

    union = rows[3]
    assert (union.found_name, union.phone, union.yelp) == ("Union", None, None)
    assert rows[5].found_name == "Broken" and not rows[5].address_error


def test_profiles_must_carry_the_name(spark, crawl, lists):
    """The profile that the lookup finds is called ``k``: it is taken, but not where its name is checked."""
    rows = {r.line_no: r for r in enrich_lists(spark, lists, crawl).collect()}
    assert rows[2].twitter == "twitter.com/kazu_mtl" and rows[2].profile_score < 0.75 and rows[3].profile_score is None
    checked = {r.line_no: r for r in enrich_lists(spark, lists, crawl, profile_above=0.75).collect()}
    assert checked[2].twitter is None and checked[2].profile_score == rows[2].profile_score
    assert {r.found_name for r in checked.values()} == {r.found_name for r in rows.values()}


def test_ampersands_on_both_sides(spark):
    names = [("Fitz and Follwell Co.", "Fitz & Follwell Co."), ("a and b", "a and b"), (None, "a & b"), ("a and b", None)]
    df = spark.createDataFrame(names, "search_name string, found_name string")
    one, both = (
        [r["flag"] for r in score_pairs(df, "search_name", "found_name", both_sides=b).select(needs_review(F.col("score")).alias("flag")).collect()]
        for b in (False, True)
    )
    assert (one, both) == ([True, False, True, True], [False, False, True, True])


def test_written_reports(spark, crawl, lists, tmp_path):
    rates = report_lists(spark, lists, crawl, str(tmp_path)).first()
    assert (rates.names, rates.address, rates.phone, rates.website) == (5, 3, 3, 3)

    def document(kind, suffix):
        parts = sorted(Path(tmp_path, kind).glob(f"june{suffix.replace('.', '*.')}"))
        return "".join(p.read_text() for p in parts)

    report = document("reports", "_HYPERLINKED.rtf")
    assert report.startswith(RTF_HEADER) and report.rstrip("\n").endswith(RTF_CLOSE)
    blocks = report.removeprefix(RTF_HEADER).split("\\line\n\n")
    assert [b.split(" \\line")[0] for b in blocks[:-1]] == ["L\\u8217?Atelier", "Kaz\\u252?", "Union", "Broken", "Kaz\\u252?"]
    assert blocks[0].split(" \\line\n") == [
        "L\\u8217?Atelier",
        "5308 Saint-Laurent Boulevard",
        "514.273.7443",
        "{\\field{\\*\\fldinst{HYPERLINK listed.test}}{\\fldrslt{\\ul\\cf1listed.test}}}",
        "{\\field{\\*\\fldinst{HYPERLINK https://www.facebook.com/t%25C3%25AAte}}{\\fldrslt{\\ul\\cf1Facebook}}}",
        "https://www.facebook.com/t\\u234?te",
        "",
    ]
    assert document("profiles", "_TWITTERS.txt").startswith("Atelier\n\nKazu\ntwitter.com/kazu_mtl\n\nUnion\n\n")


def test_a_name_many_rows_ask_for_is_split(spark, tmp_path):
    spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")).write.parquet(str(tmp_path / "facts"))
    hot = F.when(F.col("id") % 10 > 0, F.lit("k7")).otherwise(F.concat(F.lit("k"), F.col("id") % 2000))
    spark.range(400_000).select("id", hot.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(str(tmp_path / "rows"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        found = look_up(spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "facts")), "key", "f_")
        assert found.filter("f_v is not null").count() == 360_000 + 20_000
        found = found.select("id", "x", "f_v")
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in small:
            spark.conf.unset(name)


def test_long_document_is_written_in_order_by_many_tasks(spark, tmp_path):
    df = spark.range(0, 30_000, 1, 8).select(
        F.lit("big").alias("list_id"), F.col("id").alias("line_no"), F.concat(F.lit("n"), "id").alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_documents(df.repartition(8), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "out" / "list_id=big").glob("part-*"))
    assert len(parts) > 1
    assert "".join(p.read_text() for p in parts).split() == [f"n{i}" for i in range(30_000)]


def test_document_parts_are_bounded_and_whole(spark):
    rows = spark.range(250).select(
        F.lit("l").alias("list_id"), F.col("id").alias("line_no"),
        F.lit("a").alias("search_name"), F.concat(F.lit("é"), "id").alias("found_name"), (F.col("id") % 2 == 0).alias("needs_review"),
        *[F.lit(None).cast("string").alias(c) for c in ("address", "phone", "website", "facebook", "twitter")],
    )
    parts = document_parts(document_rows(report_blocks(rows)), part_lines=100).orderBy("part_no").collect()
    assert len(parts) == 5
    whole = "".join(p.text for p in parts)
    assert whole.startswith(RTF_HEADER) and whole.endswith("\\line\n\n" + RTF_CLOSE)
    assert whole.count("\\u233?") == 250 and whole.count("Search: a\\line\n") == 125
