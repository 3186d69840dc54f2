"""Facts and links of pages: the crawled pages as they are, and marked-up ones made from
suppliers and pages where the crawl lacks an element."""

from pyspark.sql import functions as F

from listwright.functions import html as H
from listwright.functions import urls as U
from listwright.operators import facts as X
from listwright.plans.catalog.shared import SHOWN_SQL, element_sql, page_texts, table, text_sql
from listwright.plans.catalog.streets import SUPPLIER_ADDRESSES_SQL, supplier_addresses
from listwright.session import materialise
from listwright.sources.pages import look_up, one_per_key


def page_snapshot(spark, sf_dir):
    """Look every crawled address up in the crawl, by page key; the first page of a key wins."""
    pages = table(spark, sf_dir, "pages")
    key = U.page_key(F.col("url")).alias("page_key")
    snapshots = pages.select("page_id", key, F.length("html").cast("bigint").alias("chars"))
    firsts = materialise(one_per_key(snapshots, "page_key"), "page-keys")
    return look_up(pages.select("page_id", key), firsts, "page_key", "found_")


_KEY_SQL = "rtrim(split_part(split_part(url, '#', 1), '?', 1), '/')"
SNAPSHOT_SQL = f"""
WITH keyed AS (SELECT page_id, {_KEY_SQL} AS page_key, length(html)::BIGINT AS chars FROM pages),
firsts AS (SELECT page_key, min(page_id) AS found_page_id, arg_min(chars, page_id) AS found_chars
           FROM keyed GROUP BY page_key)
SELECT page_key, page_id, found_page_id, found_chars FROM keyed JOIN firsts USING (page_key)"""


def first_element_text(spark, sf_dir):
    return page_texts(spark, sf_dir)


def last_element_text(spark, sf_dir):
    """Last written-out paragraph of every article, with what precedes it where end tags are missing."""
    last = H.inner_text(H.last_stretch(H.first_element(H.shown_html(F.col("html")), "article"), "p"))
    return table(spark, sf_dir, "pages").select("page_id", last.alias("text"))


def last_paragraph(spark, sf_dir):
    """Paragraph that opens last in every article; its end tag may be missing."""
    last = H.last_element(H.first_element(H.shown_html(F.col("html")), "article"), "p")
    return table(spark, sf_dir, "pages").select("page_id", H.inner_text(last).alias("text"))


def made_elements(spark, sf_dir):
    """Elements that nest their own kind, and list items without end tags, before every page."""
    parts = (
        '<div class="made"><div title="</div>">', F.col("url"), "</div><div><div></div></div> ", F.col("page_id"),
        '</div><ul><li class="phone">', F.col("url"), '<li title="class=phone" class="website"><ul><li>',
        F.col("page_id"), "</ul></ul>", F.col("html"),
    )
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, sf_dir, "pages").select(
        "page_id",
        H.first_element_text(html, "div", "class", "made").alias("nested"),
        H.first_element_text(html, "li", "class", "phone").alias("phone_item"),
        H.first_element_text(html, "li", "class", "website").alias("website_item"),
    )


_MADE_SQL = """
SELECT page_id, url || ' ' || page_id AS nested, url AS phone_item, page_id::VARCHAR AS website_item FROM pages"""


def open_links(spark, sf_dir):
    """Links of the pages with every link end tag taken out."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("</a>"), F.lit("")).alias("html"))
    return X.anchors(pages).select("page_id", "pos", "href")


_OPEN_LINKS_SQL = rf"""
WITH found AS (SELECT page_id, regexp_extract_all({SHOWN_SQL}, '<a\b[^>]*>') AS links FROM pages)
SELECT page_id, i::BIGINT AS pos, regexp_extract(links[i + 1], 'href="([^"]*)"', 1) AS href
FROM found, unnest(range(len(links))) AS u(i)"""

_ARTICLE_SQL = f"regexp_extract({SHOWN_SQL}, '(?s)<article>(.*?)</article>', 1)"


def first_link(spark, sf_dir):
    """First link of the navigation."""
    nav = H.first_element(H.shown_html(F.col("html")), "nav")
    return table(spark, sf_dir, "pages").select("page_id", H.first_link(nav, H.opening_tag("a")).alias("href"))


def anchors(spark, sf_dir):
    return X.anchors(table(spark, sf_dir, "pages"))


_ANCHORS_SQL = rf"""
WITH found AS (SELECT page_id, regexp_extract_all({SHOWN_SQL}, '(?s)<a\b[^>]*>.*?</a>') AS links FROM pages)
SELECT page_id, i::BIGINT AS pos, regexp_extract(links[i + 1], 'href="([^"]*)"', 1) AS href,
       {text_sql('links[i + 1]')} AS text, regexp_matches(links[i + 1], '^<a[^>]*\sclass') AS has_class
FROM found, unnest(range(len(links))) AS u(i)"""


def page_nodes(spark, sf_dir):
    """How many elements of each kind every page has, and how many characters stand in them."""
    nodes = X.page_nodes(table(spark, sf_dir, "pages")).filter("tag <> '#text'")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("nodes"))


_NODES_SQL = rf"""
WITH tags AS (SELECT page_id, unnest(regexp_extract_all({SHOWN_SQL}, '(?i)<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
SELECT page_id, lower(tag) AS tag, count(*) AS nodes FROM tags GROUP BY page_id, lower(tag)"""


def nodes_within(spark, sf_dir):
    """Links inside the navigation of every page, by intervals."""
    nodes = materialise(X.page_nodes(table(spark, sf_dir, "pages")).filter("tag IN ('nav', 'a')"), "nav-nodes", "tag")
    inside = X.nodes_within(nodes.filter("tag = 'nav'"), nodes.filter("tag = 'a'"))
    return inside.select("page_id", "href", F.btrim("text").alias("text"))


_WITHIN_SQL = rf"""
WITH found AS (
  SELECT page_id, unnest(regexp_extract_all(regexp_extract({SHOWN_SQL}, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a\b[^>]*>.*?</a>')) AS link
  FROM pages)
SELECT page_id, regexp_extract(link, 'href="([^"]*)"', 1) AS href, {text_sql('link')} AS text FROM found"""


def _result_pages(spark, sf_dir):
    """The crawled pages with their navigation as a ranked result list."""
    html = F.regexp_replace("html", "<li>(.*?)</li>", '<h3 class="r">$1</h3>')
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit('<h3 class="r"><a href="/outside"></a></h3><div class="x" id="search">'), html).alias("html")
    )


def result_links(spark, sf_dir):
    links = H.result_links(H.shown_html(F.col("html")))
    placed = _result_pages(spark, sf_dir).select("page_id", F.posexplode(links).alias("pos", "href"))
    return placed.withColumn("pos", F.col("pos").cast("bigint"))


_RESULTS_SQL = r"""
WITH found AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS links FROM pages)
SELECT page_id, i::BIGINT AS pos, regexp_extract(links[i + 1], 'href="([^"]*)"', 1) AS href
FROM found, unnest(range(len(links))) AS u(i)"""

HOSTS = ["example.com", "example.net", "example.org"]


def site_links(spark, sf_dir):
    """First unclassed redirect of every page to each of three sites."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(
            F.lit('<a class="gb" href="/url?q=http://example.com/own">x</a><a href="/url?q='),
            "url",
            F.lit('&amp;sa=U">y</a><a href="/url?q=https://example.net/second&amp;sa=U">z</a>'),
            "html",
        ).alias("html"),
    )
    return X.site_links(pages, HOSTS)


_SITES_SQL = """
WITH found AS (SELECT page_id, split_part(url, '&', 1) AS target FROM pages),
own AS (SELECT page_id, regexp_extract(target, 'example.(com|net|org)') AS site,
               regexp_extract('/url?q=' || target, '=(.*)$', 1) AS url FROM found)
SELECT page_id, site, url FROM own
UNION ALL SELECT page_id, 'example.net', 'https://example.net/second' FROM own WHERE site <> 'example.net'"""


def supplier_pages(spark, sf_dir):
    """A directory page and a review page per supplier."""
    described = supplier_addresses(spark, sf_dir).join(table(spark, sf_dir, "supplier"), "s_suppkey")
    name = F.concat("s_name", F.lit(" &amp; Caf&eacute;"))
    phone = F.concat(F.lit("(514) 555-"), F.right("s_name", F.lit(4)))
    directory = F.concat(
        F.lit('<html><!-- <h1 itemprop="name">old</h1> --><h1 class="a" itemprop="name"> '), name,
        F.lit('</h1><address itemprop="address">at <span itemprop="streetAddress">'), "raw",
        F.lit('</span></address><ul><li class="first phone"> '), phone,
        F.lit('</li><li class="website"><a href="#">map</a><a itemprop="url" href="http://www.'), F.lower("s_name"),
        F.lit('.com/">web</a></li></ul>'),
    )
    review = F.concat(
        F.lit("<h1 class='biz-page-title embossed'>"), name,
        F.lit('</h1><div class="biz-website"><a href="/biz_redir?url='),
        F.url_encode(F.concat(F.lit("http://"), F.lower("s_name"), F.lit(".ca/?a=b"))),
        F.lit('&amp;src=x">web</a></div><span class="biz-phone">'), phone,
        F.lit("</span><address>first</address><address>"),
        F.when(F.col("s_nationkey") < 10, F.lit("<b>near</b> <span itemprop='streetAddress'>")).otherwise(F.lit("<span>")),
        "raw", F.lit("</span></address>"),
    )
    both = F.array(
        F.struct(F.lit("directory").alias("source"), directory.alias("html")),
        F.struct(F.lit("review").alias("source"), review.alias("html")),
    )
    return described.select(
        F.col("s_suppkey").alias("page_id"),
        F.lit(None).cast("string").alias("lookup_key"),
        F.concat(F.lit("http://pages.test/"), "s_suppkey").alias("url"),
        F.inline(both),
    )


def supplier_facts(spark, sf_dir):
    return X.page_facts(supplier_pages(spark, sf_dir)).select(
        "page_id", "source", "name", "phone", "address_raw", "website"
    )


_SUPPLIER_FACTS_SQL = f"""
SELECT s_suppkey AS page_id, source, s_name || ' & Café' AS name,
       '(514) 555-' || right(s_name, 4) AS phone, raw AS address_raw,
       CASE source WHEN 'directory' THEN lower(s_name) || '.com/'
                   ELSE 'http://' || lower(s_name) || '.ca/?a=b' END AS website
FROM ({SUPPLIER_ADDRESSES_SQL}) JOIN supplier USING (s_suppkey), (VALUES ('directory'), ('review')) AS v(source)"""

QUERIES = {
    "page_snapshot": (page_snapshot, SNAPSHOT_SQL),
    "first_element_text": (
        first_element_text,
        f"SELECT page_id, {element_sql('title', 'shown')} AS title, {element_sql('h1', 'shown')} AS h1,"
        f""" {element_sql('div class="ad"', 'shown')} AS ad FROM (SELECT page_id, {SHOWN_SQL} AS shown FROM pages)""",
    ),
    "last_element_text": (
        last_element_text,
        f"SELECT page_id, {text_sql('last')} AS text FROM (SELECT page_id,"
        f" regexp_extract_all({_ARTICLE_SQL}, '(?s)<p>(.*?)</p>', 1)[-1] AS last FROM pages)",
    ),
    "last_paragraph": (
        last_paragraph,
        f"SELECT page_id, {text_sql('last')} AS text FROM (SELECT page_id, regexp_replace(string_split("
        f"{_ARTICLE_SQL}, '<p>')[-1], '(?s)</?(p|div|ul|table|h[1-6])[ >].*$', '') AS last FROM pages)",
    ),
    "made_elements": (made_elements, _MADE_SQL),
    "open_links": (open_links, _OPEN_LINKS_SQL),
    "first_link": (
        first_link,
        f"""SELECT page_id, regexp_extract({SHOWN_SQL}, '(?s)<nav>.*?<a href="([^"]*)"', 1) AS href FROM pages""",
    ),
    "anchors": (anchors, _ANCHORS_SQL),
    "page_nodes": (page_nodes, _NODES_SQL),
    "nodes_within": (nodes_within, _WITHIN_SQL),
    "result_links": (result_links, _RESULTS_SQL),
    "site_links": (site_links, _SITES_SQL),
    "supplier_facts": (supplier_facts, _SUPPLIER_FACTS_SQL),
}
