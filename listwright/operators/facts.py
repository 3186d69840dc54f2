"""Facts and links of crawled pages, one pass over the HTML and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed_values import MAP_MARKER, PROFILE_HOST, REVIEW_HOST, SITES
from listwright.functions import page_tree as T
from listwright.functions import phones as P
from listwright.functions import urls as U
from listwright.functions.binding import once
from listwright.sources.pages import one_per_key


# The nodes that facts of a kind of page are made of; a review's address may be marked on any tag.
_TAGS = {
    "search": {"a", "img", "td", "tr", "table", "div", "h3", T.TEXT},
    "review_search": {"a"},
    "review": None,
    "directory": {"a", "h1", "address", "span", "li"},
    "profile": {"a"},
}


def _filled(value: Column) -> Column:
    return once(value, lambda v: F.nullif(v, F.lit("")))


def first_site_link(anchors: Column, site: str) -> Column:
    """Target of the first link without a class that leads to ``site``."""
    own = F.filter(
        anchors, lambda a: ~a["has_class"] & F.contains(a["href"], F.lit(site))
    )
    return _filled(U.unwrap_redirect(F.get(own, F.lit(0))["href"]))


def first_website(links: Column) -> Column:
    """First ranked link that has a host of its own and, unwrapped, no path."""
    usable = F.filter(links, lambda u: U.has_host(u) & ~U.is_denied(u))
    roots = F.filter(F.transform(usable, U.unwrap_redirect), U.is_root_url)
    return F.get(roots, F.lit(0))


def _links(text: Column, nodes: Column) -> Column:
    """All links in document order: array of (pos, href, text, has_class)."""
    def described(link: Column, pos: Column) -> Column:
        shown = T.text_of(text, link).alias("text")
        return F.struct(pos.alias("pos"), link["href"].alias("href"), shown, link["class"].isNotNull().alias("has_class"))

    return F.filter(F.transform(T.elements(nodes, "a"), described), lambda link: link["href"].isNotNull())


def _hrefs(nodes: Column) -> Column:
    """All links in document order, without their text: array of (href, has_class)."""
    def described(link: Column) -> Column:
        return F.struct(link["href"].alias("href"), link["class"].isNotNull().alias("has_class"))

    return F.filter(F.transform(T.elements(nodes, "a"), described), lambda link: link["href"].isNotNull())


def _link_within(nodes: Column, outer: Column, attribute: str | None = None, value: str | None = None) -> Column:
    return once(outer, lambda node: T.first(T.within(T.elements(nodes, "a", attribute, value), node))["href"])


def _directory_address(text: Column, nodes: Column) -> Column:
    """Marked span inside the marked address."""
    address = T.first(T.elements(nodes, "address", "itemprop", "address"))
    parts = T.elements(nodes, "span", "itemprop", "streetAddress")
    return once(once(address, lambda node: T.first(T.within(parts, node))), lambda node: T.text_of(text, node))


def _review_address(text: Column, nodes: Column) -> Column:
    """Last address: its marked part if there is one, whatever its tag, else all of it."""
    parts = T.elements(nodes, None, "itemprop", "streetAddress")

    def shown(address: Column) -> Column:
        return once(F.coalesce(T.first(T.within(parts, address)), address), lambda node: T.text_of(text, node))

    return once(T.last(T.elements(nodes, "address")), shown)


def _marker_cell(text: Column, nodes: Column) -> Column:
    """Text of the cell after the one that holds the map marker, in the same row."""
    marker = T.first(F.filter(nodes, lambda node: (node["tag"] == "img") & (node["src"] == MAP_MARKER)))

    def next_cell(image: Column) -> Column:
        return T.first(F.filter(T.elements(nodes, "td"), lambda cell: cell["pre"] > image["pre"]))

    def same_row(image: Column, cell: Column) -> Column:
        def broken(node: Column) -> Column:
            row_between = (node["tag"] == "tr") & (node["pre"] > image["pre"]) & (node["pre"] < cell["pre"])
            around = node["tag"].isin("tr", "table") & (node["pre"] < image["pre"]) & (node["until"] > image["pre"])
            return row_between | (around & (node["until"] <= cell["pre"]))

        return ~F.exists(nodes, broken)

    def shown(image: Column) -> Column:
        return once(next_cell(image), lambda cell: F.when(same_row(image, cell), T.text_of(text, cell)))

    return once(marker, shown)


def _results(nodes: Column) -> Column:
    """Links of the ranked results (h3.r under div#search), best first."""
    def ranked(search: Column) -> Column:
        heads = T.within(T.elements(nodes, "h3", "class", "r"), search)
        return F.transform(heads, lambda head: T.first(T.within(T.elements(nodes, "a"), head))["href"])

    links = once(T.first(T.elements(nodes, "div", "id", "search")), ranked)
    return F.filter(links, lambda href: href.isNotNull())


def page_facts(pages: DataFrame) -> DataFrame:
    """One row of facts per page, NULL where the kind of page does not offer one.

    Kinds (``source``): search, review_search, review, directory, profile. ``link`` is what
    the two lookup pages lead to. The HTML is read once, to nodes, and dropped.
    """
    source = F.col("source")
    text, nodes, cell = F.col("text"), F.col("nodes"), F.col("cell")

    def of(**kinds: Column) -> Column:
        value = None
        for kind, column in kinds.items():
            test = source == kind
            value = F.when(test, column) if value is None else value.when(test, column)
        return _filled(value)

    def first_text(tag: str, attribute: str, value: str) -> Column:
        return once(T.first(T.elements(nodes, tag, attribute, value)), lambda node: T.text_of(text, node))

    phone_nodes = F.filter(
        nodes, lambda node: (node["tag"] == T.TEXT) & P.is_strict_phone(T.raw_text(text, node))
    )
    search = source == "search"
    prepared = (
        T.with_tree(pages, set(), tags_of=_TAGS, kind="source")
        .withColumn("cell", F.when(search, _filled(_marker_cell(text, nodes))))
        .withColumn("anchors", F.when(search, _hrefs(nodes)))
        .withColumn("results", F.when(search, _results(nodes)))
    )
    return prepared.select(
        "page_id",
        "source",
        "lookup_key",
        "url",
        of(
            search=first_text("a", "class", "spell"),
            review=first_text("h1", "class", "biz-page-title"),
            directory=first_text("h1", "itemprop", "name"),
            profile=first_text("a", "class", "js-user-profile-link"),
        ).alias("name"),
        of(
            search=F.coalesce(P.phone_loose(cell), once(T.first(phone_nodes), lambda node: T.raw_text(text, node))),
            review=first_text("span", "class", "biz-phone"),
            directory=first_text("li", "class", "phone"),
        ).alias("phone"),
        of(
            search=U.before(cell, "("),
            review=_review_address(text, nodes),
            directory=_directory_address(text, nodes),
        ).alias("address_raw"),
        of(
            search=first_website(F.col("results")),
            review=U.unquote_redirect(_link_within(nodes, T.first(T.elements(nodes, "div", "class", "biz-website")))),
            directory=U.strip_www(
                _link_within(nodes, T.first(T.elements(nodes, "li", "class", "website")), "itemprop", "url")
            ),
        ).alias("website"),
        of(
            review_search=F.concat(
                F.lit(REVIEW_HOST), U.before(T.first(T.elements(nodes, "a", "class", "biz-name"))["href"], "#")
            ),
            profile=F.concat(
                F.lit(PROFILE_HOST), T.first(T.elements(nodes, "a", "class", "js-user-profile-link"))["href"]
            ),
        ).alias("link"),
        *[first_site_link(F.col("anchors"), site).alias(site) for site in SITES],
    )


def lookup_facts(facts: DataFrame) -> DataFrame:
    """Facts with the ``key`` their kind of page is looked up by, the first page of every key."""
    by_address = F.col("source").isin("review", "directory")
    keyed = facts.withColumn("key", F.when(by_address, F.col("url")).otherwise(F.col("lookup_key")))
    return one_per_key(keyed, "source", "key")


def page_nodes(pages: DataFrame) -> DataFrame:
    """A row per node of every page: page_id, its interval, attributes and text (see ``page_tree``)."""
    trees = T.with_tree(pages.select("page_id", "html"))
    return trees.select("page_id", "text", F.explode("nodes").alias("node")).select(
        "page_id", "node.*", T.raw_text(F.col("text"), F.col("node")).alias("text")
    )


def nodes_within(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of nodes of one page, the second inside the first: an interval join.

    The columns of ``inner`` come back with ``outer_pre``. Both are some of the nodes of ``page_nodes``, such as all
    navigations and all links; adaptive execution splits a page with very many.
    """
    around = outer.select("page_id", F.col("pre").alias("outer_pre"), F.col("until").alias("outer_until"))
    inside = (F.col("pre") > F.col("outer_pre")) & (F.col("pre") < F.col("outer_until"))
    return inner.join(around, "page_id").filter(inside).drop("outer_until")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text, has_class), one row per link in document order."""
    trees = T.with_tree(pages.select("page_id", "html"), {"a"})
    links = _links(F.col("text"), F.col("nodes"))
    return trees.select("page_id", F.inline(links)).withColumn("pos", F.col("pos").cast("bigint"))


def site_links(pages: DataFrame, sites: list[str] = SITES) -> DataFrame:
    """(page_id, site, url): first link of every page to every site."""
    trees = T.with_tree(pages.select("page_id", "html"), {"a"})
    links = trees.select("page_id", _links(F.col("text"), F.col("nodes")).alias("anchors"))
    each = F.array(
        *[
            F.struct(F.lit(site).alias("site"), first_site_link(F.col("anchors"), site).alias("url"))
            for site in sites
        ]
    )
    return links.select("page_id", F.inline(each)).filter("url is not null")
