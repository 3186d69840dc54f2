"""Merge what the sources say about each listing.

Later sources see what earlier ones found: a lookup is made only where it is needed, and
rows that need none carry a key that matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed_values import ACCEPT_ABOVE, SITES
from listwright.functions.addresses import standard_address
from listwright.functions.phones import phone_format
from listwright.functions.similarity import with_match_score
from listwright.functions.text import lookup_key, name_tokens
from listwright.operators.matching import needs_review, score_pairs
from listwright.sources.pages import look_up, spread_key

ROW = ("list_id", "line_no")


def first_by_rank(values: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Most trusted value of every key: lowest rank among those given."""
    given = values.filter(F.col(value).isNotNull())
    return given.groupBy(key).agg(F.min_by(value, rank).alias(value))


def need_directory(row: DataFrame) -> Column:
    """A directory page is worth reading: something is missing and there is a link."""
    missing = F.col("website").isNull() | F.col("address").isNull() | F.col("phone").isNull()
    return missing & F.col("yellowpages").isNotNull()


def need_profile() -> Column:
    return F.col("twitter").isNull()


def _of_source(facts: DataFrame, source: str, *columns: str) -> DataFrame:
    return facts.filter(F.col("source") == source).select(F.col("key").alias("_key"), *columns)


def _ask(rows: DataFrame, pages: DataFrame, prefix: str, needed: Column, key: Column) -> DataFrame:
    keyed = rows.withColumn("_key", spread_key(needed, key, *ROW))
    return look_up(keyed, pages, "_key", prefix).drop("_key")


def default_rows(listings: DataFrame) -> DataFrame:
    """Every listing starts with its own name and nothing else."""
    empty = F.lit(None).cast("string")
    return listings.select(
        "list_id",
        "line_no",
        "section",
        "search_name",
        F.col("search_name").alias("found_name"),
        *[empty.alias(c) for c in ("address", "phone", "website", *SITES)],
        F.lit(False).alias("address_seen"),
    )


def _take_address(row: DataFrame, raw: Column) -> DataFrame:
    return row.withColumn(
        "address_seen", F.col("address_seen") | F.coalesce(raw.isNotNull(), F.lit(False))
    ).withColumn("address", F.coalesce("address", standard_address(raw)))


def with_search_page(rows: DataFrame, facts: DataFrame) -> DataFrame:
    pages = _of_source(
        facts, "search", "name", "phone", "address_raw", "website", *SITES
    )
    asked = _ask(rows, pages, "s_", F.lit(True), lookup_key(F.col("search_name"), "search"))
    named = asked.withColumn("found_name", F.coalesce("s_name", "found_name"))
    phoned = named.withColumn("phone", F.col("s_phone"))
    linked = phoned.withColumns({site: F.col(f"s_{site}") for site in SITES})
    return (
        _take_address(linked, F.col("s_address_raw"))
        .withColumn("fallback_website", F.col("s_website"))
        .select(*rows.columns, "fallback_website")
    )


def with_review_page(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """A linked review page is trusted; one found by lookup must carry a similar name."""
    lookups = _of_source(facts, "review_search", "link")
    reviews = _of_source(facts, "review", "name", "phone", "address_raw", "website")
    unlinked = F.col("yelp").isNull()
    asked = _ask(rows, lookups, "q_", unlinked, lookup_key(F.col("search_name"), "review"))
    url = F.coalesce("yelp", "q_link")
    asked = _ask(asked, reviews, "r_", url.isNotNull(), url)
    compare = F.when(unlinked, name_tokens(F.col("r_name")))
    asked = with_match_score(asked, name_tokens(F.col("search_name")), compare, "_score")
    trusted = ~unlinked | F.coalesce(F.col("_score") > ACCEPT_ABOVE, F.lit(False))
    told = asked.withColumn("_trusted", trusted).withColumns(
        {
            f"r_{c}": F.when(F.col("_trusted"), F.col(f"r_{c}"))
            for c in ("name", "phone", "address_raw", "website")
        }
    )
    merged = told.withColumns(
        {
            "yelp": F.coalesce("yelp", F.when(F.col("_trusted"), F.col("q_link"))),
            "found_name": F.coalesce("r_name", "found_name"),
            "website": F.coalesce("r_website", "website"),
            "phone": F.coalesce("phone", "r_phone"),
        }
    )
    raw = F.when(F.col("address").isNull(), F.col("r_address_raw"))
    return _take_address(merged, raw).select(*rows.columns)


def with_directory_page(rows: DataFrame, facts: DataFrame) -> DataFrame:
    pages = _of_source(facts, "directory", "name", "phone", "address_raw", "website")
    asked = _ask(rows, pages, "d_", need_directory(rows), F.col("yellowpages"))
    still_searched = F.col("found_name") == F.col("search_name")
    merged = asked.withColumns(
        {
            "found_name": F.coalesce(F.when(still_searched, F.col("d_name")), "found_name"),
            "phone": F.coalesce("phone", "d_phone"),
            "website": F.coalesce("website", "d_website"),
        }
    )
    raw = F.when(F.col("address").isNull(), F.col("d_address_raw"))
    return _take_address(merged, raw).select(*rows.columns)


def with_profile_page(rows: DataFrame, facts: DataFrame, above: float | None = None) -> DataFrame:
    """The first profile that the lookup finds, and how alike its name is to the listing's.

    The lookup takes what comes first, which may be somebody else's: ``profile_score`` tells, and with ``above`` only
    profiles that score more are taken. It is NULL where no profile was looked up or found.
    """
    pages = _of_source(facts, "profile", "link", "name")
    asked = _ask(rows, pages, "t_", need_profile(), lookup_key(F.col("found_name"), "profile"))
    scored = with_match_score(asked, name_tokens(F.col("found_name")), name_tokens(F.col("t_name")), "profile_score")
    if above is not None:
        scored = scored.withColumn("t_link", F.when(F.col("profile_score") > above, F.col("t_link")))
    return scored.withColumn("twitter", F.coalesce("twitter", "t_link")).select(*rows.columns, "profile_score")


def finish(rows: DataFrame, both_sides: bool = False) -> DataFrame:
    """Website fallback, phone format, score and flags."""
    scored = score_pairs(rows, "search_name", "found_name", both_sides=both_sides)
    return (
        scored.withColumn("website", F.coalesce("website", "fallback_website"))
        .withColumn("phone", phone_format(F.col("phone")))
        .select(
            "list_id",
            "line_no",
            "section",
            "search_name",
            "found_name",
            "score",
            needs_review(F.col("score")).alias("needs_review"),
            (F.col("found_name") != F.col("search_name")).alias("name_changed"),
            "address",
            (F.col("address_seen") & F.col("address").isNull()).alias("address_error"),
            "phone",
            "website",
            "facebook",
            "twitter",
            "profile_score",
            "yelp",
            "yellowpages",
            "urbanspoon",
        )
    )


def enrich(
    listings: DataFrame, facts: DataFrame, profile_above: float | None = None, both_sides: bool = False
) -> DataFrame:
    """One enriched row per listing.

    ``facts`` is the written table of :func:`listwright.operators.facts.lookup_facts`. Profiles need a score of more than
    ``profile_above``, if given; ``both_sides`` spells ``&`` out in found names too when they are scored.
    """
    rows = default_rows(listings)
    for add in (with_search_page, with_review_page, with_directory_page):
        rows = add(rows, facts)
    return finish(with_profile_page(rows, facts, profile_above), both_sides)
