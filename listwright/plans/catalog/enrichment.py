"""Merging: single rules over orders and customers, and the whole run over a crawl made
from customers in which every rule of precedence has its cases."""

from pyspark.sql import functions as F

from listwright.functions.text import clean_name, lookup_key
from listwright.operators import facts as X
from listwright.operators import matching as M
from listwright.operators import merge as G
from listwright.operators.listings import listings
from listwright.plans.catalog.shared import (
    LIST_LINES_SQL,
    list_lines,
    scores_sql,
    table,
    tokens_sql,
)
from listwright.schemas import PAGES
from listwright.session import materialise


def merge_precedence(spark, sf_dir):
    """Status of the most urgent order of every customer, blank where it is still open."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.when(F.col("o_orderstatus") != "O", F.concat("o_orderpriority", F.lit("/"), "o_orderkey")).alias("value"),
        F.struct("o_orderpriority", "o_orderkey").alias("rank"),
    )
    return G.first_by_rank(orders, "o_custkey", "value", "rank")


_PRECEDENCE_SQL = """
SELECT o_custkey, o_orderpriority || '/' || o_orderkey AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place
  FROM orders WHERE o_orderstatus <> 'O') WHERE place = 1"""


def _customer_rows(spark, sf_dir):
    """Customers as half-filled rows."""
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(balance > 3000, F.col("c_name")).alias("website"),
        F.when(balance > 2000, F.col("c_name")).alias("address"),
        F.when(balance > 5000, F.col("c_name")).alias("phone"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("yellowpages"),
    )


def need_directory(spark, sf_dir):
    """Customers to look up in the directory, with their first order if there is one."""
    rows = _customer_rows(spark, sf_dir)
    needy = rows.filter(G.need_directory(rows)).select("c_custkey")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    return needy.join(orders, needy.c_custkey == orders.o_custkey, "left").select("c_custkey", "first_order")


def need_profile(spark, sf_dir):
    """Customers without a finished urgent order get the part of their number as profile."""
    customers = table(spark, sf_dir, "customer")
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    orders = finished.groupBy("o_custkey").agg(F.max("o_orderkey").cast("string").alias("twitter"))
    rows = customers.join(orders, customers.c_custkey == orders.o_custkey, "left")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("profile"))
    needy = rows.filter(G.need_profile()).select("c_custkey")
    return needy.join(parts, "c_custkey", "left")


def customer_pages(spark, sf_dir):
    """Search, review and directory pages for the customers of ``list_lines``.

    By balance and segment a customer has a spelling suggestion, a map cell, linked or
    looked-up review pages under a similar or another name, a directory page, profiles.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    c = names.repartition(parts, "c_custkey").withColumn(
        "search_name", F.concat("c_name", F.lit(" and "), "c_mktsegment")
    )
    key, segment, balance = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    nation = F.concat(F.lit("Nation_"), "c_nationkey")
    yelp = F.concat(F.lit("https://www.yelp.com/biz/"), key)

    def optional(test, *parts):
        return F.when(test, F.concat(*parts)).otherwise(F.lit(""))

    def redirect(target):
        return F.concat(F.lit('<a href="/url?q='), target, F.lit('&amp;sa=U">x</a>'))

    search = F.concat(
        optional(balance < 0, F.lit('<a class="spell">'), "c_name", F.lit(" &amp; Co</a>")),
        optional(segment != "BUILDING", F.lit("<td>(514) 555-1234</td>")),
        optional(
            segment == "AUTOMOBILE",
            F.lit('<tr><td><img src="/mapfiles/marker-noalpha.png"></td><td>'), key, F.lit(" Rue "), nation,
            F.lit(" E (450) 555-9876</td></tr>"),
        ),
        F.lit('<a class="gb" href="/url?q=http://plus.test/facebook&amp;sa=U">x</a>'),
        optional(balance > 5000, redirect(F.concat(F.lit("https://www.facebook.com/c"), key))),
        optional(balance > 8000, redirect(F.concat(F.lit("https://twitter.com/c"), key))),
        optional(segment == "MACHINERY", redirect(yelp)),
        optional(balance > 1000, redirect(F.concat(F.lit("http://www.yellowpages.ca/"), key))),
        F.lit('<div id="search"><h3 class="r">'), redirect(F.lit("http://www.zagat.com/")),
        F.lit('</h3><h3 class="r">'), redirect(F.lit("http://deep.test/a/b")),
        F.lit('</h3><h3 class="r">'), redirect(F.concat(F.lit("http://own"), key, F.lit(".test/"))),
        F.lit("</h3></div>"),
    )
    review_search = F.concat(F.lit('<a class="biz-name" href="/biz/'), key, F.lit('#hrid:x">x</a>'))
    review = F.concat(
        F.lit('<h1 class="biz-page-title">'),
        F.when((segment == "HOUSEHOLD") | balance.between(2000, 4000), F.lit("Elsewhere")).otherwise(
            F.concat("c_name", F.lit(" "), segment, F.lit(" Caf&eacute;"))
        ),
        F.lit("</h1>"),
        optional(
            balance > 6000,
            F.lit('<div class="biz-website"><a href="/biz_redir?url=http%3A%2F%2Freviewed'), key,
            F.lit('.test&amp;s=1">w</a></div>'),
        ),
        F.lit('<span class="biz-phone">(438) 555-2222</span><address>'), key, F.lit(", Boul "), nation,
        F.lit(", Montreal</address>"),
    )
    directory = F.concat(
        F.lit('<h1 itemprop="name">Directory '), "c_name",
        F.lit('</h1><address itemprop="address"><span itemprop="streetAddress">unnumbered</span></address>'
              '<li class="phone">514-555-3333</li><li class="website"><a itemprop="url" href="http://www.listed'),
        key, F.lit('.test">w</a></li>'),
    )
    profile = F.concat(
        F.lit('<a class="js-user-profile-link" href="/p'), key, F.lit('">'),
        F.when(balance > 3000, F.concat("c_name", F.lit(" Café"))).otherwise(F.lit("Somebody Else")), F.lit("</a>"),
    )

    def page(source, lookup, url, html):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(source).alias("source"),
            (none if lookup is None else lookup).alias("lookup_key"),
            (none if url is None else url).alias("url"),
            html.alias("html"),
        )

    name = F.col("search_name")
    each = F.array(
        page("search", lookup_key(name, "search"), None, search),
        page("review_search", lookup_key(name, "review"), None, review_search),
        page("review", None, yelp, review),
        page("directory", None, F.concat(F.lit("http://www.yellowpages.ca/"), key), directory),
        page("profile", lookup_key(F.concat("c_name", F.lit(" "), segment, F.lit(" Café")), "profile"), None, profile),
    )
    return c.select(key.alias("page_id"), F.inline(each)).select(PAGES.names)


def enrich_listings(spark, sf_dir):
    """Lists through the whole merge against the made crawl."""
    facts = materialise(X.lookup_facts(X.page_facts(customer_pages(spark, sf_dir))), "page-facts", "source")
    enriched = G.enrich(listings(list_lines(spark, sf_dir)), facts)
    return enriched.withColumns({c: F.round(c, 6) for c in ("score", "profile_score")})


def checked_profiles(spark, sf_dir):
    """The profiles that remain when a lookup's hit must carry the listing's name."""
    facts = materialise(X.lookup_facts(X.page_facts(customer_pages(spark, sf_dir))), "page-facts", "source")
    enriched = G.enrich(listings(list_lines(spark, sf_dir)), facts, profile_above=0.75)
    return enriched.select("list_id", "line_no", "twitter", F.round("profile_score", 6).alias("profile_score"))


def review_flag_both_sides(spark, sf_dir):
    """Review flags of names with ``&``, spelled out on one side and on both."""
    name = F.concat("c_name", F.lit(" & "), F.substr("c_mktsegment", F.lit(1), F.lit(3)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", clean_name(name).alias("search_name"), name.alias("found_name"))
    one = M.score_pairs(rows, "search_name", "found_name", "one_side")
    both = M.score_pairs(one, "search_name", "found_name", "both_sides", both_sides=True)
    return both.select(
        "c_custkey",
        M.needs_review(F.col("one_side")).alias("one_side"),
        M.needs_review(F.col("both_sides")).alias("both_sides"),
    )


def _side_sql(found):
    pairs = f"SELECT c_custkey AS id, {tokens_sql('search_name')} AS ta, {tokens_sql(found)} AS tb FROM sides"
    return f"(WITH {scores_sql(pairs)} SELECT id, score < 0.8 AS flag FROM scored)"


_BOTH_SIDES_SQL = f"""
WITH sides AS (
  SELECT c_custkey, c_name || ' & ' || left(c_mktsegment, 3) AS found_name, replace(found_name, '&', 'and') AS search_name FROM customer)
SELECT one.id AS c_custkey, one.flag AS one_side, both_of.flag AS both_sides
FROM {_side_sql('found_name')} one JOIN {_side_sql("replace(found_name, '&', 'and')")} both_of ON one.id = both_of.id"""

ENRICH_SQL = rf"""
WITH named AS (
  SELECT list_id, line_no, replace(trim(line, ' ' || chr(9)), '&', 'and') AS search_name FROM ({LIST_LINES_SQL})),
sectioned AS (
  SELECT *, last_value(CASE WHEN search_name LIKE '%:' THEN rtrim(search_name, ':') END IGNORE NULLS)
            OVER (PARTITION BY list_id ORDER BY line_no) AS section FROM named WHERE search_name <> ''),
base AS (
  SELECT list_id, line_no, section, search_name, c_custkey AS k, c_name, c_mktsegment AS seg, c_acctbal AS bal,
         'Nation_' || c_nationkey AS nation, c_mktsegment = 'MACHINERY' AS linked,
         c_mktsegment = 'HOUSEHOLD' OR c_acctbal BETWEEN 2000 AND 4000 AS elsewhere
  FROM sectioned JOIN customer ON search_name = c_name || ' and ' || c_mktsegment
  WHERE search_name NOT LIKE '%:'),
checked AS (SELECT *, linked OR NOT elsewhere AS reviewed, c_name || ' ' || seg || ' Café' AS title FROM base),
told AS (
  SELECT *,
    CASE WHEN reviewed THEN CASE WHEN elsewhere THEN 'Elsewhere' ELSE title END
         WHEN bal < 0 THEN c_name || ' & Co' END AS told_name,
    CASE WHEN seg = 'AUTOMOBILE' THEN k || ' ' || nation || ' Street East'
         WHEN reviewed THEN k || ' ' || nation || ' Boulevard' END AS address,
    CASE WHEN seg = 'AUTOMOBILE' THEN '450.555.9876' WHEN seg <> 'BUILDING' THEN '514.555.1234'
         WHEN reviewed THEN '438.555.2222' END AS phone,
    CASE WHEN bal > 6000 AND reviewed THEN 'http://reviewed' || k || '.test' END AS site,
    CASE WHEN bal > 1000 THEN 'http://www.yellowpages.ca/' || k END AS yellowpages
  FROM checked),
found AS (
  SELECT *, yellowpages IS NOT NULL AND (site IS NULL OR address IS NULL OR phone IS NULL) AS listed FROM told),
merged AS (
  SELECT *, coalesce(told_name, CASE WHEN listed THEN 'Directory ' || c_name END, search_name) AS found_name,
         coalesce(phone, CASE WHEN listed THEN '514.555.3333' END) AS merged_phone FROM found),
{scores_sql(f"SELECT k AS id, {tokens_sql('search_name')} AS ta, {tokens_sql('found_name')} AS tb FROM merged")},
profiles AS (
  SELECT k, found_name, CASE WHEN bal > 3000 THEN c_name || ' Café' ELSE 'Somebody Else' END AS profile
  FROM merged WHERE found_name = title AND bal <= 8000),
profile_scores AS (
  WITH {scores_sql(f"SELECT k AS id, {tokens_sql('found_name')} AS ta, {tokens_sql('profile')} AS tb FROM profiles")}
  SELECT id AS profile_id, score AS profile_score FROM scored)
SELECT list_id, line_no, section, search_name, found_name, round(score, 6) AS score, score < 0.8 AS needs_review,
       found_name <> search_name AS name_changed, address, listed AND address IS NULL AS address_error,
       merged_phone AS phone,
       coalesce(site, CASE WHEN listed THEN 'listed' || k || '.test' END, 'http://own' || k || '.test/') AS website,
       CASE WHEN bal > 5000 THEN 'https://www.facebook.com/c' || k END AS facebook,
       CASE WHEN bal > 8000 THEN 'https://twitter.com/c' || k
            WHEN found_name = title THEN 'twitter.com/p' || k END AS twitter,
       round(profile_score, 6) AS profile_score,
       CASE WHEN reviewed THEN 'https://www.yelp.com/biz/' || k END AS yelp,
       yellowpages, NULL::VARCHAR AS urbanspoon
FROM merged JOIN scored ON id = k LEFT JOIN profile_scores ON profile_id = k"""

_CHECKED_SQL = f"""
SELECT list_id, line_no, profile_score, CASE WHEN twitter LIKE 'https:%' OR profile_score > 0.75 THEN twitter END AS twitter
FROM ({ENRICH_SQL})"""

QUERIES = {
    "merge_precedence": (merge_precedence, _PRECEDENCE_SQL),
    "need_directory": (
        need_directory,
        "SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey"
        " WHERE c_mktsegment <> 'BUILDING' AND c_acctbal <= 5000 GROUP BY c_custkey",
    ),
    "need_profile": (
        need_profile,
        "SELECT c_custkey, p_name AS profile FROM customer LEFT JOIN part ON p_partkey = c_custkey"
        " WHERE c_custkey NOT IN (SELECT o_custkey FROM orders"
        " WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    ),
    "enrich_listings": (enrich_listings, ENRICH_SQL),
    "checked_profiles": (checked_profiles, _CHECKED_SQL),
    "review_flag_both_sides": (review_flag_both_sides, _BOTH_SIDES_SQL),
}
