"""Phones and links."""

from pyspark.sql import functions as F

from listwright.functions import phones as P
from listwright.functions import urls as U
from listwright.operators import links as K
from listwright.operators import phones as J
from listwright.plans.catalog.shared import joined_words, table

JUNK_HOSTS = ["spam-farm", "cheap-pills", "casino-win", "free-bets"]

_ANY_SQL = r"[\( ]?\d{3}[\)]?[ \.]?\d{3}[-\. ]\d{4}"
_STRICT_SQL = r"^(?:\([2-9]\d{2}\)\ ?|[2-9]\d{2}(?:\-?|\ ?))[2-9]\d{2}[- ]?\d{4}$"
_LOOSE_SQL = r"[(]{0,1}\d{3}[) \.]{0,2}\d{3}[ -\.]{0,1}\d{4}"


def phone_text_node(spark, sf_dir):
    """First phone that is a text node of its own: pages whose text is cut at the phones."""
    documents = table(spark, sf_dir, "documents")
    html = F.regexp_replace("text", r"\+1 (\(\d{3}\) \d{3}-\d{4})", "<b>$1</b>")
    return documents.select("doc_id", P.phone_text_node(html).alias("phone"))


def phone_text_node_of_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.phone_text_node(F.col("html")).alias("phone"))


def phone_loose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.phone_loose(F.col("text")).alias("phone"))


def phones_all(spark, sf_dir):
    return J.source_phones(table(spark, sf_dir, "documents"), "doc_id", "text")


def phone_counts(spark, sf_dir):
    return J.phone_counts(phones_all(spark, sf_dir))


def phone_format(spark, sf_dir):
    return phone_loose(spark, sf_dir).withColumn("phone", P.phone_format(F.col("phone")))


_PHONES_ALL_SQL = (
    f"SELECT doc_id AS source_id, translate(trim(unnest(regexp_extract_all(text, '{_ANY_SQL}'))), ' -()', '..')"
    " AS phone FROM documents"
)


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def unwrap_redirect(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", U.unwrap_redirect(F.col("url")).alias("target"))


def unquote_redirect(spark, sf_dir):
    href = F.concat(F.lit("/biz_redir?url="), F.url_encode("url"), F.lit("&src=x"))
    return _urls(spark, sf_dir).select("page_id", U.unquote_redirect(href).alias("target"))


def display_url(spark, sf_dir):
    shown = F.concat("url", F.lit("/caf%25C3%25A9+bar"))
    return _urls(spark, sf_dir).select("page_id", U.display_url(shown).alias("shown"))


def host_labels(spark, sf_dir):
    return _urls(spark, sf_dir).select(
        "page_id",
        joined_words(U.host_labels(F.col("url"))).alias("labels"),
        U.has_host(F.col("url")).alias("has_host"),
    )


def host_denylist(spark, sf_dir):
    return K.allowed_links(_urls(spark, sf_dir), "url", JUNK_HOSTS)


def host_denylist_table(spark, sf_dir):
    """Links whose host has no label in common with the hosts of links that have a fragment."""
    urls = _urls(spark, sf_dir)
    denied = urls.filter(F.contains("url", F.lit("#"))).select(F.get(U.host_labels(F.col("url")), F.lit(0)).alias("label"))
    return K.allowed_links_by_table(urls, denied)


def _some_cut(spark, sf_dir):
    """Links of which those with a fragment are cut down to their host."""
    host = F.regexp_extract("url", "^https?://[^/]+", 0)
    return _urls(spark, sf_dir).select(
        "page_id",
        F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"),
        F.when(F.contains("url", F.lit("#")), F.concat(host, F.lit("/"))).otherwise(F.col("url")).alias("url"),
    )


_SOME_CUT_SQL = r"""
  SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang,
         CASE WHEN contains(url, '#') THEN regexp_extract(url, '^https?://[^/]+') || '/' ELSE url END AS url
  FROM pages"""


def root_urls_only(spark, sf_dir):
    return K.root_links(_some_cut(spark, sf_dir))


def first_website(spark, sf_dir):
    """First allowed root link of every language, by page."""
    links = K.root_links(K.allowed_links(_some_cut(spark, sf_dir), "url", JUNK_HOSTS))
    return K.first_links(links, "lang", "url", "page_id")


def strip_www(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", U.strip_www(F.col("url")).alias("website"))


_LABELS_SQL = "string_split(split_part(split_part(url, '//', 2), '/', 1), '.')"
_JUNK_SQL = "('spam-farm', 'cheap-pills', 'casino-win', 'free-bets')"
_ALLOWED_SQL = f"{_LABELS_SQL}[1] <> '' AND len(list_filter({_LABELS_SQL}, lambda w: w IN {_JUNK_SQL})) = 0"
_DENIED_TABLE_SQL = f"""
WITH denied AS (SELECT DISTINCT {_LABELS_SQL}[1] AS label FROM pages WHERE contains(url, '#'))
SELECT page_id, url FROM pages
WHERE {_LABELS_SQL}[1] <> '' AND NOT EXISTS (SELECT 1 FROM denied WHERE list_contains({_LABELS_SQL}, label))"""
_ROOT_SQL = "regexp_matches(url, '^https?://[^/]+/*$')"

QUERIES = {
    "phone_text_node": (
        phone_text_node,
        rf"SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '\+1 (\(\d{{3}}\) \d{{3}}-\d{{4}})',"
        rf" '<b>\1</b>', 'g'), '<[^>]*>'), lambda t: regexp_matches(t, '{_STRICT_SQL}'))[1] AS phone FROM documents",
    ),
    "phone_text_node_of_pages": (
        phone_text_node_of_pages,
        f"SELECT page_id, list_filter(string_split_regex(html, '<[^>]*>'),"
        f" lambda t: regexp_matches(t, '{_STRICT_SQL}'))[1] AS phone FROM pages",
    ),
    "phone_loose": (
        phone_loose, f"SELECT doc_id, nullif(regexp_extract(text, '{_LOOSE_SQL}'), '') AS phone FROM documents",
    ),
    "phones_all": (phones_all, _PHONES_ALL_SQL),
    "phone_counts": (
        phone_counts, f"SELECT phone, count(*)::BIGINT AS mentions FROM ({_PHONES_ALL_SQL}) GROUP BY phone",
    ),
    "phone_format": (
        phone_format,
        f"SELECT doc_id, translate(nullif(regexp_extract(text, '{_LOOSE_SQL}'), ''), ' -()', '..') AS phone"
        " FROM documents",
    ),
    "unwrap_redirect": (
        unwrap_redirect,
        "SELECT page_id, regexp_extract(split_part(url, '&', 1), '=(.*)$', 1) AS target FROM pages",
    ),
    "unquote_redirect": (
        unquote_redirect, "SELECT page_id, split_part(url, '&', 1) AS target FROM pages",
    ),
    "display_url": (display_url, "SELECT page_id, url || '/café+bar' AS shown FROM pages"),
    "host_labels": (
        host_labels,
        f"SELECT page_id, array_to_string({_LABELS_SQL}, ' ') AS labels, {_LABELS_SQL}[1] <> '' AS has_host FROM pages",
    ),
    "host_denylist": (host_denylist, f"SELECT page_id, url FROM pages WHERE {_ALLOWED_SQL}"),
    "host_denylist_table": (host_denylist_table, _DENIED_TABLE_SQL),
    "root_urls_only": (root_urls_only, f"SELECT * FROM ({_SOME_CUT_SQL}) WHERE {_ROOT_SQL}"),
    "first_website": (
        first_website,
        f"SELECT lang, arg_min(url, page_id) AS website FROM ({_SOME_CUT_SQL})"
        f" WHERE {_ALLOWED_SQL} AND {_ROOT_SQL} GROUP BY lang",
    ),
    "strip_www": (
        strip_www,
        "SELECT page_id, CASE WHEN contains(url, 'www.') THEN substr(url, strpos(url, 'www.') + 4)"
        " ELSE regexp_replace(url, '^[a-z]+://', '') END AS website FROM pages",
    ),
}
