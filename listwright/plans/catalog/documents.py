"""Reports over customers as enriched listings, a list per nation."""

import uuid

from pyspark.sql import functions as F

from listwright.fixed_values import REPORT_SUFFIX
from listwright.functions import rtf as R
from listwright.operators import measures as G
from listwright.operators import report as D
from listwright.operators.matching import needs_review
from listwright.plans.catalog.shared import documents, table
from listwright.session import on_its_file_system, shared_folder
from listwright.sources.reports import read_documents, write_named_documents


def enriched_customers(spark, sf_dir):
    balance, key = F.col("c_acctbal"), F.col("c_custkey").cast("string")
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("n_name").alias("list_id"),
        F.col("c_custkey").alias("line_no"),
        F.col("c_name").alias("search_name"),
        F.concat("c_name", F.lit(" {Café} & L’Été")).alias("found_name"),
        F.round(balance / 10000, 4).alias("score"),
        needs_review(balance / 10000).alias("needs_review"),
        F.when(balance > 0, F.concat(key, F.lit(" Saint-Denis Street"))).alias("address"),
        F.when(balance > 2000, F.concat(F.lit("514.555."), F.right("c_name", F.lit(4)))).alias("phone"),
        F.when(balance < 6000, F.concat(F.lit("http://www.c.test/t%25C3%25AAte/"), key)).alias("website"),
        F.when(balance > 4000, F.concat(F.lit("https://www.facebook.com/caf%C3%A9/"), key)).alias("facebook"),
        F.when(balance < 3000, F.concat(F.lit("twitter.com/"), key)).alias("twitter"),
    )


ENRICHED_SQL = """
  SELECT n_name AS list_id, c_custkey AS line_no, c_name AS search_name, c_name || ' {Café} & L’Été' AS found_name,
    round(c_acctbal / 10000, 4) AS score, c_acctbal / 10000 < 0.8 AS needs_review,
    CASE WHEN c_acctbal > 0 THEN c_custkey || ' Saint-Denis Street' END AS address,
    CASE WHEN c_acctbal > 2000 THEN '514.555.' || right(c_name, 4) END AS phone,
    CASE WHEN c_acctbal < 6000 THEN 'http://www.c.test/t%25C3%25AAte/' || c_custkey END AS website,
    CASE WHEN c_acctbal > 4000 THEN 'https://www.facebook.com/caf%C3%A9/' || c_custkey END AS facebook,
    CASE WHEN c_acctbal < 3000 THEN 'twitter.com/' || c_custkey END AS twitter
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""

_NL = "chr(10)"


def _field_sql(url, label):
    return (
        f"'{{\\field{{\\*\\fldinst{{HYPERLINK ' || {url} || '}}}}{{\\fldrslt{{\\ul\\cf1' || {label}"
        f" || '}}}}}} \\line' || {_NL}"
    )


_WEBSITE_SQL = _field_sql("website", "replace(website, '%25C3%25AA', '\\u234?')")
_FACEBOOK_SQL = (
    f"{_field_sql('facebook', chr(39) + 'Facebook' + chr(39))}"
    f" || replace(facebook, '%C3%A9', '\\u233?') || ' \\line' || {_NL}"
)
_TWITTER_SQL = f"{_field_sql('twitter', chr(39) + 'Twitter' + chr(39))} || twitter || ' \\line' || {_NL}"

BLOCKS_SQL = f"""
  SELECT list_id, line_no,
    CASE WHEN needs_review THEN 'Search: ' || search_name || '\\line' || {_NL} ELSE '' END
    || search_name || ' \\u123?Caf\\u233?\\u125? & L\\u8217?\\u201?t\\u233? \\line' || {_NL}
    || coalesce(address || ' \\line' || {_NL}, '') || coalesce(phone || ' \\line' || {_NL}, '')
    || coalesce({_WEBSITE_SQL}, '') || coalesce({_FACEBOOK_SQL}, '') || coalesce({_TWITTER_SQL}, '')
    || '\\line' || {_NL} || {_NL} AS block
  FROM ({ENRICHED_SQL})"""

_HEADER_SQL = (
    "'{\\rtf1\\ansi\\ansicpg1252\\deff0\\deflang1033{\\fonttbl{\\f0\\fnil\\fcharset0 Helvetica;}}' || chr(10)"
    " || '{\\colortbl ;\\red0\\green0\\blue255;}' || chr(10) || '{\\*\\generator Msftedit 5.41.21.2509;}"
    "\\viewkind4\\uc1\\pard\\sa200\\sl276\\slmult1\\lang9\\f0\\fs22' || chr(10) || chr(10)"
)
ROWS_SQL = f"""
  SELECT list_id, line_no, block AS text FROM ({BLOCKS_SQL})
  UNION ALL SELECT DISTINCT n_name, -1, {_HEADER_SQL} FROM nation JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT n_name, 9223372036854775807, '}}' FROM nation JOIN customer ON c_nationkey = n_nationkey"""


def attributes_long(spark, sf_dir):
    return D.attributes_long(enriched_customers(spark, sf_dir))


_LONG_SQL = " UNION ALL ".join(
    f"SELECT list_id, line_no, {i}::INTEGER AS ordinal, '{name}' AS attribute, {name} AS value"
    f" FROM ({ENRICHED_SQL}) WHERE {name} IS NOT NULL"
    for i, name in enumerate(["address", "phone", "website", "facebook", "twitter"])
)


def link_markup(spark, sf_dir):
    rows = enriched_customers(spark, sf_dir)
    return rows.select(
        "list_id", "line_no", *[R.attribute_markup(c, F.col(c)).alias(c) for c in ("website", "facebook", "twitter")]
    )


def escape_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", R.escape_text(F.col("text")).alias("escaped"))


_ESCAPE_SQL = r"""
SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c:
  CASE WHEN unicode(c) < 32 OR unicode(c) > 127 OR c IN ('\', '{', '}')
       THEN '\u' || (CASE WHEN unicode(c) < 32768 THEN unicode(c) ELSE unicode(c) - 65536 END) || '?'
       ELSE c END), '') AS escaped
FROM documents"""


def report_blocks(spark, sf_dir):
    return D.report_blocks(enriched_customers(spark, sf_dir))


def write_report(spark, sf_dir):
    """The rows a report is written from, header and close included."""
    return D.document_rows(report_blocks(spark, sf_dir))


def assemble_document(spark, sf_dir):
    return D.document_parts(write_report(spark, sf_dir), part_lines=100)


def written_reports(spark, sf_dir):
    """Reports as written: every file's name, size and digest, read back."""
    # The folder may be named as only Spark understands it; the report's writers open it themselves.
    folder = f"{on_its_file_system(spark, shared_folder(spark)).rstrip('/')}/reports-{uuid.uuid4().hex}"
    write_named_documents(write_report(spark, sf_dir), folder, REPORT_SUFFIX, part_lines=250)
    read = read_documents(spark, folder)
    return read.select("file", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("sha256"))


_WRITTEN_SQL = f"""
  WITH blocks AS (
    SELECT list_id, floor(line_no / 250.0) AS block, line_no, text, count(*) OVER (PARTITION BY list_id) AS n
    FROM ({ROWS_SQL})
  ), sizes AS (
    SELECT list_id, block, sum(count(*)) OVER (PARTITION BY list_id ORDER BY block) - count(*) AS before FROM blocks GROUP BY list_id, block
  ), parts AS (SELECT *, CAST(before // 250 AS INT) AS part, max(CAST(before // 250 AS INT)) OVER (PARTITION BY list_id) + 1 AS parts FROM sizes)
  SELECT list_id || '_HYPERLINKED' || CASE WHEN parts > 1 THEN '-' || lpad(part::VARCHAR, 5, '0') ELSE '' END || '.rtf' AS file,
    sum(length(text))::BIGINT AS chars, sha256(string_agg(text, '' ORDER BY line_no)) AS sha256
  FROM blocks JOIN parts USING (list_id, block) GROUP BY 1"""


def write_profile_list(spark, sf_dir):
    return D.profile_list_rows(enriched_customers(spark, sf_dir), "twitter")


def run_report(spark, sf_dir):
    rates = D.fill_rates(enriched_customers(spark, sf_dir))
    return rates.withColumn("mean_score", F.round("mean_score", 6))


def run_measures(spark, sf_dir):
    """Three runs over a third of the customers each, added up."""
    rows = enriched_customers(spark, sf_dir).withColumn("section", F.when(F.col("line_no") % 5 > 0, F.concat(F.lit("s"), F.col("line_no") % 2)))
    days = [G.sketches(rows.filter(F.col("line_no") % 3 == day)) for day in range(3)]
    whole = G.merged(days[0].unionByName(days[1]).unionByName(days[2]))
    # Distinct phones are an estimate: they have a test instead.
    return G.measured(whole, 0.1, 0.5).drop("distinct_phones")


_MEASURES_SQL = f"""
WITH rows AS (
  SELECT *, CASE WHEN line_no % 5 > 0 THEN 's' || (line_no % 2) END AS section, floor(score * 1000)::INTEGER AS raw_bin FROM ({ENRICHED_SQL})),
keyed AS (
  SELECT 'section' AS level, list_id, section, * EXCLUDE (list_id, section) FROM rows
  UNION ALL SELECT 'list', list_id, NULL, * EXCLUDE (list_id, section) FROM rows
  UNION ALL SELECT 'total', NULL, NULL, * EXCLUDE (list_id, section) FROM rows)
SELECT level, list_id, section, count(*) AS names, count(address) AS address, count(phone) AS phone, count(website) AS website,
       count(facebook) AS facebook, count(twitter) AS twitter, count(*) FILTER (needs_review) AS flagged, count(score) AS scored,
       quantile_disc(least(raw_bin, 1000), 0.1) / 1000 AS score_10, quantile_disc(least(raw_bin, 1000), 0.5) / 1000 AS score_50
FROM keyed GROUP BY level, list_id, section"""

QUERIES = {
    "run_measures": (run_measures, _MEASURES_SQL),
    "attributes_long": (attributes_long, _LONG_SQL),
    "link_markup": (
        link_markup,
        f"SELECT list_id, line_no, {_WEBSITE_SQL} AS website, {_FACEBOOK_SQL} AS facebook, {_TWITTER_SQL} AS twitter"
        f" FROM ({ENRICHED_SQL})",
    ),
    "escape_text": (escape_text, _ESCAPE_SQL),
    "report_blocks": (report_blocks, BLOCKS_SQL),
    "write_report": (write_report, ROWS_SQL),
    "written_reports": (written_reports, _WRITTEN_SQL),
    "assemble_document": (
        assemble_document,
        "SELECT list_id, CASE WHEN line_no < 0 THEN -1 ELSE line_no // 100 END AS part_no,"
        f" string_agg(text, '' ORDER BY line_no) AS text FROM ({ROWS_SQL}) GROUP BY 1, 2",
    ),
    "write_profile_list": (
        write_profile_list,
        f"SELECT list_id, line_no, search_name || chr(10) || coalesce(twitter || chr(10), '') || chr(10) AS text"
        f" FROM ({ENRICHED_SQL})",
    ),
    "run_report": (
        run_report,
        "SELECT list_id, count(*)::BIGINT AS names, count(address) AS address, count(phone) AS phone,"
        " count(website) AS website, count(facebook) AS facebook, count(twitter) AS twitter,"
        " round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE needs_review) AS flagged"
        f" FROM ({ENRICHED_SQL}) GROUP BY list_id",
    ),
}
