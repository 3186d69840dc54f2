"""Many sources and many crawls: agreement between sources, page versions."""

from pyspark.sql import functions as F

from listwright.operators import agreement as A
from listwright.operators import versions as V
from listwright.plans.catalog.shared import table


def _claims(spark, sf_dir):
    """What shippers say about parts."""
    lines = table(spark, sf_dir, "lineitem").withColumn("source", F.concat_ws("/", F.year("l_shipdate"), "l_linenumber"))
    return A.claims_of(lines, "l_partkey", "source", "l_returnflag", "l_linestatus")


def source_reliability(spark, sf_dir):
    rated = A.source_reliability(_claims(spark, sf_dir), rounds=3)
    return rated.withColumn("reliability", F.round("reliability", 6))


def source_agreement(spark, sf_dir):
    agreed = A.agreed_values(_claims(spark, sf_dir), rounds=3)
    return agreed.withColumn("share", F.round("share", 6))


def _rounds_sql(rounds):
    """CTEs: claims, then the sources' reliability and the values' shares by round."""
    steps = [
        """claims AS (
  SELECT DISTINCT l_partkey::VARCHAR AS listing, attribute, value, year(l_shipdate) || '/' || l_linenumber AS source
  FROM lineitem, (VALUES ('l_returnflag'), ('l_linestatus')) AS v(attribute),
       LATERAL (SELECT CASE attribute WHEN 'l_returnflag' THEN l_returnflag ELSE l_linestatus END AS value)
  WHERE value <> '' AND l_partkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_linenumber IS NOT NULL),
trust0 AS (SELECT source, count(*) AS claims, 1.0::DOUBLE AS reliability FROM claims GROUP BY source)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""votes{i} AS (
  SELECT listing, attribute, value, sum(reliability) AS votes, count(*) AS sources
  FROM claims JOIN trust{i} USING (source) GROUP BY ALL),
shares{i} AS (SELECT *, votes / sum(votes) OVER (PARTITION BY listing, attribute) AS share FROM votes{i})"""
        )
        if i < rounds:
            steps.append(
                f"""trust{i + 1} AS (
  SELECT source, count(*) AS claims, avg(share) AS reliability
  FROM claims JOIN shares{i} USING (listing, attribute, value) GROUP BY source)"""
            )
    return "WITH " + ",\n".join(steps)


_RELIABILITY_SQL = f"{_rounds_sql(3)} SELECT source, claims, round(reliability, 6) AS reliability FROM trust3"
_AGREEMENT_SQL = f"""{_rounds_sql(3)},
placed AS (
  SELECT *, count(*) OVER (PARTITION BY listing, attribute) AS values,
         row_number() OVER (PARTITION BY listing, attribute ORDER BY round(share, 9) DESC, sources DESC, value) AS place
  FROM shares3)
SELECT listing, attribute, value, round(share, 6) AS share, sources, values FROM placed WHERE place = 1"""


def page_versions(spark, sf_dir):
    """For everything else a user did, the latest click before it, as a page's latest crawl."""
    events = table(spark, sf_dir, "events")
    crawls = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("version"), "value")
    asked = events.filter("event_type <> 'click'").select("event_id", "user_id", "ts")
    return V.version_at(asked, crawls, "user_id", "ts", "version")


_VERSIONS_SQL = """
WITH crawls AS (
  SELECT user_id, ts, max(event_id) AS version, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY ALL),
asked AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click')
SELECT event_id, asked.user_id, asked.ts, crawls.ts AS found_ts, version AS found_version, value AS found_value
FROM asked ASOF LEFT JOIN crawls ON asked.user_id = crawls.user_id AND asked.ts >= crawls.ts"""

QUERIES = {
    "source_reliability": (source_reliability, _RELIABILITY_SQL),
    "source_agreement": (source_agreement, _AGREEMENT_SQL),
    "page_versions": (page_versions, _VERSIONS_SQL),
}
