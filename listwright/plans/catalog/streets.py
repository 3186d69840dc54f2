"""Addresses: one street address per supplier, written four ways."""

from pyspark.sql import functions as F

from listwright.functions import addresses as A
from listwright.operators import gazetteer as Z
from listwright.operators.addresses import standardise_addresses
from listwright.plans.catalog.shared import joined_words, table


def supplier_addresses(spark, sf_dir):
    """(s_suppkey, raw)"""
    joined = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    region = F.col("n_regionkey")
    middle = (
        F.when(region == 0, " Rue Saint-")
        .when(region == 1, ", Boul ")
        .when(region == 2, "A Avenue ")
        .when(region == 3, "Blvd De-La ")
        .otherwise(" Place ")
    )
    raw = F.concat(F.col("s_suppkey") + 1, middle, "n_name", F.lit(" E , Montreal, QC"))
    return joined.select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.lit("no number")).otherwise(raw).alias("raw"))


SUPPLIER_ADDRESSES_SQL = """
  SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'no number' ELSE (s_suppkey + 1) ||
    CASE n_regionkey WHEN 0 THEN ' Rue Saint-' WHEN 1 THEN ', Boul ' WHEN 2 THEN 'A Avenue '
                     WHEN 3 THEN 'Blvd De-La ' ELSE ' Place ' END || n_name || ' E , Montreal, QC' END AS raw
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _expand_sql(tokens):
    return f"""list_transform({tokens}, lambda t: CASE t
      WHEN 'boul' THEN 'boulevard' WHEN 'blvd' THEN 'boulevard' WHEN 'bd' THEN 'boulevard'
      WHEN 'ch' THEN 'chemin' WHEN 'av' THEN 'avenue' WHEN 'o' THEN 'ouest' WHEN 'e' THEN 'est'
      WHEN 'n' THEN 'nord' WHEN 's' THEN 'sud' ELSE t END)"""


_LIFT_SQL = """list_concat(
      list_filter(expanded, lambda t: t NOT IN ('rue', 'avenue', 'boulevard', 'chemin', 'ouest', 'nord', 'sud', 'est')),
      list_filter([CASE list_filter(expanded, lambda t: t IN ('rue', 'avenue', 'boulevard', 'chemin'))[-1]
        WHEN 'rue' THEN 'street' WHEN 'avenue' THEN 'avenue' WHEN 'boulevard' THEN 'boulevard'
        WHEN 'chemin' THEN 'road' END], lambda t: t IS NOT NULL),
      list_filter([CASE list_filter(expanded, lambda t: t IN ('ouest', 'nord', 'sud', 'est'))[-1]
        WHEN 'ouest' THEN 'west' WHEN 'nord' THEN 'north' WHEN 'sud' THEN 'south'
        WHEN 'est' THEN 'east' END], lambda t: t IS NOT NULL))"""

_CAPITALISE_SQL = """array_to_string(list_transform(lifted, lambda t:
      array_to_string(list_transform(string_split(t, '-'), lambda w: upper(w[1]) || lower(w[2:])), '-')), ' ')"""

_STEPS_SQL = rf"""
WITH addresses AS ({SUPPLIER_ADDRESSES_SQL}),
numbered AS (SELECT s_suppkey, raw,
  nullif(rtrim(regexp_extract(raw, '^(\d{{1,5}}[A-Z][ ,]|\d{{1,5}})', 1), ' ,'), '') AS number FROM addresses),
parted AS (SELECT *, lower(rtrim(split_part(ltrim(substr(raw, length(number) + 1), ' ,'), ',', 1), ' ')) AS street
  FROM numbered),
opened AS (SELECT *, {_expand_sql("list_filter(string_split_regex(street, '[ ]+'), lambda t: t <> '')")} AS expanded
  FROM parted),
moved AS (SELECT *, {_LIFT_SQL} AS lifted FROM opened),
done AS (SELECT *, {_CAPITALISE_SQL} AS standard FROM moved)
"""


def house_number(spark, sf_dir):
    return supplier_addresses(spark, sf_dir).select("s_suppkey", A.house_number(F.col("raw")).alias("number"))


def _streets(spark, sf_dir):
    return supplier_addresses(spark, sf_dir).select("s_suppkey", A.street_part(F.col("raw")).alias("street"))


def street_part(spark, sf_dir):
    return _streets(spark, sf_dir)


def _expanded(spark, sf_dir):
    tokens = A.expand_abbreviations(A.street_tokens(F.col("street")))
    return _streets(spark, sf_dir).select("s_suppkey", tokens.alias("tokens"))


def expand_abbrev(spark, sf_dir):
    return _expanded(spark, sf_dir).select("s_suppkey", joined_words(F.col("tokens")).alias("expanded"))


def _lifted(spark, sf_dir):
    return _expanded(spark, sf_dir).select(
        "s_suppkey", A.lift_type_and_direction(F.col("tokens")).alias("tokens")
    )


def lift_type_direction(spark, sf_dir):
    return _lifted(spark, sf_dir).select("s_suppkey", joined_words(F.col("tokens")).alias("lifted"))


def capitalise_hyphen(spark, sf_dir):
    return _lifted(spark, sf_dir).select("s_suppkey", A.capitalise_tokens(F.col("tokens")).alias("street"))


def compose_address(spark, sf_dir):
    return standardise_addresses(supplier_addresses(spark, sf_dir), "raw").drop("raw")


def punctuation_free_address(spark, sf_dir):
    return supplier_addresses(spark, sf_dir).select(
        "s_suppkey", A.punctuation_free_address(F.col("raw")).alias("address")
    )


_FREE_SQL = f"""
WITH addresses AS ({SUPPLIER_ADDRESSES_SQL}),
opened AS (SELECT s_suppkey, {_expand_sql(
    "list_filter(string_split_regex(replace(replace(replace(lower(raw), '.', ''), ',', ''), '-', ' '), '[ ]+'),"
    " lambda t: t <> '')")} AS every FROM addresses),
typed AS (SELECT s_suppkey, every AS expanded, len(list_filter(every, lambda t:
    t IN ('rue', 'avenue', 'boulevard', 'chemin'))) > 0 AS has_type FROM opened),
moved AS (SELECT s_suppkey, CASE WHEN has_type THEN {_LIFT_SQL} ELSE list_filter(expanded, lambda t:
    t NOT IN ('ouest', 'nord', 'sud', 'est')) END AS lifted FROM typed)
SELECT s_suppkey, {_CAPITALISE_SQL} AS address FROM moved"""


def find_addresses_in_text(spark, sf_dir):
    text = F.concat(F.lit("Visit us: "), "raw", F.lit("; tel."))
    return supplier_addresses(spark, sf_dir).select(
        "s_suppkey",
        F.explode(A.addresses_in_text(text)).alias("found"),
        F.size(A.addresses_in_text(text, narrow=True)).cast("bigint").alias("narrow"),
    )


_FIND_SQL = rf"""
SELECT s_suppkey, unnest(regexp_extract_all(text, '\d{{1,5}}[ ][\w -\.,]*[mM]ontr[eé]al[\w -\.,]*')) AS found,
       len(regexp_extract_all(text, '\d{{1,5}}[ ][A-Za-z -\.,]*[mM]ontr[eé]al[\w -\.,]{{2,15}}'))::BIGINT AS narrow
FROM (SELECT s_suppkey, 'Visit us: ' || raw || '; tel.' AS text FROM ({SUPPLIER_ADDRESSES_SQL}))"""

def find_addresses_by_street(spark, sf_dir):
    """Addresses without a city, of streets known from every second supplier."""
    raw = supplier_addresses(spark, sf_dir)
    known = Z.streets(raw.filter("s_suppkey % 2 = 0"), "raw")
    text = F.concat(F.lit("Since 10 years at "), F.substring_index("raw", " ,", 1), F.lit("; call 514 555 1234 or visit."))
    return Z.find_addresses(raw.select("s_suppkey", text.alias("text")), known, "s_suppkey").drop("pos")


_BY_STREET_SQL = f"""{_STEPS_SQL},
known AS (SELECT DISTINCT array_to_string(expanded, ' ') AS phrase FROM done WHERE s_suppkey % 2 = 0 AND number IS NOT NULL)
SELECT s_suppkey, number, standard AS street, number || ' ' || standard AS address
FROM done WHERE number IS NOT NULL AND array_to_string(expanded, ' ') IN (SELECT phrase FROM known)"""

QUERIES = {
    "house_number": (house_number, f"{_STEPS_SQL} SELECT s_suppkey, number FROM done"),
    "street_part": (street_part, f"{_STEPS_SQL} SELECT s_suppkey, street FROM done"),
    "expand_abbrev": (
        expand_abbrev, f"{_STEPS_SQL} SELECT s_suppkey, array_to_string(expanded, ' ') AS expanded FROM done",
    ),
    "lift_type_direction": (
        lift_type_direction,
        f"{_STEPS_SQL} SELECT s_suppkey, CASE WHEN number IS NOT NULL THEN array_to_string(lifted, ' ') END"
        " AS lifted FROM done",
    ),
    "capitalise_hyphen": (
        capitalise_hyphen,
        f"{_STEPS_SQL} SELECT s_suppkey, CASE WHEN number IS NOT NULL THEN standard END AS street FROM done",
    ),
    "compose_address": (
        compose_address,
        f"{_STEPS_SQL} SELECT s_suppkey, number || ' ' || standard AS address,"
        " number IS NULL AS address_error FROM done",
    ),
    "punctuation_free_address": (punctuation_free_address, _FREE_SQL),
    "find_addresses_in_text": (find_addresses_in_text, _FIND_SQL),
    "find_addresses_by_street": (find_addresses_by_street, _BY_STREET_SQL),
}
