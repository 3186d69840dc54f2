"""Inputs and SQL pieces several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import html as H


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def joined_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, h1, ad) of every page."""
    html = H.shown_html(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        H.first_element_text(html, "title").alias("title"),
        H.first_element_text(html, "h1").alias("h1"),
        H.first_element_text(html, "div", "class", "ad").alias("ad"),
    )


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list_id, line_no, line): a list per nation with headers, blanks, padding and '&'.

    A customer's name stands at line 4 * key + 3; line 4 * key + 1 is a header where the
    customer owes money, line 4 * key + 2 is blank.
    """
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    name = F.concat(F.lit("  "), F.col("c_name"), F.lit(" & "), F.col("c_mktsegment"), F.lit("\t"))
    header = F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" Debtor "), "c_custkey", F.lit(": ")))
    each = F.array(
        *[
            F.struct((4 * F.col("c_custkey") + at).alias("line_no"), line.alias("line"))
            for at, line in ((1, header), (2, F.lit("   ")), (3, name))
        ]
    )
    return customers.select(F.col("n_name").alias("list_id"), F.inline(each)).filter("line is not null")


LIST_LINES_SQL = """
  SELECT n_name AS list_id, 4 * c_custkey + k AS line_no,
         CASE k WHEN 1 THEN ' Debtor ' || c_custkey || ': ' WHEN 2 THEN '   '
                ELSE '  ' || c_name || ' & ' || c_mktsegment || chr(9) END AS line
  FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1), (2), (3)) AS v(k)
  WHERE k <> 1 OR c_acctbal < 0
"""

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
SHOWN_SQL = (
    r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"
)


def fold_sql(text: str) -> str:
    return rf"regexp_replace(strip_accents({text}), '[^\x00-\x7F]', '', 'g')"


def text_sql(fragment: str) -> str:
    """Tags out, the references of the test pages decoded, trimmed."""
    plain = f"regexp_replace({fragment}, '<[^>]*>', '', 'g')"
    for reference, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = f"replace({plain}, '{reference}', '{char}')"
    return f"trim({plain}, {BLANKS_SQL})"


def element_sql(tag: str, html: str = "html") -> str:
    return text_sql(f"regexp_extract({html}, '(?s)<{tag}>(.*?)</{tag.split(' ')[0]}>', 1)")


def split_words_sql(text: str) -> str:
    return f"list_filter(string_split(replace(lower({fold_sql(text)}), ':', ' '), ' '), lambda w: w <> '')"


def tokens_sql(text: str) -> str:
    return f"list_filter({split_words_sql(text)}, lambda w: w NOT IN ('au', 'le', 'de', 'the'))"


def ratio_sql(a: str, b: str) -> str:
    """2 * LCS / (length + length) by the textbook table."""
    return f"""
      CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * list_reduce(
        string_split({a}, ''),
        lambda above, x: list_reduce(
          range(1, length({b}) + 1),
          lambda row, j: list_append(row, CASE WHEN ({b})[j] = x THEN above[j] + 1
                                               ELSE greatest(above[j + 1], row[j]) END),
          [0]::BIGINT[]),
        list_transform(range(0, length({b}) + 1), lambda z: 0)::BIGINT[])[length({b}) + 1]
      / (length({a}) + length({b})) END"""


def scores_sql(pairs: str) -> str:
    """CTEs from ``pairs`` (id, ta, tb: word lists) to ``scored`` (id, score)."""
    return f"""
  pairs AS ({pairs}),
  cells AS (SELECT id, i, j, ta[i] AS a, tb[j] AS b
            FROM pairs, unnest(range(1, len(ta) + 1)) AS u(i), unnest(range(1, len(tb) + 1)) AS v(j)),
  word_pairs AS (SELECT DISTINCT a, b FROM cells),
  rated AS (SELECT a, b, {ratio_sql('a', 'b')} AS r FROM word_pairs),
  graded AS (SELECT id, i, j, r FROM cells JOIN rated USING (a, b)),
  side_a AS (SELECT id, avg(best) AS s FROM (SELECT id, i, max(r) AS best FROM graded GROUP BY id, i) GROUP BY id),
  side_b AS (SELECT id, avg(best) AS s FROM (SELECT id, j, max(r) AS best FROM graded GROUP BY id, j) GROUP BY id),
  scored AS (SELECT id, round(greatest(side_a.s, side_b.s), 9) AS score FROM side_a JOIN side_b USING (id))"""
