"""Name matching."""

import uuid

from pyspark.sql import functions as F

from listwright.fixed_values import ACCEPT_ABOVE
from listwright.functions.binding import once
from listwright.functions.similarity import token_ratio
from listwright.functions.text import split_tokens
from listwright.operators import matching as M
from listwright.operators import name_index as I
from listwright.plans.catalog.shared import (
    SHOWN_SQL,
    element_sql,
    page_texts,
    ratio_sql,
    scores_sql,
    split_words_sql,
    table,
    tokens_sql,
)
from listwright.session import materialise, shared_folder
from listwright.sources.lists import lines_of_texts


def indel_ratio(spark, sf_dir):
    """Ratio of every two words that follow each other somewhere in the conversations."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))

    def neighbours(words):
        firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.transform(
            firsts, lambda w, i: F.struct(w.alias("tok_a"), words[i + 1].alias("tok_b"))
        )

    follow = once(split_tokens(F.col("line")), neighbours)
    pairs = lines_of_texts(turns, "id", "text").select(F.inline(follow)).distinct()
    return pairs.withColumn("ratio", F.round(token_ratio(F.col("tok_a"), F.col("tok_b")), 6))


INDEL_SQL = rf"""
WITH words AS (
  SELECT {split_words_sql('line')} AS w
  FROM (SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM conversations)),
pairs AS (SELECT DISTINCT w[i] AS tok_a, w[i + 1] AS tok_b FROM words, unnest(range(1, len(w))) AS u(i))
SELECT tok_a, tok_b, round({ratio_sql('tok_a', 'tok_b')}, 6) AS ratio FROM pairs"""


def _title_and_ad(spark, sf_dir):
    return M.score_pairs(page_texts(spark, sf_dir), "title", "ad")


def match_score(spark, sf_dir):
    return _title_and_ad(spark, sf_dir).select("page_id", F.round("score", 6).alias("score"))


def review_flag(spark, sf_dir):
    return _title_and_ad(spark, sf_dir).select("page_id", M.needs_review(F.col("score")).alias("needs_review"))


def name_changed(spark, sf_dir):
    return page_texts(spark, sf_dir).select("page_id", (F.col("title") != F.col("ad")).alias("name_changed"))


_TEXTS_SQL = (
    f"SELECT page_id, {element_sql('title', 'shown')} AS title,"
    f""" {element_sql('div class="ad"', 'shown')} AS ad FROM (SELECT page_id, {SHOWN_SQL} AS shown FROM pages)"""
)
_TITLE_AD_SQL = "WITH " + scores_sql(
    f"SELECT page_id AS id, {tokens_sql('title')} AS ta, {tokens_sql('ad')} AS tb FROM ({_TEXTS_SQL})"
)


def _misspelt_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("list_id"),
        F.col("p_partkey").alias("line_no"),
        F.translate("p_name", "ai", "eo").alias("search_name"),
    )


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), F.col("p_name").alias("page_name")
    )


def match_candidates(spark, sf_dir):
    """All pairs of a misspelt and a right part name over the threshold."""
    left = M.distinct_names(_misspelt_parts(spark, sf_dir), "search_name")
    right = M.distinct_names(_part_names(spark, sf_dir), "page_name")
    return M.match_pairs(left, right).select("key_a", "key_b", F.round("score", 6).alias("score"))


def accept_match(spark, sf_dir):
    """Best part for every misspelt part name, if any is good enough."""
    best = M.best_matches(_misspelt_parts(spark, sf_dir), _part_names(spark, sf_dir))
    return best.withColumn("score", F.round("score", 6))


def match_kept_names(spark, sf_dir):
    """The same from a kept index of the part names, for the listings of a third of the brands at a time."""
    folder = f"{shared_folder(spark).rstrip('/')}/part-names-{uuid.uuid4().hex}"
    index = I.write_name_index(_part_names(spark, sf_dir), folder)
    third = F.pmod(F.crc32("list_id"), F.lit(3))
    listed = _misspelt_parts(spark, sf_dir)
    best = [I.match_new(listed.filter(third == part), index) for part in range(3)]
    return best[0].unionByName(best[1]).unionByName(best[2]).withColumn("score", F.round("score", 6))


_PART_PAIRS_SQL = (
    "WITH left_names AS (SELECT DISTINCT translate(p_name, 'ai', 'eo') AS a FROM part),"
    " right_names AS (SELECT p_name AS b, min(p_partkey) AS page_id FROM part GROUP BY p_name),"
    + scores_sql(
        "SELECT {'a': a, 'b': b} AS id, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb"
        " FROM left_names, right_names"
    )
)


def _key_sql(name):
    return f"array_to_string(list_sort(string_split({name}, ' ')), ' ')"


MATCH_CANDIDATES_SQL = f"""{_PART_PAIRS_SQL}
SELECT {_key_sql('id.a')} AS key_a, {_key_sql('id.b')} AS key_b, round(score, 6) AS score
FROM scored WHERE score > 0.75"""

ACCEPT_SQL = f"""{_PART_PAIRS_SQL},
placed AS (
  SELECT id.a AS a, right_names.b AS page_name, page_id, score,
         row_number() OVER (PARTITION BY id.a
           ORDER BY score DESC, {_key_sql('id.a')} = {_key_sql('id.b')} DESC, page_id) AS place
  FROM scored JOIN right_names ON right_names.b = id.b WHERE score > 0.75)
SELECT p_brand AS list_id, p_partkey AS line_no, translate(p_name, 'ai', 'eo') AS search_name,
       page_id, page_name, round(score, 6) AS score
FROM part LEFT JOIN placed ON a = translate(p_name, 'ai', 'eo') AND place = 1"""


def match_titles(spark, sf_dir):
    """Best other page for every page title."""
    texts = materialise(page_texts(spark, sf_dir), "page-texts")
    listings = texts.select(
        F.lit("titles").alias("list_id"), F.col("page_id").alias("line_no"), F.col("title").alias("search_name")
    )
    names = texts.select("page_id", F.col("ad").alias("page_name"))
    return M.best_matches(listings, names).withColumn("score", F.round("score", 6))


def _words_key_sql(tokens):
    return f"array_to_string(list_sort({tokens}), ' ')"


_TITLE_KEYS = (
    f"titles AS (SELECT page_id, title, {tokens_sql('title')} AS t FROM texts),"
    f" ads AS (SELECT page_id, ad, {tokens_sql('ad')} AS t FROM texts)"
)
MATCH_TITLES_SQL = f"""
WITH texts AS MATERIALIZED ({_TEXTS_SQL}), {_TITLE_KEYS},
listed AS (SELECT DISTINCT {_words_key_sql('t')} AS k FROM titles WHERE len(t) > 0),
paged AS (SELECT {_words_key_sql('t')} AS k, min(page_id) AS page_id, arg_min(ad, page_id) AS ad FROM ads WHERE len(t) > 0 GROUP BY 1),
{scores_sql(
    "SELECT {'a': listed.k, 'b': paged.k} AS id, string_split(listed.k, ' ') AS ta, string_split(paged.k, ' ') AS tb FROM listed, paged"
)},
best AS (
  SELECT id.a AS k, paged.page_id, ad, score,
         row_number() OVER (PARTITION BY id.a ORDER BY score DESC, id.a = id.b DESC, paged.page_id) AS place
  FROM scored JOIN paged ON paged.k = id.b WHERE score > 0.75)
SELECT 'titles' AS list_id, titles.page_id AS line_no, title AS search_name, best.page_id, ad AS page_name, round(score, 6) AS score
FROM titles LEFT JOIN best ON best.k = {_words_key_sql('t')} AND place = 1"""

# Words of lengths too far apart cannot be that alike; the others are compared one by one.
TOKEN_PAIRS_SQL = f"""
WITH texts AS MATERIALIZED ({_TEXTS_SQL}),
words AS MATERIALIZED (SELECT DISTINCT unnest({tokens_sql('title')}) AS w FROM texts),
near AS (
  SELECT a.w AS tok_a, b.w AS tok_b FROM words a, words b
  WHERE a.w < b.w AND 2.0 * least(length(a.w), length(b.w)) / (length(a.w) + length(b.w)) > 0.75)
SELECT tok_a, tok_b, round(r, 6) AS ratio FROM (SELECT tok_a, tok_b, {ratio_sql('tok_a', 'tok_b')} AS r FROM near) WHERE r > 0.75"""


def token_pairs(spark, sf_dir):
    """All pairs of different title words more alike than the threshold."""
    words = M.word_counts(M.distinct_names(page_texts(spark, sf_dir), "title"))
    words = materialise(words, "title-words")
    return M.token_pairs(words, words, ACCEPT_ABOVE).filter("tok_a < tok_b").withColumn("ratio", F.round("ratio", 6))


QUERIES = {
    "indel_ratio": (indel_ratio, INDEL_SQL),
    "match_score": (
        match_score,
        f"{_TITLE_AD_SQL} SELECT id AS page_id, round(score, 6) AS score FROM pairs LEFT JOIN scored USING (id)",
    ),
    "match_candidates": (match_candidates, MATCH_CANDIDATES_SQL),
    "accept_match": (accept_match, ACCEPT_SQL),
    "match_kept_names": (match_kept_names, ACCEPT_SQL),
    "review_flag": (
        review_flag,
        f"{_TITLE_AD_SQL} SELECT id AS page_id, coalesce(score < 0.8, TRUE) AS needs_review"
        " FROM pairs LEFT JOIN scored USING (id)",
    ),
    "name_changed": (name_changed, f"SELECT page_id, title <> ad AS name_changed FROM ({_TEXTS_SQL})"),
    "match_titles": (match_titles, MATCH_TITLES_SQL),
    "token_pairs": (token_pairs, TOKEN_PAIRS_SQL),
}
