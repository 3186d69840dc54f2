"""Lists, names and plain text."""

from pyspark.sql import functions as F

from listwright.fixed_values import REPORT_SUFFIX
from listwright.functions import text as X
from listwright.operators import listings as L
from listwright.plans.catalog.shared import (
    BLANKS_SQL,
    LIST_LINES_SQL,
    SHOWN_SQL,
    documents,
    element_sql,
    fold_sql,
    joined_words,
    list_lines,
    page_texts,
    split_words_sql,
    table,
    tokens_sql,
)
from listwright.sources.lists import lines_of_texts


def read_lists(spark, sf_dir):
    return lines_of_texts(documents(spark, sf_dir), "doc_id", "text")


def _lines_sql(source, list_id):
    return rf"""
  SELECT list_id, i::BIGINT AS line_no, lines[i + 1] AS line
  FROM (SELECT {list_id} AS list_id,
               string_split_regex(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS lines
        FROM {source} WHERE text <> ''), unnest(range(len(lines))) AS u(i)"""


READ_LISTS_SQL = _lines_sql("documents", "doc_id")


def read_lists_of_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn(
        "turn_id", F.concat_ws("-", "conv_id", "turn")
    )
    return lines_of_texts(turns, "turn_id", "text")


def output_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", X.output_name(F.col("url"), REPORT_SUFFIX).alias("output_name")
    )


def clean_name(spark, sf_dir):
    return L.clean_lines(read_lists(spark, sf_dir)).select("list_id", "line_no", "search_name")


def drop_blank(spark, sf_dir):
    return L.drop_blank(L.clean_lines(list_lines(spark, sf_dir))).drop("line")


def drop_headers(spark, sf_dir):
    return L.drop_headers(L.clean_lines(list_lines(spark, sf_dir))).drop("line")


CLEAN_SQL = f"replace(trim(line, {BLANKS_SQL}), '&', 'and')"


def ingest_lists(spark, sf_dir):
    return L.listings(list_lines(spark, sf_dir))


INGEST_SQL = f"""
WITH named AS (SELECT list_id, line_no, {CLEAN_SQL} AS search_name FROM ({LIST_LINES_SQL})),
filled AS (
  SELECT *, last_value(CASE WHEN search_name LIKE '%:' THEN rtrim(search_name, ':') END IGNORE NULLS)
            OVER (PARTITION BY list_id ORDER BY line_no) AS section
  FROM named WHERE search_name <> '')
SELECT list_id, line_no, section, search_name FROM filled WHERE search_name NOT LIKE '%:'"""


def ascii_fold(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.ascii_fold(F.col("text")).alias("folded"))


def lookup_key(spark, sf_dir):
    name = F.initcap("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", *[X.lookup_key(name, k).alias(f"{k}_key") for k in ("search", "review", "profile")]
    )


LOOKUP_SQL = """
SELECT p_partkey,
       'https://www.google.ca/search?q=' || replace(p_name, ' ', '+') || '+montreal' AS search_key,
       'https://www.yelp.com/search?find_desc=' || replace(p_name, ' ', '+') || '&find_loc=montreal' AS review_key,
       'https://twitter.com/search?q=' ||
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '%20')
         || '%20montreal&mode=users' AS profile_key
FROM part"""


def skip_words(spark, sf_dir):
    words = X.split_tokens(F.col("h1"))
    return page_texts(spark, sf_dir).select(
        "page_id",
        F.size(words).cast("bigint").alias("words"),
        joined_words(X.drop_skip_words(words)).alias("kept"),
    )


def name_tokens(spark, sf_dir):
    names = page_texts(spark, sf_dir).select(
        "page_id", F.posexplode(X.name_tokens(F.col("h1"))).alias("pos", "token")
    )
    return names.withColumn("pos", F.col("pos").cast("bigint"))


_H1_SQL = f"SELECT page_id, {element_sql('h1', SHOWN_SQL)} AS h1 FROM pages"

QUERIES = {
    "read_lists": (read_lists, READ_LISTS_SQL),
    "read_lists_of_turns": (read_lists_of_turns, _lines_sql("conversations", "conv_id || '-' || turn")),
    "output_path": (
        output_path,
        r"SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') || '_HYPERLINKED.rtf'"
        " AS output_name FROM pages",
    ),
    "clean_name": (
        clean_name,
        f"SELECT list_id, line_no, {CLEAN_SQL} AS search_name FROM ({READ_LISTS_SQL})",
    ),
    "drop_blank": (
        drop_blank,
        f"SELECT list_id, line_no, {CLEAN_SQL} AS search_name FROM ({LIST_LINES_SQL}) WHERE {CLEAN_SQL} <> ''",
    ),
    "drop_headers": (
        drop_headers,
        f"SELECT list_id, line_no, {CLEAN_SQL} AS search_name FROM ({LIST_LINES_SQL}) WHERE {CLEAN_SQL} NOT LIKE '%:'",
    ),
    "ingest_lists": (ingest_lists, INGEST_SQL),
    "ascii_fold": (ascii_fold, f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents"),
    "lookup_key": (lookup_key, LOOKUP_SQL),
    "skip_words": (
        skip_words,
        f"SELECT page_id, len({split_words_sql('h1')})::BIGINT AS words,"
        f" array_to_string({tokens_sql('h1')}, ' ') AS kept FROM ({_H1_SQL})",
    ),
    "name_tokens": (
        name_tokens,
        f"SELECT page_id, i::BIGINT AS pos, t[i + 1] AS token"
        f" FROM (SELECT page_id, {tokens_sql('h1')} AS t FROM ({_H1_SQL})), unnest(range(len(t))) AS u(i)",
    ),
}
