"""Match names between two tables.

A name counts as its sorted, folded words (the *name key*). The score of two names is the
better of two means: for every word of one name the best ratio among the words of the
other. All work happens on distinct name keys and distinct words.

Candidates are found without loss. If a mean over n words exceeds t, then with h words set
aside some other word must have a partner with ratio above (t*n - h) / (n - h). So a name
may set up to half its words aside and meet the other table through the rest, if their
partners are known down to a ratio of 2t - 1. Which words, and how many, is its cheapest
choice by the number of places they lead to at the ratios they then need; so a word in every
name is set aside, and no word is called frequent.

The set of *all* pairs over a low threshold can be quadratic by itself once a word is
frequent. ``best_matches`` never builds it: it is a threshold algorithm. Rounds go from a
high score down; a name is done when the best page found scores no less than any page not
yet seen could, and what it has found raises what the next round must look for.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.fixed_values import ACCEPT_ABOVE, REVIEW_BELOW
from listwright.functions.signatures import similarity_keys
from listwright.functions.similarity import match_score, token_ratio, with_match_score
from listwright.functions.text import clean_name, name_tokens
from listwright.session import materialise

# Scores down to which the rounds of best matches look, before the threshold.
ROUNDS = (0.8,)
# Steps of ratio between the floor and 1 at which it is known how many places a word leads to.
LEVELS = 8
_SLACK = 1e-9


def _fraction(number: float) -> Fraction:
    return Fraction(str(number))


def words_of(name_key: Column) -> Column:
    return F.split(name_key, " ")


def with_name_key(df: DataFrame, name: str) -> DataFrame:
    """Add ``name_key``: the sorted words of a name; NULL when no word is left."""
    tokens = F.array_join(F.array_sort(name_tokens(F.col(name))), " ")
    return df.withColumn("name_key", F.nullif(tokens, F.lit("")))


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    return with_name_key(df.select(name), name).select("name_key").filter(
        "name_key is not null"
    ).distinct()


def found_tokens(name: Column, both_sides: bool = False) -> Column:
    """Words of a found name. Searched names have ``&`` spelled out, and with ``both_sides``
    found ones too; known review flags depend on their not having it."""
    return name_tokens(clean_name(name) if both_sides else name)


def score_pairs(
    df: DataFrame, left: str, right: str, score: str = "score", both_sides: bool = False
) -> DataFrame:
    """Score two name columns of one table, searched and found, row by row."""
    return with_match_score(df, name_tokens(F.col(left)), found_tokens(F.col(right), both_sides), score)


def needs_review(score: Column) -> Column:
    return F.coalesce(score < REVIEW_BELOW, F.lit(True))


def word_places(names: DataFrame) -> DataFrame:
    """Names with each of their words as ``token``."""
    return names.withColumn("token", F.explode(words_of(F.col("name_key"))))


def word_counts(names: DataFrame) -> DataFrame:
    """In how many word places of distinct names each word stands."""
    return word_places(names).groupBy("token").agg(F.count(F.lit(1)).alias("places"))


def _dealt(words: DataFrame) -> DataFrame:
    """Words in as many parts as a shuffle has; adaptive execution does not merge them."""
    return words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")


def similarity_key_rows(words: DataFrame, floor: float, left: bool) -> DataFrame:
    """(token, key): keys that any two words more alike than ``floor`` share, one from either side."""
    keys = similarity_keys(F.col("token"), _fraction(floor), left=left)
    return _dealt(words).select("token", F.explode(keys).alias("key"))


def token_pairs(left: DataFrame, right: DataFrame, floor: float = ACCEPT_ABOVE) -> DataFrame:
    """All (tok_a, tok_b, ratio) with ratio above ``floor`` between two tables of distinct
    ``token``; found by an equi-join on similarity keys. Making keys is the costly part, so
    the words, a small table for their number, are dealt out to all cores. A word has up to
    thousands of keys, which the size of its table does not tell: neither side is broadcast."""
    keyed_left = similarity_key_rows(left, floor, left=True).withColumnRenamed("token", "tok_a")
    keyed_right = similarity_key_rows(right, floor, left=False).withColumnRenamed("token", "tok_b")
    return (
        keyed_left.join(keyed_right.hint("merge"), "key")
        .select("tok_a", "tok_b")
        .distinct()
        .withColumn("ratio", token_ratio(F.col("tok_a"), F.col("tok_b")))
        .filter(F.col("ratio") > floor)
    )


def pair_floor(score: float) -> float:
    """The ratio down to which word pairs must be known, for names to set half their words
    aside when looking for scores above ``score``."""
    return float(max(2 * _fraction(score) - 1, Fraction(1, 4)))


def _levels(floor: float) -> list[float]:
    return [floor + (1 - floor) * i / LEVELS for i in range(LEVELS)]


def word_reach(pairs: DataFrame, own: str, other: str, floor: float, other_counts: DataFrame) -> DataFrame:
    """(token, reach): to how many places of the other table each word leads through partners
    above each level of ratio. A misspelt frequent word leads to as many as the word itself."""
    partners = other_counts.withColumnRenamed("token", other)
    above = [F.sum(F.when(F.col("ratio") > level, F.col("places")).otherwise(0)) for level in _levels(floor)]
    return pairs.join(partners, other).groupBy(F.col(own).alias("token")).agg(F.array(*above).alias("reach"))


def meeting_words(names: DataFrame, reach: DataFrame, score: float, floor: float) -> DataFrame:
    """(name_key, token, need): words a name meets the other table through, and the ratio
    a partner must exceed for the pair to score above ``beat``, the name's own bound, which
    is no less than ``score``."""
    share = max(Fraction(0), (_fraction(score) - _fraction(floor)) / (1 - _fraction(floor)))
    none = F.array(*[F.lit(0).cast("long")] * LEVELS)
    word = F.struct((-F.col("reach")[0]).alias("most"), "token", "reach")
    whole = (
        word_places(names)
        .join(reach, "token", "left")
        .withColumn("reach", F.coalesce("reach", none))
        .groupBy("name_key", "beat")
        .agg(F.sort_array(F.collect_list(word)).alias("words"))
    )
    n = F.size("words")

    def need(aside: Column) -> Column:
        return (F.col("beat") * n - aside) / (n - aside) - F.lit(_SLACK)

    def level(aside: Column) -> Column:
        step = F.floor((need(aside) - F.lit(floor)) * LEVELS / F.lit(1 - floor)).cast("int")
        return F.least(F.greatest(step, F.lit(0)), F.lit(LEVELS - 1))

    def cost(aside: Column) -> Column:
        opened = F.slice("words", aside + 1, F.greatest(n - aside, F.lit(0)))
        places = F.aggregate(opened, F.lit(0).cast("long"), lambda sum_, w: sum_ + w["reach"][level(aside)])
        return F.struct(places.alias("places"), aside.alias("aside"))

    most = F.expr(f"size(words) * {share.numerator} div {share.denominator}").cast("int")
    best = F.array_min(F.transform(F.sequence(F.lit(0), most), cost))["aside"]
    chosen = whole.withColumn("aside", best)
    return chosen.select(
        "name_key",
        need(F.col("aside")).alias("need"),
        F.explode(F.slice("words", F.col("aside") + 1, n - F.col("aside"))["token"]).alias("token"),
    )


def both_word_counts(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts of two name tables, written once."""
    sides = word_counts(left).withColumn("side", F.lit("a")).unionByName(
        word_counts(right).withColumn("side", F.lit("b"))
    )
    counts = materialise(sides, "words")
    return tuple(counts.filter(F.col("side") == side).drop("side") for side in ("a", "b"))


def match_candidates(
    left: DataFrame,
    right: DataFrame,
    score: float,
    floor: float,
    counts: tuple[DataFrame, DataFrame],
    pairs: DataFrame,
) -> DataFrame:
    """Distinct (key_a, key_b) that include every pair scoring above ``score``, and above
    ``beat`` of the left name where it has one.

    ``left`` and ``right`` hold distinct ``name_key``; ``counts`` are their word counts and
    ``pairs`` their word pairs above ``floor`` (both may cover more words). The joins run on
    words; the postings of a word in many names are split by AQE's skew handling.
    """
    left = left if "beat" in left.columns else left.withColumn("beat", F.lit(score))
    right = right.select("name_key").withColumn("beat", F.lit(score))
    meet_a = meeting_words(left, word_reach(pairs, "tok_a", "tok_b", floor, counts[1]), score, floor)
    from_a = (
        meet_a.join(pairs, (meet_a.token == pairs.tok_a) & (pairs.ratio > meet_a.need))
        .select(F.col("name_key").alias("key_a"), F.col("tok_b").alias("token"))
        .join(word_places(right), "token")
        .select("key_a", F.col("name_key").alias("key_b"))
    )
    meet_b = meeting_words(right, word_reach(pairs, "tok_b", "tok_a", floor, counts[0]), score, floor)
    from_b = (
        meet_b.join(pairs, (meet_b.token == pairs.tok_b) & (pairs.ratio > meet_b.need))
        .select(F.col("name_key").alias("key_b"), F.col("tok_a").alias("token"))
        .join(word_places(left), "token")
        .select(F.col("name_key").alias("key_a"), "key_b")
    )
    return from_a.unionByName(from_b).distinct()


def scored_pairs(candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidates (key_a, key_b) that score above ``threshold``, with their score."""
    score = match_score(words_of(F.col("key_a")), words_of(F.col("key_b")))
    return candidates.withColumn("score", score).filter(F.col("score") > threshold)


def match_pairs(
    left: DataFrame, right: DataFrame, threshold: float = ACCEPT_ABOVE, floor: float | None = None
) -> DataFrame:
    """Every (key_a, key_b, score) with score above ``threshold``."""
    floor = pair_floor(threshold) if floor is None else floor
    counts = both_word_counts(left, right)
    pairs = materialise(token_pairs(*counts, floor), "token-pairs")
    return scored_pairs(match_candidates(left, right, threshold, floor, counts, pairs), threshold)


def _rarest_word(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name_key, token): the word of each name that the other table holds least often;
    names with a word the other table lacks are left out."""
    by_rarity = Window.partitionBy("name_key").orderBy("places", "token")
    whole = Window.partitionBy("name_key")
    return (
        word_places(names)
        .join(counts, "token", "left")
        .withColumn("place", F.row_number().over(by_rarity))
        .withColumn("missing", F.count_if(F.col("places").isNull()).over(whole))
        .filter("place = 1 and missing = 0")
        .select("name_key", "token")
    )


def _contained(
    left: DataFrame, right: DataFrame, counts: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """(key_a, key_b) where all words of one name stand in the other: these score 1."""
    def inside(small: str, large: str) -> Column:
        return F.size(F.array_except(words_of(F.col(small)), words_of(F.col(large)))) == 0

    a_in_b = (
        _rarest_word(left, counts[1]).withColumnRenamed("name_key", "key_a")
        .join(word_places(right).withColumnRenamed("name_key", "key_b"), "token")
        .filter(inside("key_a", "key_b"))
    )
    b_in_a = (
        _rarest_word(right, counts[0]).withColumnRenamed("name_key", "key_b")
        .join(word_places(left).withColumnRenamed("name_key", "key_a"), "token")
        .filter(inside("key_b", "key_a"))
    )
    return a_in_b.select("key_a", "key_b").unionByName(b_in_a.select("key_a", "key_b"))


def _best_of(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Best page per listing key: highest score, then lowest page."""
    order = F.struct((-F.col("score")).alias("s"), F.col("page_id").alias("p"))
    return (
        pairs.join(pages.select(F.col("name_key").alias("key_b"), "page_id", "page_name"), "key_b")
        .groupBy("key_a")
        .agg(F.min_by(F.struct("page_id", "page_name", "score"), order).alias("best"))
        .select(F.col("key_a").alias("name_key"), "best.*")
    )


def _settle(names: DataFrame, settled: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Settled rows and the names still open, from one written table."""
    rows = names.join(settled, "name_key", "left").select("name_key", "page_id", "page_name", "score")
    both = materialise(rows, label)
    return both.filter("score is not null"), both.filter("score is null").select("name_key")


def _fuzzy_best(names: DataFrame, pages: DataFrame, threshold: float) -> DataFrame:
    """Best page per name by the threshold algorithm: rounds look for pairs that score above
    a bound, from high bounds down; a name whose best is over the bound is settled. One that has
    found less carries it on: only pairs that score no less are looked for then."""
    keys = pages.select("name_key")
    columns = ["name_key", "page_id", "page_name", "score"]
    rest = names.select("name_key", *[F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in columns[1:3]])
    rest = rest.withColumn("score", F.lit(None).cast("double"))
    settled = None
    for bound in sorted({max(score, threshold) for score in (*ROUNDS, threshold)}, reverse=True):
        floor = pair_floor(bound)
        counts = both_word_counts(rest, keys)
        pairs = materialise(token_pairs(*counts, floor), "token-pairs")
        # What is found so far may be beaten, or tied by a page before it.
        asking = rest.select("name_key", F.greatest(F.lit(bound), F.col("score") - _SLACK).alias("beat"))
        found = scored_pairs(match_candidates(asking, keys, bound, floor, counts, pairs), threshold)
        both = _best_of(found, pages).select(columns).unionByName(rest.filter("score IS NOT NULL").select(columns))
        order = F.struct((-F.col("score")).alias("s"), F.col("page_id").alias("p"))
        best = both.groupBy("name_key").agg(F.min_by(F.struct(*columns[1:]), order).alias("best")).select("name_key", "best.*")
        state = materialise(rest.select("name_key").join(best, "name_key", "left").select(columns), "best-so-far")
        done = state.filter(F.col("score") > bound)
        settled = done if settled is None else settled.unionByName(done)
        rest = state.filter(F.coalesce(F.col("score") <= bound, F.lit(True)))
    return settled


def page_keys(page_names: DataFrame) -> DataFrame:
    """(name_key, page_name, page_id): the lowest page of each set of words; names without words are left out."""
    return (
        with_name_key(page_names.select("page_id", "page_name"), "page_name")
        .filter("name_key is not null")
        .groupBy("name_key")
        .agg(F.min_by("page_name", "page_id").alias("page_name"), F.min("page_id").alias("page_id"))
    )


def best_matches(
    listings: DataFrame,
    page_names: DataFrame,
    threshold: float = ACCEPT_ABOVE,
) -> DataFrame:
    """Best page of every listing, or none if no page scores above ``threshold``.

    ``listings`` has ``search_name``, ``page_names`` has ``page_id`` and ``page_name``; the
    listing columns come back with ``page_id``, ``page_name`` and ``score``. Ties go to the
    same set of words, then to the lowest page.

    Most names are settled by an equi-join on the name key, the next by containment; only
    the rest need the fuzzy join, in rounds from high scores down.
    """
    pages = materialise(page_keys(page_names), "page-names")
    keyed = with_name_key(listings, "search_name")
    columns = ["name_key", "page_id", "page_name", "score"]

    names = keyed.select("name_key").filter("name_key is not null").distinct()
    same, rest = _settle(names, pages.withColumn("score", F.lit(1.0)), "same-names")
    counts = both_word_counts(rest, pages.select("name_key"))
    inside = _contained(rest, pages, counts).distinct().withColumn("score", F.lit(1.0))
    contained, rest = _settle(rest, _best_of(inside, pages), "contained-names")
    best = same.unionByName(contained)
    if not rest.isEmpty():
        best = best.unionByName(_fuzzy_best(rest, pages, threshold).select(columns))
    return keyed.join(best, "name_key", "left").drop("name_key")
