"""Addresses in free text by a dictionary of streets: found whatever city, if any, stands behind them.

The dictionary comes from addresses that are known. In a text, what follows a house number is looked up in it: word n-grams of
the lengths that the dictionary has meet its phrases in an equi-join, the longest phrase at a number counts, and of
addresses that overlap the leftmost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed_values import HOUSE_NUMBER
from listwright.functions import addresses as A
from listwright.functions.binding import once
from listwright.functions.text import ascii_fold

_EDGES = r"^[\s.,;:!?()\"']+|[\s.,;:!?()\"']+$"


def _word(token: Column) -> Column:
    return F.lower(ascii_fold(F.regexp_replace(token, _EDGES, "")))


def _phrase(tokens: Column) -> Column:
    words = F.filter(F.transform(tokens, _word), lambda w: w != "")
    return F.array_join(A.expand_abbreviations(words), " ")


def streets(known: DataFrame, raw: str = "address_raw") -> DataFrame:
    """(phrase, words, street): the distinct street phrases of known addresses, abbreviations spelled out, and the standard form.

    Addresses without a house number and such without a street are left out; of several spellings the one that sorts first
    gives the standard form.
    """
    part = A.street_part(F.col(raw))
    found = known.filter(A.house_number(F.col(raw)).isNotNull()).select(
        _phrase(A.street_tokens(part)).alias("phrase"), A.standard_street(part).alias("street")
    )
    single = found.filter("phrase <> ''").groupBy("phrase").agg(F.min("street").alias("street"))
    return single.withColumn("words", F.size(F.split("phrase", " ")))


def _numbers(tokens: Column) -> Column:
    """(pos, number, rest) of tokens that begin with a house number; ``rest`` is what is written onto it."""
    def read(token: Column, pos: Column) -> Column:
        bare = F.regexp_replace(token, r"^[(\"']+", "")
        # A space ends every token but the last: it tells a letter that belongs to the number.
        number = F.regexp_extract(F.concat(bare, F.lit(" ")), rf"^(?!\d{{6}})(?:{HOUSE_NUMBER})", 1)
        rest = F.regexp_replace(F.substr(bare, F.length(number) + 1), r"^[\s,]+", "")
        return F.struct(pos.alias("pos"), number.alias("number"), rest.alias("rest"))

    return F.filter(F.transform(tokens, read), lambda n: n["number"] != "")


def _leftmost(found: Column) -> Column:
    """Of (pos, end, ...) in order, those that begin after the one kept before has ended."""
    start = F.struct(F.lit(-1).cast("int").alias("end"), F.slice(found, 1, 0).alias("kept"))

    def step(state: Column, one: Column) -> Column:
        after = one["pos"] > state["end"]
        return F.struct(
            F.when(after, one["end"]).otherwise(state["end"]).alias("end"),
            F.when(after, F.concat(state["kept"], F.array(one))).otherwise(state["kept"]).alias("kept"),
        )

    return F.aggregate(found, start, step, lambda state: state["kept"])


def find_addresses(texts: DataFrame, known_streets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, number, street, address): addresses in ``texts`` whose street is known, ``pos`` the number's word from 0.

    A street's words may not go past a comma. Only the words behind house numbers are shuffled, not the texts. Null and
    empty texts have no addresses; rows that share a key are one text to each other, so keys should be distinct.
    """
    lengths = sorted(r["words"] for r in known_streets.select("words").distinct().collect())  # numbers of words, few
    tokens = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    none = F.array().cast("array<string>")
    asked = (
        texts.filter(F.col(text).rlike("[0-9]"))
        .select(F.col(key).alias("_key"), tokens.alias("tokens"))
        .select("_key", "tokens", F.inline(_numbers(F.col("tokens"))))
        .withColumn("own", F.when(F.col("rest") != "", F.array("rest")).otherwise(none))
        .withColumn("words", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
    )
    gram = F.concat("own", F.slice("tokens", F.col("pos") + 2, F.greatest(F.col("words") - F.size("own"), F.lit(0))))
    cut = once(gram, lambda g: F.exists(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), lambda t: t.rlike(",$")))
    grams = asked.select("_key", "pos", "number", "words", (F.col("pos") + F.col("words") - F.size("own")).alias("end"), _phrase(gram).alias("phrase"), cut.alias("cut"))
    met = grams.filter("NOT cut").join(known_streets.select("phrase", "words", "street"), ["phrase", "words"])
    longest = met.groupBy("_key", "pos", "number").agg(F.max_by(F.struct("end", "street"), "words").alias("best"))
    one = F.struct("pos", F.col("best.end").alias("end"), "number", F.col("best.street").alias("street"))
    kept = longest.groupBy("_key").agg(F.sort_array(F.collect_list(one)).alias("found")).select("_key", F.inline(_leftmost(F.col("found"))))
    return kept.select(
        F.col("_key").alias(key), F.col("pos").cast("bigint").alias("pos"), "number", "street", A.compose_address(F.col("number"), F.col("street")).alias("address")
    )
