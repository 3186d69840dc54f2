"""Street addresses: split, translate and rebuild, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed_values import (
    ADDRESS_IN_TEXT,
    ADDRESS_IN_TEXT_NARROW,
    HOUSE_NUMBER,
    STREET_ABBREVIATIONS,
    STREET_DIRECTIONS,
    STREET_TYPES,
)
from listwright.functions.binding import once
from listwright.functions.text import word_map


def _last_translated(tokens: Column, words: dict[str, str]) -> Column:
    """Translation of the last token that ``words`` knows, as an array of none or one."""
    known = F.filter(tokens, lambda t: t.isin(list(words)))
    return F.transform(F.slice(F.reverse(known), 1, 1), lambda t: word_map(words)[t])


def house_number(raw: Column) -> Column:
    """Leading number, NULL if there is none or it is longer than five digits."""
    number = F.regexp_extract(raw, rf"(?!\d{{6}})(?:{HOUSE_NUMBER})", 1)
    return F.nullif(number, F.lit(""))


def street_part(raw: Column) -> Column:
    rest = F.substring(raw, F.length(house_number(raw)) + F.lit(1), F.length(raw))
    street = F.substring_index(F.regexp_replace(rest, r"^[\s,]+", ""), ",", 1)
    return F.lower(F.rtrim(street, F.lit(" \n")))


def street_tokens(street: Column) -> Column:
    return F.filter(F.split(street, r"\s+"), lambda t: t != "")


def expand_abbreviations(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.coalesce(word_map(STREET_ABBREVIATIONS)[t], t))


def lift_type_and_direction(
    tokens: Column,
    directions: dict[str, str] | None = None,
    direction_needs_type: bool = False,
) -> Column:
    """Move the street type, then the direction, to the end in English; the last one wins."""
    directions = STREET_DIRECTIONS if directions is None else directions
    lifted = list(STREET_TYPES) + list(directions)

    def rebuilt(words: Column) -> Column:
        kept = F.filter(words, lambda t: ~t.isin(lifted))
        kind = _last_translated(words, STREET_TYPES)
        heading = _last_translated(words, directions)
        if direction_needs_type:
            typed = F.exists(words, lambda t: t.isin(list(STREET_TYPES)))
            heading = F.when(typed, heading).otherwise(F.array().cast("array<string>"))
        return F.concat(kept, kind, heading)

    return once(tokens, rebuilt)


def _capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def capitalise_tokens(tokens: Column) -> Column:
    """Capitalise every part of every hyphenated word and join with spaces."""
    words = F.transform(
        tokens, lambda t: F.array_join(F.transform(F.split(t, "-"), _capitalise), "-")
    )
    return F.array_join(words, " ")


def standard_street(street: Column, directions: dict[str, str] | None = None) -> Column:
    tokens = expand_abbreviations(street_tokens(street))
    return capitalise_tokens(lift_type_and_direction(tokens, directions))


def compose_address(number: Column, street: Column) -> Column:
    return F.concat(number, F.lit(" "), street)


def standard_address(raw: Column, directions: dict[str, str] | None = None) -> Column:
    """'1741, Rue Saint-Denis, Montreal' -> '1741 Saint-Denis Street'; NULL if unparsed."""
    return compose_address(house_number(raw), standard_street(street_part(raw), directions))


def punctuation_free_address(raw: Column) -> Column:
    """Variant for typed-in addresses: no number split, punctuation dropped."""
    plain = F.lower(F.translate(raw, "-.,", " "))
    tokens = expand_abbreviations(street_tokens(plain))
    return capitalise_tokens(lift_type_and_direction(tokens, direction_needs_type=True))


def addresses_in_text(text: Column, narrow: bool = False) -> Column:
    pattern = ADDRESS_IN_TEXT_NARROW if narrow else ADDRESS_IN_TEXT
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
