"""Names and plain text."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed_values import CITY, LOOKUPS, SKIP_WORDS
from listwright.functions.binding import once

_BLANKS = " \t\n\r\f\x0b"
LINE_BREAK = r"\r\n|\r|\n"


def word_map(words: dict[str, str]) -> Column:
    """Constant map column; one literal however long the dictionary."""
    text = "\x1e".join(f"{key}\x1f{value}" for key, value in words.items())
    return F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f"))


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def split_lines(text: Column) -> Column:
    """Lines of a text, any newline style; a final newline opens no extra line."""
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK)
    )


def clean_name(line: Column) -> Column:
    return F.replace(trim_blanks(line), F.lit("&"), F.lit("and"))


def is_header(name: Column) -> Column:
    return F.endswith(name, F.lit(":"))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions that leave ASCII behind, from the Unicode database.

    One-to-one foldings feed ``translate``; the longer ones (ligatures, fractions) a map.
    """
    single_from, single_to, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        decomposed = unicodedata.normalize("NFKD", char)
        if decomposed == char:
            continue
        kept = "".join(c for c in decomposed if ord(c) < 0x80)
        if len(kept) == 1:
            single_from.append(char)
            single_to.append(kept)
        elif kept:
            longer[char] = kept
    return "".join(single_from), "".join(single_to), longer


def _char_class(chars) -> str:
    """Regular-expression class of the characters, runs as ranges."""
    codes = sorted(ord(c) for c in chars)
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in runs)


def ascii_fold(text: Column) -> Column:
    """NFKD, then drop what is not ASCII."""
    source, target, longer = _fold_tables()
    members = _char_class(longer)

    def plain(folded: Column) -> Column:
        return F.regexp_replace(folded, r"[^\x00-\x7F]+", "")

    def expanded(folded: Column) -> Column:
        expand = word_map(longer)
        pieces = F.regexp_extract_all(folded, F.lit(f"[{members}]|[^{members}]+"), F.lit(0))
        return F.array_join(
            F.transform(pieces, lambda p: F.when(p.rlike(f"^[{members}]"), expand[p]).otherwise(p)), ""
        )

    def rest(folded: Column) -> Column:
        # The class is costly to test, so it meets only what translation left over.
        left_over = F.regexp_replace(folded, r"[\x00-\x7F]+", "")
        return F.when(left_over.rlike(f"[{members}]"), plain(expanded(folded))).otherwise(plain(folded))

    return once(F.translate(text, source, target), rest)


def lookup_key(name: Column, kind: str = "search", city: str = CITY) -> Column:
    """Key under which a lookup page for ``name`` is stored: the lookup's own address."""
    prefix, space, suffix, lower = LOOKUPS[kind]
    words = F.replace(ascii_fold(name), F.lit(" "), F.lit(space))
    if lower:
        words = F.lower(words)
    return F.concat(F.lit(prefix), words, F.lit(suffix.format(city=city)))


def split_tokens(name: Column) -> Column:
    """Lower-case ASCII words; ':' separates like a space, empty words are dropped."""
    words = F.split(F.replace(F.lower(ascii_fold(name)), F.lit(":"), F.lit(" ")), " ")
    return F.filter(words, lambda w: w != "")


def drop_skip_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~F.lower(w).isin(SKIP_WORDS))


def name_tokens(name: Column) -> Column:
    return drop_skip_words(split_tokens(name))


def output_name(path: Column, suffix: str) -> Column:
    """Report name for an input path: last segment without its extension, plus suffix."""
    last = F.substring_index(path, "/", -1)
    return F.concat(F.regexp_replace(last, r"\.[^.]*$", ""), F.lit(suffix))
