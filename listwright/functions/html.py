"""Facts and links out of raw HTML with JVM-side regular expressions.

Pages are often broken (unclosed tags), so nothing here needs a well-formed tree.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed_values import MAP_MARKER
from listwright.functions.binding import once
from listwright.functions.text import trim_blanks, word_map

_NOT_SHOWN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_CHARACTER_REFERENCE = r"&(?:#[xX]0*[0-9a-fA-F]{1,6}|#0*[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
# Tag text before an attribute and after it: a quoted value, which follows "=", is passed over whole.
_BEFORE = r"""[^>=]*?(?:=\s*+(?:"[^"]*"|'[^']*'|(?!["']))[^>=]*?)*?(?<=[\s"'/])"""
_TAG_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|(?!["']))[^>=]*+)*+>"""
_IN_TAG = r"""[^<>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|(?!["']))[^<>=]*+)*+"""
_LINK_TAG = rf"<a\b(?:{_TAG_REST}|[^>]*>)"
# Elements whose end tag may be left out: tags that hold elements of the same kind deeper
# down, and tags that end the element where they stand at its own depth.
_HEADING = ("", "h[1-6]")
_CELL = ("table", "t[dhr]|thead|tbody|tfoot")
_IMPLIED_ENDS = {
    "li": ("ul|ol|menu", "li"),
    "td": _CELL,
    "th": _CELL,
    "a": ("", "a"),
    "h1": _HEADING,
    "h3": _HEADING,
    "p": ("", "p|div|ul|ol|li|dl|table|td|th|tr|h[1-6]|article|section|nav|main|aside|header|footer|address|form|body|html"),
}
# Code points 128 to 159 in references stand for these characters, as browsers read them.
_WINDOWS_1252 = {
    f"{code:08X}": bytes([code]).decode("cp1252") for code in range(128, 160) if code not in (129, 141, 143, 144, 157)
}


def shown_html(html: Column) -> Column:
    """The page without comments, scripts and style sheets."""
    return F.regexp_replace(html, _NOT_SHOWN, "")


def _named_reference(piece: Column) -> Column:
    names = word_map({f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"})
    return F.coalesce(names[piece], piece)


def _numbered_reference(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+);", 1)
    base16 = F.when(piece.rlike("^&#[xX]"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))

    def character(code: Column) -> Column:
        valid = code.rlike("^00(?:00(?!D[89A-F])|0[1-9A-F]|10)[0-9A-F]{4}$")
        read = F.coalesce(word_map(_WINDOWS_1252)[code], F.decode(F.unhex(code), "UTF-32"))
        return F.when(valid, read).otherwise(piece)

    return once(F.lpad(F.ltrim(base16, F.lit("0")), 8, "0"), character)


def decode_references(text: Column) -> Column:
    """Replace character references (&amp; &eacute; &#233; &#xE9;)."""
    def decoded(piece: Column) -> Column:
        return (
            F.when(piece.rlike("^&#.+;$"), _numbered_reference(piece))
            .when(piece.rlike("^&[A-Za-z].*;$"), _named_reference(piece))
            .otherwise(piece)
        )

    def whole(given: Column) -> Column:
        pieces = F.regexp_extract_all(
            given, F.lit(rf"(?s){_CHARACTER_REFERENCE}|[^&]+|&"), F.lit(0)
        )
        joined = F.array_join(F.transform(pieces, decoded), "")
        return F.when(F.contains(given, F.lit("&")), joined).otherwise(given)

    return once(text, whole)


def inner_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags out, references decoded, trimmed; NULL stays NULL."""
    return trim_blanks(decode_references(F.regexp_replace(fragment, f"(?i)</?[a-z]{_TAG_REST}|<[^>]*>", "")))


def opening_tag(tag: str, attribute: str | None = None, value: str | None = None) -> str:
    """Pattern of an opening tag; ``value`` is one of the attribute's space-separated words."""
    if attribute is None:
        return rf"<{tag}\b{_TAG_REST}"
    word = re.escape(value)
    return (
        rf"<{tag}\b{_BEFORE}{attribute}\s*=\s*"
        rf"""(?:"(?:[^"]*\s)?{word}(?:\s[^"]*)?"|'(?:[^']*\s)?{word}(?:\s[^']*)?'|{word}(?=[\s/>]))"""
        rf"{_TAG_REST}"
    )


def _matched(text: Column, pattern: str, group: int) -> Column:
    """Group of the first match, NULL if nothing matches; the text is searched once."""
    return once(
        F.regexp_extract(text, pattern, 0),
        lambda found: F.when(found != "", F.regexp_extract(found, pattern, group)),
    )


def _up_to_end(following: Column, tag: str) -> Column:
    """The inside of a ``tag`` element out of what follows its opening tag.

    It ends where the depth of its own tag name returns to zero, where a tag stands that
    implies its end, or with the page. Only those tags are looked at.
    """
    nesting, ending = _IMPLIED_ENDS.get(tag, (tag, ""))
    names = "|".join(filter(None, (nesting, ending)))
    marked = rf"</?(?:{names})(?=[\s/>]){_IN_TAG}"
    unmarked = rf"[^<]*+(?:<(?!/?(?:{names})(?=[\s/>]))(?:[a-z]{_IN_TAG})?[^<]*+)*+"
    opens = rf"(?i)^<(?:{nesting})(?=[\s/>])" if nesting else r"^(?!)"
    closes = rf"(?i)^</(?:{nesting})(?=[\s/>])" if nesting else r"^(?!)"

    def step(state: Column, piece: Column) -> Column:
        depth, size = state["depth"], state["size"]
        deeper = F.when(piece.rlike(opens), depth + 1).when(piece.rlike(closes), depth - 1).otherwise(depth)
        ended = state["ended"] | ((depth == 0) & ~piece.rlike(opens))
        return F.struct(
            deeper.alias("depth"),
            F.when(ended, size).otherwise(size + F.length(piece)).alias("size"),
            ended.alias("ended"),
        )

    def nested(whole: Column, head: Column) -> Column:
        rest = F.substr(whole, F.length(head) + 1)
        start = F.struct(F.lit(0).alias("depth"), F.length(head).alias("size"), F.lit(False).alias("ended"))
        pieces = F.regexp_extract_all(rest, F.lit(f"(?is){marked}{unmarked}"), F.lit(0))
        return F.substr(whole, F.lit(1), F.aggregate(pieces, start, step, lambda state: state["size"]))

    def cut(whole: Column) -> Column:
        return once(
            F.regexp_extract(whole, f"(?is)^{unmarked}", 0),
            lambda head: F.when(
                F.substr(whole, F.length(head) + 1, F.lit(16)).rlike(opens), nested(whole, head)
            ).otherwise(head),
        )

    return once(following, cut)


def first_element(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    """Inner HTML of the first matching element, NULL if there is none."""
    following = F.get(F.split(html, f"(?is){opening_tag(tag, attribute, value)}", 2), F.lit(1))
    return _up_to_end(following, tag)


def last_element(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    """Inner HTML of the element that opens last."""
    parts = F.split(html, f"(?is){opening_tag(tag, attribute, value)}")
    return _up_to_end(once(parts, lambda p: F.when(F.size(p) > 1, F.element_at(p, -1))), tag)


def last_stretch(html: Column, tag: str) -> Column:
    """Inner HTML of the last stretch from a ``tag`` to the next end tag, as written."""
    pattern = rf"(?is){opening_tag(tag)}(.*?)</{tag}\s*>"
    return F.get(F.reverse(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), F.lit(0))


def first_element_text(html: Column, tag: str, attribute: str | None = None, value: str | None = None) -> Column:
    return inner_text(first_element(html, tag, attribute, value))


def attribute_value(tag_text: Column, attribute: str) -> Column:
    """Value of an attribute inside tag text, quotes off, references decoded; NULL if absent."""
    pattern = rf"(?is)^{_BEFORE}{attribute}\s*=\s*{_VALUE}"
    raw = F.nullif(F.regexp_extract(tag_text, pattern, 1), F.lit(""))
    return decode_references(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def anchors(html: Column) -> Column:
    """All links in document order: array of (pos, href, text, has_class).

    A link ends at its end tag, at the next link or with the page.
    """
    found = F.regexp_extract_all(html, F.lit(rf"(?is){_LINK_TAG}(?:(?!</?a\b).)*+"), F.lit(0))

    def described(anchor: Column, pos: Column) -> Column:
        tag = F.regexp_extract(anchor, f"(?is)^{_LINK_TAG}", 0)
        return F.struct(
            pos.alias("pos"),
            attribute_value(tag, "href").alias("href"),
            inner_text(F.substr(anchor, F.length(tag) + 1)).alias("text"),
            tag.rlike(rf"(?is)^{_BEFORE}class\s*=").alias("has_class"),
        )

    return F.filter(F.transform(found, described), lambda a: a["href"].isNotNull())


def first_link(fragment: Column, pattern: str) -> Column:
    """href of the first link whose opening tag matches ``pattern``."""
    tag = F.nullif(F.regexp_extract(fragment, rf"(?is){pattern}", 0), F.lit(""))
    return attribute_value(tag, "href")


def first_link_of_class(html: Column, name: str) -> Column:
    return first_link(html, opening_tag("a", "class", name))


def first_link_within(html: Column, tag: str, name: str, link: str | None = None) -> Column:
    """href of the first link inside the first ``tag`` of class ``name``."""
    inside = first_element(html, tag, "class", name)
    return first_link(inside, link or opening_tag("a"))


def directory_address(html: Column) -> Column:
    """Street address of a directory page: marked span inside the marked address."""
    marked = first_element(html, "address", "itemprop", "address")
    return first_element_text(marked, "span", "itemprop", "streetAddress")


def review_address(html: Column) -> Column:
    """Last address of a review page: its marked part if there is one, else all of it."""
    marked = opening_tag("([a-z0-9]+)", "itemprop", "streetAddress")

    def part(block: Column) -> Column:
        # The marked element may be of any kind: its tags get one name, then it is cut out by depth.
        kind = F.regexp_extract(block, f"(?is){marked}", 1)
        tags = F.concat(F.lit("(?i)<(/?)"), kind, F.lit(r"(?=[\s/>])"))
        renamed = F.regexp_replace(block, tags, F.lit("<$1marked"))
        inside = F.when(kind != "", first_element(renamed, "marked", "itemprop", "streetAddress"))
        return inner_text(F.coalesce(inside, block))

    return once(last_element(html, "address"), part)


def marker_cell(html: Column) -> Column:
    """Text of the table cell after the one that holds the map marker."""
    image = rf"""(?is)<img\b[^>]*\ssrc\s*=\s*["']{re.escape(MAP_MARKER)}["'][^>]*>"""
    after = F.get(F.split(html, image, 2), F.lit(1))
    next_cell = r"(?is)^(?:(?!</?t[dr]\b|</table\b).)*+(?:</td\s*>)?\s*<td\b[^>]*>(.*)$"
    return inner_text(_up_to_end(_matched(after, next_cell, 1), "td"))


def result_links(html: Column) -> Column:
    """Links of the ranked results (h3.r under div#search), best first."""
    results = first_element(html, "div", "id", "search")
    heads = F.regexp_extract_all(
        results, F.lit(rf"(?is){opening_tag('h3', 'class', 'r')}((?:(?!</?h3\b).)*+)"), F.lit(1)
    )
    links = F.transform(heads, lambda h: first_link(h, opening_tag("a")))
    return F.filter(links, lambda u: u.isNotNull())
