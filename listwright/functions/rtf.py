"""Report markup: escaped text, link fields and blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed_values import PRINTED_ATTRIBUTES, RTF_BLOCK_END, RTF_LINE
from listwright.functions.binding import once
from listwright.functions.urls import display_url

# Control characters, the three characters with a meaning in RTF, and all non-ASCII.
_SPECIAL = r"\x00-\x1f\\{}\x{80}-\x{10FFFF}"


def _escaped_unit(unit: Column) -> Column:
    signed = F.when(unit < 32768, unit).otherwise(unit - 65536)
    return F.concat(F.lit("\\u"), signed.cast("string"), F.lit("?"))


def _escaped_char(char: Column) -> Column:
    def escaped(code: Column) -> Column:
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(code < 0x10000, _escaped_unit(code)).otherwise(
            F.concat(_escaped_unit(high), _escaped_unit(low))
        )

    return once(F.ascii(char), escaped)


def escape_text(text: Column) -> Column:
    """Special and non-ASCII characters as \\uN?, N a signed 16-bit number per UTF-16 unit."""
    def escaped(given: Column) -> Column:
        pieces = F.regexp_extract_all(given, F.lit(f"[{_SPECIAL}]|[^{_SPECIAL}]+"), F.lit(0))
        parts = F.transform(
            pieces, lambda p: F.when(p.rlike(f"^[{_SPECIAL}]"), _escaped_char(p)).otherwise(p)
        )
        return F.when(given.rlike(f"[{_SPECIAL}]"), F.array_join(parts, "")).otherwise(given)

    return once(text, escaped)


def link_field(url: Column, label: Column) -> Column:
    return F.concat(
        F.lit("{\\field{\\*\\fldinst{HYPERLINK "),
        escape_text(url),
        F.lit("}}{\\fldrslt{\\ul\\cf1"),
        label,
        F.lit("}}}"),
    )


def website_markup(url: Column) -> Column:
    return F.concat(link_field(url, escape_text(display_url(url))), F.lit(RTF_LINE))


def profile_markup(url: Column, label: str) -> Column:
    return F.concat(
        link_field(url, F.lit(label)),
        F.lit(RTF_LINE),
        escape_text(display_url(url)),
        F.lit(RTF_LINE),
    )


def attribute_markup(attribute: str, value: Column) -> Column:
    """Markup of one report attribute; NULL for a missing value."""
    if attribute == "website":
        return website_markup(value)
    if attribute in ("facebook", "twitter"):
        return profile_markup(value, attribute.capitalize())
    return F.concat(escape_text(value), F.lit(RTF_LINE))


def listing_block(search_name: Column, found_name: Column, needs_review: Column) -> Column:
    """Block of one listing; reads the printed attributes from columns of their names."""
    notice = F.concat(F.lit("Search: "), escape_text(search_name), F.lit("\\line\n"))
    parts = [attribute_markup(name, F.col(name)) for name in PRINTED_ATTRIBUTES]
    return F.concat_ws(
        "",
        F.when(needs_review, notice),
        escape_text(found_name),
        F.lit(RTF_LINE),
        *parts,
        F.lit(RTF_BLOCK_END),
    )
