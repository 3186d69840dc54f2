"""Phone numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed_values import PHONE_ANY, PHONE_LOOSE, PHONE_NODE


def is_strict_phone(text: Column) -> Column:
    return text.rlike(PHONE_NODE)


def phone_text_node(html: Column) -> Column:
    """First text node of a page that is nothing but a phone number."""
    nodes = F.filter(F.split(html, "<[^>]*>"), is_strict_phone)
    return F.get(nodes, F.lit(0))


def phone_loose(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PHONE_LOOSE, 0), F.lit(""))


def phones_all(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE_ANY), F.lit(0))


def phone_format(phone: Column) -> Column:
    """(514) 273-7442 -> 514.273.7442"""
    return F.translate(phone, " -()", "..")
