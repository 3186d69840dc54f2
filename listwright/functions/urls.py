"""Links and hosts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed_values import HOST_DENYLIST


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; '' where there is none."""
    return F.regexp_replace(text, rf"(?s)^.*?(?:{re.escape(mark)}|\z)", "")


def percent_decode(text: Column) -> Column:
    """Decode %XX; '+' and malformed escapes stay as they are."""
    valid = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(valid, F.lit("+"), F.lit("%2B")))


def unwrap_redirect(href: Column) -> Column:
    """Target of '/url?q=TARGET&...'."""
    return after(before(href, "&"), "=")


def unquote_redirect(href: Column) -> Column:
    """Target of a redirect whose query is escaped: decode first, then cut."""
    return before(after(percent_decode(href), "="), "&")


def display_url(url: Column) -> Column:
    return percent_decode(percent_decode(url))


def host_labels(url: Column) -> Column:
    return F.split(before(after(url, "//"), "/"), r"\.")


def has_host(url: Column) -> Column:
    return F.get(host_labels(url), F.lit(0)) != ""


def is_denied(url: Column, denied: list[str] | None = None) -> Column:
    names = HOST_DENYLIST if denied is None else denied
    return F.arrays_overlap(host_labels(url), F.array(*[F.lit(n) for n in names]))


def is_root_url(url: Column) -> Column:
    return url.rlike("^https?://[^/]+/*$")


def strip_www(url: Column) -> Column:
    """What follows 'www.'; without one, the link less its scheme."""
    return F.regexp_replace(url, r"(?s)^(?:.*?www\.|[a-z]+://)", "")


def page_key(url: Column) -> Column:
    """Address of a page without fragment, query and closing slashes."""
    return F.rtrim(before(before(url, "#"), "?"), F.lit("/"))
