"""Table schemas. Strings throughout; NULL means missing, '' appears only in written reports."""

from pyspark.sql import types as T

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _table(**columns):
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


LISTINGS = _table(list_id=_S, line_no=_L, section=_S, search_name=_S)
PAGES = _table(page_id=_L, source=_S, lookup_key=_S, url=_S, html=_S)
PAGE_FACTS = _table(
    page_id=_L, source=_S, lookup_key=_S, url=_S, name=_S, phone=_S, address_raw=_S,
    website=_S, link=_S,
    facebook=_S, yelp=_S, yellowpages=_S, urbanspoon=_S, twitter=_S,
)
ENRICHED = _table(
    list_id=_S, line_no=_L, section=_S, search_name=_S, found_name=_S,
    score=T.DoubleType(), needs_review=T.BooleanType(),
    address=_S, address_error=T.BooleanType(), phone=_S, website=_S,
    facebook=_S, twitter=_S, profile_score=T.DoubleType(), yelp=_S, yellowpages=_S, urbanspoon=_S,
)
