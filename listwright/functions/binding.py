"""Name an intermediate value inside a column expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
