"""Arrow-batched functions that need nothing installed on the executors but pandas."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F


def batched(function, returns: str):
    """Pandas UDF that carries the code of its module along."""
    cloudpickle.register_pickle_by_value(sys.modules[function.__module__])
    return F.pandas_udf(function, returns)
