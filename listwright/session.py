"""Session settings and reliable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that suit these jobs at any size. Shuffle partition counts and split
# sizes belong to the cluster; AQE coalesces what is too fine and splits what is skewed.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="listwright-")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Used where several branches would otherwise repeat a costly scan. Unlike cached
    blocks, the written table outlives the executors that made it, and its size is known
    to the optimizer. With ``partition_by`` readers of one value skip the rest.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def materialise_bucketed(df: DataFrame, label: str, *keys: str, distinct: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Like :func:`materialise`, in as many buckets by ``keys`` as a shuffle has parts, sorted by ``keys`` and ``order``.

    Grouping and windows by ``keys``, or by more columns, need no shuffle then. With ``distinct`` repeated rows are
    left out in the same shuffle that deals the rows out.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    rows = (dealt.distinct() if distinct else dealt).sortWithinPartitions(*keys, *order)
    written = rows.write.bucketBy(buckets, *keys).sortBy(*keys, *order)
    written.option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name).select(df.columns)


def on_its_file_system(spark: SparkSession, folder: str) -> str:
    """A folder that is there, with the file system that Spark finds it on; through mounts, as of viewfs, that behind them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    return files.resolvePath(path).toString()
