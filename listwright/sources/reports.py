"""Report files: a folder per list, or named documents that are put in place all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.session import materialise
from listwright.sources.document_sink import reachable, settle, write_files
from listwright.sources.lists import decoded_path, list_name

# Lines after which a document goes on in another file.
PART_LINES = 100_000


def write_documents(rows: DataFrame, path: str) -> None:
    """Write (list_id, line_no, text) as text files under ``path/list_id=...``.

    Rows are range-partitioned by list and line, so a long list is written by many tasks;
    its part files, taken in name order, are the document.
    """
    (
        rows.repartitionByRange("list_id", "line_no")
        .sortWithinPartitions("list_id", "line_no")
        # The text writer ends every row with a newline of its own.
        .select("list_id", F.regexp_replace("text", r"\n\z", "").alias("text"))
        .write.partitionBy("list_id")
        .mode("overwrite")
        .text(path)
    )


def document_names(lists: DataFrame, suffix: str) -> DataFrame:
    """(list_id, document): file name of every list's document.

    It is the list's name with ``suffix``; lists that share a name carry a digest of their key.
    """
    name = list_name(F.col("list_id"))
    shared = F.count(F.lit(1)).over(Window.partitionBy(name)) > 1
    mark = F.when(shared, F.concat(F.lit("-"), F.left(F.sha2("list_id", 256), F.lit(12)))).otherwise("")
    return lists.select("list_id").distinct().select("list_id", F.concat(name, mark, F.lit(suffix)).alias("document"))


def file_parts(rows: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """(document, block, part, parts): which part of its document a block of lines goes to.

    Only the blocks' counts meet. Blocks are put together to parts of ``part_lines`` lines, at most twice that.
    """
    blocks = rows.groupBy("document", _block(part_lines).alias("block")).agg(F.count(F.lit(1)).alias("lines"))
    of_document = Window.partitionBy("document")
    before = F.sum("lines").over(of_document.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    part = F.expr(f"coalesce(before, 0L) div {part_lines}").cast("int")
    parts = blocks.withColumn("before", before).withColumn("part", part)
    return parts.select("document", "block", "lines", "part", (F.max("part").over(of_document) + 1).alias("parts"))


def _block(part_lines: int) -> Column:
    return F.floor(F.col("line_no") / part_lines)


def write_named_documents(rows: DataFrame, path: str, suffix: str, part_lines: int = PART_LINES) -> None:
    """Write (list_id, line_no, text) as files under ``path``, one per list, named after the list.

    The texts in order, with nothing between, are the document. One of more than ``part_lines`` lines is cut into numbered
    files, which in order are the document: ``june_X-00000.rtf``, ``june_X-00001.rtf``, ... So no task writes more than a
    few of them at a time. All files take the place of what stood under ``path`` at once, or none does.
    Rows without a list, and null texts, are left out.
    """
    rows = rows.filter("list_id IS NOT NULL AND line_no IS NOT NULL AND text IS NOT NULL")
    named = rows.join(document_names(rows, suffix), "list_id").select("document", "line_no", "text")
    parts = materialise(file_parts(named, part_lines), "report-parts")
    wanted = parts.agg(
        F.count_distinct("document", "part").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")
    ).first()
    stem, dot, extension = suffix.rpartition(".")
    number = F.concat(F.lit("-"), F.lpad(F.col("part").cast("string"), 5, "0"), F.lit(dot + extension))
    plain = F.expr(f"left(document, length(document) - {len(dot + extension)})")
    file = F.when(F.col("parts") > 1, F.concat(plain, number)).otherwise(F.col("document"))
    placed = named.withColumn("block", _block(part_lines)).join(parts.drop("lines"), ["document", "block"])
    files = placed.select(file.alias("file"), "line_no", "text")
    files = files.repartition("file").sortWithinPartitions("file", "line_no")
    write_files(files, path, wanted["files"], wanted["lines"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the files under ``path``, each whole."""
    settle(reachable(spark, path))
    name = decoded_path(F.substring_index(F.col("_metadata.file_path"), "/", -1))
    return spark.read.text(path, wholetext=True).select(name.alias("file"), F.col("value").alias("text"))
