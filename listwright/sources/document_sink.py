"""A data source that writes documents, a file each, and puts all of them in place at once.

Tasks write whole files under their final names into a folder beside the target. Only when every task has told the
driver what it wrote, and that is all that was asked for, that folder takes the target's place: two renames, however many files
there are. Until then the old documents stay as they are, and a job that fails leaves nothing behind.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

import listwright

FORMAT = "listwright_documents"
SCHEMA = "file string, line_no bigint, text string"
_ATTEMPTS = "_attempts"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), urlsplit(path).path
    return pafs.FileSystem.from_uri(path)


def reachable(spark: SparkSession, path: str) -> str:
    """``path``, if all executors reach it: on a cluster it must name its file system."""
    if ":" in path.split("/")[0]:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} does not name its file system, as in hdfs://... or file:///...")
    return os.path.abspath(path)


def _there(files: pafs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != pafs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    files: int
    lines: int


class DocumentWriter(DataSourceArrowWriter):
    """Rows of a file must come together and in order; files may be of any length."""

    def __init__(self, path: str, overwrite: bool, files: int, lines: int):
        self.path, self.files, self.lines = path.rstrip("/"), files, lines
        self.staged = f"{self.path}.writing-{uuid.uuid4().hex}"
        store, target = file_system(self.path)
        if not _there(store, target):
            settle(self.path)
        elif not overwrite:
            raise ValueError(f"{path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staged = file_system(self.staged)
        attempt = f"{staged}/{_ATTEMPTS}/{TaskContext.get().taskAttemptId()}"
        name = stream = None
        files = lines = 0

        def ended():
            if stream is not None:
                stream.close()
                store.move(f"{attempt}/{name}", f"{staged}/{name}")

        try:
            for batch in iterator:
                for of, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                    if of != name:
                        ended()
                        if files == 0:
                            store.create_dir(attempt, recursive=True)
                        name, files = of, files + 1
                        stream = store.open_output_stream(f"{attempt}/{name}")
                    stream.write((text or "").encode())
                    lines += 1
            ended()
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
            if files:
                store.delete_dir(attempt)
            raise
        return Written(files, lines)

    def commit(self, messages: list[Written | None]) -> None:
        files, lines = (sum(getattr(m, of) for m in messages if m) for of in ("files", "lines"))
        if (files, lines) != (self.files, self.lines):
            self.abort(messages)
            raise ValueError(f"{files} files of {lines} lines were written, not {self.files} of {self.lines}")
        store, staged = file_system(self.staged)
        target = file_system(self.path)[1]
        store.create_dir(staged, recursive=True)  # no documents, an empty folder
        if _there(store, f"{staged}/{_ATTEMPTS}"):
            store.delete_dir(f"{staged}/{_ATTEMPTS}")
        old = f"{target}.replaced"
        if _there(store, target):
            if _there(store, old):
                store.delete_dir(old)
            store.move(target, old)
        store.move(staged, target)
        if _there(store, old):
            store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, staged = file_system(self.staged)
        if _there(store, staged):
            store.delete_dir(staged)


def settle(path: str) -> None:
    """Put the old documents back, if a driver ended between the two renames."""
    store, target = file_system(path.rstrip("/"))
    old = f"{target}.replaced"
    if not _there(store, target) and _there(store, old):
        store.move(old, target)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite, int(self.options["files"]), int(self.options["lines"]))


def write_files(rows: DataFrame, path: str, files: int, lines: int) -> None:
    """Write ``rows`` (file, line_no, text), each partition sorted by file and line and no file in two, as files under ``path``.

    What stood there goes, once all is written. ``files`` and ``lines`` are how many there must be in the end.
    """
    spark = rows.sparkSession
    # Executors need no copy of this package.
    cloudpickle.register_pickle_by_value(listwright)
    spark.dataSource.register(DocumentSource)
    options = {"path": reachable(spark, path), "files": str(files), "lines": str(lines)}
    rows.select("file", "line_no", "text").write.format(FORMAT).options(**options).mode("overwrite").save()
