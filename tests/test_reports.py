"""Named reports: bytes, numbered parts, replacement all at once, failures."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from listwright import session
from listwright.operators.report import document_parts, document_rows
from listwright.plans.catalog import documents
from listwright.sources import document_sink
from listwright.sources.reports import read_documents, write_named_documents

SUFFIX = "_X.rtf"


@pytest.fixture
def rows(spark):
    """Lists of one line to a thousand, two of one name, one with odd characters; texts that end in newlines or not."""
    lists = [("lists/a.txt", 1), ("lists/long list é%20.txt", 1000), ("one/same.txt", 7), ("two/same.txt", 30), ("b", 99)]
    blocks = [(name, 2 * i, f"{i}é\n" * (1 + i % 3) + ("\n" if i % 5 else "")) for name, n in lists for i in range(n)]
    blocks += [(None, 1, "no list"), ("b", 500, None)]
    return document_rows(spark.createDataFrame(blocks, "list_id string, line_no long, block string").filter("list_id IS NOT NULL"))


def wanted(rows):
    parts = document_parts(rows.filter("text IS NOT NULL"), part_lines=100).collect()
    out = {}
    for r in sorted(parts, key=lambda r: (r["list_id"], r["part_no"] if r["part_no"] >= 0 else -1)):
        out[r["list_id"]] = out.get(r["list_id"], "") + r["text"]
    return sorted(out.values())


def held(folder):
    """Documents, their numbered files put together."""
    out = {}
    for file in sorted(Path(folder).iterdir()):
        stem, _, number = file.name.removesuffix(".rtf").rpartition("-")
        whole = stem if number.isdigit() and len(number) == 5 else file.name.removesuffix(".rtf")
        out[whole] = out.get(whole, "") + file.read_bytes().decode()
    return out


@pytest.mark.parametrize("part_lines", [10, 250, 100_000])
def test_bytes(spark, rows, tmp_path, part_lines):
    write_named_documents(rows, f"{tmp_path}/out", SUFFIX, part_lines)
    assert sorted(held(tmp_path / "out").values()) == wanted(rows)
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert "a_X.rtf" in names and any(n.startswith("same-") for n in names)
    if part_lines == 100_000:
        assert len(names) == 5 and "long list é%20_X.rtf" in names
    else:
        numbers = sorted(n for n in names if n.startswith("long list"))
        assert numbers == [f"long list é%20_X-{i:05d}.rtf" for i in range(len(numbers))] and len(numbers) > 1
    read = {r["file"]: r["text"] for r in read_documents(spark, f"{tmp_path}/out").collect()}
    assert read == {p.name: p.read_bytes().decode() for p in (tmp_path / "out").iterdir()}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_replaced_at_once(spark, rows, tmp_path):
    out = f"{tmp_path}/out"
    write_named_documents(rows, out, SUFFIX)
    write_named_documents(rows.filter("list_id = 'b'"), out, SUFFIX)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b_X.rtf"]
    write_named_documents(rows.limit(0), out, SUFFIX)
    assert list((tmp_path / "out").iterdir()) == [] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_failing_task_leaves_the_old_report(spark, rows, tmp_path):
    out = f"{tmp_path}/out"
    write_named_documents(rows, out, SUFFIX)
    before = held(out)
    text = F.when((F.col("line_no") == 1500), F.raise_error(F.lit("broken line"))).otherwise(F.concat("text", F.lit("new")))
    placed = rows.select(F.concat(F.lit("x"), F.xxhash64("list_id")).alias("file"), "line_no", text.alias("text"))
    placed = placed.repartition("file").sortWithinPartitions("file", "line_no")
    with pytest.raises(Exception, match="broken line"):
        document_sink.write_files(placed, out, 5, 1)
    assert held(out) == before and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_missing_lines_leave_the_old_report(spark, rows, tmp_path):
    out = f"{tmp_path}/out"
    write_named_documents(rows, out, SUFFIX)
    before = held(out)
    placed = rows.select(F.lit("f").alias("file"), "line_no", "text").coalesce(1)
    with pytest.raises(Exception, match="were written"):
        document_sink.write_files(placed, out, 1, 1)
    assert held(out) == before and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_settled_after_a_crash(spark, rows, tmp_path):
    out = tmp_path / "out"
    write_named_documents(rows, str(out), SUFFIX)
    before = held(out)
    out.rename(tmp_path / "out.replaced")  # as if the driver had ended between the renames
    assert read_documents(spark, str(out)).count() == len(list(out.iterdir()))
    assert held(out) == before


def test_paths_name_their_file_system_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host"

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        document_sink.reachable(Session(), "/tmp/x")
    assert document_sink.reachable(Session(), "hdfs://h/x") == "hdfs://h/x"


def test_report_in_a_shared_folder_named_without_a_file_system(spark, monkeypatch, tmp_path):
    """On a cluster spark.checkpoint.dir may be a bare path, which Spark finds on its default file system."""
    customers = [(i, f"Customer {i}", i % 2, 100.0 * i, "MACHINERY") for i in range(20)]
    columns = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(customers, columns).write.parquet(f"{tmp_path}/in/customer.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/in/nation.parquet")
    for module in (session, documents):
        monkeypatch.setattr(module, "shared_folder", lambda spark: f"{tmp_path}/shared")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    files = {r["file"] for r in documents.written_reports(spark, f"{tmp_path}/in").collect()}
    assert files == {"A_HYPERLINKED.rtf", "B_HYPERLINKED.rtf"}
