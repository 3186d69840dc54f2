from pathlib import Path

import pytest

from pyspark.sql import functions as F

from listwright.operators.listings import carry_forward, listings
from listwright.sources.lists import read_lists
from listwright.sources.reports import write_named_documents
from listwright.streaming.list_drops import ingest_list_drops


def test_newlines_blanks_and_headers(spark, tmp_path):
    (tmp_path / "june.txt").write_bytes(b"  Ramen:\r\n\r\n Kazu \r\nToi & Moi\rBar:\n\nKazu")
    (tmp_path / "july.txt").write_bytes("Café\n".encode())
    rows = listings(read_lists(spark, str(tmp_path))).orderBy("list_id", "line_no").collect()
    assert [(Path(r[0]).stem, *r[1:]) for r in rows] == [
        ("july", 0, None, "Café"),
        ("june", 2, "Ramen", "Kazu"),
        ("june", 3, "Ramen", "Toi and Moi"),
        ("june", 6, "Bar", "Kazu"),
    ]


def test_files_of_one_name_are_lists_of_their_own(spark, tmp_path):
    for folder in ("a", "b + c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "june.txt").write_text(f"{folder}:\nKazu\n")
    (tmp_path / "a" / "may31").write_text("Kazu\nUnion\n")
    (tmp_path / "a" / "may31.txt").write_text("Bar:\nKazu\n")
    rows = listings(read_lists(spark, str(tmp_path / "*"))).collect()
    got = {(r.list_id.split(str(tmp_path))[1], r.line_no, r.section) for r in rows}
    assert len(rows) == len(got) and got == {
        ("/a/june.txt", 1, "a"),
        ("/b + c/june.txt", 1, "b + c"),
        ("/a/may31", 0, None),
        ("/a/may31", 1, None),
        ("/a/may31.txt", 1, "Bar"),
    }
    out = tmp_path / "out"
    lines = read_lists(spark, str(tmp_path / "*")).select("list_id", "line_no", F.concat("line", F.lit("\n")).alias("text"))
    write_named_documents(lines, str(out), "_X.txt")
    written = sorted(p.name for p in out.iterdir() if not p.name.startswith((".", "_")))
    assert [n.split("-")[0] for n in written] == ["june", "june", "may31", "may31"]
    assert sorted((out / n).read_text() for n in written) == ["Bar:\nKazu\n", "Kazu\nUnion\n", "a:\nKazu\n", "b + c:\nKazu\n"]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    lines = [f"name {i} {'x' * (i % 50)}" for i in range(20_000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = read_lists(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 40_000
    assert all(lines[r.line_no] == r.line for r in rows)
    assert len({(r.list_id, r.line_no) for r in rows}) == 40_000


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_carry_forward_in_chunks(spark, chunk):
    values = [None, None, "a", None, None, None, None, "b", None, "c", None, None, None, None, None]
    df = spark.createDataFrame(
        [(g, i, v) for g in ("x", "y") for i, v in enumerate(values)], "list_id string, line_no long, v string"
    )
    wanted, last = [], None
    for v in values:
        last = v or last
        wanted.append(last)
    got = carry_forward(df, "v", chunk).orderBy("list_id", "line_no").collect()
    assert [r.v for r in got] == wanted * 2


def test_dropped_lists_are_taken_once(spark, tmp_path):
    drops, out, checkpoint = tmp_path / "drops", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    drops.mkdir()

    def run():
        ingest_list_drops(spark, str(drops), out, checkpoint).awaitTermination(120)
        return {(Path(r.list_id).stem, r.line_no, r.search_name) for r in spark.read.parquet(out).collect()}

    (drops / "june6.txt").write_text("Ramen:\nKazu\n")
    assert run() == {("june6", 1, "Kazu")}
    (drops / "june14.txt").write_text("Sumo\nKazu\n")
    both = {("june6", 1, "Kazu"), ("june14", 0, "Sumo"), ("june14", 1, "Kazu")}
    assert run() == both
    assert run() == both
