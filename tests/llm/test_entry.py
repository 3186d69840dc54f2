"""The queries against their SQL, and the pipeline from end to end, on awkward tables too."""

import random

import pytest
from compare import difference, duck

from listwright.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    query, sql = QUERIES[name]
    assert difference(query(spark, SF_DIR), duck(SF_DIR), sql) is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids, frame = None, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF_DIR)
        assert frame.columns == docs.columns
    ids = {r["doc_id"] for r in frame.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


AWKWARD = "doc_id long, text string, lang string, rank string, task long, set_id string, _keep string"


def awkward_rows():
    chance = random.Random(6)
    words = ["".join(chance.choices("abcdefghijklm", k=chance.randint(2, 9))) for _ in range(300)]
    good = [" ".join(chance.choices(words, k=60)) + ". And so on.\n" + " ".join(chance.choices(words, k=40)) + "." for _ in range(30)]
    rows = [(None, good[0]), (None, None), (1, None), (2, ""), (3, " \n\n"), (4, good[1]), (4, good[1]), (5, good[1]), (4, good[2])]
    rows += [(10 + i, text) for i, text in enumerate(good)] + [(90, "x" + " " * 20_000 + "y " + good[3])]
    return [(*row, "en", "r", 1, "s", "k") for row in rows]


def test_pipeline_of_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    rows = awkward_rows()
    spark.createDataFrame(rows, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, rows[5][1][:200]), (None, "x"), (2, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    frame, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns and frame.schema["task"].dataType == docs.schema["task"].dataType
        counts.append(frame.count())
    assert counts == sorted(counts, reverse=True) and counts[0] < len(rows)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces) > 0


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
