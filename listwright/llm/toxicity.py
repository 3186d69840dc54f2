"""Toxicity: the recurrent network trained on a bounded sample of labelled rows and applied to all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import column, in_arrow, record_batch, texts
from listwright.llm.toxicity_model import Model, Scorer

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
# The sample: at most so many rows of each label, of texts of at most so many code points.
SAMPLE_ROWS = {0: 3000, 1: 1500}
SAMPLE_CHARS = 3000


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learnt from, each once."""
    return labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()


def training_rows(docs: DataFrame, marked: DataFrame, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most SAMPLE_ROWS texts of each label, taken by the hash of their id; rows that share an id count once."""
    sizes = docs.select("doc_id", F.length("text").alias("size")).filter(f"size BETWEEN 1 AND {chars}")
    both = marked.join(sizes.distinct(), "doc_id").select("doc_id", "toxic")
    # Only ids and sizes are shuffled; then the bounded choice goes out to the scan of the texts.
    ranked = [
        both.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for label, rows in SAMPLE_ROWS.items()
    ]
    chosen = F.broadcast(ranked[0].union(ranked[1]).distinct())
    held = docs.select("doc_id", "text").filter(F.length("text").between(1, chars)).join(chosen, "doc_id")
    found = held.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy("doc_id", "toxic").collect()
    return [(row["text"], row["toxic"]) for row in found]


def trained(rows: list[tuple[str, int]], share: float) -> Model | None:
    """The model; none if a label is missing. ``share`` is that of toxic rows among all labelled ones: the sample has more of
    them, so the bias is moved by the difference in log odds."""
    toxic = sum(label for _, label in rows)
    if not 0 < toxic < len(rows):
        return None
    model = Model().train([text for text, _ in rows], [label for _, label in rows])
    model.p["bias"] += np.float32(np.log(share / (1 - share)) - np.log(toxic / (len(rows) - toxic)))
    return model


def _score(parameters: dict | None):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(parameters) if parameters is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            bodies = [body.decode() for body in column(batch, "body")]
            scores = scorer.scores(bodies) if scorer is not None else [0.0] * len(bodies)
            yield record_batch(schema, column(batch, "doc_id"), scores)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    ``score`` is the highest chance of any window of the whole text, 0 for null or empty texts and those without words, and for
    all if the labels lack either class. Rows without an id are scored, not learnt from. Only texts are inputs of a score.
    """
    marked = learnable(labels)
    share = marked.agg(F.avg("toxic")).first()[0]
    model = trained(training_rows(docs, marked), share)
    scored = in_arrow(texts(docs), _score(model.p if model else None), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
