"""Connected components: links are contracted within tasks, then least labels spread and are followed; nothing meets on the driver
but a count."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import in_arrow, numbers, record_batch
from listwright.session import materialise

# Nodes whose links a task contracts at a time, which bounds what it holds.
HELD = 250_000

_LABELS = pa.schema([("node", pa.int64()), ("root", pa.int64())])
_LABELS_SQL = "node long, root long"


def _contracted(batches) -> Iterator[pa.RecordBatch]:
    """Stream links: each node with the least one that this task's links reach, itself included. Of more than HELD nodes what
    is known goes out and the task begins anew, so a node may come out several times; no link is lost."""
    up: dict[int, int] = {}  # towards the least node

    def root(node: int) -> int:
        while (above := up.setdefault(node, node)) != node:
            up[node] = node = up[above]
        return node

    def known() -> pa.RecordBatch:
        return record_batch(_LABELS, list(up), [root(node) for node in up])

    for batch in batches:
        for a, b in zip(numbers(batch, "a").tolist(), numbers(batch, "b").tolist()) if batch.num_rows else ():
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > HELD:
            yield known()
            up.clear()
    if up:
        yield known()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b), whole numbers: ``root`` is the least node that links reach.

    Each task first puts its links into trees of depth one. If they have no more rows than a task holds, one more pass joins
    them; larger ones take steps over the whole cluster. Each step takes the least label among a node's neighbours and then that
    label's own label, so chains halve with every step. Steps are written tables: lost executors cost one step.
    Nulls link nothing; repeated links and links of a node with itself change nothing; no links, no rows.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().filter("a <> b")
    trees = materialise(in_arrow(links, _contracted, _LABELS_SQL), "cc-trees")
    links = trees.select(F.col("root").alias("a"), F.col("node").alias("b"))
    if trees.count() <= HELD:
        return materialise(in_arrow(links.coalesce(1), _contracted, _LABELS_SQL), "cc-labels")
    links = links.filter("a <> b").distinct()
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))
    labels = materialise(labels, "cc-labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("seen"))
        )
        step = labels.join(near, "node").select("node", "root", F.least("root", "seen").alias("seen"))
        jump = labels.select(F.col("node").alias("seen"), F.col("root").alias("beyond"))
        step = step.join(jump, "seen").select("node", F.col("root").alias("old"), F.least("seen", "beyond").alias("root"))
        step = materialise(step, "cc-labels")
        labels = step.select("node", "root")
        if step.filter("root < old").isEmpty():
            return labels
