"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows are gathered into items: equal texts stay together, small groups share one of a fixed number of buckets by hash,
and a group too large for one item is dealt into several. So the number of items has a bound of its own and only they
are placed on the driver: from large to small, each where the dot product with the residual capacity is highest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, column, in_arrow, texts
from listwright.llm.packing import token_ids, tokenizer
from listwright.session import materialise

SHARDS = 40
# Items have at most about 1/LARGE of a shard in any dimension; buckets of small groups far less.
LARGE = 64
BUCKETS = 8192
ROW_BYTES = 16
DIMENSIONS = ("bytes", "tokens", "rows")
ITEM_SQL = "item long, shard int, first_slot long"


_SIZED = pa.schema([(name, pa.int64()) for name in ("doc_id", "size", "text_crc32", "tokens")] + [("digest", pa.string())])
_SIZED_SQL = "doc_id long, size long, text_crc32 long, tokens long, digest string"


def _sizes(path: str | None):
    def sizes(batches) -> Iterator[pa.RecordBatch]:
        coder, out = tokenizer(path), Buffer(_SIZED)
        for batch in batches:
            for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
                tokens = len(token_ids(coder, body.decode()))
                yield from out.add((doc_id, len(body) + ROW_BYTES, zlib.crc32(body), tokens, hashlib.md5(body).hexdigest()))
        yield from out.flush()

    return sizes


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, digest): measures and a 128-bit hash of each text (null: empty).

    Tokens are the ids of the byte-level tokenizer and the id that ends a text, as they are packed.
    """
    return in_arrow(texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), _sizes(path), _SIZED_SQL)


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (a row of bytes, tokens, rows), by the dot product with what each shard has left."""
    totals = items.sum(axis=0)
    shares = items / np.where(totals > 0, totals, 1)
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-shares.max(axis=1), kind="stable").tolist():
        need = shares[i]
        fit = (left >= need - 1e-12).all(axis=1)
        gain = left @ need
        # Where it fits nowhere, the same measure tells where it is the least too much.
        out[i] = int(np.argmax(np.where(fit, gain, -np.inf) if fit.any() else gain))
        left[out[i]] -= need
    return out


def shard(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per row of ``docs``.

    The law is ``bytes``: shards have nearly equal sizes (and tokens and rows), as far as single rows allow. Equal texts
    share a shard unless they are over 1/64 of one. ``slot`` counts 0, 1, ... within a shard. Null texts are empty;
    rows without an id, repeated rows and ties are rows like others. Texts of any length are read whole; other columns play no
    part. An empty table gives no rows. ``path`` names the tokenizer's ranks.
    """
    spark: SparkSession = docs.sparkSession
    rows = materialise(sized(docs, path), "sized")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = materialise(groups, "groups")
    totals = groups.agg(*(F.sum(name).alias(name) for name in DIMENSIONS)).first()
    limits = {name: max(1.0, (totals[name] or 0) / (shards * LARGE)) for name in DIMENSIONS}
    over = F.greatest(*(F.col(name) / limits[name] for name in DIMENSIONS))
    # A large group takes over 1/(shards * LARGE) of some total: there are at most 3 * shards * LARGE.
    large = groups.filter(over > 1).select("digest", F.ceil(over).cast("long").alias("parts")).orderBy("digest").collect()
    first, plan = BUCKETS, []
    for digest, parts in large:
        plan.append((digest, first, parts))
        first += parts
    plan = F.broadcast(spark.createDataFrame(plan, "digest string, first long, parts long"))
    # Dealt by the row, not its values, so that rows alike in all spread too; written once, as a row's number is its scan's.
    mixed = F.xxhash64(F.monotonically_increasing_id())
    own = F.col("first") + F.pmod(F.col("mixed"), F.col("parts"))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("long")
    dealt = rows.withColumn("mixed", mixed).join(plan, "digest", "left").withColumn("item", F.coalesce(own, bucket))
    dealt = materialise(dealt.drop("first", "parts", "mixed"), "dealt")
    found = dealt.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    found = found.orderBy("item").collect()  # at most BUCKETS and twice as many as large groups have parts
    where = place(np.array([[r[d] for d in DIMENSIONS] for r in found], float).reshape(-1, 3), shards)
    slots, placed = [0] * shards, []
    for row, s in zip(found, where.tolist()):
        placed.append((row["item"], s, slots[s]))
        slots[s] += row["rows"]
    placed = F.broadcast(spark.createDataFrame(placed, ITEM_SQL))
    within = Window.partitionBy("item").orderBy("digest", "doc_id")
    return (
        dealt.withColumn("at", F.row_number().over(within))
        .join(placed, "item")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("at") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
