"""Weighted rendezvous sharding in DataFrame functions only.

Every shard scores a record's key, and the highest score takes the record. A
shard's scores do not depend on the others, so an added shard takes records
only into itself: about its share of the weight, and none move elsewhere.

Slots number a shard's rows without gaps. Rows of a shard are split by a hash
into buckets, numbered inside their bucket, and shifted by the sizes of the
buckets before, so no task ever sorts a whole shard. One sum per bucket is all
that is gathered: 24 bytes for each million rows. The bucket depends on the
partition too, so a row that repeats very often does not fill one; the placed
rows, without their texts, are written once, so all readers see the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BUCKET_ROWS = 1_000_000
LEAST_BUCKETS = 64


def _score(key: Column, shard: int, weight: float) -> Column:
    """weight / -ln(u) with u uniform in (0, 1): the highest wins with probability weight / total."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return F.lit(float(weight)) / -F.log((draw + F.lit(0.5)) / F.lit(float(1 << 53)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that wins the key; of equal scores the lower."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    ranked = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return -F.array_max(F.array(*ranked))["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float], grown: float | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot and, if grown gives a new shard's weight, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and the CRC of
    nothing. Rows of a null id share the key of an empty string. Rows that repeat
    get slots of their own. An empty table gives no rows. Other columns are not
    looked at.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = rows.withColumn("shard", rendezvous(key, weights))
    if grown is not None:
        placed = placed.withColumn("grown_shard", rendezvous(key, [*weights, grown]))
    spread = F.xxhash64(key, "text_crc32", "size", F.spark_partition_id())
    placed = written(placed.withColumn("spread", spread), "placed")
    buckets = max(LEAST_BUCKETS, -(-placed.count() // (BUCKET_ROWS * len(weights))))
    placed = placed.withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(inside) - 1)
    out = numbered.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("nth"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *(["grown_shard"] if grown is not None else []))
