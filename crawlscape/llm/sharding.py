"""Weighted rendezvous hashing of stable record keys.

For a key and every shard an independent uniform number u is derived by hashing;
the shard with the smallest ``-ln(u) / weight`` owns the key. Adding a shard can
only take keys into itself, and a key's owner depends on nothing but the key and
the shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_rows, parquet

SHARDS = 40
ROW_OVERHEAD = 16


def _cost(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int"), F.lit(seed)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / weight


def owners(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None, seed: int = 2077) -> DataFrame:
    """Adds ``shard``, and ``grown_shard`` for one more shard of ``grown_weight``.

    A null key is a key like any other. Repeated keys share their shard. Shards of
    weight 0 own nothing; at least one weight has to be positive.
    """
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(w).alias("w")) for i, w in live])
    best = F.array_min(F.transform(shards, lambda x: F.struct(_cost(F.col(key), x["s"], x["w"], seed).alias("c"), x["s"].alias("s"))))
    out = df.withColumn("__own", best).withColumn("shard", F.col("__own.s").cast("int"))
    if grown_weight is None:
        return out.withColumn("grown_shard", F.lit(None).cast("int")).drop("__own")
    extra = _cost(F.col(key), F.lit(len(weights)), F.lit(float(grown_weight)), seed)
    return out.withColumn("grown_shard", F.when(extra < F.col("__own.c"), F.lit(len(weights))).otherwise(F.col("shard")).cast("int")).drop("__own")


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``key``; slots number a shard's rows from 0.

    A null text has 16 bytes and CRC 0; an empty table gives no rows; repeated rows
    are kept, each with a slot of its own, in an order that follows from their columns.
    """
    docs = parquet(spark, sf_dir, "documents")
    total = docs.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = owners(light, "doc_id", [1.0] * SHARDS, 1.0).withColumn("law", F.lit("key"))
    return number_rows(placed, ["shard"], ["doc_id"], total // SHARDS, 500).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
