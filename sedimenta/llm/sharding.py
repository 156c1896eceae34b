"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a score for a record key; the highest score takes the record. A score
depends on the key, the shard and the shard's weight only, so one more shard takes rows
only into itself, about its share of the weights, and no row moves between old shards.

Slots number the rows of a shard without gaps. Rows are written once with a row number that
holds their partition and place; a block of at most 2^16 neighbouring rows is numbered by
itself, and the sums of the blocks before it are added, so a hot key is split like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, small

BLOCK_BITS = 16


def score(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u) of a uniform draw u in (0, 1) for this key and shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -weight / F.log(u)


def winner(key: Column, weights: list[float]) -> Column:
    """Struct (score, shard) of the shard that takes the key."""
    table = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_max(
        F.transform(table, lambda x: F.struct(score(key, x["shard"], x["weight"]).alias("score"), x["shard"].alias("shard")))
    )


def shard_rows(
    docs: DataFrame, weights: list[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): one row per row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 16, a null text having none. Rows of one id, and all
    rows with a null id, share a shard. Of equal scores the later of the shards takes the record, but a new shard
    none. An empty table has no rows. Other columns of ``docs`` aren't read, so their names may clash.
    """
    text, n = F.coalesce(F.col(text_col), F.lit("")), len(weights)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        winner(F.col(id_col), weights).alias("best"),
    )
    grown = score(F.col("doc_id"), F.lit(n), F.lit(float(grown_weight)))
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("best.shard").alias("shard"),
        F.when(grown > F.col("best.score"), F.lit(n)).otherwise(F.col("best.shard")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = cut(rows.withColumn("block", F.shiftright("rid", BLOCK_BITS)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = cut(blocks.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("rid"))
    return (
        rows.withColumn("place", place)
        .join(small(blocks), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).alias("slot"), "grown_shard")
    )


def op9_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs, [1.0] * 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
