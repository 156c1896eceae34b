"""Planning over sorted runs: metadata, level scores, compaction choice, manifest replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators import versions

LEVELS, TRIGGER, BASE_BYTES, MULTIPLIER = 7, 4, 8 * 1024 * 1024, 10
ENTRY_OVERHEAD = 64


def run_meta(entries: DataFrame, run: str = "run") -> DataFrame:
    """Per run: key range, seqno range, entries, bytes (key + value + a fixed overhead)."""
    size = F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)) + ENTRY_OVERHEAD
    return entries.groupBy(run).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seqno").alias("min_seqno"),
        F.max("seqno").alias("max_seqno"), F.count(F.lit(1)).alias("entries"), F.sum(size).cast("long").alias("bytes"),
    )


def level_budget(level: Column) -> Column:
    """Bytes that a level below the first may hold."""
    return F.lit(float(BASE_BYTES)) * F.pow(F.lit(float(MULTIPLIER)), level - 1)


def level_scores(tables: DataFrame) -> DataFrame:
    """(level, tables, bytes, score): tables over the trigger at level 0, bytes over the budget below."""
    per = tables.groupBy("level").agg(F.count(F.lit(1)).alias("tables"), F.sum("bytes").cast("long").alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("tables") / F.lit(float(TRIGGER))).otherwise(F.col("bytes") / level_budget(F.col("level")))
    return per.withColumn("score", score)


def pick_level(tables: DataFrame) -> DataFrame:
    """The level with the highest score of 1 or more that has a level below it; ties go to the lowest."""
    return level_scores(tables).filter((F.col("score") >= 1) & (F.col("level") < LEVELS - 1)).orderBy(F.col("score").desc(), "level").limit(1)


def overlapping(tables: DataFrame, low, high) -> DataFrame:
    """Tables whose key range meets [low, high]."""
    return tables.filter((F.col("min_key") <= high) & (F.col("max_key") >= low))


def pick_compaction(tables: DataFrame) -> DataFrame:
    """Input tables of the next compaction: all of level 0 or the largest of its level, and what they meet below."""
    level = F.broadcast(pick_level(tables).select(F.col("level").alias("from_level")))  # one row
    at = tables.join(level, F.col("level") == F.col("from_level"))
    # the largest of the level by a top-1, as all tables of a level are in one place for a window
    largest = at.filter("level > 0").orderBy(F.col("bytes").desc(), "id").limit(1)
    sources = at.filter("level = 0").unionByName(largest)
    span = F.broadcast(sources.groupBy("from_level").agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi")))  # one row
    met = tables.join(span, (F.col("level") == F.col("from_level") + 1) & (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo")))
    names = ["id", "level", "min_key", "max_key", "bytes"]
    return sources.select(*names).unionByName(met.select(*names))


def lookup_order(tables: DataFrame, key) -> DataFrame:
    """Tables that may hold the key, in the order to ask them: level 0 newest first, then level by level."""
    return overlapping(tables, key, key).withColumn("newest", F.when(F.col("level") == 0, -F.col("id")).otherwise(0)).orderBy("level", "newest", "id").drop("newest")


def replay_manifest(edits: DataFrame) -> DataFrame:
    """Live tables after an edit log (seq, kind add/remove/snapshot, id): the last edit of an id since the last snapshot."""
    since = F.broadcast(edits.filter("kind = 'snapshot'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("since")))  # one row
    after = edits.join(since, F.col("seq") > F.col("since")).filter("kind <> 'snapshot'")
    return after.groupBy("id").agg(F.max_by("kind", "seq").alias("kind")).filter("kind = 'add'").select("id")


def orphans(files: DataFrame, live: DataFrame) -> DataFrame:
    return files.join(live, "id", "left_anti")


def bloom_parameters(keys: int, bits_per_key: int = 10) -> tuple[int, int, float]:
    """Bits, hash functions and the expected false positive rate of a filter."""
    import math

    bits = max(64, keys * bits_per_key)
    k = max(1, round(bits_per_key * math.log(2)))
    return bits, k, (1 - math.exp(-k * keys / bits)) ** k


class Bloom:
    """A filter over the keys of a frame, built in tasks and merged, to ask for single keys on the driver."""

    def __init__(self, made):
        self._made = made

    @classmethod
    def build(cls, keys: DataFrame, column: str = "key", bits_per_key: int = 10) -> Bloom:
        n = max(1, keys.count())
        bits = bloom_parameters(n, bits_per_key)[0]
        plain = keys.select(F.hex(column).alias("k") if isinstance(keys.schema[column].dataType, T.BinaryType) else F.col(column).cast("string").alias("k"))
        return cls(plain.filter("k IS NOT NULL")._jdf.stat().bloomFilter("k", n, bits))

    def contains(self, key) -> bool:
        """False only if the key isn't there."""
        return self._made.mightContainString(bytes(key).hex().upper() if isinstance(key, (bytes, bytearray)) else str(key))

    def merge(self, other: Bloom) -> Bloom:
        self._made.mergeInPlace(other._made)
        return self


def write_run(entries: DataFrame, path: str, partitions: int, bloom: bool = True) -> None:
    """A sorted run: range-partitioned files, sorted inside, with Parquet statistics and bloom filters on the key."""
    out = entries.repartitionByRange(partitions, "key").sortWithinPartitions(F.col("key"), F.col("seqno").desc()).write
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true")
    out.parquet(path)


def read_run(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The entries of a run in stored order: by key, newest first."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).orderBy("key", F.col("seqno").desc())


def checksum(entries: DataFrame) -> int:
    """A checksum of a run's entries that doesn't depend on their order."""
    return entries.agg(F.bit_xor(F.xxhash64("key", "seqno", "value", "tombstone"))).first()[0] or 0


def disorder(spark: SparkSession, path: str, schema: T.StructType | None = None) -> int:
    """Entries of a written run that don't come after the one stored before them in their file."""
    reader = spark.read.schema(schema) if schema else spark.read
    stored = reader.parquet(path).select(
        F.struct("key", -F.col("seqno")).alias("k"), F.col("_metadata.file_path").alias("run"), F.col("_metadata.row_index").alias("pos")
    )
    return versions.out_of_order(stored, key="k").first()[0]


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs in one frame, newest first, with ``run`` as their age."""
    return reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
