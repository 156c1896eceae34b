"""Algebra of versioned rows: a log holds (key, seqno, value, tombstone), newest seqno wins.

Newest-per-key is an aggregate (``max_by``), not a window: it combines on the map side, so a key
with a third of all versions meets as one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, snapshot: int | Column | None = None, key: str = "key", seq: str = "seqno") -> DataFrame:
    """One row per key: its newest version at or before ``snapshot``; tombstones stay."""
    if snapshot is not None:
        log = log.filter(F.col(seq) <= snapshot)
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def as_of(log: DataFrame, snapshot: int, key: str = "key", seq: str = "seqno") -> DataFrame:
    """What a reader with this snapshot sees."""
    return newest(log, snapshot, key, seq).filter("NOT tombstone")


def overlay(base: DataFrame, log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``base`` (key, value) under the newest versions of ``log``; a tombstone removes the key."""
    top = newest(log, snapshot).select("key", F.col("value").alias("new"), "tombstone")
    out = base.join(top, "key", "full_outer").filter(~F.coalesce("tombstone", F.lit(False)))
    return out.select("key", F.when(F.col("tombstone").isNull(), F.col("value")).otherwise(F.col("new")).alias("value"))


def fold(base: DataFrame, log: DataFrame, watermark: int) -> tuple[DataFrame, DataFrame]:
    """Merge versions up to the watermark into the base; those above it stay in the log."""
    return overlay(base, log, watermark), log.filter(F.col("seqno") > watermark)


def conflicts(log: DataFrame, writes: DataFrame, snapshot: int) -> DataFrame:
    """Keys that ``writes`` holds and that someone has committed after the snapshot."""
    return writes.select("key").join(log.filter(F.col("seqno") > snapshot).select("key"), "key", "left_semi").distinct()


def watermark(snapshots: DataFrame, current: int) -> DataFrame:
    """The oldest live snapshot, or the current time if none lives."""
    return snapshots.agg(F.coalesce(F.min("snapshot"), F.lit(current).cast("long")).alias("watermark"))


def recover(records: DataFrame) -> DataFrame:
    """Operations of committed transactions that weren't rolled back, by commit time, then place in the log.

    ``records``: lsn, kind (insert, delete, commit, rollback), txn_id, key, value, commit_ts.
    """
    ops = records.filter(F.col("kind").isin("insert", "delete")).select("lsn", "kind", "txn_id", "key", "value")
    commits = records.filter("kind = 'commit'").groupBy("txn_id").agg(F.max("commit_ts").alias("commit_ts"))
    undone = records.filter("kind = 'rollback'").select("txn_id").distinct()
    return ops.join(commits.join(undone, "txn_id", "left_anti"), "txn_id").select("txn_id", "commit_ts", "lsn", "kind", "key", "value")


def lookup_state(log: DataFrame, keys: DataFrame, snapshot: int) -> DataFrame:
    """found, deleted or absent for each key asked for, with the value found."""
    top = newest(log, snapshot).select("key", "value", "tombstone")
    state = F.when(F.col("tombstone").isNull(), "absent").when(F.col("tombstone"), "deleted").otherwise("found")
    return keys.join(top, "key", "left").select("key", state.alias("state"), F.when(~F.col("tombstone"), F.col("value")).alias("value"))


def once(runs: DataFrame) -> DataFrame:
    """Of equal (key, seqno) the entry of the newest run (lowest ``run``)."""
    rest = [c for c in runs.columns if c not in ("key", "seqno")]
    top = runs.groupBy("key", "seqno").agg(F.min_by(F.struct(*rest), "run").alias("v"))
    return top.select("key", "seqno", *[F.col(f"v.{c}").alias(c) for c in rest])


def _merged(runs: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """Entries above the floor, and the newest of each key at or below it.

    Both are aggregates that combine before the shuffle: a key with a third of all versions at or below the
    floor meets as one row from each task, and its versions above it are dealt out by their sequence numbers.
    """
    names = ["key", "seqno", "value", "tombstone"]
    above = once(runs.filter(F.col("seqno") > floor)).select(*names)
    low = runs.filter(F.col("seqno") <= floor).groupBy("key")
    low = low.agg(F.max_by(F.struct("seqno", "value", "tombstone"), F.struct("seqno", -F.col("run"))).alias("v"))
    return above, low.select("key", *[F.col(f"v.{c}").alias(c) for c in names[1:]])


def merge_runs(runs: DataFrame, floor: int, bottom: bool) -> DataFrame:
    """One run of several (``run`` is the age, 0 the newest).

    Of equal (key, seqno) the newest run's entry stays; all versions above the floor stay, and of those at or
    below it the newest of a key, unless it is a tombstone in the bottom level.
    """
    above, below = _merged(runs, floor)
    return above.unionByName(below.filter("NOT tombstone") if bottom else below)


def merge_stats(runs: DataFrame, floor: int, bottom: bool) -> DataFrame:
    """Entries in and out, versions and tombstones dropped, and amplification of one merge."""
    above, below = _merged(runs, floor)
    gone = F.count_if(F.col("tombstone") & F.lit(bottom)).alias("tombstones_dropped")
    out = runs.agg(F.count(F.lit(1)).alias("entries_in")).crossJoin(above.agg(F.count(F.lit(1)).alias("a")))
    out = out.crossJoin(below.agg(F.count(F.lit(1)).alias("b"), gone))  # one row each
    out = out.withColumn("entries_out", F.col("a") + F.col("b") - F.col("tombstones_dropped")).drop("a", "b")
    out = out.withColumn("versions_dropped", F.col("entries_in") - F.col("entries_out") - F.col("tombstones_dropped"))
    return out.withColumn("amplification", F.when(F.col("entries_out") == 0, 1.0).otherwise(F.col("entries_in") / F.col("entries_out")))


def out_of_order(sorted_rows: DataFrame, key: str = "key", at: str = "pos", part: str = "run") -> DataFrame:
    """Number of rows whose key isn't above the one stored before it in the same run."""
    before = F.lag(key).over(Window.partitionBy(part).orderBy(at))
    return sorted_rows.withColumn("before", before).agg(F.count_if(F.col("before") >= F.col(key)).alias("violations"))
