"""A log of transactions: records with checksums in numbered parts, replayed up to the first broken one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import versions
from sedimenta.sources.commit_log import CommitLog

RECORD = "lsn bigint, kind string, txn_id bigint, key binary, value binary, commit_ts bigint, crc bigint"


def record_crc() -> Column:
    """CRC-32 of a record's fields, each with its length, so that fields don't run into one another."""
    parts = []
    for c in ("lsn", "kind", "txn_id", "key", "value", "commit_ts"):
        raw = F.hex(F.col(c)) if c in ("key", "value") else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(raw).cast("string"), F.lit(":"), raw), F.lit("-")))
    return F.crc32(F.concat(*parts).cast("binary"))


class Wal:
    """Records are gathered on the driver; ``sync`` writes them as one part, which counts once it is committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log, self.pending = spark, CommitLog(spark, root), []
        state = self.log.latest()[1]
        if state is None:
            state = {"parts": [], "next": 0}
            self.log.commit(1, state)
        self.next = state["next"]

    def append(self, kind: str, txn_id: int, key: bytes | None = None, value: bytes | None = None, commit_ts: int | None = None) -> int:
        """Add a record of kind insert, delete, commit or rollback; its place in the log."""
        if kind not in ("insert", "delete", "commit", "rollback"):
            raise ValueError(f"no such kind: {kind}")
        self.pending.append((self.next, kind, txn_id, key, value, commit_ts, None))
        self.next += 1
        return self.next - 1

    def commit(self, txn_id: int, commit_ts: int) -> int:
        """A transaction's end; it and all before it are on disk when this returns."""
        lsn = self.append("commit", txn_id, commit_ts=commit_ts)
        self.sync()
        return lsn

    def sync(self) -> int:
        if not self.pending:
            return 0
        n, path = len(self.pending), f"{self.log.root}/wal-{uuid.uuid4().hex}"
        number, state = self.log.latest()
        self.spark.createDataFrame(self.pending, RECORD).withColumn("crc", record_crc()).coalesce(1).write.parquet(path)
        self.log.commit(number + 1, {"parts": [*state["parts"], path], "next": self.next})
        self.pending = []
        return n

    def records(self) -> DataFrame:
        """What was written, up to the first record whose checksum is wrong."""
        parts = self.log.latest()[1]["parts"]
        if not parts:
            return self.spark.createDataFrame([], RECORD).drop("crc")
        rows = self.spark.read.schema(RECORD).parquet(*parts)
        broken = F.broadcast(rows.filter(~F.coalesce(F.col("crc") == record_crc(), F.lit(False))).agg(F.min("lsn").alias("broken")))  # one row
        good = rows.crossJoin(broken).filter(F.col("broken").isNull() | (F.col("lsn") < F.col("broken")))
        return good.drop("crc", "broken")

    def recover(self) -> DataFrame:
        """Operations of committed transactions, as ``versions.recover`` gives them."""
        return versions.recover(self.records())

    def truncate(self) -> None:
        """Begin anew after a checkpoint; places go on where they were."""
        number, state = self.log.latest()
        self.log.commit(number + 1, {**state, "parts": []})
        for path in state["parts"]:
            self.log.drop_folder(path)
