"""A version log as a stream: each micro-batch is added to the store's state, which is folded now and then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import versions
from sedimenta.sources.commit_log import CommitLog

#: Parts that a read puts together at most before they are folded into one.
FOLD_EVERY = 16


class StreamFold:
    """Keeps (key, seqno, value, tombstone), newest per key, exactly once for each batch id.

    A batch writes its own newest versions as a part; every ``every`` parts are folded into one, so a batch's work
    follows its size and not the state's.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, every: int = FOLD_EVERY):
        self.spark, self.log, self.schema, self.every = spark, CommitLog(spark, root), schema, every

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def state(self) -> DataFrame:
        state = self.log.latest()[1]
        return versions.newest(self._read(state["parts"] if state else []))

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.log.root}/state-{uuid.uuid4().hex}"
        versions.newest(rows.select(*self._read([]).columns)).write.parquet(path)
        return path

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        number, state = self.log.latest()
        if state and batch_id <= state["batch"]:
            return  # a batch that is replayed after a failure
        parts = [*(state["parts"] if state else []), self._write(batch)]
        if len(parts) > self.every:
            parts = [self._write(self._read(parts))]
        self.log.commit(number + 1, {"batch": batch_id, "parts": parts})

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def visible(self) -> DataFrame:
        return self.state().filter(~F.col("tombstone")).select("key", "value")
