"""Shared helpers: row keys, cut lineage, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of slim rows (a key and a few numbers) that is sent to every executor.
BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sedimenta-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Bytes of the rows that a Python worker gets in one Arrow batch, about; a row of more goes by itself.
BATCH_BYTES = 4 << 20
#: Workers stay for later tasks, so they give freed memory back: Arrow keeps none and malloc up to 8 MB.
WORKER_ENV = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
}


def with_python(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it is there for them too.

    Their batches are bounded by bytes as well as by rows, and they give freed memory back, unless the session or
    its environment says otherwise: two workers and a JVM whose heap is full share an executor's memory.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for name, value in WORKER_ENV.items():
        env.setdefault(name, os.environ.get(name, value))
    batch_bytes = "spark.sql.execution.arrow.maxBytesPerBatch"
    if batch_bytes not in spark.conf.getAll:
        spark.conf.set(batch_bytes, str(BATCH_BYTES))


#: Folders that ``cut`` and ``written`` have made, for each ``scratch`` that is open.
_scratch: list[list[str]] = []


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what ``cut`` and ``written`` made inside; results must have been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for folder in _scratch.pop():
            drop_folder(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _scratch:
        folder = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if folder.isDefined():
            _scratch[-1].append(folder.get())
    return out


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    A checkpoint keeps its partitioning, and a join by the same key then takes the rows as they lie. A table brings
    none: the join deals both sides out anew, and a hot key on the other side can be split at run time.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if _scratch:
        _scratch[-1].append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (already cut, so counting is cheap) has at most ``bound`` slim rows.

    Beyond the bound the frame comes back without a hint and the join shuffles.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def keyed(docs: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """(_id, _th, _text, extra...): the row key is the id with a 64-bit hash of the text.

    Rows that agree in id and text are one document listed more than once: each of them
    gets the same result. Rows that share an id but not the text are told apart.
    """
    return docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("_text"), *extra
    )


def key_join(left: DataFrame, right: DataFrame, how: str = "inner", hint: bool = False) -> DataFrame:
    """Join on the row key (_id, _th); a null id equals a null id. The key comes from ``left``."""
    right = right.withColumnsRenamed({"_id": "_id_r", "_th": "_th_r"})
    on = F.col("_id").eqNullSafe(F.col("_id_r")) & (F.col("_th") == F.col("_th_r"))
    return left.join(F.broadcast(right) if hint else right, on, how).drop("_id_r", "_th_r")


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
