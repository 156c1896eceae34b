"""A store of sorted runs: a buffer of writes, flushes to level 0, compaction down the levels, recovery.

Versions are rows (key, seqno, value, tombstone). A run is a folder of range-partitioned, sorted Parquet files; the
manifest holds its key and seqno ranges, size and a checksum that doesn't depend on the order of rows. Reads go to the
runs whose range holds the key. Only metadata of runs, one row each, is ever on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators import lsm, versions
from sedimenta.sources.commit_log import CommitLog
from sedimenta.sources.manifest import Manifest

#: Bytes of buffered writes after which the buffer is frozen.
BUFFER_BYTES = 4 * 1024 * 1024


class Corrupt(RuntimeError):
    """A run is missing or doesn't hold what the manifest says."""


@dataclass
class LsmStats:
    active_entries: int = 0
    frozen: int = 0
    tables: dict[int, int] = field(default_factory=dict)
    bytes: int = 0
    flushes: int = 0
    compactions: int = 0
    checkpoint: int = 0


class LsmEngine:
    def __init__(self, spark: SparkSession, root: str, key: str = "binary", value: str = "binary", buffer_bytes: int = BUFFER_BYTES, partitions: int = 1, validate: bool = True):
        self.spark, self.root, self.buffer_bytes, self.partitions = spark, root.rstrip("/"), buffer_bytes, partitions
        self.schema = T._parse_datatype_string(f"key {key}, seqno bigint, value {value}, tombstone boolean")
        self.active: dict[tuple, tuple] = {}
        self.size, self.flushes, self.compactions = 0, 0, 0
        self.frozen: list[DataFrame] = []  # oldest first
        self.manifest = Manifest(spark, f"{self.root}/manifest")
        if validate:
            self.verify()
        self._drop_orphans()

    # writes

    def put(self, key, value, seqno: int) -> None:
        """Buffer a version; the same (key, seqno) is replaced."""
        self._buffer(key, seqno, value, False)

    def delete(self, key, seqno: int) -> None:
        self._buffer(key, seqno, None, True)

    def _buffer(self, key, seqno: int, value, tombstone: bool) -> None:
        if seqno < 1:
            raise ValueError("sequence numbers begin at 1")
        width = lambda v: 0 if v is None else len(v) if isinstance(v, (bytes, bytearray)) else len(str(v).encode())
        old = self.active.get((key, seqno))
        if old is not None:
            self.size -= width(key) + width(old[2]) + lsm.ENTRY_OVERHEAD
        self.active[key, seqno] = (key, seqno, value, tombstone)
        self.size += width(key) + width(value) + lsm.ENTRY_OVERHEAD
        if self.size >= self.buffer_bytes:
            self.rotate()

    def load(self, rows: DataFrame) -> None:
        """Freeze a frame of versions as it is: bulk writes don't pass the driver."""
        self.rotate()
        self.frozen.append(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]))

    def rotate(self) -> bool:
        """Freeze the buffer, if it holds anything."""
        if not self.active:
            return False
        self.frozen.append(self.spark.createDataFrame(list(self.active.values()), self.schema))
        self.active, self.size = {}, 0
        return True

    @property
    def needs_flush(self) -> bool:
        return bool(self.frozen)

    # memory

    def memtable(self) -> DataFrame:
        """The buffer's versions in order of key, newest first."""
        rows = self.spark.createDataFrame(list(self.active.values()), self.schema)
        return rows.orderBy("key", F.col("seqno").desc())

    def drain(self) -> DataFrame:
        """``memtable``, and the buffer is empty then."""
        out, self.active, self.size = self.memtable(), {}, 0
        return out

    def distinct_keys(self) -> int:
        return len({k for k, _ in self.active})

    # runs

    def path(self, run: int) -> str:
        return f"{self.root}/run-{run:012d}"

    def _read(self, run: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path(run))

    def _measure(self, rows: DataFrame) -> dict | None:
        meta = lsm.run_meta(rows.withColumn("run", F.lit(0))).drop("run").first()
        if meta is None:
            return None
        out = {c: v.hex() if isinstance(v, (bytes, bytearray)) else v for c, v in meta.asDict().items()}
        return out | {"checksum": lsm.checksum(rows)}

    def _write(self, rows: DataFrame, level: int) -> dict | None:
        """A new run; None if there is nothing in it."""
        run = self.manifest.allocate()
        lsm.write_run(rows, self.path(run), self.partitions)
        made = self._measure(self._read(run))
        if made is None:
            self._drop(run)
            return None
        return {"id": run, "level": level, **made}

    def _drop(self, run: int) -> None:
        CommitLog(self.spark, f"{self.root}/manifest").drop_folder(self.path(run))

    def tables(self) -> DataFrame:
        """(id, level, min_key, max_key, bytes) of the live runs."""
        key = self.schema["key"].dataType
        kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("min_key", key), T.StructField("max_key", key), T.StructField("bytes", T.LongType())])
        back = (lambda v: bytes.fromhex(v)) if isinstance(key, T.BinaryType) else (lambda v: v)
        return self.spark.createDataFrame([(t["id"], t["level"], back(t["min_key"]), back(t["max_key"]), t["bytes"]) for t in self.manifest.tables.values()], kind)

    def verify(self) -> None:
        """Raise if a live run is missing, short or changed, or its files aren't in order."""
        for t in self.manifest.tables.values():
            try:
                rows = self._read(t["id"])
                found = (rows.count(), lsm.checksum(rows), lsm.disorder(self.spark, self.path(t["id"]), self.schema))
            except Exception as e:
                raise Corrupt(f"run {t['id']} can't be read: {str(e).splitlines()[0]}") from e
            if found != (t["entries"], t["checksum"], 0):
                raise Corrupt(f"run {t['id']} holds {found}; the manifest says {(t['entries'], t['checksum'], 0)}")

    def _drop_orphans(self) -> list[int]:
        """Delete runs that no edit of the manifest holds: a flush or a compaction that didn't end."""
        live = {f"run-{i:012d}" for i in self.manifest.tables}
        gone = [n for n in self.manifest.log.folders(self.root) if n.startswith("run-") and n not in live]
        for name in gone:
            self.manifest.log.drop_folder(f"{self.root}/{name}")
        return [int(n[4:]) for n in gone]

    # flush and compaction

    def flush_one(self) -> int | None:
        """The oldest frozen buffer becomes a run of level 0; the checkpoint moves on. Its id, if there was one."""
        if not self.frozen:
            return None
        t = self._write(self.frozen[0], 0)
        if t is not None:
            self.manifest.append(add=[t], checkpoint=t["max_seqno"])
        self.frozen.pop(0)
        self.flushes += 1
        return t and t["id"]

    def flush_all(self) -> int:
        n = 0
        self.rotate()
        while self.frozen:
            self.flush_one()
            n += 1
        return n

    @staticmethod
    def is_bottom_most(level: int) -> bool:
        return level + 1 >= lsm.LEVELS

    def compact_once(self, floor: int) -> dict | None:
        """Merge the inputs that ``pick_compaction`` names into one run a level below; versions at or below ``floor``
        shrink to the newest. What the merge did, or None if no level is due."""
        inputs = [r["id"] for r in lsm.pick_compaction(self.tables()).select("id").collect()]
        if not inputs:
            return None
        level = min(self.manifest.tables[i]["level"] for i in inputs) + 1
        rows = lsm.union_runs([self._read(i) for i in self._newest_first(inputs)])
        stats = versions.merge_stats(rows, floor, self.is_bottom_most(level)).first().asDict()
        made = self._write(versions.merge_runs(rows, floor, self.is_bottom_most(level)), level)
        self.manifest.append(add=[made] if made else [], remove=inputs)
        for i in inputs:
            self._drop(i)
        self.compactions += 1
        return stats | {"inputs": inputs, "output": made and made["id"], "level": level}

    def compact_until_stable(self, floor: int, most: int = 64) -> int:
        """``compact_once`` until no level is due; the number of merges."""
        for n in range(most):
            if self.compact_once(floor) is None:
                return n
        return most

    def _newest_first(self, ids: list[int]) -> list[int]:
        return sorted(ids, key=lambda i: (self.manifest.tables[i]["level"], -i))

    # reads

    def log(self) -> DataFrame:
        """All versions that the store holds; a (key, seqno) that is in several runs comes once, from the newest."""
        memory = [self.spark.createDataFrame(list(self.active.values()), self.schema)] if self.active else []
        runs = [*memory, *reversed(self.frozen), *(self._read(i) for i in self._newest_first(list(self.manifest.tables)))]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return versions.once(lsm.union_runs(runs)).select(*self.schema.names)

    def scan(self, snapshot: int | None = None) -> DataFrame:
        """(key, value) that a reader at ``snapshot`` sees."""
        return versions.newest(self.log(), snapshot).filter("NOT tombstone").select("key", "value")

    def get(self, key, snapshot: int | None = None) -> tuple[str, object]:
        """('found', value), ('deleted', None) or ('absent', None); only runs whose range holds the key are read."""
        ids = [r["id"] for r in lsm.lookup_order(self.tables(), F.lit(key)).collect()]
        memory = [self.spark.createDataFrame(list(self.active.values()), self.schema)] if self.active else []
        runs = [*memory, *reversed(self.frozen), *(self._read(i) for i in ids)]
        if not runs:
            return "absent", None
        rows = versions.once(lsm.union_runs([r.filter(F.col("key") == F.lit(key)) for r in runs]))
        r = versions.newest(rows.select(*self.schema.names), snapshot).first()
        return ("absent", None) if r is None else ("deleted", None) if r["tombstone"] else ("found", r["value"])

    def set_checkpoint(self, seqno: int) -> int:
        """The checkpoint never falls."""
        if seqno > self.manifest.checkpoint:
            self.manifest.append(checkpoint=seqno)
        return self.manifest.checkpoint

    def stats(self) -> LsmStats:
        tables = self.manifest.tables.values()
        levels = {n: sum(t["level"] == n for t in tables) for n in sorted({t["level"] for t in tables})}
        return LsmStats(len(self.active), len(self.frozen), levels, sum(t["bytes"] for t in tables), self.flushes, self.compactions, self.manifest.checkpoint)

    def close(self) -> None:
        self.flush_all()
