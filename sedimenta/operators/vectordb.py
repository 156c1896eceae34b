"""A store of vectors under text ids: immutable Parquet parts under a commit log, newest ordinal of an id counts.

An insert is checked as a whole before anything is written. Replacing and removing append; ``compact`` writes the live
records anew. Search is exact up to a number of vectors, else by the saved index if it is as new as the records.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import vector
from sedimenta.operators.vector import IvfIndex, Metric
from sedimenta.sources.commit_log import CommitLog, Conflict

RECORD = "id string, embedding array<float>, ordinal bigint, deleted boolean"


@dataclass(frozen=True)
class VectorQuery:
    query: list[float]
    k: int = 10

    def __post_init__(self):
        if not 1 <= self.k <= vector.MAX_K:
            raise ValueError(f"k must be in 1..{vector.MAX_K}")


class VectorDb:
    def __init__(self, spark: SparkSession, root: str, dim: int | None = None, metric: Metric | None = None):
        """Open or make a store; one that is there must have the dimension and metric asked for."""
        self.spark, self.log, self.closed = spark, CommitLog(spark, root), False
        state = self.log.latest()[1]
        if state is None:
            if dim is None or not 1 <= dim <= vector.MAX_DIM:
                raise ValueError(f"a new store needs a dimension in 1..{vector.MAX_DIM}")
            state = {"dim": dim, "metric": int(Metric.COSINE if metric is None else metric), "parts": [], "next": 0, "index": None}
            self.log.commit(1, state)
        self.dim, self.metric = state["dim"], Metric(state["metric"])
        if dim not in (None, self.dim) or metric not in (None, self.metric):
            raise ValueError(f"the store holds vectors of dimension {self.dim} under {self.metric.name}")

    def _state(self) -> tuple[int, dict]:
        if self.closed:
            raise ValueError("the store is closed")
        return self.log.latest()

    def _records(self, state: dict) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(*state["parts"]) if state["parts"] else self.spark.createDataFrame([], RECORD)

    def records(self) -> DataFrame:
        """Every record that was appended, with its ordinal."""
        return self._records(self._state()[1])

    def live(self) -> DataFrame:
        return vector.live(self.records()).select("id", "embedding", "ordinal")

    def _append(self, make) -> None:
        """Write what ``make(next ordinal)`` gives as a part; again if another writer came first."""
        for _ in range(8):
            number, state = self._state()
            path = f"{self.log.root}/part-{uuid.uuid4().hex}"
            make(state["next"]).write.parquet(path)
            top = self.spark.read.schema(RECORD).parquet(path).agg(F.max("ordinal")).first()[0]
            if top is None:
                self.log.drop_folder(path)
                return
            try:
                return self.log.commit(number + 1, {**state, "parts": [*state["parts"], path], "next": top + 1})
            except Conflict:
                self.log.drop_folder(path)
        raise Conflict("too many writers")

    def insert(self, id: str, embedding: list[float]) -> None:
        self.insert_many([(id, embedding)])

    def insert_many(self, rows: list[tuple[str, list[float]]] | DataFrame) -> int:
        """Insert or replace rows of (id, embedding), all or none; of equal ids in a batch the last one counts."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(i, n, [float(x) for x in v]) for n, (i, v) in enumerate(rows)], "id string, n long, embedding array<float>")
        else:
            rows = rows.select(F.col("id").cast("string").alias("id"), F.monotonically_increasing_id().alias("n"), F.col("embedding").cast("array<float>").alias("embedding"))
        n, good = rows.agg(F.count(F.lit(1)), F.count_if(vector.valid(rows, self.dim))).first()
        if n != good:
            raise ValueError(f"{n - good} of {n} rows have no id of 1 to {vector.MAX_ID_BYTES} bytes or no {self.dim} finite numbers; none was inserted")
        self._append(lambda at: rows.select("id", "embedding", (F.col("n") + at).alias("ordinal"), F.lit(False).alias("deleted")))
        return n

    def remove(self, id: str) -> bool:
        return self.remove_many([id]) == 1

    def remove_many(self, ids: list[str]) -> int:
        """How many of the ids were there."""
        found = [r["id"] for r in self.live().filter(F.col("id").isin(ids)).select("id").collect()]
        if found:
            none = F.lit(None).cast("array<float>")
            gone = self.spark.createDataFrame([(i, n) for n, i in enumerate(found)], "id string, n long")
            self._append(lambda at: gone.select("id", none.alias("embedding"), (F.col("n") + at).alias("ordinal"), F.lit(True).alias("deleted")))
        return len(found)

    def get(self, id: str) -> list[float] | None:
        r = vector.live(self.records().filter(F.col("id") == id)).first()
        return r and list(r["embedding"])

    def contains(self, id: str) -> bool:
        return self.get(id) is not None

    def __len__(self) -> int:
        return self.live().count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def stats(self) -> dict:
        return vector.vector_stats(self.records(), self.dim).first().asDict() | {"metric": self.metric.name}

    def _index(self, state: dict) -> IvfIndex | None:
        """The saved index; none if records were appended since."""
        at = state["index"]
        if at is None or at["parts"] != state["parts"]:
            return None
        lists = self.spark.read.parquet(at["path"])
        return IvfIndex(np.array(at["centroids"]), lists, "id", "embedding", self.metric, at["rows"])

    def save(self, lists: int = 16) -> None:
        """Build and save the index; the newest one counts until records are appended."""
        number, state = self._state()
        index = IvfIndex.build(self.live(), lists, id_col="id", metric=self.metric)
        path = f"{self.log.root}/index-{uuid.uuid4().hex}"
        index.lists.write.parquet(path)
        made = {"path": path, "centroids": index.centroids.tolist(), "rows": index.rows, "parts": state["parts"]}
        self.log.commit(number + 1, {**state, "index": made})

    def search(self, query: list[float], k: int = 10, probes: int = 8) -> DataFrame:
        """(id, distance, score), nearest first, ties by id; ``k`` = 0 and an empty store give none."""
        vector.check_query(query, self.dim, k)
        state = self._state()[1]
        live = vector.live(self._records(state)).select("id", "embedding")
        return vector.search(live, query, k, self.metric, self._index(state), probes, id_col="id")

    def query(self, q: VectorQuery, probes: int = 8) -> DataFrame:
        return self.search(q.query, q.k, probes)

    def search_many(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """``search`` for each row of (query_id, query)."""
        state = self._state()[1]
        live = vector.live(self._records(state)).select("id", "embedding")
        return vector.search_batch(live, queries, k, self.metric, self._index(state), probes, id_col="id")

    def compact(self) -> int:
        """Write the live records alone; the number of records that this reclaims. Folders of older states go."""
        number, state = self._state()
        reclaimed = vector.vector_stats(self._records(state), self.dim).first()["deleted"]
        path = f"{self.log.root}/part-{uuid.uuid4().hex}"
        vector.compacted(self._records(state)).select("id", "embedding", "ordinal", F.lit(False).alias("deleted")).write.parquet(path)
        self.log.commit(number + 1, {**state, "parts": [path], "index": None})
        for name in self.log.folders(self.log.root):
            if name.startswith(("part-", "index-")) and not path.endswith(name):
                self.log.drop_folder(f"{self.log.root}/{name}")
        return reclaimed

    def close(self) -> None:
        self.closed = True
