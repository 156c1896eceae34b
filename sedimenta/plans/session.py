"""Running statements of the dialect over registered and stored tables.

Stored tables are immutable Parquet parts under a commit log: an insert adds a part, an update or a delete
writes the parts anew that hold a row it meets, and a reader keeps the version that it began with. Beyond a
number of parts they are merged.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.plans import compile as plan
from sedimenta.plans.compile import MIXED, ROW_ID
from sedimenta.plans.dialect import CreateTable, Delete, DropTable, Insert, Literal, Select, SqlError, Update, parse
from sedimenta.sources.commit_log import CommitLog, Conflict

#: Parts that a table has at most.
MAX_PARTS = 64

_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType()}


@dataclass
class SqlResult:
    """Rows (a lazy frame), a count of affected rows, or what changed in the schema."""

    columns: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    affected: int = 0
    detail: str | None = None

    @property
    def is_rows(self) -> bool:
        return self.df is not None

    def rows(self) -> list[list]:
        def plain(v):
            if isinstance(v, T.Row) and set(v.asDict()) == {"k", "i", "d", "s"}:
                return v["i"] if v["k"] == "int" else v["d"] if v["k"] == "float" else v["s"]
            return v

        return [[plain(v) for v in r] for r in self.df.collect()] if self.is_rows else []

    @property
    def row_count(self) -> int:
        return self.df.count() if self.is_rows else 0

    def as_maps(self) -> list[dict]:
        return [dict(zip(self.columns, r)) for r in self.rows()]

    def scalar(self):
        first = self.rows()[:1]
        return first[0][0] if first and first[0] else None

    def to_json(self) -> str:
        """One of three shapes; numbers that JSON can't hold are null."""
        if self.is_rows:
            clean = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
            return json.dumps({"type": "rows", "columns": self.columns, "rows": [[clean(v) for v in r] for r in self.rows()]}, ensure_ascii=False)
        if self.detail is not None:
            return json.dumps({"type": "schema", "detail": self.detail})
        return json.dumps({"type": "affected", "count": self.affected})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> SqlResult:
        """A result that ``to_json`` wrote; columns whose values are of several kinds come back as mixed."""
        data = json.loads(text)
        if data["type"] == "schema":
            return cls(detail=data["detail"])
        if data["type"] == "affected":
            return cls(affected=data["count"])

        def kind(v) -> str:
            return "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"

        values = [[Literal("null") if v is None else Literal(kind(v), v) for v in r] for r in data["rows"]]
        kinds = [joined_kind({r[i].kind for r in values} - {"null"}) for i in range(len(data["columns"]))]
        schema = T.StructType([T.StructField(c, MIXED if k == "mixed" else _TYPES.get(k, T.StringType())) for c, k in zip(data["columns"], kinds)])
        return cls(columns=data["columns"], df=spark.createDataFrame([tuple(cell(v, k) for v, k in zip(r, kinds)) for r in values], schema))

    def render(self) -> str:
        if not self.is_rows:
            return self.detail if self.detail is not None else f"{self.affected} row(s) affected"
        rows = self.rows()
        body = [" | ".join(self.columns), *[" | ".join("NULL" if v is None else str(v) for v in r) for r in rows]]
        return "\n".join([*body, f"({len(rows)} row(s))"])


class SqlSession:
    """``register`` exposes a frame for SELECT; CREATE TABLE makes stored tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self.frames[name.lower()] = df

    def query(self, sql: str) -> SqlResult:
        s = parse(sql)
        run = {"create": self._create, "drop": self._drop, "insert": self._insert, "select": self._select, "update": self._update, "delete": self._delete}
        return run[s.kind](s)

    # stored tables

    def _log(self, table: str) -> CommitLog:
        if self.root is None:
            raise SqlError(f"no such table: {table}")
        return CommitLog(self.spark, f"{self.root}/{table.lower()}")

    def _state(self, table: str) -> tuple[CommitLog, int, dict]:
        log = self._log(table)
        version, state = log.latest()
        if state is None or state["dropped"]:
            raise SqlError(f"no such table: {table}")
        return log, version, state

    @staticmethod
    def _schema(state: dict) -> T.StructType:
        kinds = _TYPES | {"mixed": MIXED, None: T.StringType()}
        return T.StructType([T.StructField(ROW_ID, T.LongType()), *[T.StructField(c["name"], kinds[c["kind"]]) for c in state["columns"]]])

    def _read(self, state: dict) -> DataFrame:
        out = self.spark.createDataFrame([], self._schema(state)) if not state["parts"] else None
        for part in state["parts"]:
            df = self.spark.read.schema(part_schema(part)).parquet(part["path"])
            df = df.select(ROW_ID, *[widened(F.col(f"`{c['name']}`"), p, c["kind"]).alias(c["name"]) for c, p in zip(state["columns"], part["kinds"])])
            out = df if out is None else out.unionByName(df)
        return out

    def table(self, name: str) -> DataFrame:
        """The table as of now; later commits don't change the frame."""
        if name.lower() in self.frames:
            return self.frames[name.lower()]
        return self._read(self._state(name)[2])

    def _write(self, log: CommitLog, df: DataFrame, kinds: list) -> dict:
        path = f"{log.root}/part-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return {"path": path, "names": df.columns[1:], "kinds": kinds}

    def _commit(self, log: CommitLog, version: int, state: dict) -> None:
        """Commit a state, with its parts merged if there are too many."""
        if len(state["parts"]) > MAX_PARTS:
            merged = self._write(log, self._read(state), [c["kind"] for c in state["columns"]])
            state = {**state, "parts": [merged]}
        log.commit(version, state)

    def _create(self, s: CreateTable) -> SqlResult:
        if s.table.lower() in self.frames:
            raise SqlError(f"table exists: {s.table}")
        log = self._log(s.table)
        version, state = log.latest()
        if state and not state["dropped"]:
            if s.if_not_exists:
                return SqlResult(detail=f"table {s.table} already exists, skipped")
            raise SqlError(f"table exists: {s.table}")
        names = [c.name.lower() for c in s.columns]
        if len(set(names)) < len(names):
            raise SqlError("duplicate column")
        if sum(c.primary_key for c in s.columns) > 1:
            raise SqlError("more than one primary key")
        columns = [{"name": c.name, "type": c.type, "kind": None, "not_null": c.not_null} for c in s.columns]
        log.commit(version + 1, {"dropped": False, "columns": columns, "parts": [], "next_row_id": 1})
        return SqlResult(detail=f"table {s.table} created with {len(columns)} column(s)")

    def _drop(self, s: DropTable) -> SqlResult:
        log = self._log(s.table)
        version, state = log.latest()
        if state is None or state["dropped"]:
            if s.if_exists:
                return SqlResult(detail=f"table {s.table} does not exist, skipped")
            raise SqlError(f"no such table: {s.table}")
        n = self._read(state).count()
        log.commit(version + 1, {**state, "dropped": True, "parts": []})
        return SqlResult(detail=f"table {s.table} dropped, {n} row(s) removed")

    def _insert(self, s: Insert) -> SqlResult:
        log, version, state = self._state(s.table)
        columns = state["columns"]
        place = {c["name"].lower(): i for i, c in enumerate(columns)}
        for c in s.columns:
            if c.lower() not in place:
                raise SqlError(f"no such column: {c}")
        at = [place[c.lower()] for c in s.columns] or list(range(len(columns)))
        if len(set(at)) < len(at):
            raise SqlError("a column is named twice")
        rows = []
        for r in s.rows:
            if len(r) != len(at):
                raise SqlError(f"{len(at)} value(s) expected, {len(r)} given")
            full = [Literal("null")] * len(columns)
            for i, v in zip(at, r):
                full[i] = v
            for c, v in zip(columns, full):
                if c["not_null"] and v.kind == "null":
                    raise SqlError(f"column {c['name']} is NOT NULL")
            rows.append(full)
        kinds = [joined_kind({v.kind for v in col} - {"null"}) for col in zip(*rows)]
        first = state["next_row_id"]
        values = [(first + i, *[cell(v, k) for v, k in zip(r, kinds)]) for i, r in enumerate(rows)]
        part_state = {"columns": [{**c, "kind": k} for c, k in zip(columns, kinds)]}
        part = self._write(log, self.spark.createDataFrame(values, self._schema(part_state)), kinds)
        widened_columns = [{**c, "kind": joined_kind({c["kind"], k} - {None})} for c, k in zip(columns, kinds)]
        self._commit(log, version + 1, {**state, "columns": widened_columns, "parts": [*state["parts"], part], "next_row_id": first + len(rows)})
        return SqlResult(affected=len(rows))

    def load(self, name: str, df: DataFrame) -> int:
        """Append the rows of a frame with the table's columns as one part; ids follow the frame's order."""
        log, version, state = self._state(name)
        kinds = [plan.kind_of(df.schema[c].dataType) for c in df.columns]
        if "other" in kinds or len(kinds) != len(state["columns"]):
            raise SqlError("the frame's columns don't fit the table")
        ids = (F.monotonically_increasing_id() + state["next_row_id"]).alias(ROW_ID)
        typed = [F.col(f"`{c}`").cast(_TYPES.get(k, MIXED)).alias(d["name"]) for c, k, d in zip(df.columns, kinds, state["columns"])]
        part = self._write(log, df.select(ids, *typed), kinds)
        written = self.spark.read.schema(part_schema(part)).parquet(part["path"])
        n, top = written.agg(F.count(F.lit(1)), F.max(ROW_ID)).first()
        columns = [{**c, "kind": joined_kind({c["kind"], k} - {None})} for c, k in zip(state["columns"], kinds)]
        self._commit(log, version + 1, {**state, "columns": columns, "parts": [*state["parts"], part], "next_row_id": (top or state["next_row_id"] - 1) + 1})
        return n

    def _select(self, s: Select) -> SqlResult:
        out = plan.select(self.table(s.table), s)
        return SqlResult(columns=out.columns, df=out)

    def _rewrite(self, table: str, change) -> SqlResult:
        """``change(rows, columns)`` gives new rows, a condition for those it meets, and the columns then."""
        log, version, state = self._state(table)
        parts = state["parts"]
        _, hit, columns = change(self._read(state), state["columns"])
        found = [self._read({**state, "parts": [p]}).filter(hit).select(F.lit(i).alias("i")) for i, p in enumerate(parts)]
        met = {r["i"]: r["count"] for r in reduce(DataFrame.unionByName, found).groupBy("i").count().collect()} if found else {}
        if met:
            old = self._read({**state, "parts": [parts[i] for i in sorted(met)]})
            part = self._write(log, change(old, state["columns"])[0], [c["kind"] for c in columns])
            self._commit(log, version + 1, {**state, "columns": columns, "parts": [*(p for i, p in enumerate(parts) if i not in met), part]})
        return SqlResult(affected=sum(met.values()))

    def _update(self, s: Update) -> SqlResult:
        def change(df: DataFrame, columns: list[dict]):
            hit = plan.condition(df, s.where)
            hit = F.lit(True) if hit is None else hit
            new = {plan.resolve(df, c): v for c, v in s.assignments}  # the last of equal names stays
            columns = [dict(c) for c in columns]
            out = []
            for c in columns:
                old = F.col(f"`{c['name']}`")
                if c["name"] not in new:
                    out.append(old)
                    continue
                v = new[c["name"]]
                if c["not_null"] and v.kind == "null":
                    raise SqlError(f"column {c['name']} is NOT NULL")
                kind = joined_kind({c["kind"], None if v.kind == "null" else v.kind} - {None})
                out.append(F.when(hit, literal(v, kind)).otherwise(widened(old, c["kind"], kind)).alias(c["name"]))
                c["kind"] = kind
            return df.select(ROW_ID, *out), hit, columns

        return self._rewrite(s.table, change)

    def _delete(self, s: Delete) -> SqlResult:
        def change(df: DataFrame, columns: list[dict]):
            hit = plan.condition(df, s.where)
            hit = F.lit(True) if hit is None else hit
            return df.filter(~hit), hit, columns

        return self._rewrite(s.table, change)

    def transaction(self, body, retries: int = 3):
        """Run ``body(self)`` again if another writer committed first."""
        for attempt in range(retries + 1):
            try:
                return body(self)
            except Conflict:
                if attempt == retries:
                    raise


def joined_kind(kinds: set) -> str | None:
    """One kind stays as it is; more make a mixed column; none is known yet."""
    return None if not kinds else next(iter(kinds)) if len(kinds) == 1 else "mixed"


def part_schema(part: dict) -> T.StructType:
    kinds = _TYPES | {"mixed": MIXED, None: T.StringType()}
    return T.StructType([T.StructField(ROW_ID, T.LongType()), *[T.StructField(n, kinds[k]) for n, k in zip(part["names"], part["kinds"])]])


def cell(v: Literal, kind: str | None):
    if v.kind == "null":
        return None
    if kind != "mixed":
        return v.value
    return (v.kind, *[v.value if v.kind == k else None for k in ("int", "float", "text")])


def literal(v: Literal, kind: str | None) -> Column:
    spark_type = MIXED if kind == "mixed" else _TYPES.get(kind, T.StringType())
    if v.kind == "null":
        return F.lit(None).cast(spark_type)
    if kind != "mixed":
        return F.lit(v.value).cast(spark_type)
    return F.struct(F.lit(v.kind), *[F.lit(v.value if v.kind == k else None).cast(t) for k, t in _TYPES.items()]).cast(MIXED)


def widened(c: Column, kind: str | None, to: str | None) -> Column:
    """A column of one kind as one of the kind that its table has come to."""
    if kind == to:
        return c
    if kind is None:
        return F.lit(None).cast(MIXED if to == "mixed" else _TYPES[to])
    made = F.struct(F.lit(kind), *[(c if k == kind else F.lit(None)).cast(t) for k, t in _TYPES.items()]).cast(MIXED)
    return F.when(c.isNotNull(), made)
