"""Queries by name over the driver's tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions import codecs, observability, security
from sedimenta.operators import lsm, vector, versions
from sedimenta.operators.vector import Metric
from sedimenta.plans.session import SqlSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dialect(name: str, tables: str | dict, statement: str, sql: str) -> None:
    """Register a statement of the dialect over one table or a derived frame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = SqlSession(spark)
        for alias, make in ({tables: None} if isinstance(tables, str) else tables).items():
            session.register(alias, make(spark, sf_dir) if make else table(spark, sf_dir, alias))
        return session.query(statement).df

    run.__name__ = name
    query(sql)(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["sql_flagship"](spark, sf_dir)


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality label, null where there is none."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


GRADED = "(SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
FLAG = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_orderkey DESC LIMIT 10"

for name, tables, statement, sql in [
    ("sql_flagship", "orders", FLAG, FLAG),
    ("sql_select_star", "nation", "SELECT * FROM Nation", "SELECT * FROM nation"),
    ("sql_project_reorder", "orders", "SELECT O_TOTALPRICE, o_orderkey FROM orders", "SELECT o_totalprice, o_orderkey FROM orders"),
    ("sql_filter_eq", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3", None),
    ("sql_filter_ne", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'", None),
    ("sql_filter_lt", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10", None),
    ("sql_filter_le", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.02", None),
    ("sql_filter_gt", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > 50000", None),
    ("sql_filter_ge", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus >= 'O'", None),
    ("sql_filter_and", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 AND o_custkey < 500", None),
    ("sql_filter_or", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 5000", None),
    ("sql_eq_null", {"graded": graded}, "SELECT doc_id FROM graded WHERE quality = NULL", f"SELECT doc_id FROM {GRADED} WHERE quality IS NULL"),
    ("sql_ne_null", {"graded": graded}, "SELECT doc_id FROM graded WHERE quality <> NULL", f"SELECT doc_id FROM {GRADED} WHERE quality IS NOT NULL"),
    ("sql_lt_null", {"graded": graded}, "SELECT doc_id FROM graded WHERE quality < NULL", f"SELECT doc_id FROM {GRADED} WHERE FALSE"),
    ("sql_ne_with_nulls", {"graded": graded}, "SELECT doc_id FROM graded WHERE quality <> 1", f"SELECT doc_id FROM {GRADED} WHERE quality <> 1"),
    ("sql_type_mismatch", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey = 'x'", "SELECT o_orderkey FROM orders WHERE FALSE"),
    ("sql_ne_type_mismatch", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <> 'x'", "SELECT o_orderkey FROM orders WHERE FALSE"),
    ("sql_int_vs_float", "part", "SELECT p_partkey, p_size FROM part WHERE p_size > 24.5", None),
    ("sql_float_vs_int", "part", "SELECT p_partkey FROM part WHERE p_retailprice >= 1200", None),
    ("sql_wide_literal", "part", "SELECT p_partkey FROM part WHERE p_size < 9223372036854775807", None),
    ("sql_order_asc", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey ASC", None),
    ("sql_order_desc", "customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC", None),
    ("sql_order_unprojected", "events", "SELECT user_id FROM events ORDER BY event_id DESC", None),
    ("sql_topk", "events", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 25", None),
    ("sql_limit_zero", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0", None),
    ("sql_order_nulls_last", {"keyed": lambda s, d: graded(s, d).select("lang", (F.col("doc_id") * F.when(F.col("quality").isNotNull(), 1)).alias("k"))},
     "SELECT k FROM keyed ORDER BY k DESC",
     f"SELECT CASE WHEN quality IS NOT NULL THEN doc_id END AS k FROM {GRADED} ORDER BY k DESC NULLS LAST"),
    ("sql_comments", "nation", "SELECT /* all of\n them */ n_name -- by name\nFROM nation /**/", "SELECT n_name FROM nation"),
]:
    dialect(name, tables, statement, sql or statement)


# statements that change a stored table


def stored(spark: SparkSession, df: DataFrame, *statements: str, name: str = "t") -> DataFrame:
    """Copy a small frame into a stored table with one insert, run the statements, return the table."""
    from sedimenta.sources.folders import work_folder

    session = SqlSession(spark, f"{work_folder(spark)}/sql-{uuid.uuid4().hex}")
    columns = ", ".join(df.columns)
    session.query(f"CREATE TABLE {name} ({columns})")
    session.load(name, df)
    for s in statements:
        session.query(s)
    return session.query(f"SELECT * FROM {name}").df


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query(f"{NATION} UNION ALL SELECT 100, 'NEW', NULL UNION ALL SELECT 101, NULL, NULL")
def dml_insert_partial(spark, sf_dir):
    return stored(spark, _nation(spark, sf_dir), "INSERT INTO t (n_name, N_NATIONKEY) VALUES ('NEW', 100), (NULL, 101)")


@query(f"SELECT n_nationkey, n_name, CASE WHEN n_regionkey >= 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM ({NATION})")
def dml_update_where(spark, sf_dir):
    return stored(spark, _nation(spark, sf_dir), "UPDATE t SET n_regionkey = 9 WHERE n_regionkey >= 2")


@query(f"SELECT n_nationkey, 'x' AS n_name, n_regionkey FROM ({NATION})")
def dml_update_all(spark, sf_dir):
    return stored(spark, _nation(spark, sf_dir), "UPDATE t SET n_name = 'y', n_name = 'x'")


@query(f"SELECT * FROM ({NATION}) WHERE NOT n_nationkey > 9")
def dml_delete_where(spark, sf_dir):
    return stored(spark, _nation(spark, sf_dir), "DELETE FROM t WHERE n_nationkey > 9")


@query("SELECT s_suppkey, s_name FROM supplier WHERE FALSE")
def dml_delete_all(spark, sf_dir):
    return stored(spark, table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "DELETE FROM t")


# key/value and versions

LOG = """(SELECT user_id AS key, event_id + 1 AS seqno, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
  event_type = 'error' AS tombstone, CAST(event_id % 4 AS INTEGER) AS run FROM events)"""
NEWEST = f"(SELECT * FROM {LOG} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seqno"), F.when(~error, F.col("value")).alias("value"),
        error.alias("tombstone"), (F.col("event_id") % 4).cast("int").alias("run"),
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))


def share(spark: SparkSession, sf_dir: str, percent: int) -> int:
    """A sequence number so far up the log."""
    return table(spark, sf_dir, "events").agg(F.max("event_id") + 1).first()[0] * percent // 100


def _share(percent: int) -> str:
    return f"(SELECT (max(event_id) + 1) * {percent} // 100 FROM events)"


def _newest_at(percent: int) -> str:
    return f"(SELECT * FROM {LOG} WHERE seqno <= {_share(percent)} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1)"


BASE = "(SELECT c_custkey AS key, c_acctbal AS value FROM customer)"
_OVERLAY = """SELECT coalesce(b.key, v.key) AS key, CASE WHEN v.key IS NULL THEN b.value ELSE v.value END AS value
FROM {b} b FULL OUTER JOIN {v} v ON b.key = v.key WHERE NOT coalesce(v.tombstone, FALSE)"""


@query(f"SELECT key, value FROM {NEWEST} WHERE NOT tombstone")
def kv_scan(spark, sf_dir):
    return versions.as_of(log(spark, sf_dir), 2**62).select("key", "value").orderBy("key")


@query(f"SELECT key, seqno, value FROM {NEWEST} WHERE key = 7 AND NOT tombstone")
def kv_get(spark, sf_dir):
    return versions.as_of(log(spark, sf_dir).filter("key = 7"), 2**62).select("key", "seqno", "value")


@query(f"SELECT run, count(DISTINCT key) AS n FROM {LOG} GROUP BY run")
def lsm_distinct_keys(spark, sf_dir):
    return log(spark, sf_dir).groupBy("run").agg(F.count_distinct("key").alias("n"))


@query(f"SELECT count(*) AS n FROM {NEWEST} WHERE NOT tombstone")
def kv_count(spark, sf_dir):
    return versions.as_of(log(spark, sf_dir), 2**62).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT key, seqno, value FROM {_newest_at(50)} WHERE NOT tombstone")
def mvcc_asof(spark, sf_dir):
    return versions.as_of(log(spark, sf_dir), share(spark, sf_dir, 50)).select("key", "seqno", "value")


@query(_OVERLAY.format(b=BASE, v=NEWEST))
def mvcc_overlay(spark, sf_dir):
    return versions.overlay(base(spark, sf_dir), log(spark, sf_dir))


@query(
    f"SELECT 'base' AS side, key, value, NULL::BIGINT AS seqno FROM ({_OVERLAY.format(b=BASE, v=_newest_at(60))}) "
    f"UNION ALL SELECT 'log', key, value, seqno FROM {LOG} WHERE seqno > {_share(60)}"
)
def mvcc_fold(spark, sf_dir):
    folded, rest = versions.fold(base(spark, sf_dir), log(spark, sf_dir), share(spark, sf_dir, 60))
    left = folded.select(F.lit("base").alias("side"), "key", "value", F.lit(None).cast("long").alias("seqno"))
    return left.unionByName(rest.select(F.lit("log").alias("side"), "key", "value", "seqno"))


@query(f"SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT key FROM {LOG} WHERE seqno > {_share(90)})")
def mvcc_conflicts(spark, sf_dir):
    return versions.conflicts(log(spark, sf_dir), base(spark, sf_dir), share(spark, sf_dir, 90))


@query("SELECT coalesce(min(event_id), 999) AS watermark FROM events WHERE event_type = 'signup'")
def mvcc_watermark(spark, sf_dir):
    live = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("snapshot"))
    return versions.watermark(live, 999)


RECORDS = """(SELECT o_orderkey * 2 AS lsn, CASE WHEN o_orderpriority LIKE '1%' THEN 'delete' ELSE 'insert' END AS kind,
    o_custkey AS txn_id, o_orderkey AS key, o_totalprice AS value, NULL::BIGINT AS commit_ts FROM orders
  UNION ALL SELECT max(o_orderkey) * 2 + 1, 'commit', o_custkey, NULL, NULL, max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
  UNION ALL SELECT max(o_orderkey) * 2 + 1, 'rollback', o_custkey, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)"""


@query(f"""WITH r AS {RECORDS} SELECT o.txn_id, c.commit_ts, o.lsn, o.kind, o.key, o.value FROM r o
JOIN (SELECT txn_id, max(commit_ts) AS commit_ts FROM r WHERE kind = 'commit' GROUP BY txn_id) c ON o.txn_id = c.txn_id
WHERE o.kind IN ('insert', 'delete') AND o.txn_id NOT IN (SELECT txn_id FROM r WHERE kind = 'rollback')""")
def wal_recover(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.lit(None)
    kind = F.when(F.col("o_orderpriority").startswith("1"), "delete").otherwise("insert")
    ops = o.select(
        (F.col("o_orderkey") * 2).alias("lsn"), kind.alias("kind"), F.col("o_custkey").alias("txn_id"), F.col("o_orderkey").alias("key"),
        F.col("o_totalprice").alias("value"), none.cast("long").alias("commit_ts"),
    )

    def marks(status: str, what: str, ts) -> DataFrame:
        last = o.filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
        return last.select(
            (F.col("m") * 2 + 1).alias("lsn"), F.lit(what).alias("kind"), F.col("o_custkey").alias("txn_id"),
            none.cast("long").alias("key"), none.cast("double").alias("value"), ts.alias("commit_ts"),
        )

    records = ops.unionByName(marks("F", "commit", F.col("m"))).unionByName(marks("P", "rollback", none.cast("long")))
    return versions.recover(records)


# runs


@query(f"SELECT key, seqno, value, tombstone, run FROM {_newest_at(70)}")
def lsm_snapshot_view(spark, sf_dir):
    return versions.newest(log(spark, sf_dir), share(spark, sf_dir, 70))


@query(f"""SELECT k.c_custkey AS key, CASE WHEN v.key IS NULL THEN 'absent' WHEN v.tombstone THEN 'deleted' ELSE 'found' END AS state,
CASE WHEN NOT v.tombstone THEN v.value END AS value FROM customer k LEFT JOIN {_newest_at(40)} v ON v.key = k.c_custkey""")
def lsm_lookup_state(spark, sf_dir):
    return versions.lookup_state(log(spark, sf_dir), base(spark, sf_dir).select("key"), share(spark, sf_dir, 40))


def _merged(percent: int, bottom: bool) -> str:
    floor = _share(percent)
    keep = f"seqno > {floor} OR (rn = 1" + (" AND NOT tombstone)" if bottom else ")")
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, seqno <= {floor} ORDER BY seqno DESC) AS rn FROM {LOG}) WHERE {keep}"""


@query(f"SELECT key, seqno, value, tombstone FROM ({_merged(50, False)})")
def lsm_merge_runs(spark, sf_dir):
    return versions.merge_runs(log(spark, sf_dir), share(spark, sf_dir, 50), False)


@query(f"SELECT key, seqno, value, tombstone FROM ({_merged(80, True)})")
def lsm_merge_bottom(spark, sf_dir):
    return versions.merge_runs(log(spark, sf_dir), share(spark, sf_dir, 80), True)


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY key, seqno <= {_share(80)} ORDER BY seqno DESC) AS rn FROM {LOG}),
s AS (SELECT count(*) AS entries_in, count(*) FILTER (seqno > {_share(80)} OR (rn = 1 AND NOT tombstone)) AS entries_out,
  count(*) FILTER (seqno <= {_share(80)} AND rn = 1 AND tombstone) AS tombstones_dropped FROM a)
SELECT *, entries_in - entries_out - tombstones_dropped AS versions_dropped,
  CASE WHEN entries_out = 0 THEN 1.0::DOUBLE ELSE entries_in::DOUBLE / entries_out END AS amplification FROM s""")
def lsm_merge_stats(spark, sf_dir):
    return versions.merge_stats(log(spark, sf_dir), share(spark, sf_dir, 80), True)


RUN_META = f"""(SELECT run, min(key) AS min_key, max(key) AS max_key, min(seqno) AS min_seqno, max(seqno) AS max_seqno, count(*) AS entries,
  CAST(sum(strlen(CAST(key AS VARCHAR)) + CASE WHEN tombstone THEN 0 ELSE 1 END + 64) AS BIGINT) AS bytes
  FROM (SELECT key, seqno, tombstone, run FROM {LOG}) GROUP BY run)"""


@query(f"SELECT * FROM {RUN_META}")
def lsm_run_meta(spark, sf_dir):
    one = F.when(~F.col("tombstone"), F.lit("v"))
    return lsm.run_meta(log(spark, sf_dir).withColumn("value", one))


TABLES = """(SELECT p_partkey AS id, CAST(CASE WHEN p_partkey <= 6 THEN 0 ELSE 1 + p_partkey % 3 END AS INTEGER) AS level,
  p_partkey AS min_key, p_partkey + p_size * 10 AS max_key, CAST(p_size * 400000 AS BIGINT) AS bytes FROM part)"""
SCORES = f"""(SELECT level, count(*) AS tables, CAST(sum(bytes) AS BIGINT) AS bytes,
  CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(bytes)::DOUBLE / (8388608.0 * pow(10.0, level - 1)) END AS score FROM {TABLES} GROUP BY level)"""


def tables_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("p_partkey") <= 6, 0).otherwise(1 + F.col("p_partkey") % 3).cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), level.alias("level"), F.col("p_partkey").alias("min_key"),
        (F.col("p_partkey") + F.col("p_size") * 10).alias("max_key"), (F.col("p_size") * 400000).cast("long").alias("bytes"),
    )


@query(f"SELECT level, tables, bytes, round(score, 9) AS score FROM {SCORES}")
def lsm_level_score(spark, sf_dir):
    return lsm.level_scores(tables_of_runs(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"SELECT level, tables, bytes, round(score, 9) AS score FROM {SCORES} WHERE score >= 1 AND level < 6 ORDER BY score DESC, level LIMIT 1")
def lsm_pick(spark, sf_dir):
    return lsm.pick_level(tables_of_runs(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"""WITH t AS {TABLES}, p AS (SELECT level FROM {SCORES} WHERE score >= 1 AND level < 6 ORDER BY score DESC, level LIMIT 1),
s AS (SELECT t.* FROM t JOIN p USING (level) QUALIFY t.level = 0 OR row_number() OVER (ORDER BY bytes DESC, id) = 1),
r AS (SELECT min(level) AS level, min(min_key) AS lo, max(max_key) AS hi FROM s)
SELECT id, level, min_key, max_key, bytes FROM s UNION ALL
SELECT t.id, t.level, t.min_key, t.max_key, t.bytes FROM t JOIN r ON t.level = r.level + 1 AND t.min_key <= r.hi AND t.max_key >= r.lo""")
def lsm_pick_compaction(spark, sf_dir):
    return lsm.pick_compaction(tables_of_runs(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str, percent: int) -> int:
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] * percent // 100


def _sql_parts(percent: int) -> str:
    return f"(SELECT max(p_partkey) * {percent} // 100 FROM part)"


@query(f"SELECT * FROM {TABLES} WHERE min_key <= {_sql_parts(60)} AND max_key >= {_sql_parts(40)}")
def lsm_overlap(spark, sf_dir):
    return lsm.overlapping(tables_of_runs(spark, sf_dir), _parts(spark, sf_dir, 40), _parts(spark, sf_dir, 60))


@query(f"SELECT * FROM {TABLES} WHERE min_key <= {_sql_parts(50)} AND max_key >= {_sql_parts(50)}")
def lsm_lookup_order(spark, sf_dir):
    return lsm.lookup_order(tables_of_runs(spark, sf_dir), _parts(spark, sf_dir, 50))


@query(f"""WITH e AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_id = {_share(30)} THEN 'snapshot' WHEN event_type IN ('error', 'view') THEN 'remove' ELSE 'add' END AS kind FROM events)
SELECT id FROM (SELECT id, arg_max(kind, seq) AS kind FROM e WHERE seq > {_share(30)} GROUP BY id) WHERE kind = 'add'""")
def manifest_replay(spark, sf_dir):
    kind = F.when(F.col("event_id") == share(spark, sf_dir, 30), "snapshot").when(F.col("event_type").isin("error", "view"), "remove").otherwise("add")
    edits = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), kind.alias("kind"))
    return lsm.replay_manifest(edits)


@query(f"SELECT id FROM {TABLES} WHERE id NOT IN (SELECT n_nationkey FROM nation)")
def manifest_orphans(spark, sf_dir):
    live = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return lsm.orphans(tables_of_runs(spark, sf_dir).select("id"), live)


def _engine(spark: SparkSession, sf_dir: str):
    """The log in four bulk loads, flushed to runs of level 0."""
    from sedimenta.operators.engine import LsmEngine
    from sedimenta.sources.folders import work_folder

    engine = LsmEngine(spark, f"{work_folder(spark)}/engine-{uuid.uuid4().hex}", "bigint", "double")
    rows = log(spark, sf_dir)
    for run in range(4):
        engine.load(rows.filter(F.col("run") == run))
    engine.flush_all()
    return engine


@query(f"SELECT key, seqno, value, tombstone FROM ({_merged(60, False)})")
def lsm_compact_once(spark, sf_dir):
    """Four runs of level 0, which is when a merge is due, become one of level 1."""
    engine = _engine(spark, sf_dir)
    engine.compact_once(share(spark, sf_dir, 60))
    return engine.log()


@query(f"SELECT key, value FROM {_newest_at(90)} WHERE NOT tombstone")
def lsm_reopen(spark, sf_dir):
    """A store that is closed after compaction and opened again, its runs checked, read at a snapshot above the floor."""
    from sedimenta.operators.engine import LsmEngine

    engine = _engine(spark, sf_dir)
    engine.compact_until_stable(share(spark, sf_dir, 80))
    engine.close()
    return LsmEngine(spark, engine.root, "bigint", "double").scan(share(spark, sf_dir, 90))


@query(f"""SELECT 4::BIGINT AS tables, 4::BIGINT AS flushes, (SELECT count(*) FROM {LOG}) AS entries, (SELECT max(event_id) + 1 FROM events) AS checkpoint,
  (SELECT CAST(sum(strlen(CAST(key AS VARCHAR)) + 64) AS BIGINT) FROM {LOG}) AS least_bytes""")
def lsm_stats(spark, sf_dir):
    """Figures of the store; its bytes are those of keys and overheads at least."""
    engine = _engine(spark, sf_dir)
    stats, runs = engine.stats(), engine.manifest.tables.values()
    values = log(spark, sf_dir).agg(F.sum(F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)))).first()[0]
    row = (sum(stats.tables.values()), stats.flushes, sum(t["entries"] for t in runs), stats.checkpoint, stats.bytes - values)
    return spark.createDataFrame([row], "tables long, flushes long, entries long, checkpoint long, least_bytes long")


# metrics and traces

SAMPLES = "(SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS micros FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("micros"))


SQL_BUCKET = "CASE WHEN micros < 2 THEN 0 ELSE CAST(least(31, len(bin(micros)) - 1) AS INTEGER) END"


@query(f"SELECT {SQL_BUCKET} AS bucket, count(*) AS n FROM {SAMPLES} GROUP BY ALL")
def hist_buckets(spark, sf_dir):
    return observability.histogram(samples(spark, sf_dir))


@query(f"""WITH h AS (SELECT event_type, {SQL_BUCKET} AS bucket, count(*) AS n FROM {SAMPLES} GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h),
q AS (SELECT unnest([0.5, 0.99, 0.999]::DOUBLE[]) AS q),
f AS (SELECT event_type, q, min(bucket) AS bucket FROM c, q WHERE cum >= greatest(1, ceil(total * q)) GROUP BY ALL),
m AS (SELECT event_type, greatest(1, max(micros)) AS top FROM {SAMPLES} GROUP BY event_type)
SELECT event_type, q, CAST(least(CASE WHEN bucket = 31 THEN 9223372036854775807 ELSE pow(2, bucket + 1)::BIGINT END, top) AS BIGINT) AS quantile FROM f JOIN m USING (event_type)""")
def hist_quantiles(spark, sf_dir):
    return observability.quantiles(samples(spark, sf_dir), [0.5, 0.99, 0.999], "micros", "event_type")


@query(f"SELECT event_type, count(*) AS n, CAST(sum(micros) AS BIGINT) AS total, avg(micros) AS mean, min(micros) AS least, max(micros) AS largest FROM {SAMPLES} GROUP BY event_type")
def hist_stats(spark, sf_dir):
    return observability.summary(samples(spark, sf_dir), "micros", "event_type")


@query("SELECT user_id, round(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 9) AS ratio FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def cache_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click"))
    hits, misses = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    return e.groupBy("user_id").agg(F.round(observability.hit_ratio(hits, misses), 9).alias("ratio"))


@query("SELECT conv_id AS trace_id, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS total_us, count(*) FILTER (role = 'system') AS errors FROM conversations GROUP BY conv_id")
def trace_group(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.col("role").alias("name"),
        F.length("text").cast("long").alias("duration_us"), (F.col("role") == "system").alias("error"),
    )
    return observability.traces(c).drop("spans")


@query("SELECT event_id AS seq, event_type AS name FROM events ORDER BY event_id DESC LIMIT 64")
def span_ring(spark, sf_dir):
    return observability.ring(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name")), 64)


# roles, audit, codecs

GRANTS = [("BUILDING", "read"), ("BUILDING", "write"), ("MACHINERY", "read"), ("AUTOMOBILE", "admin"), ("F", "delete")]
_GRANT_SQL = "(VALUES " + ", ".join(f"('{r}', '{p}')" for r, p in GRANTS) + ") g(role, permission)"
HELD = """(SELECT c_custkey AS user_id, c_mktsegment AS role FROM customer UNION
  SELECT o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"""


def _principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("role"))
    return c.unionByName(o.join(c.select("user_id"), "user_id", "left_semi")).groupBy("user_id").agg(F.collect_set("role").alias("roles"))


@query(f"SELECT DISTINCT user_id, permission FROM {HELD} h JOIN {_GRANT_SQL} USING (role)")
def rbac_effective(spark, sf_dir):
    return security.effective_permissions(_principals(spark, sf_dir), spark.createDataFrame(GRANTS, "role string, permission string"))


@query(f"""SELECT e.event_id, e.user_id, 'delete' AS permission, e.user_id IN (SELECT user_id FROM {HELD} h JOIN {_GRANT_SQL} USING (role) WHERE permission = 'delete') AS allowed FROM events e""")
def rbac_authorize(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit("delete").alias("permission"))
    return security.authorize(asked, _principals(spark, sf_dir), spark.createDataFrame(GRANTS, "role string, permission string"))


@query("""SELECT event_id, concat_ws(chr(9), CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR), '-',
  lower(hex(encode(props[1:64]))) || CASE WHEN strlen(props) > 64 THEN '~' ELSE '' END, '-',
  replace(replace(replace(replace(props, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')) AS line FROM events""")
def audit_encode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = security.audit_line(
        F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string"), F.lit(""), F.encode("props", "UTF-8"), F.lit(None).cast("string"), F.col("props")
    )
    return e.select("event_id", line.alias("line"))


_HEX16 = "printf('%016X', c_custkey)"
_LE = " || ".join(f"substr({_HEX16}, {i}, 2)" for i in range(15, 0, -2))


@query(f"SELECT c_custkey, '02' || {_LE} AS encoded FROM customer")
def prefs_int_encode(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(codecs.encode_int(F.col("c_custkey"))).alias("encoded"))


@query("SELECT c_custkey, c_custkey * -3 AS n, c_name AS s, c_custkey % 2 = 0 AS b, c_acctbal AS d, array_to_string(string_split(c_name, '0'), '|') AS l, 'stringList' AS kind FROM customer")
def prefs_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = codecs.encode_int(F.col("c_custkey") * -3)
    s, b = codecs.encode_string(F.col("c_name")), codecs.encode_bool(F.col("c_custkey") % 2 == 0)
    d, items = codecs.encode_double("c_acctbal"), codecs.encode_list(F.split("c_name", "0"))
    return c.select(
        "c_custkey", codecs.decode_int(n).alias("n"), codecs.decode_string(s).alias("s"), codecs.decode_bool(b).alias("b"),
        codecs.decode_double(d).alias("d"), F.array_join(codecs.decode_list(items), "|").alias("l"), codecs.type_of(items).alias("kind"),
    )


@query("SELECT event_id, props, strlen(props) + 16 AS sealed_bytes, TRUE AS hidden FROM events")
def page_encryption(spark, sf_dir):
    """Seal and open every row again; a wrong version or page opens nothing, and a tag of 16 bytes is added."""
    e = table(spark, sf_dir, "events")
    key, page, plain = F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2)), F.col("event_id"), F.encode("props", "UTF-8")
    sealed = codecs.encrypt_page(plain, key, page, F.lit(3))
    opened = codecs.decrypt_page(sealed, key, page, F.lit(3))
    hidden = codecs.decrypt_page(sealed, key, page, F.lit(4)).isNull() & codecs.decrypt_page(sealed, key, page + 1, F.lit(3)).isNull()
    bytes_ = F.octet_length(sealed).cast("long")
    return e.select("event_id", F.decode(opened, "UTF-8").alias("props"), bytes_.alias("sealed_bytes"), (hidden & (F.substring(sealed, F.lit(1), bytes_.cast("int") - 16) != plain)).alias("hidden"))


# vectors


def _embeddings(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    v = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5) if scaled else x.cast("double"))
    return e.select("vec_id", v.alias("embedding"), "label")


QUERY = [round(((i * 37) % 64) / 64 - 0.4, 6) for i in range(64)]
_Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda x, y: x + y)"


def _sq(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)"


def _vectors(scaled: bool) -> str:
    v = "list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5))" if scaled else "embedding::DOUBLE[]"
    return f"(SELECT vec_id, label, {v} AS v, {_Q} AS q FROM embeddings)"


def _knn_sql(order: str, distance: str, score: str, k: int, scaled: bool = False) -> str:
    return f"""SELECT vec_id, round({distance}, 6) AS distance, round({score}, 6) AS score FROM
  (SELECT vec_id, {order} AS o FROM {_vectors(scaled)}) ORDER BY o, vec_id LIMIT {k}"""


_COS = f"1 - greatest(-1.0, least(1.0, {_dot('v', 'q')} / (sqrt({_dot('v', 'v')}) * sqrt({_dot('q', 'q')}))))"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6)).withColumn("score", F.round("score", 6))


@query(_knn_sql(_COS, "o", "1 - o", 10))
def knn_cosine(spark, sf_dir):
    return _rounded(vector.knn(_embeddings(spark, sf_dir), QUERY, 10, Metric.COSINE))


@query(_knn_sql(_sq("v", "q"), "sqrt(o)", "1 / (1 + sqrt(o))", 10))
def knn_l2(spark, sf_dir):
    return _rounded(vector.knn(_embeddings(spark, sf_dir), QUERY, 10, Metric.L2))


@query(_knn_sql("-" + _dot("v", "q"), "o", "-o", 10, True))
def knn_dot(spark, sf_dir):
    return _rounded(vector.knn(_embeddings(spark, sf_dir, True), QUERY, 10, Metric.DOT))


@query(f"""SELECT query_id, vec_id, round(sqrt(o), 6) AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id, {_sq("b.v", "a.v")} AS o FROM {_vectors(False)} a, {_vectors(False)} b WHERE a.vec_id % 20 = 0)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o, vec_id) <= 5""")
def knn_batch(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.knn_batch(e, asked, 5, Metric.L2).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query(_knn_sql(_COS, "o", "1 - o", 100_000).replace("LIMIT 100000", ""))
def knn_score(spark, sf_dir):
    """Distance and score of every vector, a zero vector's cosine distance being 1."""
    q = F.array(*[F.lit(x) for x in QUERY])
    d = vector.ordering(Metric.COSINE, F.col("embedding"), q)
    return _embeddings(spark, sf_dir).select("vec_id", F.round(d, 6).alias("distance"), F.round(vector.score(Metric.COSINE, d), 6).alias("score"))


def vector_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, those of ids 0-9 replaced by their scaled copies, every seventh removed."""
    e = _embeddings(spark, sf_dir)
    first = e.select(F.col("vec_id").alias("id"), "embedding", F.col("vec_id").alias("ordinal"), F.lit(False).alias("deleted"))
    again = _embeddings(spark, sf_dir, True).filter("vec_id < 10").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") + 1_000_000).alias("ordinal"), F.lit(False).alias("deleted"))
    gone = e.filter("vec_id % 7 = 3").select(F.col("vec_id").alias("id"), F.lit(None).cast("array<double>").alias("embedding"), (F.col("vec_id") + 2_000_000).alias("ordinal"), F.lit(True).alias("deleted"))
    return first.unionByName(again).unionByName(gone)


LIVE = f"""(SELECT vec_id AS id, CASE WHEN vec_id < 10 THEN list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5)) ELSE embedding::DOUBLE[] END AS v,
  {_Q} AS q, CASE WHEN vec_id < 10 THEN vec_id + 1000000 ELSE vec_id END AS ordinal FROM embeddings WHERE vec_id % 7 <> 3)"""


@query(f"SELECT id, ordinal, round(list_sum(v), 6) AS total FROM {LIVE} WHERE id < 10")
def vec_replace(spark, sf_dir):
    out = vector.live(vector_log(spark, sf_dir)).filter("id < 10")
    return out.select("id", "ordinal", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"SELECT id, round(sqrt(o), 6) AS distance FROM (SELECT id, {_sq('v', 'q')} AS o FROM {LIVE}) ORDER BY o, id LIMIT 10")
def vec_remove_search(spark, sf_dir):
    out = vector.knn(vector.live(vector_log(spark, sf_dir)), QUERY, 10, Metric.L2, id_col="id")
    return out.select("id", F.round("distance", 6).alias("distance"))


@query(f"SELECT id, ordinal FROM {LIVE}")
def vec_compact(spark, sf_dir):
    return vector.compacted(vector_log(spark, sf_dir)).select("id", "ordinal")


@query(f"""SELECT live, total, total - live AS deleted, CAST(64 AS INTEGER) AS dim, (total - live)::DOUBLE / total AS deleted_ratio FROM
  (SELECT (SELECT count(*) FROM {LIVE}) AS live, (SELECT count(*) + count(*) FILTER (vec_id < 10) FROM embeddings) AS total)""")
def vec_stats(spark, sf_dir):
    return vector.vector_stats(vector_log(spark, sf_dir), 64)


@query(f"SELECT id, len(v) AS dim FROM {LIVE} WHERE id IN (5, 10, 12)")
def vec_get(spark, sf_dir):
    out = vector.live(vector_log(spark, sf_dir).filter(F.col("id").isin(5, 10, 12)))
    return out.select("id", F.size("embedding").cast("long").alias("dim"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are null, too short, not finite or without a number."""
    e, k = _embeddings(spark, sf_dir), F.col("vec_id") % 10
    v = F.col("embedding")
    short = F.slice(v, 1, 63)
    made = F.when(k == 1, F.lit(None)).when(k == 2, short).when(k == 3, F.concat(short, F.array(F.lit(float("nan"))))).when(k == 4, F.concat(short, F.array(F.lit(float("-inf")))))
    return e.withColumn("embedding", made.when(k == 5, F.concat(short, F.array(F.lit(None).cast("double")))).otherwise(v))


PLANTED = f"""(SELECT vec_id, CASE vec_id % 10 WHEN 1 THEN NULL WHEN 2 THEN x[1:63] WHEN 3 THEN list_append(x[1:63], 'nan'::DOUBLE)
  WHEN 4 THEN list_append(x[1:63], '-inf'::DOUBLE) WHEN 5 THEN list_append(x[1:63], NULL::DOUBLE) ELSE x END AS v, {_Q} AS q
  FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"""
_GOOD = "coalesce(len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64, FALSE)"


@query(f"SELECT vec_id, {_GOOD} AS valid FROM {PLANTED}")
def vec_validate(spark, sf_dir):
    e = planted(spark, sf_dir)
    return e.select("vec_id", vector.valid(e, 64, "vec_id").alias("valid"))


@query(f"""SELECT vec_id, round(sqrt(o), 6) AS distance, round(1 / (1 + sqrt(o)), 6) AS score FROM (
  SELECT vec_id, {_sq('v', 'q')} AS o FROM {PLANTED} WHERE {_GOOD}) ORDER BY o, vec_id LIMIT 20""")
def knn_broken_vectors(spark, sf_dir):
    """Vectors that can't be inserted are nobody's neighbours."""
    return _rounded(vector.knn(planted(spark, sf_dir), QUERY, 20, Metric.L2))


@query(f"""WITH p AS (SELECT vec_id, v FROM {PLANTED} WHERE {_GOOD}) SELECT query_id, vec_id, round(o, 6) AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id, 1 - greatest(-1.0, least(1.0, {_dot('b.v', 'a.v')} / (sqrt({_dot('b.v', 'b.v')}) * sqrt({_dot('a.v', 'a.v')})))) AS o
  FROM p a, p b WHERE a.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o, vec_id) <= 5""")
def knn_batch_broken_vectors(spark, sf_dir):
    e = planted(spark, sf_dir)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.knn_batch(e, asked, 5, Metric.COSINE).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def _approximate(spark: SparkSession, sf_dir: str, metric: Metric) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors of different lengths, queries (every twentieth) and their 10 neighbours by inverted lists, exact for few vectors."""
    e = _embeddings(spark, sf_dir, scaled=metric != Metric.L2)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector.IvfIndex.build(e, 16, metric=metric)
    probes = index.probes_for(asked, 10) if index.rows > vector.EXACT_LIMIT else 0
    return e, asked, vector.search_batch(e, asked, 10, metric, index, probes)


@query()
def knn_ivf(spark, sf_dir):
    """Approximate search by inverted lists; as many are probed as measured recall needs."""
    return _approximate(spark, sf_dir, Metric.L2)[2]


@query()
def knn_recall(spark, sf_dir):
    """Share of the exact neighbours that ``knn_ivf`` finds."""
    e, asked, found = _approximate(spark, sf_dir, Metric.L2)
    return vector.recall(found, vector.knn_batch(e, asked, 10, Metric.L2), 10)


def _recall_of(metric: Metric) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, asked, found = _approximate(spark, sf_dir, metric)
        return vector.recall(found, vector.knn_batch(e, asked, 10, metric), 10).select("n", (F.col("recall") >= 0.9).alias("reached"))

    run.__name__ = f"knn_ivf_recall_{metric.name.lower()}"
    query("SELECT 10 * count(*) AS n, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0")(run)


for _metric in Metric:
    _recall_of(_metric)


@query(f"""SELECT id, round(1 - o, 6) AS score FROM (SELECT CAST(id AS VARCHAR) AS id, {_COS} AS o FROM {LIVE}) ORDER BY o, id LIMIT 10""")
def vec_db_search(spark, sf_dir):
    """A store of vectors: all inserted, some replaced and removed, compacted, opened again and searched."""
    from sedimenta.operators.vectordb import VectorDb
    from sedimenta.sources.folders import work_folder

    root = f"{work_folder(spark)}/vectors-{uuid.uuid4().hex}"
    db = VectorDb(spark, root, 64, Metric.COSINE)
    rows = vector_log(spark, sf_dir)
    db.insert_many(rows.filter("NOT deleted AND ordinal < 1000000").select("id", "embedding"))
    db.insert_many(rows.filter("NOT deleted AND ordinal >= 1000000").select("id", "embedding"))
    db.remove_many([str(r["id"]) for r in rows.filter("deleted").select("id").collect()])
    db.compact()
    db.close()
    out = VectorDb(spark, root).search(QUERY, 10)
    return out.select("id", F.round("score", 6).alias("score"))


@query(f"SELECT key, value FROM {NEWEST} WHERE NOT tombstone")
def stream_fold(spark, sf_dir):
    """The version log as a stream of files, folded batch by batch."""
    from sedimenta.sources.folders import work_folder
    from sedimenta.streaming.fold import StreamFold

    root = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = log(spark, sf_dir).select("key", "seqno", "value", "tombstone")
    rows.repartitionByRange(3, "seqno").write.parquet(f"{root}/in")
    schema = "key bigint, seqno bigint, value double, tombstone boolean"
    fold = StreamFold(spark, f"{root}/state", schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    fold.start(stream, f"{root}/checkpoint").awaitTermination()
    return fold.visible()


__all__ = ["ORACLE_SQL", "QUERIES", "T", "flagship"]
