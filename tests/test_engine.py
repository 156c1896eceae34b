"""Stores of runs and of vectors: flush, compaction, recovery, lifecycle."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import lsm
from sedimenta.operators.engine import Corrupt, LsmEngine
from sedimenta.operators.vector import Metric
from sedimenta.operators.vectordb import VectorDb, VectorQuery
from sedimenta.sources.commit_log import Conflict
from sedimenta.sources.manifest import Manifest


def visible(model, snapshot=None):
    out = {}
    for k, s, v in sorted(model, key=lambda r: r[1]):
        if snapshot is None or s <= snapshot:
            out[k] = v
    return {k: v for k, v in out.items() if v is not None}


def test_engine_equals_a_list_of_versions(spark, tmp_path):
    rng, model, seq = random.Random(3), [], 0
    db = LsmEngine(spark, str(tmp_path / "e"), "bigint", "string")
    for batch in range(5):
        for _ in range(12):
            seq += 1
            k, v = rng.randint(0, 9), None if rng.random() < 0.25 else f"v{seq}"
            db.delete(k, seq) if v is None else db.put(k, v, seq)
            model.append((k, seq, v))
        if batch < 4:
            db.rotate()
            db.flush_one()
    read = lambda s=None, e=db: {r["key"]: r["value"] for r in e.scan(s).collect()}
    assert read() == visible(model) and read(30) == visible(model, 30)
    assert db.stats().tables == {0: 4} and db.stats().active_entries == 12 and db.stats().checkpoint == 48
    assert db.distinct_keys() == len({k for k, s, _ in model if s > 48})
    done = db.compact_once(30)
    assert done["level"] == 1 and len(done["inputs"]) == 4 and done["entries_in"] == 48 > done["entries_out"]
    assert read() == visible(model) and read(40) == visible(model, 40)
    assert db.compact_until_stable(30) == 0
    for k in range(12):
        state, value = db.get(k)
        last = max((r for r in model if r[0] == k), key=lambda r: r[1], default=None)
        assert (state, value) == (("absent", None) if last is None else ("deleted", None) if last[2] is None else ("found", last[2]))
    db.close()
    assert not db.active and not db.needs_flush
    again = LsmEngine(spark, str(tmp_path / "e"), "bigint", "string")
    assert read(e=again) == visible(model) and again.stats().checkpoint == 60
    assert again.manifest.allocate() not in {t for t in again.manifest.tables}
    assert again.set_checkpoint(5) == 60 and again.set_checkpoint(70) == 70


def test_buffer_replaces_rotates_and_drains(spark, tmp_path):
    db = LsmEngine(spark, str(tmp_path / "e"), buffer_bytes=400)
    db.put(b"a", b"1", 1)
    db.put(b"a", b"2", 1)
    assert [(r["key"], r["value"]) for r in db.memtable().collect()] == [(b"a", b"2")] and not db.needs_flush
    db.put(b"b", b"x" * 300, 2)
    assert db.needs_flush and not db.active and db.flush_all() == 1
    db.delete(b"c", 3)
    assert [r["tombstone"] for r in db.drain().collect()] == [True] and not db.rotate()
    with pytest.raises(ValueError):
        db.put(b"a", b"", 0)
    assert db.get(b"b")[0] == "found" and db.get(b"zz") == ("absent", None)
    assert LsmEngine.is_bottom_most(lsm.LEVELS - 1) and not LsmEngine.is_bottom_most(lsm.LEVELS - 2)


def test_recovery_checks_runs_and_drops_orphans(spark, tmp_path):
    root = str(tmp_path / "e")
    db = LsmEngine(spark, root, "bigint", "string")
    for s in range(1, 4):
        db.put(s, "v", s)
    db.flush_all()
    shutil.copytree(db.path(1), f"{root}/run-000000000077")
    again = LsmEngine(spark, root, "bigint", "string")
    assert not (tmp_path / "e" / "run-000000000077").exists() and again.scan().count() == 3
    changed = spark.read.parquet(db.path(1)).withColumn("value", F.lit("w")).collect()
    spark.createDataFrame(changed, db.schema).write.mode("overwrite").parquet(db.path(1))
    with pytest.raises(Corrupt, match="run 1"):
        LsmEngine(spark, root, "bigint", "string")
    shutil.rmtree(db.path(1))
    with pytest.raises(Corrupt, match="run 1"):
        LsmEngine(spark, root, "bigint", "string")


def test_disorder_in_a_file_is_counted(spark, tmp_path):
    rows = [(2, 1, "a", False), (1, 1, "b", False), (1, 3, "c", False)]
    spark.createDataFrame(rows, "key long, seqno long, value string, tombstone boolean").coalesce(1).write.parquet(str(tmp_path / "r"))
    assert lsm.disorder(spark, str(tmp_path / "r")) == 2
    assert [(r["key"], r["seqno"]) for r in lsm.read_run(spark, str(tmp_path / "r")).collect()] == [(1, 3), (1, 1), (2, 1)]


def test_manifest_replays_from_its_snapshot(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"), every=4)
    for i in range(1, 7):
        m.append(add=[{"id": m.allocate(), "level": 0}], remove=[i - 1] if i % 2 else [], checkpoint=10 - i)
    again = Manifest(spark, str(tmp_path / "m"))
    assert again.tables == m.tables and sorted(again.tables) == [1, 3, 5, 6] and (again.next_id, again.checkpoint) == (7, 9)
    assert again.edits == 2  # the others lie before the snapshot
    m.append()
    with pytest.raises(Conflict):
        again.append()


def test_vector_store(spark, tmp_path):
    rng = random.Random(2)
    root = str(tmp_path / "v")
    db = VectorDb(spark, root, 4, Metric.L2)
    assert db.is_empty() and db.search([0.0] * 4).count() == 0
    db.insert_many([(f"i{i}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)] + [("twice", [0.0] * 4), ("twice", [9.0] * 4)])
    assert len(db) == 31 and db.get("twice") == [9.0] * 4 and db.contains("i3") and not db.contains("none")
    for bad in ([("ok", [1.0] * 4), ("short", [1.0])], [("", [1.0] * 4)], [("nan", [float("nan")] * 4)], [("é" * 65, [1.0] * 4)]):
        with pytest.raises(ValueError):
            db.insert_many(bad)
    assert len(db) == 31 and not db.contains("ok")
    db.insert("i3", [5.0] * 4)
    assert db.remove("i4") and not db.remove("i4")
    found = [r["id"] for r in db.query(VectorQuery([5.0] * 4, 2)).collect()]
    assert found == ["i3", "twice"]
    s = db.stats()
    assert (s["live"], s["total"], s["deleted"], s["metric"]) == (30, 33, 3, "L2")
    assert db.compact() == 3 and db.stats()["deleted"] == 0 and len(db) == 30 and not db.contains("i4")
    db.save(lists=4)
    assert [r["id"] for r in db.search([5.0] * 4, 2).collect()] == found
    db.insert("new", [5.0] * 4)  # the index is older now and isn't used
    assert [r["id"] for r in db.search([5.0] * 4, 2).collect()] == ["i3", "new"]
    asked = spark.createDataFrame([(1, [5.0] * 4)], "query_id long, query array<double>")
    assert [r["id"] for r in db.search_many(asked, 2).orderBy("rank").collect()] == ["i3", "new"]
    db.close()
    with pytest.raises(ValueError):
        len(db)
    assert len(VectorDb(spark, root, 4)) == 31
    for bad in (lambda: VectorDb(spark, root, 5), lambda: VectorDb(spark, root, 4, Metric.DOT), lambda: VectorDb(spark, str(tmp_path / "w")), lambda: VectorQuery([1.0], 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        VectorDb(spark, root).search([1.0], 2)
