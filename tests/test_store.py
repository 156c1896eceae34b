"""Versions, runs, key/value transactions, preferences, streams, roles, metrics."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import codecs, observability, security
from sedimenta.operators import lsm, versions
from sedimenta.operators.kv import KvStore, NotFound, Preferences
from sedimenta.sources.commit_log import CommitLog, Conflict

RUNS = "key long, seqno long, value string, tombstone boolean, run int"


def sequential_merge(rows, floor, bottom):
    seen, by_key, dropped = set(), defaultdict(list), 0
    for k, s, v, t, run in sorted(rows, key=lambda r: (r[0], -r[1], r[4])):
        if (k, s) not in seen:
            seen.add((k, s))
            by_key[k].append((s, v, t))
    out = []
    for k, vs in by_key.items():
        taken = False
        for s, v, t in vs:
            if s > floor:
                out.append((k, s, v, t))
            elif not taken:
                taken = True
                if t and bottom:
                    dropped += 1
                else:
                    out.append((k, s, v, t))
    return sorted(out), dropped


@pytest.mark.parametrize("floor", [0, 15, 99])
@pytest.mark.parametrize("bottom", [False, True])
def test_merge_equals_a_sequential_fold(spark, floor, bottom):
    rng = random.Random(floor)
    rows = [(rng.randint(0, 6), rng.randint(1, 30), None if t else f"v{i}", t, i % 3) for i in range(120) for t in [rng.random() < 0.3]]
    rows = list({(r[0], r[1], r[4]): r for r in rows}.values())  # a pair may be in several runs, once in each
    df = spark.createDataFrame(rows, RUNS)
    want, dropped = sequential_merge(rows, floor, bottom)
    got = sorted(tuple(r) for r in versions.merge_runs(df, floor, bottom).collect())
    assert got == want
    stats = versions.merge_stats(df, floor, bottom).first()
    assert (stats["entries_in"], stats["entries_out"], stats["tombstones_dropped"]) == (len(rows), len(want), dropped)
    assert stats["versions_dropped"] == len(rows) - len(want) - dropped


def test_lookup_has_three_states(spark):
    df = spark.createDataFrame([(1, 1, "a", False, 0), (1, 5, None, True, 0), (2, 3, "b", False, 0)], RUNS)
    keys = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    state = lambda at: {r["key"]: r["state"] for r in versions.lookup_state(df, keys, at).collect()}
    assert state(9) == {1: "deleted", 2: "found", 3: "absent"}
    assert state(2) == {1: "found", 2: "absent", 3: "absent"}


def test_fold_keeps_what_is_above_the_watermark(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, value string")
    log = spark.createDataFrame([(1, 1, "x", False, 0), (2, 2, None, True, 0), (4, 3, "n", False, 0), (1, 9, "late", False, 0)], RUNS)
    folded, rest = versions.fold(base, log, 5)
    assert sorted(map(tuple, folded.collect())) == [(1, "x"), (3, "c"), (4, "n")]
    assert [r["seqno"] for r in rest.collect()] == [9]


def test_snapshots_conflicts_and_checkpoints(spark, tmp_path):
    kv = KvStore(spark, str(tmp_path / "kv"))
    kv.put_auto(b"k", b"v1")
    reader = kv.begin(read_only=True)
    kv.put_auto(b"k", b"v2")
    assert kv.get(b"k", reader) == b"v1" and kv.get(b"k") == b"v2"
    a, b = kv.begin(), kv.begin()
    kv.put(a, b"k", b"a")
    kv.put(b, b"k", b"b")
    assert kv.get(b"k", a) == b"a"
    kv.commit(a)
    with pytest.raises(Conflict):
        kv.commit(b)
    c, d = kv.begin(), kv.begin()
    kv.put(c, b"c", b"1")
    kv.put(d, b"d", b"\x00" * 5000)
    kv.commit(c)
    kv.commit(d)  # other keys don't conflict
    with pytest.raises(NotFound):
        kv.delete_auto(b"none")
    kv.delete_auto(b"c")
    kv.checkpoint(2)
    assert [bytes(r["key"]) for r in kv.scan().collect()] == [b"d", b"k"] and kv.get(b"k") == b"a"
    kv.checkpoint()
    assert kv.count() == 2 and kv.get(b"c") is None and kv.get(b"k") == b"a"
    with pytest.raises(ValueError):
        kv.put(kv.begin(), b"", b"x")
    assert kv.verify() == 0 and len(kv.vacuum()) > 0 and kv.vacuum() == [] and kv.count() == 2
    kv.put_auto(b"n", b"1")
    assert tuple(kv.stats().first())[1:] == (1, 1, 1)


def test_only_one_writer_gets_a_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "l"))
    log.commit(1, {"n": 1})
    with pytest.raises(Conflict):
        log.commit(1, {"n": 2})
    assert log.latest() == (1, {"n": 1})


def test_preferences(spark, tmp_path):
    p = Preferences(KvStore(spark, str(tmp_path / "p")))
    values = {"s": "é🙂", "i": -(2**63), "d": 2.5, "b": True, "l": ["a", "", "日本"], "y": b"\x00\xff"}
    p.set_many(values)
    assert {k: p.get(k) for k in values} == values and p.count() == 6
    with pytest.raises(TypeError):
        p.get("s", int)
    with pytest.raises(TypeError):
        p.set_many({"ok": 1, "bad": object()})
    assert not p.contains("ok") and p.remove("s") and not p.remove("s")
    p.remove_many(["i", "absent"])
    assert p.count() == 4 and p.type_of("l") == "stringList" and p.type_of("absent") is None
    few = Preferences(p.store, {"d"})
    assert few.get("d") == 2.5
    for bad in (lambda: few.get("b"), lambda: few.set("x", 1), lambda: p.set("", 1), lambda: p.get("")):
        with pytest.raises(ValueError):
            bad()
    few.checkpoint()
    few.close()
    with pytest.raises(ValueError):
        few.count()
    assert p.count() == 4


def test_columns_and_driver_codecs_agree(spark):
    rows = [(1, "a", 2.5, True, ["x", "yé"]), (-42, "", -0.0, False, []), (2**63 - 1, "日本", 1e300, True, [""])]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean, l array<string>")
    enc = df.select(codecs.encode_int(F.col("i")), codecs.encode_string(F.col("s")), codecs.encode_double("d"), codecs.encode_bool(F.col("b")), codecs.encode_list(F.col("l")))
    for got, want in zip(enc.collect(), rows):
        assert [bytes(x) for x in got] == [codecs.encode_value(v) for v in want]
        assert [codecs.decode_value(x) for x in got] == list(want)
    back = df.select(codecs.decode_int(codecs.encode_int(F.col("i"))).alias("i")).collect()
    assert [r["i"] for r in back] == [r[0] for r in rows]
    with pytest.raises(Exception, match="expected int"):
        df.select(codecs.decode_int(codecs.encode_string(F.col("s")))).collect()
    out = df.select(codecs.decode_double(codecs.encode_double("d")).alias("d"), codecs.decode_list(codecs.encode_list(F.col("l"))).alias("l")).collect()
    assert [(r["d"], r["l"]) for r in out] == [(d, x) for _, _, d, _, x in rows]
    none = spark.createDataFrame([(None,)], "d double").select(codecs.decode_double(codecs.encode_double("d")).alias("d")).first()
    assert none["d"] is None
    for cut in (b"\x05\x02\x00\x00\x00\x01\x00\x00\x00a", b"\x05\x01\x00\x00\x00\xff\x00\x00\x00", b"\x05\x00\x00\x00\x00a", b"\x05\x01"):
        with pytest.raises(Exception, match="truncated list"):
            spark.createDataFrame([(cut,)], "v binary").select(codecs.decode_list(F.col("v"))).collect()
    for bad in (b"", b"\x02\x01", b"\x05\x01\x00\x00\x00\xff\x00\x00\x00"):
        with pytest.raises(ValueError):
            codecs.decode_value(bad)


def test_quantiles_equal_a_walk_over_buckets(spark):
    rng = random.Random(0)
    values = [rng.choice([0, 1, 2, 3, rng.randint(0, 10**6)]) for _ in range(500)]
    got = {r["q"]: r["quantile"] for r in observability.quantiles(spark.createDataFrame([(v,) for v in values], "micros long"), [0.5, 0.99, 0.999]).collect()}
    n = [0] * 32
    for v in values:
        n[0 if v < 2 else min(31, v.bit_length() - 1)] += 1
    for q, found in got.items():
        rank, total = max(1, -(-int(len(values) * q * 1000) // 1000)), 0
        for i, c in enumerate(n):
            total += c
            if total >= rank:
                assert found == min(2 ** (i + 1), max(1, max(values)))
                break


def test_small_metric_functions(spark):
    row = spark.range(1).select(
        observability.hit_ratio(F.lit(0), F.lit(0)).alias("a"), observability.write_amplification(F.lit(3), F.lit(0)).alias("b"),
        observability.saturating_gauge(F.array(*map(F.lit, [2, -5, 4]))).alias("c"),
        observability.attribute(F.array(F.struct(F.lit("k").alias("k"), F.lit("1").alias("v")), F.struct(F.lit("k").alias("k"), F.lit("2").alias("v"))), "k").alias("d"),
    ).first()
    assert tuple(row) == (0.0, 1.0, 4, "1")


def test_access_control_and_audit(spark, tmp_path):
    ac = security.AccessControl()
    assert ac.authorize_open("anyone", "admin") is None
    with pytest.raises(PermissionError):
        ac.authorize("anyone", "read")
    ac.define_role("reader", ["read"])
    ac.add_principal("tok", "ann", ["reader", "reader"])
    assert ac.authorize("tok", "read") == "ann"
    for bad in (lambda: ac.authorize("tok", "write"), lambda: ac.authorize("other", "read")):
        with pytest.raises(PermissionError):
            bad()
    for bad in (lambda: ac.add_principal("tok", "x", []), lambda: ac.add_principal("t2", "x", ["nope"]), lambda: ac.define_role("", ["read"])):
        with pytest.raises(ValueError):
            bad()
    held, granted = ac.frames(spark)
    asked = spark.createDataFrame([("ann", "read"), ("ann", "admin"), ("bob", "read")], "user_id string, permission string")
    assert {(r["user_id"], r["permission"]): r["allowed"] for r in security.authorize(asked, held, granted).collect()} == {("ann", "read"): True, ("ann", "admin"): False, ("bob", "read"): False}
    line = security.audit_line(F.lit(5), F.lit("allow"), F.lit("a\tb"), F.lit("put"), F.lit(b"k" * 70), F.lit(""), F.lit(None).cast("string"))
    spark.range(1).select(line.alias("value")).write.text(str(tmp_path / "audit"))
    r = security.read_audit(spark, str(tmp_path / "audit")).first()
    assert (r["ts"], r["user_id"], r["source"], r["detail"]) == (5, "a\\tb", "-", "-") and r["key"] == "6b" * 64 + "~"


def test_audit_log_is_appended(spark, tmp_path):
    log = security.AuditLog(spark, str(tmp_path / "audit"))
    log.allow(1, "ann", "put", key=b"k\x01")
    log.deny(2, "bob\n", "drop", detail="no\tright")
    assert log.sync() == 2 and log.sync() == 0
    log.append(3, "allow", "ann", "get")
    log.sync()
    rows = [tuple(r) for r in log.read().orderBy("ts").collect()]
    assert rows == [(1, "allow", "ann", "put", "6b01", "-", "-"), (2, "deny", "bob\\n", "drop", "-", "-", "no\\tright"), (3, "allow", "ann", "get", "-", "-", "-")] or rows[1][4] == ""


def test_metrics_of_an_engine(spark):
    m = observability.EngineMetrics()
    assert {r["name"]: r["value"] for r in m.frame(spark).collect()}["write_amplification"] == 1.0
    m.add("cache_hits", 3)
    m.add("cache_misses")
    m.move("runs", 2)
    m.move("runs", -5)
    with m.time("read_us"):
        pass
    with pytest.raises(ValueError):
        m.add("reads", -1)
    values = {r["name"]: r["value"] for r in m.frame(spark).collect()}
    assert values["cache_hits_total"] == 3 and values["runs"] == 0 and values["cache_hit_ratio"] == 0.75
    lines = [r["line"] for r in observability.prometheus(m.frame(spark)).collect()]
    at = lines.index("# TYPE cache_hits_total counter")
    assert lines[at - 1] == "# HELP cache_hits_total reads served from the cache" and lines[at + 1] == "cache_hits_total 3"
    assert "cache_hits 3" in m.report() and m.latencies(spark).count() == 3


def test_checksums_and_nonces(spark):
    import zlib

    r = spark.createDataFrame([(b"page", b"data")], "a binary, b binary").select(codecs.crc32(F.col("a"), F.col("b")).alias("c")).first()
    assert r["c"] == zlib.crc32(b"pagedata")
    writes = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 2, 1), (4, 1, 6), (5, 2, 9), (6, 1, 2)], "seq long, page_id long, version long")
    assert sorted(x["seq"] for x in codecs.nonce_reuse(writes).collect()) == [4, 6]


def test_run_planning(spark):
    t = spark.createDataFrame([(i, 0, i, i + 5, 100) for i in range(5)] + [(10, 1, 0, 3, 50), (11, 1, 8, 20, 60), (12, 1, 30, 40, 70)], "id long, level int, min_key long, max_key long, bytes long")
    assert lsm.pick_level(t).first()["level"] == 0
    assert sorted(r["id"] for r in lsm.pick_compaction(t).collect()) == [0, 1, 2, 3, 4, 10, 11]
    assert [r["id"] for r in lsm.lookup_order(t, 3).collect()] == [3, 2, 1, 0, 10]
    edits = spark.createDataFrame([(1, "add", 1), (2, "snapshot", None), (3, "add", 2), (4, "add", 3), (5, "remove", 2)], "seq long, kind string, id long")
    assert [r["id"] for r in lsm.replay_manifest(edits).collect()] == [3]
    bits, k, rate = lsm.bloom_parameters(10_000)
    assert (bits, k) == (100_000, 7) and rate < 0.01


def test_sorted_runs_are_written_and_pruned(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 100).alias("key"), F.col("id").alias("seqno"), F.lit("v").alias("value"), F.lit(False).alias("tombstone"))
    lsm.write_run(rows, str(tmp_path / "run"), 3)
    back = spark.read.parquet(str(tmp_path / "run"))
    assert back.count() == 1000 and versions.newest(back.filter("key = 7"), 600).first()["seqno"] == 507
    at = back.select("key", F.lit(0).alias("run"), F.monotonically_increasing_id().alias("pos"))
    assert versions.out_of_order(at.dropDuplicates(["key"]).orderBy("key").withColumn("pos", F.monotonically_increasing_id())).first()[0] == 0


def test_tracer(spark):
    seen = []
    t = observability.Tracer(capacity=2, export=seen.append)
    with t.span("outer") as outer:
        outer["attributes"] += [("k", "1"), ("k", "2")]
        with pytest.raises(KeyError):
            with t.span("inner", outer):
                raise KeyError
    with t.span("last"):
        pass
    rows = t.frame(spark).collect()
    assert [r["name"] for r in rows] == ["last", "outer"] and len(t.done) == 3 and seen == t.done
    got = {r["trace_id"]: (r["n"], r["errors"]) for r in observability.traces(spark.createDataFrame(t.done, observability.SPAN)).collect()}
    assert sorted(got.values()) == [(1, 0), (2, 1)]


def test_stream_state_is_folded_now_and_then(spark, tmp_path):
    from sedimenta.streaming.fold import StreamFold

    kind = "key long, seqno long, value string, tombstone boolean"
    fold = StreamFold(spark, str(tmp_path / "f"), kind, every=2)
    for batch in range(5):
        rows = [(k, 10 * batch + k, f"{batch}", k == batch) for k in range(3)] + [(0, 10 * batch + 5, "again", False)]
        fold.apply(spark.createDataFrame(rows, kind), batch)
        fold.apply(spark.createDataFrame([(9, 9, "replayed", False)], kind), batch)
        assert len(fold.log.latest()[1]["parts"]) <= 2
    assert {r["key"]: r["value"] for r in fold.visible().collect()} == {0: "again", 1: "4", 2: "4"}


def test_wal_is_replayed_up_to_a_broken_record(spark, tmp_path):
    from sedimenta.sources.wal import RECORD, Wal

    wal = Wal(spark, str(tmp_path / "w"))
    wal.append("insert", 1, b"a", b"1")
    wal.append("insert", 2, b"b", b"2")
    wal.commit(1, 10)
    wal.append("delete", 3, b"a")
    wal.append("rollback", 2)
    wal.commit(3, 11)
    wal.append("insert", 4, b"lost")  # never synced
    ops = lambda w: [(r["lsn"], r["kind"], r["key"], r["commit_ts"]) for r in w.recover().orderBy("commit_ts", "lsn").collect()]
    again = Wal(spark, str(tmp_path / "w"))
    assert ops(again) == [(0, "insert", b"a", 10), (3, "delete", b"a", 11)] and again.next == 6
    part = again.log.latest()[1]["parts"][1]
    rows = [tuple(r) for r in spark.read.parquet(part).orderBy("lsn").collect()]
    rows[1] = (*rows[1][:3], b"changed", *rows[1][4:])
    spark.createDataFrame(rows, RECORD).write.mode("overwrite").parquet(part)
    assert ops(again) == [(0, "insert", b"a", 10)] and again.records().count() == 4  # the commit after it doesn't count
    again.truncate()
    assert ops(again) == [] and Wal(spark, str(tmp_path / "w")).next == 6
    with pytest.raises(ValueError):
        wal.append("other", 1)


def test_bloom_filters_have_no_false_negatives(spark):
    keys = spark.range(10_000).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("key"))
    bloom = lsm.Bloom.build(keys)
    assert all(bloom.contains(str(i).encode()) for i in range(0, 10_000, 7))
    assert sum(bloom.contains(str(i).encode()) for i in range(20_000, 24_000)) / 4_000 < 0.05
    more = lsm.Bloom.build(keys.select(F.concat(F.col("key"), F.lit(b"x")).alias("key"))).merge(bloom)
    assert more.contains(b"5") and more.contains(b"5x")
