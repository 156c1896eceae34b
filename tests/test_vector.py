"""Distances, exact and approximate search, validation, lifecycle."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import vector
from sedimenta.operators.vector import Metric

VEC = "vec_id long, embedding array<float>"


def cloud(n, dim, seed):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]


def test_known_distances(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], VEC)
    r = {x["vec_id"]: x for x in vector.knn(df, [0.0, 0.0], 2, Metric.L2).collect()}
    assert r[1]["distance"] == 5.0 and r[1]["score"] == pytest.approx(1 / 6)
    r = {x["vec_id"]: x for x in vector.knn(df, [1.0, 0.0], 2, Metric.COSINE).collect()}
    assert r[2]["distance"] == 1.0 and r[2]["score"] == 0.0 and r[1]["distance"] == pytest.approx(0.4)
    angles = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-3.0, 0.0])], VEC)
    assert [round(x["distance"], 9) for x in vector.knn(angles, [5.0, 0.0], 3, Metric.COSINE).collect()] == [0, 1, 2]
    dots = spark.createDataFrame([(1, [1.0, 1.0]), (5, [5.0, 5.0])], VEC)
    assert [(x["vec_id"], x["score"]) for x in vector.knn(dots, [1.0, 1.0], 2, Metric.DOT).collect()] == [(5, 10.0), (1, 2.0)]
    assert vector.knn(df, [0.0, 0.0], 0, Metric.L2).count() == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_batches_equal_single_queries(spark, metric):
    df = spark.createDataFrame(cloud(300, 8, 1) + [(900, [0.0] * 8), (901, [0.5] * 8), (902, [0.5] * 8)], VEC)
    qs = cloud(7, 8, 2) + [(99, [0.5] * 8)]
    queries = spark.createDataFrame(qs, "query_id long, query array<double>")
    got = {}
    for r in vector.knn_batch(df, queries, 4, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    for i, q in qs:
        assert got[i] == [(r["vec_id"], r["distance"]) for r in vector.knn(df, q, 4, metric).collect()]
    assert [x[0] for x in got[99]][:2] == [901, 902] or metric != Metric.L2
    blocks = vector.knn_batch(df, queries, 4, metric, query_block=3, query_bytes=0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in blocks) == sorted((i, n + 1, v, d) for i, x in got.items() for n, (v, d) in enumerate(x))
    assert vector.knn_batch(df, queries.limit(0), 4, metric).count() == vector.knn_batch(df, queries, 0, metric).count() == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_a_scan_holds_the_same_for_large_batches_and_many_copies(metric):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(16_000, 16)), np.ones((4_000, 16))])
    q = np.concatenate([rng.normal(size=(500, 16)), np.ones((100, 16))])
    asked = pa.table({"query_id": pa.array(range(600)), "query": pa.array(list(q), pa.list_(pa.float64()))})
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"])
    tracemalloc.start()
    out = pa.Table.from_batches(vector._scan(asked, 5, metric, 16, None, "id")(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    o = {Metric.L2: lambda: ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), Metric.DOT: lambda: -q @ x.T, Metric.COSINE: lambda: 1 - q @ x.T / n}[metric]()
    o = np.round(o, 9)
    best = np.lexsort((np.broadcast_to(np.arange(20_000), o.shape), o))[:, :5]
    got = {}
    for r in sorted(out.to_pylist(), key=lambda r: (r["query_id"], round(r["o"], 9), r["id"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert [got[i] for i in range(600)] == best.tolist()


def test_batches_keep_near_ties_of_large_vectors_and_text_ids(spark):
    rng = random.Random(4)
    far = [1e6 + rng.random() for _ in range(6)]
    rows = [(f"é{i}", [x + i * 1e-4 for x in far]) for i in range(40)] + [("z", far), ("a", far)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([("q", far)], "query_id string, query array<double>")
    got = [(r["vec_id"], r["distance"]) for r in vector.knn_batch(df, queries, 5, Metric.L2).orderBy("rank").collect()]
    assert got == [(r["vec_id"], r["distance"]) for r in vector.knn(df, far, 5, Metric.L2).collect()] and [x for x, _ in got[:2]] == ["a", "z"]


@pytest.mark.parametrize("metric", list(Metric))
def test_broken_vectors_are_nobodys_neighbours(spark, metric):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [1.0, math.nan]), (7, [math.inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    df = spark.createDataFrame(rows, VEC)
    assert sorted(r["vec_id"] for r in vector.knn(df, [1.0, 2.0], 9, metric).collect()) == [1, 2]
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<double>")
    for size in (0, vector.QUERY_BYTES):
        assert sorted(r["vec_id"] for r in vector.knn_batch(df, queries, 9, metric, query_bytes=size).collect()) == [1, 2]
    index = vector.IvfIndex.build(df, 2, metric=metric)
    assert index.rows == 2 and sorted(r["vec_id"] for r in index.search([1.0, 2.0], 9, 1).collect()) == [1, 2]
    assert vector.IvfIndex.build(df.limit(0), 2, metric=metric).search([1.0], 3, 1).count() == 0
    for bad in ([[1.0, 2.0], [1.0]], [[math.nan, 1.0]], [None]):
        with pytest.raises(ValueError):
            vector.knn_batch(df, spark.createDataFrame([(i, q) for i, q in enumerate(bad)], "query_id long, query array<double>"), 2, metric)


@pytest.mark.parametrize("metric", list(Metric))
def test_inverted_lists_reach_the_recall(spark, metric):
    """Vectors of very different lengths: lists by plain Euclidean distance would lose cosine and dot neighbours."""
    rng = random.Random(5)
    rows = [(i, [x * s for x in v]) for i, v in cloud(1500, 16, 5) for s in [rng.choice([0.1, 1.0, 9.0])]]
    df = spark.createDataFrame(rows, VEC).cache()
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector.IvfIndex.build(df, 16, metric=metric)
    exact = vector.knn_batch(df, queries, 10, metric).cache()
    probes = index.probes_for(queries, 10)
    some = vector.recall(index.search_batch(queries, 10, probes), exact, 10).first()
    assert 1 <= probes <= 14 and some["n"] == 750 and some["recall"] >= 0.95
    assert vector.recall(index.search_batch(queries, 10, 16), exact, 10).first()["recall"] == 1.0
    one = [r["vec_id"] for r in index.search_batch(queries.filter("query_id = 40"), 10, 3).orderBy("rank").collect()]
    assert one == [r["vec_id"] for r in index.search(list(queries.filter("query_id = 40").first()["query"]), 10, 3).collect()]
    index.rows = vector.EXACT_LIMIT  # few vectors: every list is searched
    assert vector.recall(vector.search_batch(df, queries, 10, metric, index, 1), exact, 10).first()["recall"] == 1.0


@pytest.mark.parametrize("metric", list(Metric))
def test_lists_are_fitted_without_python(spark, metric, monkeypatch):
    from pyspark.ml.clustering import KMeans

    plans, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (plans.append(df), fit(self, df))[1])
    rows = cloud(60, 4, 2) + [(60, [0.0] * 4)]
    index = vector.IvfIndex.build(spark.createDataFrame(rows, VEC), 3, metric=metric)
    assert index.rows == 61 and "MapInArrow" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    space = index._space(metric, np.sqrt((x * x).sum(axis=1).max()))(x)
    assert np.allclose(sorted(r["features"].toArray().tolist() for r in plans[0].collect()), sorted(space.tolist()))


@pytest.mark.parametrize("metric", list(Metric))
def test_a_batch_places_vectors_where_it_compares_them(spark, metric):
    """One Python worker a task; the same neighbours as from lists that were written before."""
    df = spark.createDataFrame([(i, [x * (1 + i % 5) for x in v]) for i, v in cloud(800, 8, 9)], VEC).cache()
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector.IvfIndex.build(df, 8, metric=metric)
    stored = vector.IvfIndex(index.centroids, index.lists.cache(), "vec_id", "embedding", metric, index.rows)
    for size in (0, vector.QUERY_BYTES):
        got, want = (x.search_batch(queries, 5, 3, query_block=17, query_bytes=size) for x in (index, stored))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == (size > 0)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_over_embeddings(spark, sf):
    from sedimenta.plans.catalogue import QUERIES

    row = QUERIES["knn_recall"](spark, f"/root/testdata/{sf}").first()
    assert row["n"] == (250 if sf == "sf0.01" else 1000) and row["recall"] >= (1.0 if sf == "sf0.01" else 0.9)


def test_validation(spark):
    rows = [("a", [1.0, 2.0]), ("", [1.0, 2.0]), ("é" * 65, [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, math.nan]), ("d", [1.0, math.inf]), ("e", None), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert [r["v"] for r in df.select(vector.valid(df, 2).alias("v")).collect()] == [True] + [False] * 7
    for bad in (lambda: vector.check_query([1.0], 2, 1), lambda: vector.check_query([math.nan], 1, 1), lambda: vector.check_query([1.0], 1, 5000)):
        with pytest.raises(ValueError):
            bad()


def test_replace_remove_compact(spark):
    kind = "id string, embedding array<float>, ordinal long, deleted boolean"
    log = spark.createDataFrame([("a", [1.0], 0, False), ("b", [2.0], 1, False), ("a", [9.0], 2, False), ("b", None, 3, True), ("c", [3.0], 4, False)], kind)
    assert sorted((r["id"], r["embedding"]) for r in vector.live(log).collect()) == [("a", [9.0]), ("c", [3.0])]
    s = vector.vector_stats(log, 1).first()
    assert (s["live"], s["total"], s["deleted"], s["deleted_ratio"]) == (2, 4, 2, 0.5)
    assert vector.vector_stats(log.limit(0), 1).first()["deleted_ratio"] == 0.0
    assert [r["id"] for r in vector.compacted(log).orderBy("ordinal").collect()] == ["a", "c"]
    a = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, vec_id long")
    e = spark.createDataFrame([(1, 1), (1, 3)], "query_id long, vec_id long")
    assert vector.recall(a, e, 2).first()["recall"] == 0.5


def test_score_function(spark):
    r = spark.range(1).select(*[vector.score(m, F.lit(3.0)) for m in Metric]).first()
    assert tuple(r) == (-2.0, 0.25, -3.0)
