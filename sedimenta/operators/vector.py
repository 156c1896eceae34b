"""k nearest neighbours under cosine, Euclidean and dot-product metrics; index lifecycle.

Exact search by one query is a projection and a top-k, which Spark runs as partial heaps. A batch of queries
goes through Arrow and a matrix product per batch of vectors, in one scan of the vectors: queries within a checked
size are sent to every task, which keeps its k best for each, so what meets is k rows per query and task, not a row
per pair. More queries are dealt out in blocks that meet blocks of vectors. A task compares a step of queries with a
step of vectors at a time, so that beside the queries and what it keeps it holds the same however many there are.

A vector that is null, of another length than the query or not finite can't be inserted, and is nobody's neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from enum import IntEnum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.sources.folders import with_python

MAX_DIM, MAX_K, MAX_ID_BYTES, EXACT_LIMIT = 65_536, 4_096, 128, 512
TINY = 1.1754943508222875e-38  # least normal number of single precision
#: Bytes of queries that are sent to every task, and results that a task keeps, at most.
QUERY_BYTES, KEPT_ROWS = 64 * 1024 * 1024, 2_000_000
#: Queries and vectors compared at a time, and numbers of the pairs among them that are measured at a time.
QUERY_STEP, VECTOR_STEP, MEASURED = 256, 1024, 1 << 18


class Metric(IntEnum):
    COSINE = 0
    L2 = 1
    DOT = 2


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), dot(v, v)))


def ordering(metric: Metric, a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """What neighbours are ordered by: 1 - similarity (1 beside a zero vector), squared distance, or -dot."""
    if metric == Metric.L2:
        return squared_l2(a, b)
    if metric == Metric.DOT:
        return -dot(a, b)
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / both))
    return F.when(both <= TINY, F.lit(1.0)).otherwise(1 - cosine)


def finalize(metric: Metric, d: Column) -> Column:
    return F.sqrt(d) if metric == Metric.L2 else d


def score(metric: Metric, distance: Column) -> Column:
    if metric == Metric.COSINE:
        return 1 - distance
    return 1 / (1 + F.greatest(distance, F.lit(0.0))) if metric == Metric.L2 else -distance


def check_query(query: list[float], dim: int | None, k: int) -> None:
    if not 0 <= k <= MAX_K:
        raise ValueError(f"k must be in 0..{MAX_K}")
    if not 1 <= len(query) <= MAX_DIM or (dim is not None and len(query) != dim):
        raise ValueError("wrong dimension")
    if not np.isfinite(query).all():
        raise ValueError("a vector must be finite")


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has this many finite numbers; never null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def valid(df: DataFrame, dim: int, id_col: str = "id", vector: str = "embedding") -> Column:
    """Whether a row can be inserted: id of 1 to 128 bytes, right length, finite numbers."""
    size = F.octet_length(F.col(id_col).cast("string"))
    return F.coalesce(size.between(1, MAX_ID_BYTES), F.lit(False)) & usable(F.col(vector), dim)


def knn(df: DataFrame, query: list[float], k: int, metric: Metric, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, distance, score) of the k nearest, ties by id. k = 0 gives none."""
    check_query(query, None, k)
    q = F.array(*[F.lit(float(x)) for x in query])
    q_norm = F.lit(float(np.sqrt(np.cumsum(np.square(np.array(query, dtype=np.float64)))[-1])))  # summed from left to right
    rows = df.filter(usable(F.col(vector), len(query)))
    ranked = rows.select(id_col, ordering(metric, F.col(vector), q, norm_b=q_norm).alias("o")).orderBy("o", id_col).limit(k)
    d = finalize(metric, F.col("o"))
    return ranked.select(id_col, d.alias("distance"), score(metric, d).alias("score"))


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    """Vectors of an Arrow list column without nulls as rows of a matrix."""
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(v), dim)


def _nearest(q: np.ndarray, x: np.ndarray, names: np.ndarray, k: int, metric: Metric, bound: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, name, order) of the k best vectors of each query at least; with ``wanted`` (query, vector) of those only.

    Vectors farther than a query's ``bound``, the order of the k-th best found elsewhere, may be left out.

    The matrix product only chooses: what may be among the k best within its rounding is measured by sums from left
    to right, as the one-query form has them.
    """
    dim, k = q.shape[1], min(k, len(x))
    eps = 8 * (dim + 2) * np.finfo(np.float64).eps
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    both = q @ x.T
    if metric == Metric.L2:
        o, off = q2[:, None] + x2[None, :] - 2 * both, eps * (q2[:, None] + x2[None, :])
    elif metric == Metric.DOT:
        o, off = -both, eps * np.sqrt(q2[:, None] * x2[None, :])
    else:
        n = np.sqrt(q2)[:, None] * np.sqrt(x2)[None, :]
        zero = n <= TINY
        o, off = np.where(zero, 1.0, 1 - np.clip(both / np.where(zero, 1.0, n), -1, 1)), np.full_like(both, eps)
    if wanted is not None:
        o = np.where(wanted, o, np.inf)
    low, edge = o - off, bound.copy()
    many = np.flatnonzero((low <= edge[:, None]).sum(axis=1) > k)
    if len(many):
        edge[many] = np.minimum(edge[many], np.partition(o[many] + off[many], k - 1, axis=1)[:, k - 1])
    qi, xi = np.nonzero((low <= edge[:, None]) & (o < np.inf))
    out, step = np.empty(len(qi)), max(1, MEASURED // dim)
    for at in range(0, len(qi), step):
        a, b = q[qi[at : at + step]], x[xi[at : at + step]]
        if metric == Metric.L2:
            out[at : at + step] = np.cumsum((b - a) ** 2, axis=1)[:, -1]
            continue
        dots = np.cumsum(b * a, axis=1)[:, -1]
        if metric == Metric.COSINE:
            n = np.sqrt(np.cumsum(b * b, axis=1)[:, -1]) * np.sqrt(np.cumsum(a * a, axis=1)[:, -1])
            dots = np.where(n <= TINY, 0.0, np.clip(dots / np.where(n <= TINY, 1.0, n), -1, 1)) - 1
        out[at : at + step] = -dots
    return qi, names[xi], out


def _best(qi: np.ndarray, names: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by order, then name."""
    order = np.lexsort((names, o, qi))
    qi, names, o = qi[order], names[order], o[order]
    begin = np.searchsorted(qi, qi)
    keep = np.arange(len(qi)) - begin < k
    return qi[keep], names[keep], o[keep]


def _bound(found: tuple[np.ndarray, np.ndarray, np.ndarray] | None, n: int, k: int) -> np.ndarray:
    """Order of the k-th of each of n queries in what ``_best`` gave; infinite if there are fewer."""
    bound = np.full(n, np.inf)
    if found is not None:
        qi, _, o = found
        last = np.arange(len(qi)) - np.searchsorted(qi, qi) == k - 1
        bound[qi[last]] = o[last]
    return bound


Probed = Callable[[np.ndarray], np.ndarray]
Listed = Callable[[np.ndarray], np.ndarray]


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: Metric, id_col: str = "vec_id", vector: str = "embedding", query_block: int = 10_000, probed: Probed | None = None, query_bytes: int = QUERY_BYTES, listed: Listed | None = None) -> DataFrame:
    """(query_id, id, distance, score, rank) of every query of (query_id, query).

    Queries of up to ``query_bytes`` are sent to every task of one scan; beyond that, blocks of ``query_block`` queries
    meet blocks of vectors. All queries must have one length and be finite. ``probed`` gives the places (query, list) that
    the lists have for the queries of a block, and whether they are looked into, over the column ``list``, or what
    ``listed`` gives for the vectors of a batch.
    """
    check_query([0.0], None, k)
    with_python(df.sparkSession)
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    n, least, most, bad = asked.agg(
        F.count(F.lit(1)), F.min(F.coalesce(F.size("query"), F.lit(-1))), F.max(F.size("query")), F.count_if(~usable(F.col("query"), F.size("query")))
    ).first()
    if n and (bad or least != most or not 1 <= most <= MAX_DIM):
        raise ValueError("queries must be finite and of one dimension")
    dim = most or 1
    kinds = {c: t for c, t in (("query_id", queries.schema["query_id"].dataType.simpleString()), (id_col, df.schema[id_col].dataType.simpleString()))}
    lists = [] if probed is None or listed else [F.col("list").alias("l")]
    rows = df.filter(usable(F.col(vector), dim)).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), *lists)
    schema = f"query_id {kinds['query_id']}, {id_col} {kinds[id_col]}, o double"
    args = (k, metric, dim, probed, id_col, listed)
    if n * dim * 8 <= query_bytes:
        run = _scan(asked.toArrow() if n else None, *args)
        found = rows.mapInArrow(run, schema) if n and k else rows.sparkSession.createDataFrame([], schema)
    else:
        found = _blocks(rows, asked, n, query_block, schema, *args)
    place = Window.partitionBy("query_id").orderBy("o", id_col)
    d = finalize(metric, F.col("o"))
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", id_col, d.alias("distance"), score(metric, d).alias("score"), "rank")


def _scan(asked: pa.Table | None, k: int, metric: Metric, dim: int, probed: Probed | None, id_col: str, listed: Listed | None = None):
    """One pass over batches of vectors, with the k best so far of every query."""
    if asked is None:
        return None
    ids = asked.column("query_id").combine_chunks()
    q = _matrix(asked.column("query").combine_chunks(), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}  # by the first query of a step
        keeps = len(q) * k <= KEPT_ROWS  # else more than a task should hold

        def made(at: int, found: tuple) -> pa.RecordBatch:
            qi, names, o = found
            return pa.RecordBatch.from_arrays([ids.take(pa.array(qi + at)), pa.array(names), pa.array(o)], ["query_id", id_col, "o"])

        for batch in batches:
            if not len(batch):
                continue
            x, names = _matrix(batch.column("v"), dim), batch.column("id").to_numpy(zero_copy_only=False)
            names = names.astype(str) if names.dtype == object else names
            lists = None if probed is None else listed(x) if listed else batch.column("l").to_numpy()
            for at in range(0, len(q), QUERY_STEP):
                part = q[at : at + QUERY_STEP]
                looked, found = None if probed is None else probed(part), kept.get(at)
                for i in range(0, len(x), VECTOR_STEP):
                    wanted = None if looked is None else looked[:, lists[i : i + VECTOR_STEP]]
                    new = _nearest(part, x[i : i + VECTOR_STEP], names[i : i + VECTOR_STEP], k, metric, _bound(found, len(part), k), wanted)
                    if found is None or len(new[0]):
                        found = _best(*(new if found is None else (np.concatenate(c) for c in zip(found, new))), k)
                if keeps:
                    kept[at] = found
                else:
                    yield made(at, found)
        for at, found in kept.items():
            yield made(at, found)

    return run


def _blocks(rows: DataFrame, asked: DataFrame, n: int, query_block: int, schema: str, k: int, metric: Metric, dim: int, probed: Probed | None, id_col: str, listed: Listed | None) -> DataFrame:
    """Blocks of queries against blocks of vectors: each vector is sent to every block of queries."""
    parts = max(1, -(-n // query_block))
    spread = max(1, rows.rdd.getNumPartitions())
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    right = rows.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = list(_scan(a.select(["query_id", "query"]), k, metric, dim, probed, id_col, listed)(iter(b.to_batches(max_chunksize=10_000)))) if len(a) and len(b) else []
        none = pa.table([pa.array([], a.schema.field("query_id").type), pa.array([], b.schema.field("id").type), pa.array([], pa.float64())], ["query_id", id_col, "o"])
        return pa.Table.from_batches(out) if out else none

    left, right = left.withColumn("qb", F.col("qb").cast("long")), right.withColumn("qb", F.col("qb").cast("long"))
    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, schema)


# lifecycle: a log of (id, embedding, ordinal, deleted), newest ordinal of an id counts


def live(log: DataFrame, id_col: str = "id") -> DataFrame:
    rest = [c for c in log.columns if c != id_col]
    top = log.groupBy(id_col).agg(F.max_by(F.struct(*rest), "ordinal").alias("v"))
    return top.select(id_col, *[F.col(f"v.{c}").alias(c) for c in rest]).filter("NOT deleted")


def vector_stats(log: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    """Live, total and deleted records, and the share deleted (0 when empty)."""
    n = live(log, id_col).agg(F.count(F.lit(1)).alias("live"))
    total = log.filter("NOT deleted").agg(F.count(F.lit(1)).alias("total"))
    out = n.crossJoin(total)  # one row each
    out = out.withColumn("deleted", F.col("total") - F.col("live")).withColumn("dim", F.lit(dim))
    return out.withColumn("deleted_ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.col("deleted") / F.col("total")))


def compacted(log: DataFrame, id_col: str = "id") -> DataFrame:
    """Live records with ordinals that keep their order; the old ones' gaps remain, since only order counts."""
    return live(log, id_col).select(id_col, "embedding", "ordinal")


class IvfIndex:
    """Inverted lists around k-means centroids; ``probes`` nearest lists are searched exactly.

    Lists are made in a space whose Euclidean order is the metric's: unit vectors for the cosine, and for dot products
    vectors with one more coordinate that brings all to the length of the longest. Up to ``EXACT_LIMIT`` vectors every list
    is searched. An index that was just built has the rows without their list too, and ``listed``: a batch of queries then
    places the vectors where it compares them, by one Python worker a task instead of two in a row.
    """

    def __init__(self, centroids: np.ndarray, lists: DataFrame, id_col: str, vector: str, metric: Metric, rows: int, unlisted: DataFrame | None = None, listed: Listed | None = None):
        self.centroids, self.lists, self.id_col, self.vector, self.metric, self.rows = centroids, lists, id_col, vector, metric, rows
        self.unlisted, self.listed = lists if listed is None else unlisted, listed

    @classmethod
    def build(cls, df: DataFrame, lists: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = 50_000, seed: int = 7, metric: Metric = Metric.L2) -> IvfIndex:
        """Centroids are fitted on about ``sample`` vectors (a share by hashes of ids); every usable vector is assigned."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        with_python(df.sparkSession)
        v = F.col(vector).cast("array<double>")
        dim = (df.filter(F.size(vector) > 0).agg(F.mode(F.size(vector))).first()[0]) or 1
        good = df.filter(usable(F.col(vector), dim))
        rows, longest = good.agg(F.count(F.lit(1)), F.max(norm(v))).first()
        if not rows:
            return cls(np.zeros((1, dim + (metric == Metric.DOT))), good.withColumn("list", F.lit(0)), id_col, vector, metric, 0)
        space = cls._space(metric, longest)
        at = F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < min(1.0, sample / rows) * 1_000_003
        spaced = good.filter(at).select(cls._spaced(metric, v, longest).alias("v"))  # k-means zips it with itself: Python would run twice a task
        model = KMeans(k=lists, seed=seed, maxIter=10).fit(spaced.select(array_to_vector("v").alias("features")))
        centroids = np.array(model.clusterCenters())

        def listed(x: np.ndarray) -> np.ndarray:
            return ((centroids * centroids).sum(1)[None, :] - 2 * space(x) @ centroids.T).argmin(axis=1)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    near = listed(_matrix(b.column("_v"), dim))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(near, pa.int32())], [*names, "list"])

        names = [c for c in good.columns if c != "list"]
        kinds = ", ".join(f"`{c}` {good.schema[c].dataType.simpleString()}" for c in names)
        out = cls(centroids, good.select(*names, v.alias("_v")).mapInArrow(assign, f"{kinds}, list int"), id_col, vector, metric, rows, good, listed)
        return out

    @staticmethod
    def _spaced(metric: Metric, v: Column, longest: float) -> Column:
        """What ``_space`` does, as a column."""
        if metric == Metric.L2:
            return v
        if metric == Metric.DOT:
            return F.concat(v, F.array(F.sqrt(F.greatest(F.lit(0.0), F.lit(longest * longest) - dot(v, v)))))
        unit = F.struct(v.alias("v"), norm(v).alias("n"))  # the norm once a vector
        return F.transform(F.array(unit), lambda u: F.transform(u["v"], lambda x: x / F.when(u["n"] <= TINY, 1.0).otherwise(u["n"])))[0]

    @staticmethod
    def _space(metric: Metric, longest: float) -> Callable[[np.ndarray], np.ndarray]:
        def space(x: np.ndarray) -> np.ndarray:
            if metric == Metric.L2:
                return x
            n2 = (x * x).sum(axis=1)
            if metric == Metric.DOT:
                return np.c_[x, np.sqrt(np.maximum(0.0, longest * longest - n2))]
            n = np.sqrt(n2)[:, None]
            return x / np.where(n <= TINY, 1.0, n)

        return space

    def ranks(self, queries: np.ndarray) -> np.ndarray:
        """(query, list): place of the list by the distance of its centroid, from 0."""
        if self.metric == Metric.DOT:  # a query's further coordinate is 0
            queries = np.c_[queries, np.zeros(len(queries))]
        elif self.metric == Metric.COSINE:
            queries = self._space(Metric.COSINE, 0.0)(queries)
        centroids = self.centroids
        d = (centroids * centroids).sum(axis=1)[None, :] - 2 * queries @ centroids.T
        return np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable")

    def _probes(self, probes: int) -> int:
        return len(self.centroids) if self.rows <= EXACT_LIMIT else probes

    def search(self, query: list[float], k: int, probes: int) -> DataFrame:
        near = np.flatnonzero(self.ranks(np.array([query], dtype=np.float64))[0] < self._probes(probes)).tolist()
        return knn(self.lists.filter(F.col("list").isin(near)), query, k, self.metric, self.id_col, self.vector)

    def search_batch(self, queries: DataFrame, k: int, probes: int, query_block: int = 10_000, query_bytes: int = QUERY_BYTES) -> DataFrame:
        """``knn_batch`` over the ``probes`` nearest lists of each query."""
        place, upto = Places(self.centroids, self.metric), self._probes(probes)
        return knn_batch(self.unlisted, queries, k, self.metric, self.id_col, self.vector, query_block, lambda q: place.ranks(q) < upto, query_bytes, self.listed)

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95, sample: int = 200) -> int:
        """Least number of lists whose measured recall reaches ``target``, over ``sample`` queries (least hashes of ids).

        The exact neighbours of those queries are sought, and the places of the lists that hold them counted.
        """
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
        rows = some.collect()
        if not rows:
            return len(self.centroids)
        asked = {r["query_id"]: i for i, r in enumerate(rows)}
        places = self.ranks(np.array([r["query"] for r in rows], dtype=np.float64))
        best = knn_batch(self.unlisted, some, k, self.metric, self.id_col, self.vector).select("query_id", self.id_col)
        exact = self.lists.select(self.id_col, "list").join(F.broadcast(best), self.id_col).collect()
        at = np.bincount([places[asked[r["query_id"]], r["list"]] for r in exact], minlength=len(self.centroids))
        reached = np.cumsum(at) >= target * max(1, at.sum())
        return int(np.argmax(reached)) + 1 if reached.any() else len(self.centroids)


class Places(IvfIndex):
    """What a task needs of an index to place lists."""

    def __init__(self, centroids: np.ndarray, metric: Metric):
        self.centroids, self.metric = centroids, metric


def search_batch(df: DataFrame, queries: DataFrame, k: int, metric: Metric, index: IvfIndex | None = None, probes: int = 8, **names) -> DataFrame:
    """``search`` for every query of (query_id, query)."""
    if index is None or index.rows <= EXACT_LIMIT:
        return knn_batch(df, queries, k, metric, **names)
    return index.search_batch(queries, k, probes)


def search(df: DataFrame, query: list[float], k: int, metric: Metric, index: IvfIndex | None = None, probes: int = 8, **names) -> DataFrame:
    """Exact up to ``EXACT_LIMIT`` vectors or without an index, else by the index."""
    if index is None or index.rows <= EXACT_LIMIT:
        return knn(df, query, k, metric, **names)
    return index.search(query, k, probes)


def recall(approximate: DataFrame, exact: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Share of the exact neighbours that the approximate lists hold."""
    hits = approximate.select("query_id", id_col).join(exact.select("query_id", id_col), ["query_id", id_col], "left_semi")
    n = exact.agg(F.count(F.lit(1)).alias("n"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(n).select("hits", "n", (F.col("hits") / F.col("n")).alias("recall"))  # one row each
