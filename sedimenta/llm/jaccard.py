"""N-gram Jaccard join by MinHash banding.

A document is the set of its five-word shingles, hashed to 64 bits. Documents with equal sets
are one set with a weight. The signature of a set is cut into bands; band and row counts come
from the recall wanted at the threshold. Sets that share a band hash fall into a bucket, and
each set is sent, with its whole shingle set, to the least member of every bucket it is in: its
homes. Two sets that share a bucket share a home, mostly one for all their common bands.

At a home all pairs are verified on the whole sets, in blocks: a home of many sets is cut into
blocks of a bounded number of shingles, and each pair of blocks is a task of its own. A task
gives one row for each set that has links, with their number and the least set it is joined
with, never a row for each pair. A pair that meets at several homes counts at the least one.
Classes are the connected components over the rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, key_join, keyed, small, with_python, written
from sedimenta.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 5
RECALL = 0.999
#: Sets and shingles in a block at most on average; a task holds two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 128, 400_000

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_FOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Least number of bands of ``rows`` rows that find a pair at the threshold with the recall wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words, but not none, are one shingle."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=_U, count=len(words))
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, k, dtype=_U)
    for j in range(k):
        s = mixed(s * _FOLD + h[j : len(h) - k + 1 + j])
    return np.unique(s)


def signature(s: np.ndarray, perms: int) -> np.ndarray:
    """Least value of each of ``perms`` multiply-add permutations."""
    i = np.arange(perms, dtype=_U)
    a, b = mixed(i * _U(2) + _U(1)) | _U(1), mixed(i * _U(2) + _U(2))
    out = np.full(perms, np.iinfo(np.uint64).max, dtype=_U)
    for at in range(0, len(s), 4096):
        np.minimum(out, (s[None, at : at + 4096] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = signature(s, bands * rows).reshape(bands, rows)
    out = np.zeros(bands, dtype=_U)
    for r in range(rows):
        out = mixed(out * _FOLD + sig[:, r])
    return out.view(np.int64)


def _profile(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hi, lo, bh = [], [], [], []
            for text in batch.column("_text").to_pylist():
                s = shingles(text or "")
                size.append(len(s))
                # order-free 128-bit key of the set
                hi.append(int(mixed(s + _M1).sum(dtype=_U).view(np.int64)))
                lo.append(int(mixed(s ^ _M2).sum(dtype=_U).view(np.int64)))
                bh.append(band_hashes(s, bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_th"), pa.array(size, pa.int32()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(bh, pa.list_(pa.int64()))],
                ["_id", "_th", "n_sh", "hi", "lo", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets as bytes; a set that is listed again in this task is left out."""
    seen: set[int] = set()
    for batch in batches:
        keep, out = [], []
        for i, (sid, text) in enumerate(zip(batch.column("sid").to_pylist(), batch.column("_text").to_pylist())):
            if sid not in seen:
                seen.add(sid)
                keep.append(i)
                out.append(shingles(text or "").tobytes())
        rest = batch.take(pa.array(keep, pa.int64())).select(["sid", "weight", "homes"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.binary())], ["sid", "weight", "homes", "sh"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets, in memory that doesn't grow with their size squared."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, which = every[order], which[order]
    new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    count = np.diff(np.r_[new, len(every)])
    col = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    col, which = col[shared], which[shared]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    step = 4096
    edges = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + step, step))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[which[a:b], col[a:b] - k * step] = 1
        out += (m @ m.T).astype(np.int64)  # at most step, which single precision holds
    return out


def linked(rows: list[dict], home: int, p: int, q: int, threshold: float) -> list[tuple[int, int, int]]:
    """(sid, links counted here, least sid joined with) of the sets of a pair of blocks."""
    rows = list({r["sid"]: r for r in rows}.values())
    if len(rows) < 2:
        return []
    sets = [np.frombuffer(r["sh"], dtype=_U) for r in rows]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    both = overlaps(sets)
    least = Fraction(str(threshold))  # whole numbers throughout, so that a pair at the threshold is a link
    near = both * least.denominator >= least.numerator * (n[:, None] + n[None, :] - both)
    blk = np.array([r["blk"] for r in rows])
    np.fill_diagonal(near, False)
    if p != q:
        near &= blk[:, None] != blk[None, :]
    # a pair counts at the least home that both have
    less: dict[int, int] = {}
    at = [(i, less.setdefault(h, len(less))) for i, r in enumerate(rows) for h in r["homes"] if h < home]
    first = np.ones_like(near)
    if at:
        m = np.zeros((len(rows), len(less)), dtype=np.float32)
        m[tuple(np.array(at).T)] = 1
        first = (m @ m.T) == 0
    weight = np.array([r["weight"] for r in rows], dtype=np.int64)
    links = (near & first) @ weight
    label = np.arange(len(rows))
    sid = np.array([r["sid"] for r in rows])
    order = np.argsort(sid)
    near = near[order][:, order]
    while True:
        low = np.where(near, label[None, :], len(rows)).min(axis=1)
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    sid, links = sid[order], links[order]
    return [(int(sid[i]), int(links[i]), int(sid[label[i]])) for i in range(len(rows)) if links[i] or label[i] != i]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done():
            out = linked(rows, *key, threshold) if key else []
            cols = list(zip(*out)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["sid", "links", "root"])

        # rows become Python objects a few at a time
        for r in (r for batch in batches for i in range(0, len(batch), 500) for r in batch.slice(i, 500).to_pylist()):
            at = (r["home"], r["p"], r["q"])
            if at != key:
                yield done()
                key, rows = at, []
            rows.append(r)
        yield done()

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    rows: int = ROWS,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """(_id, _th, class_id, is_first, n_links, n_rows): one row per document (id and text).

    A class is a connected component of links; its id is the least document id in it, whose document is
    ``is_first``. ``n_links`` counts the other documents with a Jaccard similarity of ``threshold`` or more.
    Texts without a word, null ones among them, are linked to none. ``n_rows`` rows of ``docs`` agree in id and text;
    null ids are equal and come first. An empty table has no rows; other columns aren't read, so their names may clash.
    """
    with_python(docs.sparkSession)
    bands = bands_for(threshold, recall, rows)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, _th bigint, n_sh int, hi bigint, lo bigint, bands array<bigint>"
    profiles = cut(keyed(docs, id_col, text_col).mapInArrow(_profile(bands, rows), schema))
    one = profiles.groupBy("_id", "_th", "n_sh", "hi", "lo").agg(F.count(F.lit(1)).alias("n_rows"))
    one = cut(one)
    least = F.min(F.struct("_id", "_th")).alias("rep")
    found = (
        one.filter("n_sh > 0").groupBy("hi", "lo").agg(least, F.count(F.lit(1)).alias("weight"), F.first("n_sh").alias("n_sh"))
    )
    sets = cut(found.withColumn("sid", F.monotonically_increasing_id()))

    reps = sets.select("sid", F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th"))
    banded = key_join(profiles.select("_id", "_th", "bands"), reps).select("sid", F.posexplode("bands").alias("t", "bh"))
    banded = cut(banded.distinct())
    buckets = banded.groupBy("t", "bh").agg(F.min("sid").alias("home"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    buckets = small(written(buckets.drop("m")))
    homes = cut(banded.join(buckets, ["t", "bh"]).select("sid", "home").distinct())

    per_set = homes.groupBy("sid").agg(F.array_sort(F.collect_list("home")).alias("homes"))
    members = cut(
        per_set.join(sets, "sid").select("sid", "weight", "n_sh", "homes", F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th"))
    )
    sizes = (
        members.select(F.explode("homes").alias("home"), "n_sh")
        .groupBy("home")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("n_sh").alias("total"))
        .select("home", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("g"))
    )
    slim = members.count() <= broadcast_rows
    texts = key_join(keyed(docs, id_col, text_col), members.drop("n_sh"), hint=slim)
    payload = texts.select("sid", "weight", "homes", "_text").mapInArrow(
        _sets, "sid bigint, weight bigint, homes array<bigint>, sh binary"
    )
    # only homes of several blocks are looked up: a set is in one block of the others
    split = small(written(sizes.filter("g > 1")))
    spread = members.select("sid", F.explode("homes").alias("home")).join(split, "home", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    spread = spread.withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("g")).cast("int"))
    spread = spread.select("sid", "home", "blk", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    spread = spread.select("sid", "home", "blk", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"))
    tasks = payload.join(spread, "sid").select("home", "p", "q", "blk", "sid", "weight", "homes", "sh")
    tasks = tasks.repartition("home", "p", "q").sortWithinPartitions("home", "p", "q")
    links = cut(tasks.mapInArrow(_verify(threshold), "sid bigint, links bigint, root bigint"))

    totals = links.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(links.filter("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")))
    of_set = (
        sets.join(classes.withColumnRenamed("v", "sid"), "sid", "left")
        .join(totals, "sid", "left")
        .select("hi", "lo", "n_sh", "rep", "weight", F.coalesce("c", "sid").alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    of_set = cut(of_set)
    first = of_set.groupBy("c").agg(F.min("rep").alias("first"))
    of_set = of_set.join(first, "c").select("hi", "lo", "weight", "links", "first")
    out = one.join(of_set, ["hi", "lo"], "left")
    alone = F.col("first").isNull() | (F.col("n_sh") == 0)
    me = F.struct("_id", "_th")
    return out.select(
        "_id",
        "_th",
        F.when(alone, F.col("_id")).otherwise(F.col("first._id")).alias("class_id"),
        (alone | me.eqNullSafe(F.col("first"))).alias("is_first"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("weight") - 1).cast("long").alias("n_links"),
        "n_rows",
    )


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).select(
        F.col("_id").alias("doc_id"), "class_id", "n_links", "is_first"
    )
