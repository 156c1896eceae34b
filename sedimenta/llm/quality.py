"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over dense features of a text gives each document's own evidence. It is
fitted on a bounded sample of labelled rows; everything after runs over all documents. Evidence
is summed by path (host and section) and by host; each host's rate of good documents is shrunk
toward the global rate, each path's toward its host's, by prior strengths that the spread of the
groups gives (method of moments). A document's score joins its own log odds with those of its
path, its own share in the path left out. Sparse sites thus fall back to global priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, small, with_python
from sedimenta.llm.textstats import counts

#: Labelled rows that the document classifier is fitted on at most: those whose ids' hashes lie below a share.
TRAIN_ROWS = 20_000
#: Documents whose score is below are rejected.
MIN_SCORE = 0.5
#: How much the path's log odds count against the document's own.
PATH_WEIGHT = 0.5

FEATURES = 16


def features(text: str, lang: str | None) -> list[float]:
    m = counts(text, lang)
    n, chars = max(1, m["n_words"]), max(1, len(text))
    share = m["classes"] / chars
    common = 1 - m["common"][-1] / n if m["common"] is not None else 0.4
    return [
        *share.tolist(),
        m["n_symbols"] / n,
        min(m["word_chars"] / n, 30) / 10,
        m["n_dup_lines"] / max(1, m["n_lines"]),
        m["n_repeat_words"] / n,
        m["n_distinct"] / n,
        common,
        np.log1p(m["n_words"]) / 10,
        float(m["n_words"] < 20),
        m["n_lines"] / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t or "", lang) for t, lang in zip(batch.column("_text").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["doc_id", "_th", "host", "path"]).columns, pa.array(x, pa.list_(pa.float64()))],
            ["doc_id", "_th", "host", "path", "x"],
        )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Intercept and weights on the raw features, by Newton steps with a ridge on standardised ones."""
    n, d = x.shape if x.ndim == 2 else (0, FEATURES)
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n else 0.5
        return float(np.log(rate / (1 - rate))), np.zeros(d)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(n), (x - mean) / std]
    keep = np.r_[0.0, np.full(d, ridge)]
    w = np.zeros(d + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - keep * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-6)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / std
    return float(w[0] - weights @ mean), weights


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def prior_strength(groups: DataFrame, target: Column) -> float:
    """Pseudo-count of a beta prior around ``target`` for groups (n, s), by the method of moments."""
    rate = F.col("s") / F.col("n")
    within = target * (1 - target) / F.col("n")
    r = groups.filter("n > 0").agg(
        F.sum(F.col("n") * ((rate - target) * (rate - target) - within)).alias("between"),
        F.sum(F.col("n") * target * (1 - target)).alias("spread"),
    ).first()
    if r["spread"] is None or r["spread"] <= 0:
        return 1.0
    share = min(0.5, max(1e-4, (r["between"] or 0.0) / r["spread"]))  # variance between groups over p (1 - p)
    return 1 / share - 1


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    min_score: float = MIN_SCORE,
    path_weight: float = PATH_WEIGHT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, p_doc, host_rate, path_rate, score, kept.

    A null host or path is a group of its own. A null text is empty. Rows with a null label, or an id that
    ``docs`` doesn't have, don't train; each row of an id that is listed more than once does. Without labels of both
    kinds the classifier is their rate alone. An empty table has no rows; null ids are carried and don't train. Very
    long texts are measured in one pass. Other columns of ``docs`` aren't read, so their names may clash.
    """
    with_python(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("_th"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.col(text_col).alias("_text"),
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    measured = cut(rows.mapInArrow(_measure, f"doc_id {id_type}, _th bigint, host string, path string, x array<double>"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y IS NOT NULL")
    # a share of the labels by hash, not the first of an order: then no partition sends more than its part
    n_known = known.count()
    share = min(1.0, 0.95 * train_rows / max(1, n_known))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    train = measured.select("doc_id", "x").join(known, "doc_id").limit(train_rows).toPandas()
    train = train.iloc[np.lexsort((train["y"], train["doc_id"]))]  # sums in one order
    b, w = fit_logistic(np.array(train["x"].tolist(), dtype=float), train["y"].to_numpy(dtype=float))
    z = F.lit(b) + F.aggregate(
        F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v
    )
    z = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z))
    scored = measured.select("doc_id", "_th", "host", "path", z.alias("z")).withColumn("p_doc", 1 / (1 + F.exp(-F.col("z"))))

    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_doc").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    k_host = prior_strength(hosts, F.lit(rate))
    host_rate = (F.col("hs") + k_host * rate) / (F.col("hn") + k_host)
    groups = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    groups = cut(groups.withColumn("host_rate", host_rate))
    k_path = prior_strength(groups, F.col("host_rate"))
    out = scored.join(small(groups), ["host", "path"])
    path_rate = (F.col("s") - F.col("p_doc") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    out = out.withColumn("path_rate", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), path_rate)))
    odds = F.col("z") + path_weight * (_logit(F.col("path_rate")) - float(np.log(rate / (1 - rate))))
    score = 1 / (1 + F.exp(-odds))
    return out.select(
        "doc_id", "_th", "p_doc", "host_rate", "path_rate", score.alias("score"), (score >= min_score).alias("kept")
    )


def op10_hierarchical_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).drop("_th")
