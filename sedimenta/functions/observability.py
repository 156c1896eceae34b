"""Histograms with log2 buckets, ratios, spans and their groups."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 32


def bucket(micros: Column) -> Column:
    """0 below 2, else floor(log2), at most the last; exact, from the length of the binary form."""
    return F.when(micros < 2, 0).otherwise(F.least(F.lit(BUCKETS - 1), F.length(F.bin(micros)) - 1))


def histogram(samples: DataFrame, value: str = "micros", *by: str) -> DataFrame:
    return samples.groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def summary(samples: DataFrame, value: str = "micros", *by: str) -> DataFrame:
    """Count, sum, mean, least and largest; 0 for none."""
    v, zero = F.col(value), F.lit(0).cast("long")
    return samples.groupBy(*by).agg(
        F.count(v).alias("n"), F.coalesce(F.sum(v), zero).alias("total"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(F.min(v), zero).alias("least"), F.coalesce(F.max(v), zero).alias("largest"),
    )


def quantiles(samples: DataFrame, qs: list[float], value: str = "micros", *by: str) -> DataFrame:
    """Upper bound of the bucket in which the rank ceil(n * q) falls, at most the largest sample (1 at least).

    The window runs over at most 32 buckets of a group.
    """
    hist = histogram(samples, value, *by)
    tops = samples.groupBy(*by).agg(F.greatest(F.lit(1), F.max(value)).cast("long").alias("top"))
    w = Window.partitionBy(*by).orderBy("bucket")
    cum = hist.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    asked = cum.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("all") * F.col("q")))
    found = asked.filter(F.col("cum") >= rank).groupBy(*by, "q").agg(F.min("bucket").alias("bucket"))
    upper = F.when(F.col("bucket") == BUCKETS - 1, F.lit(2**63 - 1)).otherwise(F.pow(F.lit(2.0), F.col("bucket") + 1).cast("long"))
    joined = found.join(tops, list(by)) if by else found.crossJoin(F.broadcast(tops))  # one row
    return joined.select(*by, "q", F.least(upper, "top").alias("quantile"))


def hit_ratio(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses == 0, 0.0).otherwise(hits / (hits + misses))


def write_amplification(out: Column, taken: Column) -> Column:
    return F.when(taken == 0, 1.0).otherwise(out / taken)


def throughput_mib(bytes_in: Column, micros: Column) -> Column:
    return F.when(micros == 0, 0.0).otherwise(bytes_in / F.lit(1048576.0) / (micros / F.lit(1e6)))


def saturating_gauge(changes: Column) -> Column:
    """Fold of ordered changes that doesn't go below 0."""
    return F.aggregate(changes, F.lit(0).cast("long"), lambda s, x: F.greatest(F.lit(0).cast("long"), s + x))


def attribute(attributes: Column, name: str) -> Column:
    """The first attribute of this name."""
    return F.get(F.filter(attributes, lambda a: a["k"] == name), F.lit(0))["v"]


def traces(spans: DataFrame) -> DataFrame:
    """Spans of each trace in order, with their number, time and errors."""
    span = F.struct("span_id", "name", "duration_us")
    return spans.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(span)).alias("spans"), F.count(F.lit(1)).alias("n"), F.sum("duration_us").alias("total_us"), F.count_if("error").alias("errors")
    )


def ring(spans: DataFrame, capacity: int, seq: str = "seq") -> DataFrame:
    """The last ``capacity`` spans."""
    return spans.orderBy(F.col(seq).desc()).limit(capacity)


def prometheus(metrics: DataFrame) -> DataFrame:
    """Lines of a text report of (name, kind, help, value), in order of names: help, type and value of each."""
    value = F.when(F.col("kind") == "counter", F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    lines = F.array(F.format_string("# HELP %s %s", "name", "help"), F.format_string("# TYPE %s %s", "name", "kind"), F.concat_ws(" ", "name", value))
    return metrics.orderBy("name").select(F.explode(lines).alias("line"))


class Timer:
    """Microseconds of a block on the driver, added to a list."""

    def __init__(self, into: list[int]):
        self.into = into

    def __enter__(self) -> Timer:
        self.began = time.perf_counter_ns()
        return self

    def __exit__(self, *_) -> None:
        self.into.append((time.perf_counter_ns() - self.began) // 1000)


METRIC = "name string, kind string, help string, value double"


class EngineMetrics:
    """Counters, gauges and latencies of an engine on the driver; as frames they are summed and summarised like others."""

    COUNTERS = {
        "wal_fsyncs": "log syncs", "wal_bytes": "log bytes written", "cache_hits": "reads served from the cache",
        "cache_misses": "reads that weren't", "cache_evictions": "pages evicted", "flushes": "buffers flushed", "compactions": "merges run",
        "compaction_bytes_in": "bytes that merges read", "compaction_bytes_out": "bytes that merges wrote", "txn_commits": "commits",
        "txn_rollbacks": "rollbacks", "txn_conflicts": "write conflicts", "reads": "point reads", "writes": "writes",
    }
    GAUGES = {"cache_resident_pages": "pages in the cache", "runs": "live runs"}
    LATENCIES = ["wal_fsync_us", "compaction_us", "txn_commit_us", "read_us"]

    def __init__(self):
        self.counters = dict.fromkeys(self.COUNTERS, 0)
        self.gauges = dict.fromkeys(self.GAUGES, 0)
        self.samples: dict[str, list[int]] = {n: [] for n in self.LATENCIES}

    def add(self, name: str, n: int = 1) -> None:
        if n < 0:
            raise ValueError("a counter only grows")
        self.counters[name] += n

    def move(self, name: str, by: int) -> None:
        """A gauge doesn't go below 0."""
        self.gauges[name] = max(0, self.gauges[name] + by)

    def time(self, name: str) -> Timer:
        return Timer(self.samples[name])

    def latencies(self, spark: SparkSession) -> DataFrame:
        """(metric, q, quantile) of every latency that has samples."""
        rows = [(n, v) for n, vs in self.samples.items() for v in vs]
        return quantiles(spark.createDataFrame(rows, "metric string, micros long"), [0.5, 0.99, 0.999], "micros", "metric")

    def frame(self, spark: SparkSession) -> DataFrame:
        """(name, kind, help, value), with the ratios of hits and of bytes written to bytes read."""
        c = self.counters
        rows = [(f"{n}_total", "counter", h, float(c[n])) for n, h in self.COUNTERS.items()]
        rows += [(n, "gauge", h, float(self.gauges[n])) for n, h in self.GAUGES.items()]
        tried, read = c["cache_hits"] + c["cache_misses"], c["compaction_bytes_in"]
        rows.append(("cache_hit_ratio", "gauge", "hits among reads", c["cache_hits"] / tried if tried else 0.0))
        rows.append(("write_amplification", "gauge", "bytes written by merges to bytes read", c["compaction_bytes_out"] / read if read else 1.0))
        return spark.createDataFrame(rows, METRIC)

    def report(self) -> str:
        """A line for people for each counter and gauge."""
        return "\n".join(f"{n} {v}" for n, v in [*self.counters.items(), *self.gauges.items()])


SPAN = "seq long, trace_id long, span_id long, parent_id long, name string, duration_us long, attributes array<struct<k:string,v:string>>, error boolean"


class Tracer:
    """Spans timed on the driver, in the order in which they end; ``frame`` makes a table of them.

    ``export`` is called with each span that ends.
    """

    def __init__(self, capacity: int = 10_000, export: Callable[[tuple], None] | None = None):
        self.capacity, self.export, self.done, self._ids = capacity, export, [], itertools.count(1)

    @contextmanager
    def span(self, name: str, parent: dict | None = None):
        """Time a block; a block that raises is marked. Attributes may repeat and keep their order."""
        number = next(self._ids)
        own = {"trace_id": parent["trace_id"] if parent else number, "span_id": number, "parent_id": parent and parent["span_id"], "attributes": [], "error": False}
        began = time.perf_counter_ns()
        try:
            yield own
        except BaseException:
            own["error"] = True
            raise
        finally:
            took = (time.perf_counter_ns() - began) // 1000
            self.done.append((len(self.done), own["trace_id"], number, own["parent_id"], name, took, own["attributes"], own["error"]))
            if self.export:
                self.export(self.done[-1])

    def frame(self, spark: SparkSession) -> DataFrame:
        return ring(spark.createDataFrame(self.done, SPAN), self.capacity)


def current_millis() -> Column:
    return F.unix_millis(F.current_timestamp())
