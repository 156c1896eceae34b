"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into the same words. Of every ``span`` consecutive
words the ``span - k + 1`` word k-grams are hashed and the least hash is kept, so two texts
that share ``span`` words in a row share a kept hash at the same place in that span. The
fingerprints of the documents are joined with those of the benchmark, each hit is extended
to the windows around it, and a window counts only if its words are equal, so the result is
exact: a document word is hit if it lies in any occurrence of a benchmark window.

Only DataFrame functions are used. One pass over the texts makes fingerprints, which meet
the benchmark's in a map-side join while the benchmark is within a checked bound and in a
shuffled join beyond it; the second pass reads only the documents with hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, key_join, keyed, sha256_text, small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: every ASCII character but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of window texts that are sent to every executor at most.
BROADCAST_BYTES = 32 * 1024 * 1024

#: Low bits of a packed fingerprint that hold the position; longer texts wrap around.
POS_BITS = 24


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; none for a null text.

    ``lower`` would also change letters beyond ASCII, and ``translate`` is slow, so words
    of ASCII letters take the first and only the others the second.
    """

    def lowered(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != ""), lowered)


def _hash_at(h: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(h, i + j) for j in range(k)])


def _packed(hashed: Column, position: Column) -> Column:
    low = (1 << POS_BITS) - 1
    return hashed.bitwiseAND(F.lit(~low)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(low)))


def _grams(h: Column, n: Column, k: int) -> Column:
    """Packed hash and position of every k-gram."""
    made = F.transform(F.sequence(F.lit(0), n - k), lambda i: _packed(_hash_at(h, i, k), i))
    return F.when(n >= k, made).otherwise(F.array().cast("array<long>"))


def winnowed(df: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """Add ``_fps``: packed winnowed fingerprints of ``_words``, and all grams of the lengths in ``short``."""
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_n", F.size("_words"))
    h, n, g = F.col("_h"), F.col("_n"), F.col("_g")
    df = df.withColumn("_g", _grams(h, n, k))
    kept = F.array_distinct(
        F.transform(F.sequence(F.lit(0), n - span), lambda i: F.least(*[F.get(g, i + j) for j in range(span - k + 1)]))
        if span > k
        else g
    )
    parts = [F.when(n >= span, kept).otherwise(F.array().cast("array<long>"))]
    # a gram of a short item is hashed with its length, so lengths do not meet
    def seeded(m: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), n - m), lambda i: _packed(F.xxhash64(F.lit(m), _hash_at(h, i, m)), i))
        return F.when(n >= m, made).otherwise(F.array().cast("array<long>"))

    parts += map(seeded, short)
    return df.withColumn("_fps", F.concat(*parts) if len(parts) > 1 else parts[0]).drop("_h", "_g")


def _windows(n: Column, span: int) -> Column:
    """(start, length) of the windows of an item: ``span`` words each, or the whole of a shorter one."""
    length = F.least(n, F.lit(span))
    made = F.transform(F.sequence(F.lit(0), n - length), lambda s: F.struct(s.alias("s"), length.alias("m")))
    return F.when(n > 0, made)


def _window_text(w: Column, s: Column, m: Column) -> Column:
    return F.array_join(F.slice(w, s + 1, m), " ")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 8,
    k: int = 5,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per document row: _id, _th, n_words, n_hit, hits (sorted spans), item_ids (sorted strings).

    A null text has no words. An item with fewer than ``span`` words is one window; an item
    without words is none. A null item id is the string ''. Rows of one item id are one item.
    Repeated document rows each get the row's result. Empty tables give no rows or no hits.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("_words")
    )
    items = cut(items.filter(F.size("_words") > 0))
    short = sorted(r[0] for r in items.select(F.size("_words").alias("m")).filter(F.col("m") < span).distinct().collect())
    place = F.shiftright("_v", POS_BITS)
    prints = cut(
        winnowed(items, span, k, short)
        # an item short of a window has only its whole gram as fingerprint
        .withColumn("_fps", F.when(F.col("_n") < span, F.slice("_fps", -1, 1)).otherwise(F.col("_fps")))
        # an outer explode: the other kind gives rise to a filter that Spark pushes below, where it
        # writes the arrays' expressions into each other and evaluates them for every element
        .select(F.least("_n", F.lit(span)).alias("m"), F.explode_outer("_fps").alias("_v"))
        .filter("_v IS NOT NULL")
        .select(place.alias("f"), "m")
        .distinct()
    )
    # windows of equal sets of items share a set, so that a passage meets its items once and not window by window
    windows_of = (
        items.select("item", "_words", F.explode_outer(_windows(F.size("_words"), span)).alias("x"))
        .filter("x IS NOT NULL")
        .groupBy(_window_text(F.col("_words"), F.col("x.s"), F.col("x.m")).alias("wt"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    windows_of = written(windows_of.withColumn("g", F.sha2(F.to_json("items"), 256)))
    sets = written(windows_of.select("g", "items").dropDuplicates(["g"]))
    sets = small(sets, rows=sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0], bound=broadcast_rows)
    n_texts, size = windows_of.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("wt")), F.lit(0))).first()
    texts = windows_of.select("wt", "g")
    if n_texts <= broadcast_rows and size <= BROADCAST_BYTES:
        texts = F.broadcast(texts)

    marked = winnowed(keyed(docs, id_col, text_col).withColumn("_words", words(F.col("_text"))), span, k, short)
    exploded = marked.select("_id", "_th", "_n", F.posexplode_outer("_fps").alias("at", "_v")).select(
        "_id", "_th", "_n", "at", place.alias("f"), F.col("_v").bitwiseAND((1 << POS_BITS) - 1).cast("int").alias("p")
    )
    # the first row of each document stays as its header, with or without a hit
    met = cut(
        exploded.join(small(prints, bound=broadcast_rows), "f", "left")
        .filter(F.col("m").isNotNull() | F.coalesce(F.col("at") == 0, F.lit(True)))
        .select("_id", "_th", "_n", "at", "p", "m")
    )
    heads = met.filter(F.coalesce(F.col("at") == 0, F.lit(True))).select("_id", "_th", F.col("_n").cast("long").alias("n_words"))
    spots = (
        met.filter(F.col("m").isNotNull())
        .groupBy("_id", "_th")
        .agg(F.collect_set(F.struct("p", "m")).alias("spots"))
    )
    spots = cut(spots)
    hit_docs = spots.count()

    # extend: the windows that can hold a hit at p start at p - (span - k) .. p
    source = keyed(docs, id_col, text_col)
    found = key_join(source, spots.select("_id", "_th"), "left_semi", hint=hit_docs <= broadcast_rows)
    found = key_join(found, spots).select("_id", "_th", "spots", words(F.col("_text")).alias("_words"))
    n = F.size("_words")
    turn = 1 << POS_BITS

    def starts(x: Column) -> Column:
        at = F.sequence(x["p"], F.greatest(n, x["p"]), F.lit(turn))
        full = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (span - k), F.lit(0)), p)))
        return F.transform(
            F.when(x["m"] == span, full).otherwise(at), lambda s: F.struct(s.alias("s"), x["m"].alias("m"))
        )

    tried = F.filter(
        F.array_distinct(F.flatten(F.transform("spots", starts))), lambda x: (x["s"] + x["m"]) <= n
    )
    windows = found.select("_id", "_th", "_words", tried.alias("tried")).select(
        "_id",
        "_th",
        F.explode_outer(
            F.transform("tried", lambda x: F.struct(x["s"], x["m"], _window_text(F.col("_words"), x["s"], x["m"]).alias("wt")))
        ).alias("x"),
    )
    true_hits = cut(windows.filter("x IS NOT NULL").select("_id", "_th", "x.s", "x.m", "x.wt").join(texts, "wt").drop("wt").distinct())
    spans = true_hits.groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct("s", "m"))).alias("hits"))
    named = (
        true_hits.select("_id", "_th", "g")
        .distinct()
        .join(sets, "g")
        .groupBy("_id", "_th")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    )
    both = key_join(spans, named)
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["s"], x["s"] + x["m"] - 1))))
    )
    both = both.withColumn("n_hit", covered.cast("long"))
    return key_join(heads, both, "left").select(
        "_id",
        "_th",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hits", F.array().cast("array<struct<s:int,m:int>>")).alias("hits"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_items: int = 1, span: int = 8
) -> DataFrame:
    """``docs`` without the documents that hold passages of more than ``max_items`` items; from the texts of
    the others the hit words go, with what lies between them. Documents without hits stay as they are, as do
    null and empty texts; without items all do. Column names may clash with those of ``benchmark``.
    """
    found = decontaminate(docs, benchmark, id_col, text_col, span=span).filter("n_hit > 0").select("_id", "_th", "hits", "item_ids").distinct()
    whole = keyed(docs, id_col, text_col, F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    out = key_join(whole, found, "left").filter(F.col("hits").isNull() | (F.size("item_ids") <= max_items))
    # the pieces of a text in turn: what is between words, then the word
    ends = F.transform("hits", lambda x: x["s"] + x["m"])
    begins = F.transform("hits", lambda x: x["s"])
    pieces = F.regexp_extract_all("_text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    # spans come sorted, so the kept pieces lie between the furthest end so far and the next begin; no more than
    # span * span of them begin less than span words before one, and the others end before it does
    far = span * span
    furthest = lambda i: F.array_max(F.slice(ends, F.greatest(F.lit(1), i - far + 1), F.least(i, F.lit(far))))
    after = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(1), F.size(ends)), furthest))
    upto = F.concat(begins, F.array(F.size("_pieces")))
    left = F.flatten(
        F.zip_with(after, upto, lambda a, b: F.when(b > a, F.slice(F.col("_pieces"), a + 1, b - a)).otherwise(F.array().cast("array<string>")))
    )
    head = F.regexp_extract("_text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    out = out.withColumn("_pieces", F.when(F.col("hits").isNotNull(), pieces))
    text = F.when(F.col("hits").isNull(), F.col("_text")).otherwise(F.concat(head, F.array_join(left, "")))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op2_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, benchmark)
    n_items = F.size("item_ids").cast("long")
    return out.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "n_hit",
        n_items.alias("n_items"),
        sha256_text(F.array_join("item_ids", ",")).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 8) AS m, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') AS wt
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT rid, s, m, array_to_string(w[s:s + m - 1], ' ') AS wt
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lens WHERE len(w) >= m)),
h AS (SELECT DISTINCT dw.rid, dw.s, dw.m, bw.item FROM dw JOIN bw ON dw.wt = bw.wt AND dw.m = bw.m),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
       FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
