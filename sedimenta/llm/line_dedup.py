"""Line dedup over a suffix array of line ids, built by distributed prefix doubling.

A text is a sequence of lines; lines without a word are no part of it. Its suffixes are the positions of its
lines. Level 0 ranks positions by line; level k + 1 sorts the pairs (rank of the first 2^k lines, rank of the
next 2^k lines), so a rank orders the suffixes by their first 2^(k+1) lines. Sorting is by range partitions
over the *distinct* pairs that occur twice or more: a line that fills a third of the corpus is one key
there, and a position whose pair occurs once leaves the doubling.

A run counts if it has at least ``min_words`` words; it is a later copy if an equal run stands at an earlier place
(by id, then position), and a line goes if it lies in a later copy. The longest later copy from each position need
not be known for that: it is covered by its *shortest* runs, those that lose a word too many with either their first
or their last line (proof: from a line on, or up to it, or on both sides of it, a shortest run of the copy contains it,
and a part of a later copy is a later copy, of the same earlier one). There are at most two of them a line, of
``min_words`` lines at most, as each line has a word. The suffixes that agree on a shortest run form one interval of
the suffix array with that common prefix, which two overlapping ranks of the highest level that fits name. The
first suffix of an interval stays; the runs of the others go, joined to the maximal repeated runs that they cover.
A deleted line thus always has an equal line at an earlier place, and the earliest of equal lines is never deleted.

Only DataFrame functions are used. Ranks are written to the checkpoint folder level by level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, small, written

KEY = ["_id", "_th"]

#: White space, and scripts that are written without it, of which each character counts as a word.
_BLANK = r"\x09-\x0D\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_DENSE = (
    r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
)
WORD = rf"[{_DENSE}]|[^\x20{_BLANK}{_DENSE}]+"
#: What the plain count of single spaces would get wrong.
_ODD = rf"\x20\x20|[{_BLANK}{_DENSE}]"


def _plain_key(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """Row keys without nulls: a null id becomes its type's zero and marks the hash instead."""
    kind = docs.schema[id_col].dataType
    zero = F.lit("0").cast(kind)
    return docs.select(
        F.coalesce(F.col(id_col), zero).alias("_id"),
        F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("_th"),
        F.col(text_col).alias("_text"),
        *extra,
    )


def _weight(line: Column) -> Column:
    """Words of a line: runs without white space, and single characters of scripts without spaces."""
    t = F.trim(line)
    spaces = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(line.rlike(_ODD), F.regexp_count(line, F.lit(WORD))).when(F.octet_length(t) == 0, 0).otherwise(spaces + 1)


def _ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct keys with ``r``, which grows in their sorted order."""
    return cut(
        keys.repartitionByRange(*cols).sortWithinPartitions(*cols).select(*cols, F.monotonically_increasing_id().alias("r"))
    )


def _twice(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*cols)


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(_id, _th, i, h1, h2, need, most, multi): one row per line with a word.

    The shortest runs from line i have ``need`` to ``most`` lines; null if what follows has too few words.
    ``multi`` is set where the line can lie in a run of several lines.
    """
    lines = F.transform(
        F.split("_text", "\n"),
        lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.least(_weight(x), F.lit(min_words)).alias("w")),
    )
    rows = _plain_key(docs, id_col, text_col).select(*KEY, F.filter(lines, lambda x: x["w"] > 0).alias("ls"))
    rows = rows.withColumn("ws", F.transform("ls", lambda x: x["w"]))

    def need(w: Column, i: Column) -> Column:
        """Lines from i that hold enough words; each has one, so no more than ``min_words`` are looked at."""
        walk = F.aggregate(
            F.slice("ws", i + 1, min_words),
            F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")),
            lambda a, x: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))),
        )
        return F.when(w >= min_words, 1).otherwise(F.transform(F.array(walk), lambda a: F.when(a["s"] >= min_words, a["n"]))[0])

    rows = rows.withColumn("needs", F.transform("ws", need))

    def packed(x: Column, i: Column) -> Column:
        own = F.get("needs", i)
        light = F.least(x["w"], F.get("ws", i - 1), F.get("ws", i + 1)) < min_words
        return F.struct(
            i.alias("i"), x["h1"], x["h2"], own.alias("need"),
            F.when(own.isNotNull(), F.greatest(own, F.coalesce(F.get("needs", i + 1), F.size("ws") - i))).alias("most"), light.alias("multi"),
        )

    # outer, as the other kind makes Spark filter on the arrays below, where it evaluates them once more
    return rows.select(*KEY, F.inline_outer(F.transform("ls", packed))).filter("i IS NOT NULL")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """(_id, _th, s, e): merged half-open intervals to delete, in lines that have a word."""
    rows = cut(lines_of(docs, id_col, text_col, min_words))
    base = rows.join(small(_ranked(_twice(rows, "h1", "h2"), "h1", "h2")), ["h1", "h2"]).select(*KEY, "i", "need", "most", "multi", "r")
    base = cut(base.dropDuplicates([*KEY, "i"]))  # a document may be listed more than once
    longest = base.agg(F.max("most")).first()[0] or 0

    # intervals of runs of one line, then level by level those of 2^k to 2^(k+1) - 1
    runs = [base.filter("need = 1").select(*KEY, F.col("i").alias("s"), F.lit(1).alias("m"), F.col("r").alias("a"), F.col("r").alias("b"))]
    level, size = base.filter("multi"), 1
    by_doc = Window.partitionBy(*KEY).orderBy("i")
    while longest >= 2 * size:
        pairs = level.withColumn("b", F.first("r").over(by_doc.rangeBetween(size, size))).withColumnRenamed("r", "a").filter("b IS NOT NULL")
        pairs = cut(pairs)
        ranks = small(_ranked(_twice(pairs, "a", "b"), "a", "b"))
        level = pairs.join(ranks, ["a", "b"]).drop("a", "b")
        size *= 2
        near = F.collect_list(F.struct("i", "r")).over(by_doc.rangeBetween(0, min(longest, 2 * size - 1) - size))
        level = cut(level.withColumn("near", near))
        lengths = F.sequence(F.greatest("need", F.lit(size)), F.least("most", F.lit(2 * size - 1)))
        found = level.filter((F.col("most") >= size) & (F.col("need") < 2 * size)).withColumn("m", F.explode(lengths))
        end = F.get(F.filter("near", lambda x: x["i"] == F.col("i") + F.col("m") - size), F.lit(0))
        runs.append(found.select(*KEY, F.col("i").alias("s"), "m", F.col("r").alias("a"), end["r"].alias("b")).filter("b IS NOT NULL"))
        level = level.drop("near")

    members = reduce(DataFrame.unionByName, runs)
    interval, place = ["m", "a", "b"], F.struct(*KEY, "s")
    firsts = members.groupBy(*interval).agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    later = members.join(small(written(firsts)), interval).filter(place != F.col("f")).select(*KEY, "s", (F.col("s") + F.col("m")).alias("e"))

    in_doc = Window.partitionBy(*KEY).orderBy("s", "e")
    reach = F.max("e").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("s") <= reach, 0).otherwise(1)
    return (
        later.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("island")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, broadcast_rows: int = 100_000
) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text_col``, and _n_lines, _n_deleted (long).

    Columns of ``docs`` that have the names of the two counts give way to them; other names may clash freely.

    A run must hold ``min_words`` words. Lines without a word are no part of a run: they go where the next lines
    with a word on both sides go. A null text stays null and has no lines; an empty one has one line. An empty table has no rows.
    Rows that agree in id and text are one document: each gets the same result. A null id comes first.
    """
    names = docs.columns
    gone = written(repeated_runs(docs, id_col, text_col, min_words).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_gone")))
    n_gone = gone.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if n_gone <= broadcast_rows else gone.hint("shuffle_hash")
    whole = _plain_key(docs, id_col, text_col, F.struct(*[F.col(c) for c in names]).alias("_row"))
    left = whole.join(gone, KEY, "left").withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("_text", "\n")))
    # from lines with a word to all lines
    spoken = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(rf"[^\x20{_BLANK}]"), i)), lambda i: i.isNotNull())
    left = left.withColumn("_at", F.when(F.col("_gone").isNotNull(), spoken))
    bounds = F.transform("_gone", lambda x: F.struct(F.get("_at", x["s"]).alias("s"), (F.get("_at", x["e"] - 1) + 1).alias("e")))
    left = left.withColumn("_cuts", bounds)
    cuts = F.col("_cuts")
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["e"]))
    ends = F.concat(F.transform(cuts, lambda x: x["s"]), F.array(F.size("_lines")))
    parts = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("_lines"), a + 1, b - a)))
    text = F.when(cuts.isNull(), F.col("_text")).otherwise(F.array_join(parts, "\n"))
    deleted = F.aggregate(cuts, F.lit(0), lambda a, x: a + x["e"] - x["s"])
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)
    return left.select(
        *[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names if c not in ("_n_lines", "_n_deleted")],
        n_lines.cast("long").alias("_n_lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("_n_deleted"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), "text"
    )


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM w WHERE w > 0),
r AS (SELECT a.doc_id, a.j, b.j AS k FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + 19
  WHERE b.c - a.c + a.w >= 20 AND (b.c - a.c + a.w - b.w < 20 OR b.c - a.c < 20)),
t AS (SELECT doc_id, list(line ORDER BY j) AS s FROM c GROUP BY doc_id),
k AS (SELECT r.doc_id, j, k, array_to_string(s[j:k], chr(10)) AS run FROM r JOIN t USING (doc_id)),
f AS (SELECT run, min(struct_pack(a := doc_id, b := j)) AS f FROM k GROUP BY run),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT k.doc_id, unnest(range(k.j, k.k + 1)) AS j FROM k JOIN f USING (run)
  WHERE k.doc_id <> f.f.a OR k.j <> f.f.b)),
x AS (SELECT c.doc_id, c.j, c.i FROM g JOIN c ON c.doc_id = g.doc_id AND c.j = g.j),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(x.i, coalesce(y.i, x.i + 1))) AS p
  FROM x LEFT JOIN x y ON y.doc_id = x.doc_id AND y.j = x.j + 1)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l
  LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = l.i WHERE gone.p IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT o.doc_id, CAST(coalesce(len(string_split(o.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_deleted,
  CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents o LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
