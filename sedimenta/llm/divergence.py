"""Quality rules by distribution divergence.

Each language has a reference: the mean histogram of character classes and of common words over all its
documents that pass the base rules. The mean is taken twice, the second time over the half of the documents
that is nearest to the first. A document is kept if the Jensen-Shannon distances of its own histograms to those
of its language are within limits.

Limits come from the distances themselves. A histogram of n observations lies about c / n from what it was drawn
from (squared distance), so n times the square is alike for short and long texts; per language its median and its
lower tenth, which junk doesn't reach, give a level and a spread. A document may lie ``Z`` spreads above the level, besides
a floor for what documents differ by beyond chance. A short text thus has a wider limit, as its histogram is noisy;
below a minimum of words none, and a language with few documents has no reference and gives no verdict.
Quantiles are read off counts of bins, so nothing grows with a language's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, small, with_python
from sedimenta.llm.textstats import CLASSES, COMMON, N_COMMON, counts

MIN_WORDS = 50
#: Documents that a language's reference needs.
MIN_DOCS = 20
#: What the two distances of a long document may come to, and spreads above the level that chance may account for.
CLASS_FLOOR, WORD_FLOOR, Z = 0.18, 0.10, 6.0
#: Bins of a distance, and of a doubling of the scaled square of one. Spread of a normal distribution below its median.
STEPS, OCTAVE, TENTH = 4096, 32, 1.2816

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [
            counts(t or "", lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
        ]
        cols = [pa.array([m[c] for m in made], pa.int64()) for c in _COUNTS]
        hists = [pa.array([m[c] for m in made], pa.list_(pa.int64())) for c in ("classes", "common")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *cols, *hists], ["doc_id", "lang", *_COUNTS, "classes", "common"])


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays that each sum to 1."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        one = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (one(a) + one(b)) / 2

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.sqrt(total)).when(total <= 0, 0.0)


def _share(c: str) -> Column:
    total = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total > 0, F.transform(c, lambda x: x / total))


def _bin(x: Column) -> Column:
    """Bins of a positive number, ``OCTAVE`` for each doubling."""
    return F.floor(F.log2(F.greatest(x, F.lit(1e-9))) * OCTAVE)


def _quantiles(rows: DataFrame, value: Column, names: dict[str, float]) -> DataFrame:
    """By language, the bin in which each quantile falls; the window runs over bins, not rows."""
    bins = rows.filter(value.isNotNull()).groupBy("lang", value.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    so_far, whole = Window.partitionBy("lang").orderBy("b"), Window.partitionBy("lang")
    bins = bins.withColumn("up", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(whole))
    return bins.groupBy("lang").agg(*[F.min(F.when(F.col("up") >= q * F.col("all"), F.col("b"))).alias(name) for name, q in names.items()])


def divergence_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = MIN_WORDS,
    min_docs: int = MIN_DOCS,
    class_floor: float = CLASS_FLOOR,
    word_floor: float = WORD_FLOOR,
    z: float = Z,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, class_js, word_js, class_far, word_far, kept.

    A null text has no words and fails the base rules; an empty table has no rows. A null language is the language ''.
    A language without a list of common words has no word_js, one of fewer than ``min_docs`` documents neither distance,
    and what isn't there isn't far. Distances in the median's bin count as near. Repeated rows each get the row's result and
    each count in references; null ids are carried. Other columns of ``docs`` aren't read, so their names may clash.
    """
    with_python(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text")
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, lang string, {', '.join(f'{c} bigint' for c in _COUNTS)}, classes array<bigint>, common array<bigint>"
    measured = rows.mapInArrow(_measure, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut(measured.withColumn("base_failed", failed).withColumn("p", _share("classes")).withColumn("w", _share("common")).drop("classes", "common"))

    def mean(c: str, n: int) -> Column:
        return F.array(*[F.coalesce(F.avg(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)])

    def against(chosen: DataFrame) -> DataFrame:
        references = (
            chosen.groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n"), mean("p", len(CLASSES)).alias("ref_p"), mean("w", N_COMMON + 1).alias("ref_w"))
            .filter(F.col("n") >= min_docs)
            .drop("n")
        )
        return (
            measured.join(small(cut(references)), "lang", "left")
            .withColumn("class_js", js_distance(F.col("p"), F.col("ref_p")))
            .withColumn("word_js", js_distance(F.col("w"), F.col("ref_w")))
        )

    first = against(measured.filter("NOT base_failed")).filter("NOT base_failed")
    near = F.floor(F.col("class_js") * STEPS)
    middle = cut(_quantiles(first, near, {"middle": 0.5}))
    joined = against(first.join(small(middle), "lang").filter(near <= F.col("middle")))

    # by how much n times the squared distance may exceed its language's level
    class_t, word_t = F.pow("class_js", 2) * F.col("word_chars"), F.pow("word_js", 2) * F.col("n_words")
    passed = joined.filter("NOT base_failed")
    limits = _quantiles(passed, _bin(class_t), {"cm": 0.5, "cl": 0.1}).join(_quantiles(passed, _bin(word_t), {"wm": 0.5, "wl": 0.1}), "lang", "left")
    edge = lambda b: F.pow(F.lit(2.0), (F.col(b) + 1) / OCTAVE)
    level = lambda m, low: edge(m) + z / TENTH * (edge(m) - edge(low))
    limits = cut(limits.select("lang", level("cm", "cl").alias("class_level"), level("wm", "wl").alias("word_level")))
    judged = joined.join(small(limits), "lang", "left")
    far = lambda t, n, floor, top: F.coalesce(t > floor * floor * F.col(n) + F.col(top), F.lit(False))
    judged = judged.withColumn("class_far", far(class_t, "word_chars", class_floor, "class_level"))
    judged = judged.withColumn("word_far", far(word_t, "n_words", word_floor, "word_level"))
    kept = ~F.col("base_failed") & ~F.col("class_far") & ~F.col("word_far")
    return judged.select("doc_id", *_COUNTS, "base_failed", "class_js", "word_js", "class_far", "word_far", kept.alias("kept"))


def op1_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return divergence_rules(docs).select("doc_id", *_COUNTS, "base_failed", "kept", "class_far", "word_far")


def _sql_js(p: str, q: str) -> str:
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    both = f"({part.format(x='z[1]')} + {part.format(x='z[2]')}) / 2"
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {both}))))"


def _sql_mean(name: str, source: str, where: str) -> str:
    """References of a round: mean histograms by language."""

    def one(c: str) -> str:
        return f"""(SELECT lang, list(m ORDER BY i) AS ref_{c} FROM (SELECT lang, i, avg(v) AS m FROM (
    SELECT lang, unnest({c}) AS v, unnest(range(len({c}))) AS i FROM {source} WHERE {where}) GROUP BY lang, i) GROUP BY lang)"""

    return f"""{name} AS (SELECT n.lang, ref_p, ref_w FROM (SELECT lang FROM {source} WHERE {where} GROUP BY lang HAVING count(*) >= {MIN_DOCS}) n
  LEFT JOIN {one('p')} USING (lang) LEFT JOIN {one('w')} USING (lang))"""


def _sql_quantiles(source: str, value: str, names: dict[str, float]) -> str:
    picked = ", ".join(f"min(CASE WHEN up >= {q} * al THEN b END) AS {name}" for name, q in names.items())
    return f"""(SELECT lang, {picked} FROM (SELECT lang, b, sum(n) OVER (PARTITION BY lang ORDER BY b) AS up, sum(n) OVER (PARTITION BY lang) AS al
    FROM (SELECT lang, {value} AS b, count(*) AS n FROM {source} GROUP BY ALL) WHERE b IS NOT NULL) GROUP BY lang)"""


def _sql_bin(t: str) -> str:
    return f"floor(log2(greatest({t}, 1e-9)) * {OCTAVE})"


def _sql_level(m: str, low: str) -> str:
    edge = f"pow(2.0, ({{}} + 1) / {OCTAVE})"
    return f"{edge.format(m)} + {Z} / {TENTH} * ({edge.format(m)} - {edge.format(low)})"


_LISTS = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON.items())

OP1_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  [len(regexp_replace(t, '[^' || k || ']', '', 'g')) FOR k IN ['a-z', 'A-Z', '0-9', '\x20\x09-\x0D', '#*$%&|<>']] AS c5,
  len(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS wide FROM t),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w3) AS n FROM (
  SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS w3 FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM a))),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY rid),
b AS (SELECT a.*, len(ws) AS n_words, len(t) - c5[4] AS word_chars, c5[5] AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, list_concat(c5, [len(t) - list_sum(c5) - wide, wide]) AS c, CASE lang {_LISTS} END AS common,
  list_transform(list_filter(ws, lambda x: strlen(x) < 16), lambda x: translate(trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM a LEFT JOIN rep USING (rid)),
k AS (SELECT *, list_transform(common, lambda x: len(list_filter(s, lambda y: y = x))) AS cw,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
m AS (SELECT *, CASE WHEN len(t) > 0 THEN list_transform(c, lambda x: x / len(t)::DOUBLE) END AS p,
  CASE WHEN n_words > 0 AND common IS NOT NULL THEN
    list_transform(list_append(cw, n_words - list_sum(cw)), lambda x: x / n_words::DOUBLE) END AS w FROM k),
{_sql_mean('r1', 'm', 'NOT base_failed')},
d1 AS (SELECT m.*, {_sql_js('p', 'ref_p')} AS js FROM m LEFT JOIN r1 USING (lang) WHERE NOT base_failed),
near AS (SELECT d1.* FROM d1 JOIN {_sql_quantiles("d1", f"floor(js * {STEPS})", {"middle": 0.5})} USING (lang) WHERE floor(js * {STEPS}) <= middle),
{_sql_mean('r2', 'near', 'TRUE')},
d2 AS (SELECT m.*, pow({_sql_js('p', 'ref_p')}, 2) * word_chars AS ct, pow({_sql_js('w', 'ref_w')}, 2) * n_words AS wt FROM m LEFT JOIN r2 USING (lang)),
ok AS (SELECT * FROM d2 WHERE NOT base_failed),
lim AS (SELECT c.lang, {_sql_level("cm", "cl")} AS class_level, {_sql_level("wm", "wl")} AS word_level
  FROM {_sql_quantiles("ok", _sql_bin("ct"), {"cm": 0.5, "cl": 0.1})} c LEFT JOIN {_sql_quantiles("ok", _sql_bin("wt"), {"wm": 0.5, "wl": 0.1})} w ON c.lang = w.lang),
v AS (SELECT d2.*, coalesce(ct > {CLASS_FLOOR} * {CLASS_FLOOR} * word_chars + class_level, FALSE) AS class_far,
  coalesce(wt > {WORD_FLOOR} * {WORD_FLOOR} * n_words + word_level, FALSE) AS word_far FROM d2 LEFT JOIN lim USING (lang))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT class_far AND NOT word_far AS kept, class_far, word_far
FROM v
"""
