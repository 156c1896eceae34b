"""PII by patterns and information-theoretic sanitisation.

Base patterns mark e-mail addresses, IP addresses, card and phone numbers. Each value found is a
protected entity. Words of a document that holds it are terms that may reveal it: over the corpus,
the pointwise mutual information of a term and an entity, log p(e | t) / p(e), is compared with
the entity's own information, -log p(e). A term that carries more than a share ``alpha`` of it
discloses the entity and is generalised wherever it stands in a document that holds the entity.

Frequencies are counted over all documents, whole documents each. As most entities lie in one or
two of them, p(e | t) is shrunk towards p(e) by ``prior`` documents: (n_te + prior p(e)) / (n_t + prior).
p(t) takes a pass that sums words within each batch before the counts meet, p(e) and p(t, e) the
documents with entities, which are few.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, key_join, keyed, sha256_text, small, with_python

KINDS = ["email", "ip", "card", "phone", "term"]
#: Share of an entity's information that a term may carry, and documents that its estimate is shrunk by.
ALPHA, PRIOR = 0.8, 1.0
#: Most frequent terms (and bytes of one) that every executor gets, to leave out pairs early; the result doesn't depend on it.
COMMON_TERMS, COMMON_BYTES = 50_000, 64
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000

# what a pattern can begin with is bounded, so that long runs of digits or letters take linear time
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Leftmost matches in turn: the run before an @, back to the last match, with a domain after it."""
    at = 0
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > at and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        if s < m.start():
            yield 0, s, m.end()
            at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        out += _emails(text)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _value(kind: int, found: str) -> str:
    """An entity's value without its spelling: case of addresses, spaces and signs of numbers."""
    return f"{KINDS[kind]}:" + (found.lower() if kind < 2 else "".join(c for c in found if c.isdigit()))


def words(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans; of documents with any, the text, its entities and its words as well."""
    span = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    for batch in batches:
        base, kept, entities, terms = [], [], [], []
        for text in batch.column("_text").to_pylist():
            spans = base_spans(text or "")
            base.append([dict(zip(("kind", "s", "e"), x)) for x in spans])
            kept.append(text if spans else None)
            entities.append(list({_value(k, text[a:b]) for k, a, b in spans}))
            terms.append(list(words(text)) if spans else [])
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_th"), pa.array(kept, pa.string()), pa.array(base, pa.list_(span)), pa.array(entities, strings), pa.array(terms, strings)],
            ["_id", "_th", "_text", "base", "entities", "terms"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df): documents with the word, summed over batches until more than ``HELD_WORDS`` words are held."""
    count: Counter = Counter()

    def summed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "df"])

    for batch in batches:
        for text in batch.column("_text").to_pylist():
            if text:
                count.update(words(text))
        if len(count) > HELD_WORDS:
            yield summed()
            count.clear()
    yield summed()


def term_spans(text: str, base: list[tuple[int, int]], told: set[str]) -> list[tuple[int, int]]:
    """(start, end) of the words in ``told`` that touch no base span."""
    covered = bytearray(len(text))
    for a, b in base:
        covered[a:b] = b"\1" * (b - a)
    return [m.span() for m in _WORD.finditer(text) if m[0].lower() in told and not any(covered[m.start() : m.end()])]


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans with those of the disclosing terms."""
    span = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    for batch in batches:
        out = []
        for text, base, told in zip(*(batch.column(c).to_pylist() for c in ("_text", "base", "told"))):
            found = term_spans(text, [(x["s"], x["e"]) for x in base], set(told)) if told else []
            every = {(x["kind"], x["s"], x["e"]) for x in base} | {(4, s, e) for s, e in found}
            out.append([dict(zip(("kind", "s", "e"), x)) for x in sorted(every)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_th", "base")), pa.array(out, pa.list_(span))], ["_id", "_th", "base", "spans"])


def sanitise_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``docs``: _id, _th, base and spans (arrays of (kind, s, e), kind 4 for terms).

    A null text is empty. A document listed more than once counts as often in every frequency. An entity that
    all documents hold has no information to disclose; an empty table has no rows.
    """
    with_python(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    source = keyed(docs, id_col, text_col)
    spans = "array<struct<kind:int,s:int,e:int>>"
    scanned = cut(source.mapInArrow(_scan, f"_id {id_type}, _th bigint, _text string, base {spans}, entities array<string>, terms array<string>"))
    n = float(scanned.count())
    p = F.col("n_e") / F.lit(n)

    def tells(n_te: Column) -> Column:
        return (F.col("n_e") < n) & (F.log((n_te + prior * p) / (F.col("n_t") + prior) / p) >= -alpha * F.log(p))

    held = scanned.filter(F.size("base") > 0).select("_id", "_th", F.explode("entities").alias("entity"), "terms")
    entity = small(cut(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))))
    df = cut(source.select("_text").mapInArrow(_frequencies, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("n_t")))
    # a pair with a common term is left out early if it would fail at the largest count it can have
    # which terms are the most frequent is read off counts of bins, so that no task sends more than its part
    octave, room, least = F.floor(F.log2("n_t") * 8), COMMON_TERMS, None
    for b, count in sorted(((r["b"], r["count"]) for r in df.groupBy(octave.alias("b")).count().collect()), reverse=True):
        if count > room:
            break
        room, least = room - count, b
    often = F.lit(False) if least is None else (octave >= least) & (F.octet_length("term") <= COMMON_BYTES)
    common = F.broadcast(df.filter(often).withColumnRenamed("n_t", "n_c"))
    pairs = held.join(entity, "entity").select("_id", "_th", "entity", "n_e", F.explode("terms").alias("term")).join(common, "term", "left")
    pairs = pairs.withColumn("n_t", F.col("n_c")).filter(F.col("n_c").isNull() | tells(F.least("n_e", "n_c"))).select("_id", "_th", "entity", "n_e", "term")
    both = pairs.groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te"))
    told = cut(both.join(df, "term").filter(tells(F.col("n_te"))).select("entity", "term"))
    terms = pairs.join(told, ["entity", "term"], "left_semi")
    terms = terms.groupBy("_id", "_th").agg(F.collect_set("term").alias("told"))
    placed = key_join(scanned.select("_id", "_th", "_text", "base"), terms, "left")
    return placed.mapInArrow(_place, f"_id {id_type}, _th bigint, base {spans}, spans {spans}")


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
            at, made = 0, []
            for s, e, kind in sorted((x["s"], x["e"], x["kind"]) for x in spans or []):
                if s >= at:
                    made += [text[at:s], f"[{KINDS[kind].upper()}]"]
                    at = e
            out.append(None if text is None else "".join([*made, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(out, pa.string())], ["_id", "_th", "text"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(_id, _th, text): each document with its entities and disclosing terms generalised to their kind."""
    spans = sanitise_scan(docs, id_col, text_col, **options).select("_id", "_th", "spans").dropDuplicates(["_id", "_th"])
    id_type = docs.schema[id_col].dataType.simpleString()
    return key_join(keyed(docs, id_col, text_col), spans).mapInArrow(_mask, f"_id {id_type}, _th bigint, text string")


def joined(spans: Column) -> Column:
    label = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(label, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def op8_information_sanitisation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def n(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return sanitise_scan(docs).select(
        F.col("_id").alias("doc_id"), *map(n, range(4)), sha256_text(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
