"""Each stage of the pipeline against plain code, text by text, and its edges."""

import hashlib
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_decontam, brute_lines, words_of

from sedimenta.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, each from the written rows before."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    assert all(s.columns == stages[0].columns and s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[:5])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_quality_keeps_what_the_classifier_keeps(spark, stages):
    judged = quality.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    before = texts(stages[0])
    assert texts(stages[1]) == {r["doc_id"]: before[r["doc_id"]] for r in judged if r["kept"]}
    bad = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()]
    assert sum(i in texts(stages[1]) for i in bad) <= 0.1 * len(bad)


def test_lines_equal_brute_force(stages):
    before = texts(stages[1])
    want = brute_lines(list(before.items()), 20)
    assert texts(stages[2]) == {i: t for i, t in want.items() if t == before[i] or t.strip()}


def test_one_document_of_each_class_stays(stages):
    docs = texts(stages[2])
    sets = {i: set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else {tuple(w)} - {()} for i, t in docs.items() for w in [re.findall(r"[^\W_]+", t.lower())]}
    label = {i: i for i in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    assert texts(stages[3]) == {i: docs[i] for i in docs if find(i) == i}


def test_decontamination_equals_brute_force(spark, stages):
    docs = texts(stages[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {i: (n, ids) for i, _, n, ids in brute_decontam(list(docs.items()), items)}
    got = texts(stages[4])
    assert set(got) == {i for i in docs if len(found[i][1]) < 2}
    for i, t in got.items():
        assert (t == docs[i]) if not found[i][0] else len(words_of(t)) == len(words_of(docs[i])) - found[i][0]


def test_encoding_equals_the_library(stages):
    docs, tok = texts(stages[4]), bpe.TreeEncoder(bpe.default_tokenizer()).tok
    rows = stages[5].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_run_leaves_its_result_alone(spark, stages):
    spark.conf.get("spark.checkpoint.dir", None)
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[5].collect()))


def test_nulls_repeated_rows_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(docs.limit(5)).unionByName(odd)
    for c in ("_row", "hits", "kept", "_th", "r"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count(), name
        assert name.startswith("BPE") or (out.columns == docs.columns and out.filter("hits <> 'clash' OR _row <> 'clash'").isEmpty()), name
    once = corpus_pipeline.near_duplicate_join(spark, docs, SF)
    assert once.count() == once.select("doc_id", "text").distinct().count()


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    few = docs.limit(10)
    assert texts(corpus_pipeline.decontamination(spark, few, str(tmp_path))) == texts(few)
    assert corpus_pipeline.quality(spark, few, str(tmp_path)).count() in (0, 10)
