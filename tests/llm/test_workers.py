"""What Python workers hold at once: batches of bounded bytes, and no memory that is free."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sedimenta.llm import bpe, common, pii


def test_batches_are_bounded_by_bytes_and_pools_keep_nothing(spark):
    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes]), pa.array([pa.default_memory_pool().backend_name])], ["n", "bytes", "pool"])

    common.with_python(spark)
    rows = spark.range(0, 2000, 1, 1).select(F.expr("repeat('x', if(id = 7, 6000000, 10000))").alias("text"))
    got = rows.mapInArrow(held, "n long, bytes long, pool string").collect()
    assert sum(r["n"] for r in got) == 2000
    assert sum(r["bytes"] > 1.1 * common.BATCH_BYTES for r in got) == 1  # the long row's; else all 26 MB are one batch
    assert {r["pool"] for r in got} == {"system"}


def test_what_the_session_says_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    common.with_python(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, "1000000")
    common.with_python(spark)
    assert spark.conf.get(key) == "1000000"
    spark.conf.set(key, before)


def test_terms_are_summed_over_batches():
    part = pa.RecordBatch.from_arrays([pa.array(["alpha beta", None, "alpha"])], ["_text"])
    rows = [r for b in pii._frequencies(iter([part, part])) for r in b.to_pylist()]
    assert sorted((r["term"], r["df"]) for r in rows) == [("alpha", 4), ("beta", 2)]


def test_long_texts_over_many_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, " ".join(f"word{j * i % 97}é" for j in range(40 * i))) for i in range(60)], "doc_id long, text string")
    run = lambda: sorted(map(str, bpe.encode_documents(docs, bpe.default_tokenizer(), leaf_chars=500).collect()))
    common.with_python(spark)
    want, before = run(), spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        assert run() == want
    finally:
        spark.conf.set(key, before)


def test_few_files_for_digests(spark, tmp_path):
    """A writer may start a process for each file, so tasks that encode don't write one each."""
    texts = {i: " ".join(f"word{i * j % 89}é" for j in range(30 * i)) for i in range(1, 100, 9)}
    assert max(map(len, texts.values())) > bpe.LEAF_CHARS
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    bpe.op3_bpe_tree(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    tok, sha = bpe.TreeEncoder(bpe.default_tokenizer()).tok, lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(i, len(ids := tok.encode(t, add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(t)) for i, t in texts.items()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_ids_of_any_vocabulary_between_tasks(tmp_path):
    from tokenizers import Tokenizer, models

    for n, size in ((1 << 16, 2), (70_000, 4)):
        Tokenizer(models.WordLevel({f"w{i}": i for i in range(n)}, unk_token="w0")).save(path := f"{tmp_path}/{n}.json")
        enc, ids = bpe.TreeEncoder(path), np.array([0, 1, 65_535, n - 1], dtype=np.int32)
        assert len(enc.packed(ids)) == size * len(ids)
        assert enc.unpacked(enc.packed(ids)).tolist() == ids.tolist()
        assert enc.unpacked(enc.packed(ids[:0])).tolist() == []
