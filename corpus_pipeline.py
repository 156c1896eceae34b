"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a frame; all but
the last return the columns of ``documents``. Between stages the rows are written as Parquet to
the shared checkpoint folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.bpe import default_tokenizer, encode_documents
from sedimenta.llm.common import checkpoint_dir, drop_folder, key_join, keyed, scratch
from sedimenta.llm.decontam import clean
from sedimenta.llm.jaccard import near_duplicates
from sedimenta.llm.line_dedup import dedup_lines
from sedimenta.llm.quality import classify


def _with_row(docs: DataFrame) -> DataFrame:
    """(_id, _th, _row): each row under its key."""
    return keyed(docs, "doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row")).drop("_text")


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = classify(docs, labels).select(F.col("doc_id").alias("_id"), "_th", "kept").filter("kept").select("_id", "_th").distinct()
    return key_join(_with_row(docs), kept, "left_semi").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document of which nothing is left goes."""
    out = dedup_lines(docs)
    emptied = (F.col("_n_deleted") > 0) & (F.length(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " "))) == 0)
    return _sized(out.filter(~F.coalesce(emptied, F.lit(False))).select(*docs.columns))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates, once."""
    first = near_duplicates(docs).filter("is_first").select("_id", "_th", "n_rows")
    once = key_join(_with_row(docs), first)
    many = once.filter("n_rows > 1").dropDuplicates(["_id", "_th"])
    return once.filter("n_rows = 1").unionByName(many).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; from the others the hit words are cut."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _sized(clean(docs, benchmark, max_items=1))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and decoded text."""
    return encode_documents(docs, default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]

#: No SQL: the classifier is fitted by Newton steps and the last stage is a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage wrote for itself goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
