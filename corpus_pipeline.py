"""The corpus pipeline: language ID, exact dedup, near dedup, secret redaction, then packing into training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcut.llm import _common as C
from fleetcut.llm.exact_dedup import drop_exact_copies
from fleetcut.llm.language import identify_languages
from fleetcut.llm.minhash import near_groups
from fleetcut.llm.packing import pack_documents
from fleetcut.llm.secrets import redact, scan_secrets

#: No SQL: the stages learn models, draw MinHash signatures and pack; the tests compare them with plain code.
ORACLE_SQL = None


def _only(docs: DataFrame, ids: DataFrame, key: str, keep: bool) -> DataFrame:
    """The rows of docs whose key is in ids (or is not). Rows that a bounded Bloom filter rules out do not shuffle."""
    ids = C.stage(ids.select(F.col(ids.columns[0]).alias("__id")).distinct(), "ids")
    words = C.filter_words(ids.count())
    bloom = C.stage(C.bloom_of(ids.select(F.xxhash64("__id").alias("h")), "h", words), "bloom")
    marked = C.probe(docs, F.xxhash64(F.col(key)), bloom, words, "__maybe")
    some = marked.filter("__maybe").join(ids, F.col(key) == F.col("__id"), "left_semi" if keep else "left_anti").select(*C.columns_of(docs))
    return some if keep else marked.filter(~F.col("__maybe")).select(*C.columns_of(docs)).unionByName(some)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language cannot be told. Rows are told apart by what the verdict reads, not by id, so
    null and repeated ids are safe."""
    key = F.sha2(F.concat_ws("\u0000", F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), 256)
    keyed = docs.withColumn("__key", key)
    out = identify_languages(keyed, declared=F.col("lang"), host=F.col("source"), id_col="__key")
    return _only(keyed, out.filter("not kept").select("doc_id"), "__key", False).select(*C.columns_of(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of 5-word shingle similarity 0.8 or more; rows that share an id are one
    document and stay or go together."""
    return _only(docs, near_groups(docs).filter("not kept").select("doc_id"), "doc_id", False)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a marker; n_chars follows the new text."""
    keyed = docs.withColumn("__key", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = redact(keyed, scan_secrets(keyed, path=F.col("source"), id_col="__key"), id_col="__key").select(*C.columns_of(docs))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the stage before it kept, each result staged as Parquet in the shared folder; what a stage has staged for
    itself goes when its result is there, so a session holds one run of this function's tables at a time."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), C.staged(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = C.stage(docs, name)
            C.sweep(spark, docs, before=before)
    return docs
