"""Exact dedup by two-pass Bloom filtering; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcut.llm import _common as C


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Single spaces are left alone, which is faster."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Pass one counts the cells (word, mask) of a Bloom filter, combined in each task before they shuffle: a cell of each row at
    most, without text, hash or id. Pass two probes a filter of the cells seen twice. Only rows that it flags shuffle, as
    (id, hash); all others pass straight through as groups of one.
    Null text counts as empty. The smallest id stays; a null id sorts last; of rows that repeat an id, one stays.
    An empty table gives no rows. Other columns are ignored.
    """
    hashed = C.stage(
        C.clean(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha"))
        .withColumn("rid", F.monotonically_increasing_id()), "hashes",
    )
    total = hashed.count()
    words = C.filter_words(total)
    h = F.xxhash64("sha")
    bloom = C.bloom_of_repeated(hashed.select(h.alias("h")), "h", words)
    flagged = C.stage(C.probe(hashed, h, bloom, words, "maybe"), "flagged")
    alone = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    rows = flagged.filter("maybe").select("doc_id", "rid", "sha")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    groups = C.stage(rows.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    together = C.lookup(rows, groups, "sha", "group_size", total).select(
        "doc_id", F.col("first.d").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.r")).alias("kept"), "sha"
    )
    return alone.unionByName(together).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without later copies, all columns kept.

    Rows that the filter does not flag pass straight through with their texts; flagged ones shuffle once, after each
    task has kept one row of every group it saw, so a group of any size costs a row per task.
    """
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    h = F.xxhash64(sha)
    total = docs.count()
    words = C.filter_words(total)
    bloom = C.stage(C.bloom_of_repeated(docs.select(h.alias("h")), "h", words), "bloom")
    row = F.struct(*C.columns_of(docs)).alias("__row")
    packed = docs.select(row, sha.alias("__sha"), F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("d")).alias("__order"))
    marked = C.probe(packed, F.xxhash64("__sha"), bloom, words, "__maybe")
    alone = marked.filter(~F.col("__maybe")).select("__row")
    firsts = marked.filter("__maybe").groupBy("__sha").agg(F.min_by("__row", "__order").alias("__row")).select("__row")
    return alone.unionByName(firsts).select("__row.*")
