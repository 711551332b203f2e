"""Helpers shared by the training-data operators: staging, bounded Bloom filters, skew-safe lookups, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast of hot keys can have at most; a key of more rows than HOT_ROWS is hot unless that makes too many.
HOT_KEYS, HOT_ROWS = 100_000, 1_000_000
#: 64-bit words of a broadcast Bloom filter at most (32 MiB); a fuller filter only lets more rows through.
MAX_WORDS = 1 << 22
_CHUNK = 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one is set only where that is unset and all tasks run in this process's JVM."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_fleetcut_scratch", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._fleetcut_scratch = path
    return path.rstrip("/")


def columns_of(df: DataFrame) -> list[Column]:
    """Its columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def stage(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors lose nothing. codec: of the files, if not the session's."""
    path = f"{_session_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fleetcut_path = path
    return out


def _session_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/fleetcut-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(spark: SparkSession) -> set[str]:
    """The names of the tables that this application has staged."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in fs.listStatus(p)} if fs.exists(p) else set()


def sweep(spark: SparkSession, *keep: DataFrame, before: set[str] = frozenset()) -> None:
    """Remove what this application has staged but for the tables to keep and those that were there before (names that staged() gave).
    Call it when no other result of an operator that ran since will be read."""
    for name in staged(spark) - before - {os.path.basename(df._fleetcut_path) for df in keep}:
        _remove(spark, f"{_session_dir(spark)}/{name}")


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch to a Python worker, besides its rows: long texts would make batches of any size, of which the JVM
    and the worker each hold several. A lower limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(key, str(limit))


def slices(batch, text: int = 1, rows: int = 512, limit: int = 1 << 20):
    """An Arrow batch in slices of at most `rows` rows and `limit` bytes of text (column number `text`), or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + limit, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def trim() -> None:
    """Give a Python worker's freed memory back at the end of a task; workers live on and share an executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no table refers to any more; else they stay until the driver happens to collect its garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "_fleetcut_path", None)
    if path:
        _remove(df.sparkSession, path)


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words))


def _mask(h: Column) -> Column:
    """Three bits of a word, from bits of the hash that do not choose the word."""
    one = F.lit(1).cast("bigint")
    bits = [F.shiftrightunsigned(F.xxhash64(h), s).bitwiseAND(F.lit(63)).cast("int") for s in (0, 6, 12)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", one, b) for b in bits])


def filter_words(n_keys: int, bits_per_key: int = 16) -> int:
    """64-bit words of a filter for n_keys, at most MAX_WORDS or what the session's spark.fleetcut.bloom.words says."""
    session = SparkSession.getActiveSession()
    most = int(session.conf.get("spark.fleetcut.bloom.words", str(MAX_WORDS))) if session else MAX_WORDS
    need = max(1, n_keys * bits_per_key // 64)
    return min(most, 1 << max(10, (need - 1).bit_length()))


def _pack(cells: DataFrame) -> DataFrame:
    """Cells (w, m) to a table of at most MAX_WORDS / 1024 rows, each with a dense array of 1024 words."""
    words = cells.groupBy("w").agg(F.bit_or("m").alias("m"))
    entries = words.groupBy((F.col("w") / _CHUNK).cast("bigint").alias("chunk")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("w") % _CHUNK).cast("int").alias("i"), "m"))).alias("e")
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(_CHUNK - 1)), lambda i: F.coalesce(F.col("e")[i], F.lit(0).cast("bigint")))
    return entries.select("chunk", dense.alias("bits"))


def bloom_of(keys: DataFrame, h: str, words: int) -> DataFrame:
    """Bloom filter of the hashes in column h."""
    return _pack(keys.select(_word(F.col(h), words).alias("w"), _mask(F.col(h)).alias("m")))


def bloom_of_repeated(keys: DataFrame, h: str, words: int) -> DataFrame:
    """Second-pass Bloom filter: the cells that a counting pass saw twice. Counts combine before they shuffle."""
    cells = keys.select(_word(F.col(h), words).alias("w"), _mask(F.col(h)).alias("m"))
    seen = cells.groupBy("w", "m").agg(F.count(F.lit(1)).alias("n"))
    return _pack(seen.filter("n > 1").select("w", "m"))


def probe(df: DataFrame, h: Column, bloom: DataFrame, words: int, flag: str) -> DataFrame:
    """Add boolean flag: false means that the hash surely is not in the filter. Nothing shuffles."""
    bits = F.broadcast(bloom.select(F.col("chunk").alias("__chunk"), F.col("bits").alias("__bits")))
    keyed = df.withColumn("__h", h).withColumn("__chunk", (_word(F.col("__h"), words) / _CHUNK).cast("bigint"))
    mask = _mask(F.col("__h"))
    word = F.col("__bits")[(_word(F.col("__h"), words) % _CHUNK).cast("int")]
    hit = F.coalesce(word.bitwiseAND(mask) == mask, F.lit(False))
    return keyed.join(bits, "__chunk", "left").withColumn(flag, hit).drop("__chunk", "__bits", "__h")


def hot_limit(total: int) -> int:
    """Rows beyond which a key is hot: a thousandth of all, a million at most, but never so few that more than HOT_KEYS keys are hot."""
    return max(1000, min(total // 1000, HOT_ROWS), total // HOT_KEYS)


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner", most: int = HOT_KEYS, small: Column | None = None) -> DataFrame:
    """Join rows to a table unique by key. count: its column with the rows that each key has. Keys with over hot_limit(total)
    rows (`most` at most) come by broadcast, where they do not shuffle; the rest, and those that are not small, by a shuffle."""
    limit = max(hot_limit(total), total // most)
    is_hot = F.coalesce((F.col(count) > limit) & (small if small is not None else F.lit(True)), F.lit(False))
    mine = [c for c in table.columns if c != key]
    hot = table.filter(is_hot).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__hot_{c}") for c in mine])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left")
    known = marked.filter(F.col("__k").isNotNull()).select(key, *[c for c in rows.columns if c != key], *[F.col(f"__hot_{c}").alias(c) for c in mine])
    rest = marked.filter(F.col("__k").isNull()).select(*rows.columns)
    return known.unionByName(rest.join(table.filter(~is_hot), key, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of distinct edges: (id, comp), comp the smallest id reachable. Each round maps every
    vertex to its smallest neighbour (twice), renames the edges and drops loops, so hubs vanish in the first round."""
    e = stage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        ends = e.select(F.col("b").alias("v"), F.col("a").alias("u")).unionByName(e.select(F.col("a").alias("v"), F.col("b").alias("u")))
        p = stage(ends.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")), "parents")
        q = p.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        hop = stage(p.join(q, "p").select("v", F.col("pp").alias("p")), "hops")
        if labels is None:
            labels = hop.select(F.col("v").alias("id"), F.col("p").alias("comp"))
        else:
            old, labels = labels, stage(
                labels.join(hop.withColumnRenamed("v", "comp"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "labels"
            )
            unstage(old)
        moved = hop.filter("v <> p")
        renamed = (
            e.join(moved.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a", "left")
            .join(moved.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b", "left")
            .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        )
        nxt = stage(renamed.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        unstage(e)
        unstage(p)
        e = nxt
    if labels is None:
        labels = e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return labels


def clean(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns cannot clash with its own names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)
