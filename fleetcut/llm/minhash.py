"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.llm import _common as C
from fleetcut.llm.words import WordHashes, mix, shingles

#: Bands of rows each: sets of similarity 0.8 share no bucket with chance (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, ROWS = 40, 6
_TRIES = 1024
#: Documents of a block and of a chunk of a bucket, about.
BLOCK, CHUNK = 128, 128


@lru_cache(4)
def _donors(bins: int) -> np.ndarray:
    """donors[t, i]: the bin that empty bin i asks at its try t, drawn uniformly and independently."""
    t, i = np.arange(_TRIES, dtype=np.uint64)[:, None], np.arange(bins, dtype=np.uint64)[None]
    return ((mix(mix(t + np.uint64(1)) + i * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)


def signature(unique: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of sorted distinct hashes: the range is cut into bins, the smallest of each bin counts. An
    empty bin takes the value of the first non-empty bin among its own sequence of random ones."""
    at = ((unique >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sig, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sig[at[first]], full[at[first]] = unique[first], True
    empty = np.flatnonzero(~full)
    for donors in _donors(bins):
        if not len(empty):
            return sig
        ask = donors[empty]
        hit = full[ask]
        sig[empty[hit]] = sig[ask[hit]]
        empty = empty[~hit]
    sig[empty] = sig[at[first[0]]]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sig.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, r])
    return key.view(np.int64)


def _map_sets(docs: DataFrame, size: int, with_set: bool) -> DataFrame:
    """(doc_id, n, set_key, bands) or (doc_id, n, set_key, items) of each document with a word."""
    import pyarrow as pa

    C.small_batches(docs.sparkSession)

    id_type = docs.schema["doc_id"].dataType
    longs = T.ArrayType(T.LongType(), False)
    head = [T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType())]
    schema = T.StructType([*head, T.StructField("items" if with_set else "bands", longs)])

    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for part in C.slices(batch):
                n, keys, lists = [], [], []
                for text in part.column(1):
                    items = np.unique(shingles(hashes.of(text.as_py()), size))
                    n.append(len(items))
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                    lists.append(items.view(np.int64) if with_set else band_keys(signature(items, BANDS * ROWS), BANDS, ROWS) if len(items) else None)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())
        hashes.clear()
        C.trim()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("items").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("sb"))
    near = lambda x, y: F.col(x) * 100 >= F.col(y) * percent
    both = pairs.join(one, "a").join(two, "b").filter(near("na", "nb") & near("nb", "na"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("shared", shared).filter(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).select("a", "b")


def _relabel(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components after edges between vertices are added to components (id, comp)."""
    if labels is None:
        return C.components(edges)
    name = lambda df, c: (
        df.join(labels.select(F.col("id").alias(c), F.col("comp").alias("__c")), c, "left").withColumn(c, F.coalesce("__c", c)).drop("__c")
    )
    over = C.components(name(name(edges, "a"), "b"))
    seen = labels.join(over.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    fresh = over.join(labels.select("id"), "id", "left_anti")
    return C.stage(seen.unionByName(fresh).distinct(), "labels")


def _with_comp(df: DataFrame, labels: DataFrame, vertex: str, out: str) -> DataFrame:
    named = labels.select(F.col("id").alias(vertex), F.col("comp").alias(out))
    return df.join(named, vertex, "left").withColumn(out, F.coalesce(out, vertex))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one vertex. Each bucket of 40 bands links its members with its smallest one
    only, so candidate edges are at most 40 a vertex. Edges are confirmed on the full sets, the likeliest of each vertex
    first, and the rest only between components that are still apart. In a bucket that still holds several
    components further centres follow, then an exact join of its members by their rarest shingles: no link is lost to the star shape.

    Null or blank text has no shingles and links with nothing; a null id links with nothing (its component is null). Rows
    that share an id are one document: it links with whatever one of its texts is like, and so links these with each other.
    Ties need no rule: a component's id is its smallest. Other columns are ignored. An empty table gives no rows.
    """
    base = C.clean(docs, id_col, text_col)
    signed = C.stage(_map_sets(base, size, False), "signed")
    some = signed.filter("n > 0 and doc_id is not null")
    classes = C.stage(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    members = C.lookup(some.select("doc_id", "set_key"), classes, "set_key", "members", signed.count()).select("doc_id", "rep", "set_key")
    members = C.stage(members.distinct(), "members")
    same = members.select("doc_id", "rep").distinct()
    reps = members.filter("doc_id = rep").select("doc_id", "set_key")
    one_each = some.join(reps, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    spread = C.stage(one_each.select(F.col("doc_id").alias("m"), "n", F.explode("bands").alias("key")), "buckets")
    sizes = spread.groupBy("key").agg(F.min("m").alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    sizes = C.stage(sizes, "centres")
    n_keys = sizes.count()
    labels = None
    if n_keys:
        words = C.filter_words(n_keys)
        bloom = C.stage(C.bloom_of(sizes.select("key"), "key", words), "bloom")
        probed = C.probe(spread, F.col("key"), bloom, words, "maybe").filter("maybe").drop("maybe")
        full = C.stage(C.lookup(probed, sizes, "key", "k", spread.count()), "full")
        C.unstage(spread)
        star = C.stage(full.filter("m <> c").groupBy("c", "m").agg(F.count(F.lit(1)).alias("bands")), "stars")
        ends = C.stage(full.select(F.col("m").alias("doc_id")).distinct(), "ends")
        words = C.filter_words(ends.count())
        ids = C.stage(C.bloom_of(ends.select(F.xxhash64("doc_id").alias("h")), "h", words), "bloom")
        texts = C.probe(base.filter("doc_id is not null"), F.xxhash64("doc_id"), ids, words, "maybe").filter("maybe").select("doc_id", "text")
        sets = _map_sets(texts, size, True).filter("n > 0").join(ends, "doc_id", "left_semi")
        sets = C.stage(sets.dropDuplicates(["doc_id", "set_key"]).drop("set_key"), "sets")
        C.release(docs.sparkSession)  # plans and shuffles of the steps so far; many follow
        best = C.stage(star.groupBy("m").agg(F.max_by("c", F.struct("bands", "c")).alias("c")), "best")
        labels = _relabel(None, _similar(best.select(F.col("c").alias("a"), F.col("m").alias("b")), sets, percent))
        apart = _with_comp(_with_comp(star, labels, "c", "kc"), labels, "m", "km").filter("kc <> km")
        rest = apart.join(best, ["c", "m"], "left_anti").select(F.col("c").alias("a"), F.col("m").alias("b"))
        labels = _relabel(labels, _similar(rest, sets, percent))
        labels = _finish(full.filter("k > 2"), labels, sets, percent)
        for table in (full, star, sets, best):
            C.unstage(table)
    several = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc_id", "a")
    edges = C.stage(same.join(several, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")), "several")
    if not edges.isEmpty():
        labels = _relabel(labels, edges)
    out = same if labels is None else _with_comp(same, labels, "rep", "comp")
    comp = out.select("doc_id", F.col("rep" if labels is None else "comp").alias("component_id"))
    comp = comp.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    joined = signed.join(comp, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _open(full: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with theirs."""
    with_comp = C.stage(_with_comp(full, labels, "m", "comp"), "with_comp")
    mixed = with_comp.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k")).filter(F.col("x") != F.col("y"))
    out = C.stage(C.lookup(with_comp, C.stage(mixed.select("key", "k"), "mixed"), "key", "k", with_comp.count()).drop("k"), "open")
    C.unstage(with_comp)
    return out


def _finish(full: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the stars of buckets (key, m, n, c, k) cannot show.

    First a few more centres: the members with the most leading zeros in their hash, about four a bucket, meet all others. In
    buckets that are still mixed, members that may have a link by their rarest shingles then meet in blocks.
    """
    zeros = F.length(F.regexp_extract(F.lpad(F.bin(F.xxhash64("key", "m").bitwiseAND(F.lit((1 << 40) - 1))), 40, "0"), "^0*", 0))
    full = full.select("key", "m", "n", (zeros >= F.ceil(F.log2("k")).cast("int") - 2).alias("centre"))
    open_ = _open(full, labels)
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    one = open_.filter("centre").select(F.col("key").alias("k1"), F.col("m").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ka"))
    two = open_.select("key", F.col("m").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("kb"), F.col("centre").alias("cb"))
    met = (F.col("k1") == F.col("key")) & (F.col("ka") != F.col("kb")) & near & (~F.col("cb") | (F.col("a") < F.col("b")))
    pairs = C.stage(one.join(two, met).select("a", "b").distinct(), "pairs")
    C.release(full.sparkSession)
    if not pairs.isEmpty():
        labels = _relabel(labels, _similar(pairs, sets, percent))
    C.unstage(open_)
    open_ = _open(full, labels)
    if open_.isEmpty():
        return labels
    members = C.stage(open_.select("m", "comp").distinct().join(sets.select(F.col("doc_id").alias("m"), "n", "items"), "m"), "apart")
    keep = C.stage(_may_link(members, percent), "keep")
    meeting = C.stage(_groups(open_).join(keep, "m", "left_semi"), "meeting")
    C.release(full.sparkSession)
    return _relabel(labels, _meet_in_blocks(meeting, members, percent))


def _groups(open_: DataFrame) -> DataFrame:
    """(key, m, comp) of mixed buckets, those with one largest component and the same members outside it as one: near copies share many
    buckets, and with each outsider they need to meet once."""
    per = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("m")).alias("h"))
    main = per.groupBy("key").agg(F.max_by(F.struct("comp", "h"), F.struct("k", "comp")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("most"), F.bit_xor("h").alias("all"))
    group = F.xxhash64("main.comp", F.col("all").bitwiseXOR(F.col("main.h")), F.col("total") - F.col("most"))
    named = C.lookup(open_.select("key", "m", "comp"), C.stage(main.select("key", group.alias("group"), "total"), "groups"), "key", "total", open_.count())
    return C.stage(named.select(F.col("group").alias("key"), "m", "comp").distinct(), "grouped")


def _may_link(members: DataFrame, percent: int) -> DataFrame:
    """The members (m, comp, n, items) that share a shingle of their prefix with a member of another component; no other can have a link.

    With shingles in one order, rarest first, two sets of n and n' shingles can only have the similarity if the first
    n - ceil(n * percent / 100) + 1 of the one and likewise of the other share a shingle. Shingles of one member alone come first and match
    nothing, so a member whose own text fills its prefix is through.
    """
    items = members.select("m", "n", F.explode("items").alias("key"))
    counts = C.stage(items.groupBy("key").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "repeated")
    total = members.agg(F.sum("n")).first()[0] or 0
    mine = C.lookup(items, counts, "key", "f", total).groupBy("m", "n").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("known"))
    left = (F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.size("known"))).cast("int")
    first = mine.withColumn("left", left).filter("left > 0").select("m", F.explode(F.slice("known", F.lit(1), F.col("left"))).alias("s"))
    first = C.stage(first.select(F.col("s.key").alias("key"), "m").join(members.select("m", "comp").distinct(), "m"), "prefixes")
    met = first.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k")).filter(F.col("x") != F.col("y"))
    return C.lookup(first, C.stage(met.select("key", "k"), "met"), "key", "k", first.count()).select("m").distinct()


def _meet_in_blocks(open_: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members outside their group's largest component with members of other components.

    A group's outsiders are dealt into blocks of about BLOCK, its members into chunks of about CHUNK, within classes of lengths of which only
    neighbours can be similar; each block meets each chunk as one bounded group, in which the members' sets are looked up in the
    sorted items of the block. Of several links of an outsider with one component, one is returned.
    """
    import pyarrow as pa

    C.small_batches(open_.sparkSession)
    step = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    per = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("most")).filter("total > most")
    blocks, chunks = F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("total") / CHUNK).cast("int")
    sized = C.stage(main.select("key", "main", "total", blocks.alias("blocks"), chunks.alias("chunks")), "sized")
    rows = C.lookup(open_, sized, "key", "total", open_.count())
    rows = rows.join(vertices.select("m", step.alias("step"), "items"), "m")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("m", F.lit(salt)), F.col(n)).cast("int")
    members = rows.withColumn("chunk", deal("chunks", "c")).withColumn("block", each("blocks")).select("key", "step", "block", "chunk", "m", "comp", "items")
    outside = rows.filter(F.col("comp") != F.col("main")).withColumn("block", deal("blocks", "b")).withColumn("chunk", each("chunks"))
    outside = outside.withColumn("step", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)))
    outside = outside.select(*[F.col(c).alias(f"o_{c}") for c in ("key", "step", "block", "chunk", "m", "comp", "items")])
    kind = dict(vertices.dtypes)["m"]

    def meet(left, right):
        a, b = left.combine_chunks(), right.combine_chunks()
        ids_a, ids_b, src, got = a.column("m"), b.column("o_m"), [], []
        if len(a) and len(b):
            comp_a, comp_b = a.column("comp").to_pylist(), b.column("o_comp").to_pylist()
            items = [np.asarray(x.values) for x in b.column("o_items")]
            size = np.array([len(x) for x in items])
            flat, owner = np.concatenate(items), np.repeat(np.arange(len(items)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            seen = set()
            for i, x in enumerate(a.column("items")):
                mine = np.asarray(x.values)
                lo, hi = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
                n = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(items))
                for j in np.flatnonzero(100 * shared >= percent * (len(mine) + size - shared)).tolist():
                    if comp_a[i] != comp_b[j] and (comp_a[i], j) not in seen:
                        seen.add((comp_a[i], j))
                        src.append(i), got.append(j)
        take = lambda col, at: col.take(pa.array(at, pa.int64()))
        return pa.table({"a": take(ids_a, src), "b": take(ids_b, got)})

    keys = ("key", "step", "block", "chunk")
    return members.groupBy(*keys).cogroup(outside.groupBy(*[f"o_{k}" for k in keys])).applyInArrow(meet, f"a {kind}, b {kind}")
