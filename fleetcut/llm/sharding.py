"""Sharding by a hierarchical tree of weighted hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.llm import _common as C

#: (region, rack, shard) by name; a node's weight is the sum of the weights below it.
Tree = dict[str, dict[str, dict[int, float]]]
#: Rows of a shard that one window group numbers, about.
GROUP = 100_000


def grid(shards: int, racks: int = 4, per_rack: int = 2) -> Tree:
    """Shards of weight one, per_rack to a rack and racks to a region, filled from the left."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack % racks}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """One more shard, as a region of its own: no other weight changes, so rows move only into the new subtree."""
    return {**tree, f"region-of-{shard}": {"rack0": {shard: weight}}}


def _levels(tree: Tree) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children (path, weight) of every node above it."""
    top: dict[str, list[tuple[str, float]]] = {"": []}
    mid: dict[str, list[tuple[str, float]]] = {}
    low: dict[str, list[tuple[str, float]]] = {}
    for region, racks in tree.items():
        top[""].append((region, sum(sum(r.values()) for r in racks.values())))
        mid[region] = [(f"{region}/{rack}", sum(shards.values())) for rack, shards in racks.items()]
        for rack, shards in racks.items():
            low[f"{region}/{rack}"] = [(f"{region}/{rack}/{s}", w) for s, w in shards.items()]
    return [top, mid, low]


def _descend(key: Column, node: Column, level: dict[str, list[tuple[str, float]]]) -> Column:
    """The child with the largest weighted draw ln(u) / weight: chosen with chance in proportion to its weight."""
    table = F.create_map(
        *[x for k, kids in level.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("w")) for n, w in kids]))]
    )

    def draw(kid: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, kid["n"]), 11).cast("double") + 1.0) / float(1 << 53)
        return F.struct((F.log(u) / kid["w"]).alias("d"), kid["n"].alias("n"))

    return F.array_max(F.transform(F.element_at(table, node), draw))["n"]


def with_shard(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Descend region, rack and shard; a key meets only the draws of the branch it is in."""
    node = f"__{out}"
    df = df.withColumn(node, F.lit(""))
    for level in _levels(tree):
        df = df.withColumn(node, _descend(F.col(key), F.col(node), level))
    return df.withColumn(out, F.element_at(F.split(node, "/"), -1).cast("int")).drop(node)


def assign_shards(docs: DataFrame, tree: Tree, bigger: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the tree alone decide the shard (law `key`). Slots number each shard from 0 without gaps: rows are
    counted in hashed parts of a shard of about 100,000 rows, so no task holds a whole shard. Null text has size 16
    and the checksum of nothing; a null id is a key like others; repeated rows share a shard and get slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000null"))
    sized = C.clean(docs, id_col, text_col).select(
        "doc_id", (F.length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")
    )
    placed = with_shard(sized, "key", tree, "shard")
    placed = with_shard(placed, "key", bigger, "grown_shard") if bigger else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    part = F.pmod(F.xxhash64("key", F.lit("chunk")), F.lit(max(1, docs.count() // GROUP))).cast("int")
    placed = C.stage(placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard", part.alias("chunk")), "placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("rank", rank)
        .join(offsets, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("rank") - 1).cast("bigint").alias("slot"), "grown_shard")
    )
