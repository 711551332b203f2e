"""Prefix trie of conversations: z-fast tries of batches, whose edges are expanded into nodes and merged by prefix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.llm import _common as C

#: Turns of a batch, and of a conversation that is inserted; a longer one is a path of its own. Width of the blocks in which members are listed.
BATCH, IDS = 50_000, 4096
ROOT = bytes(16)


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the largest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of paths. A path is the list of the keys of its prefixes, so equal keys mean equal prefixes. A node covers the depths (top, end] of
    one path and is found by the key at its handle, the two-fattest of these depths."""

    def __init__(self):
        self.paths: list[list[bytes]] = [[ROOT]]
        self.top, self.end, self.path, self.parent, self.ends = [-1], [0], [0], [-1], [[]]
        self.handles: dict[bytes, int] = {}
        self.children: dict[tuple[int, bytes], int] = {}

    def _place(self, node: int) -> None:
        self.handles[self.paths[self.path[node]][two_fattest(self.top[node], self.end[node])]] = node
        self.children[self.parent[node], self.paths[self.path[node]][self.top[node] + 1]] = node

    def _new(self, top: int, end: int, path: int, parent: int) -> int:
        for column, value in zip((self.top, self.end, self.path, self.parent, self.ends), (top, end, path, parent, []), strict=True):
            column.append(value)
        return len(self.top) - 1

    def exit_node(self, path: list[bytes]) -> tuple[int, int]:
        """The node in which a path leaves the trie and the depth to which it follows it: fat binary search over handles, then over the edge."""
        a, b, best = 0, len(path) - 1, 0
        while a < b:
            f = two_fattest(a, b)
            node = self.handles.get(path[f])
            if node is None:
                b = f - 1
                continue
            end = self.end[node]
            if end < len(path) and path[end] == self.paths[self.path[node]][end]:
                a, best = end, node
            else:
                return node, self._common(path, node, f)
        if a + 1 < len(path) and (child := self.children.get((best, path[a + 1]))) is not None:
            return child, self._common(path, child, a + 1)
        return best, a

    def _common(self, path: list[bytes], node: int, low: int) -> int:
        other, high = self.paths[self.path[node]], min(self.end[node], len(path) - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if path[mid] == other[mid] else (low, mid - 1)
        return low

    def insert(self, name: int, path: list[bytes]) -> None:
        node, depth = self.exit_node(path)
        if depth < self.end[node]:  # the path leaves inside the edge, or ends there
            del self.handles[self.paths[self.path[node]][two_fattest(self.top[node], self.end[node])]]
            upper = self._new(self.top[node], depth, self.path[node], self.parent[node])
            self.top[node], self.parent[node] = depth, upper
            self._place(upper)
            self._place(node)
            node = upper
        if depth < len(path) - 1:
            self.paths.append(path)
            node = self._new(depth, len(path) - 1, len(self.paths) - 1, node)
            self._place(node)
        self.ends[node].append(name)

    def members(self) -> tuple[list[int], list[int]]:
        """How many paths pass each node's end, and the smallest of their names."""
        count, least = [len(x) for x in self.ends], [min(x, default=1 << 63) for x in self.ends]
        for node in sorted(range(1, len(self.top)), key=self.end.__getitem__, reverse=True):
            up = self.parent[node]
            count[up] += count[node]
            least[up] = min(least[up], least[node])
        return count, least


def _tries(batches):
    """Paths in order (conv, depth, key, tokens) to nodes of tries of batches (key, parent, depth, tokens, conv_id, n_convs), every depth of every edge one."""
    trie, tokens, size = ZFastTrie(), [np.zeros(1, np.int64)], 0

    def rows(keys, parents, depths, lengths, convs, counts) -> pa.RecordBatch:
        types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["key", "parent", "depth", "tokens", "conv_id", "n_convs"]
        return pa.record_batch([pa.array(c, t) for c, t in zip((keys, parents, depths, lengths, convs, counts), types, strict=True)], names)

    def expanded():
        count, least = trie.members()
        out: list[list] = [[], [], [], [], [], []]
        for node in range(len(trie.top)):
            if count[node]:
                path, lengths = trie.paths[trie.path[node]], tokens[trie.path[node]]
                for d in range(trie.top[node] + 1, trie.end[node] + 1):
                    for column, value in zip(out, (path[d], path[d - 1] if d else None, d, int(lengths[d]), least[node], count[node]), strict=True):
                        column.append(value)
        return rows(*out)

    conv, path, lengths, before = None, [], [], 0  # before: turns of a long conversation that have already gone
    for batch in batches:
        for c, d, key, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if d == 0:
                if path and not before:
                    known = len(trie.paths)
                    trie.insert(conv, path)
                    if len(trie.paths) > known:
                        tokens.append(np.array(lengths))
                    size += len(path)
                elif before:
                    yield rows(path[1:], path[:-1], range(before + 1, before + len(path)), lengths[1:], [conv] * (len(path) - 1), [1] * (len(path) - 1))
                if size >= BATCH:
                    yield expanded()
                    trie, tokens, size = ZFastTrie(), [np.zeros(1, np.int64)], 0
                conv, path, lengths, before = c, [], [], 0
            path.append(key)
            lengths.append(n)
            if len(path) > BATCH:
                if not before:
                    yield rows([ROOT], [None], [0], [0], [conv], [1])
                yield rows(path[1:], path[:-1], range(before + 1, before + len(path)), lengths[1:], [conv] * (len(path) - 1), [1] * (len(path) - 1))
                before, path, lengths = d, [key], [n]
    if path and before:
        yield rows(path[1:], path[:-1], range(before + 1, before + len(path)), lengths[1:], [conv] * (len(path) - 1), [1] * (len(path) - 1))
    elif path:
        known = len(trie.paths)
        trie.insert(conv, path)
        if len(trie.paths) > known:
            tokens.append(np.array(lengths))
    if path or size:
        yield expanded()
    C.trim()


def _digests(batches):
    """Blocks of members sorted by node and block (key, members) to a digest of each node's list."""
    now, digest, out = None, None, []
    for batch in batches:
        for key, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == now:
                digest.update(b"," + members.encode())
                continue
            if now is not None:
                out.append((now, digest.hexdigest()))
            now, digest = key, hashlib.sha256(members.encode())
            if len(out) >= 4000:
                yield pa.record_batch([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out])], ["key", "ends_sha256"])
                out = []
    if now is not None:
        out.append((now, digest.hexdigest()))
        yield pa.record_batch([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out])], ["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, ids: DataFrame, conv_col: str = "conv_id", place_col: str = "place", item_cols: tuple[str, ...] = ("role", "text"), size: str = "char_length(text)") -> DataFrame:
    """One row per node of the trie of the conversations in `ids`: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    `turns` has each conversation's turns with distinct places that order them; equal items (nulls equal) share nodes; `size` is what a turn costs. A
    conversation of `ids` without turns ends at the root; turns of other conversations must not occur. Without conversations there are no rows.
    Null ids belong to no conversation. Prefixes are told apart by 128 bits of hash. Tasks insert conversations of neighbouring ids into z-fast tries of
    bounded batches; what these share is combined there, and nodes of equal prefix are merged by one aggregation.
    """
    spark = turns.sparkSession
    C.small_batches(spark)
    items = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in item_cols]
    turn = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(place_col).alias("place"), F.xxhash64(*items).alias("h1"), F.xxhash64(F.lit(7), *items[::-1]).alias("h2"),
        F.coalesce(F.expr(size), F.lit(0)).cast("bigint").alias("tokens"),
    )
    tops = ids.select(F.col(ids.columns[0]).cast("bigint").alias("conv")).filter("conv IS NOT NULL").distinct()
    none = F.lit(None).cast("bigint")
    rows = turn.unionByName(tops.select("conv", none.cast(dict(turn.dtypes)["place"]).alias("place"), none.alias("h1"), none.alias("h2"), F.lit(0).cast("bigint").alias("tokens")))
    own = "PARTITION BY block, conv ORDER BY place NULLS FIRST"
    placed = rows.withColumn("block", F.expr("conv DIV 100")).repartition("block").withColumn("d", F.expr(f"CAST(row_number() OVER ({own}) AS BIGINT) - 1"))
    part = [F.coalesce(x, F.lit(0).cast("bigint")) for x in (F.when(F.col("d") > 0, F.xxhash64("d", "h1", "h2")), F.when(F.col("d") > 0, F.xxhash64("h2", "d", "h1")))]
    halves = placed.withColumn("p1", part[0]).withColumn("p2", part[1])
    halves = halves.withColumn("p1", F.expr(f"bit_xor(p1) OVER ({own})")).withColumn("p2", F.expr(f"bit_xor(p2) OVER ({own})"))
    summed = halves.withColumn("so_far", F.expr(f"sum(tokens) OVER ({own})"))
    key = F.unhex(F.concat(F.lpad(F.hex("p1"), 16, "0"), F.lpad(F.hex("p2"), 16, "0"))).alias("key")
    paths = C.stage(summed.select("block", "conv", "d", key, "tokens", "so_far"), "paths")

    whole = paths.repartition("block").sortWithinPartitions("block", "conv", "d").select("conv", "d", "key", "tokens")
    part_nodes = whole.mapInArrow(_tries, "key binary, parent binary, depth bigint, tokens bigint, conv_id bigint, n_convs bigint")
    nodes = C.stage(
        part_nodes.groupBy("key").agg(*[F.min(c).alias(c) for c in ("parent", "depth", "tokens", "conv_id")], F.sum("n_convs").alias("n_convs")), "nodes"
    )
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    known = C.stage(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "known")

    # a conversation owns the nodes of which it is the smallest member: a chain from some depth to its end. With that, sums over a subtree's nodes are sums
    # over its members
    owners = known.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("since"), F.sum("tokens").alias("chain"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf")
    )
    totals = paths.groupBy("conv").agg(F.max("so_far").alias("total"), F.max("d").alias("last"))
    member = paths.join(totals.join(owners, "conv", "left"), "conv")
    rest = F.col("total") - F.col("so_far") + F.col("tokens")
    mine = F.when(F.col("since").isNull(), 0).when(F.col("d") >= F.col("since"), rest).otherwise(F.col("chain"))
    sums = member.groupBy("key").agg(
        F.sum(rest - mine).cast("bigint").alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).cast("bigint").alias("n_leaves")
    )
    last = member.filter(F.col("d") == F.col("last")).groupBy("key", F.expr(f"conv DIV {IDS}").alias("ids"))
    listed = last.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("members"))
    digests = listed.repartition("key").sortWithinPartitions("key", "ids").select("key", "members").mapInArrow(_digests, "key binary, ends_sha256 string")
    full = C.stage(known.join(sums, "key").join(digests, "key", "left"), "full")
    parents = full.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = full.filter("parent IS NOT NULL").withColumnRenamed("n_children", "below")
    joined = C.lookup(below, parents, "parent", "n_children", below.count())
    out = joined.select(*[c for c in full.columns if c != "n_children"], F.col("below").alias("n_children"), "parent_conv_id")
    top = full.filter("parent IS NULL").withColumn("parent_conv_id", none).select(*out.columns)
    return out.unionByName(top).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
