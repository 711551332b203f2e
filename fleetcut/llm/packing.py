"""Packing into fixed-length sequences: Martello-Toth dominance reduction on the length histogram, then best fit."""

from __future__ import annotations

import json
import re
import zlib

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.llm import _common as C

#: Rows that one window group numbers, at least, and groups for each shuffle partition, about.
GROUP, GROUPS = 500, 20


def _tokenizer(path: str, pattern: str, added_tokens: bool):
    """Encoding function of the byte-level BPE of a tokenizers JSON file, run by tiktoken's core, which gives the same ids several times
    as fast. A text that holds the string of an added token gets that token's id, as the library does unless its
    encode_special_tokens is set (added_tokens false: such strings are ordinary text). The core's split pattern gives up on very long white space; such a
    text is split by the regex module, which has no limit, and its pieces are encoded one by one.

    In the file each byte is a printable character: itself if it is printable in Latin-1, else one counted from U+0100.
    """
    import tiktoken

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    added = {t["content"]: t["id"] for t in doc.get("added_tokens", ())}
    if any(t.get(flag) for t in doc.get("added_tokens", ()) for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take their surroundings along are not supported")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in doc["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    special = added if added_tokens else {}
    whole = (lambda text: encoding.encode(text, allowed_special="all")) if special else encoding.encode_ordinary
    between, pieces = re.compile("(" + "|".join(map(re.escape, special)) + ")"), regex.compile(pattern)

    def by_pieces(text: str) -> list[int]:
        ids: list[int] = []
        for part in between.split(text) if special else [text]:
            if part in special:
                ids.append(special[part])
            else:
                for m in pieces.finditer(part):
                    ids += encoding._encode_single_piece(m.group())
        return ids

    def encode(text: str) -> list[int]:
        try:
            return whole(text)
        except ValueError:
            return by_pieces(text)

    return encode


def cut_documents(
    docs: DataFrame, vocab_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True,
) -> DataFrame:
    """Token pieces (doc_id, piece, start, length, ids_crc32): a document's ids, then end_id. Only a document of more than
    `capacity` ids is cut, and its first piece takes the remainder."""
    import pyarrow as pa

    C.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )

    def run(batches):
        import numpy as np

        encode = _tokenizer(vocab_path, pattern, added_tokens)
        for batch in batches:
            for part in C.slices(batch):
                src, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(part.column(1)):
                    ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                    lo, hi, k = 0, first, 0
                    while lo < len(ids):
                        src.append(row), piece.append(k), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                        lo, hi, k = hi, hi + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(src, pa.int32())), pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                    schema.fieldNames(),
                )
        del encode  # about 35 MB, which an idle worker would keep
        C.trim()

    return C.clean(docs, id_col, text_col).mapInArrow(run, schema)


def reduce_by_dominance(count: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate every other set with the same longest piece; count[length] is lowered in place.

    With room r beside a piece w: {w} if nothing fits; {w, r} if the room fills exactly; {w, x}, x the longest that fits, if
    no two pieces fit or x is at least the sum of any two that do; {w, x, y} if no three fit and every two that fit are,
    each, at most x and y. Whatever else joins w in an optimal packing can then be exchanged for the set.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(count[x] // n for x, n in need.items())
        for x, n in need.items():
            count[x] -= n * times
        fixed.append((lengths, times))

    for w in range(capacity, 0, -1):
        while count[w]:
            room = capacity - w
            own = lambda x: count[x] - (x == w)  # noqa: B023, E731
            fits = [x for x in range(1, room + 1) if own(x) > 0]
            if not fits:
                fix(w)
                continue
            x = fits[-1]
            if x == room:
                fix(w, x)
                continue
            small = [s for s in fits[:3] for _ in range(min(3, own(s)))][:3]
            if len(small) < 2 or small[0] + small[1] > room:
                fix(w, x)
                continue
            # the longest partner of each length that fits
            pairs, j = [], len(fits) - 1
            for a in fits:
                while j >= 0 and fits[j] + a > room:
                    j -= 1
                if j < 0:
                    break
                b = fits[j]
                if b == a and own(a) < 2:
                    b = fits[j - 1] if j else 0
                if b:
                    pairs.append((a, b))
            if max(a + b for a, b in pairs) <= x:
                fix(w, x)
                continue
            y = next((b for a, b in pairs if a == x), 0)
            no_three = len(small) < 3 or sum(small) > room
            if no_three and y and all(min(a, b) <= y or a + b <= x for a, b in pairs):
                fix(w, x, y)
                continue
            break
    return fixed


def best_fit(count: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for all pieces of a length at once: open sequences are groups (content, how many) by room."""
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for w in range(capacity, 0, -1):
        left = count[w]
        while left:
            room = next((r for r in range(w, capacity) if rooms[r]), None)
            if room is None:
                k = min(capacity // w, left)
                n = left // k
                rooms[capacity - k * w][(w,) * k] = rooms[capacity - k * w].get((w,) * k, 0) + n
                left -= n * k
                continue
            content, n = rooms[room].popitem()
            take = min(n, left)
            if take < n:
                rooms[room][content] = n - take
            rooms[room - w][content + (w,)] = rooms[room - w].get(content + (w,), 0) + take
            left -= take
    return [x for group in rooms for x in group.items()]


def plan(count: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset): pieces of a length in the order of their ranks."""
    count = list(count)
    used, runs, sequence = [0] * (capacity + 1), [], 0
    for content, times in reduce_by_dominance(count, capacity) + best_fit(count, capacity):
        offset = 0
        for w in content:
            runs.append((w, used[w], times, sequence, offset))
            used[w] += times
            offset += w
        sequence += times
    return runs


def pack_documents(
    docs: DataFrame, vocab_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver sees only the histogram of lengths (`capacity` numbers at most) and plans how many sequences of each
    content there are. Pieces get a rank within their length, counted in hashed groups; a length is dealt into as many groups as its own
    count asks for, so that one that a third of all pieces share is spread. A rank picks its place in the plan. Null text is a document of end_id
    alone; the string of an added token is that token (see _tokenizer). Repeated rows are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = C.stage(cut_documents(docs, vocab_path, pattern, capacity, end_id, id_col, text_col, added_tokens).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    count = [0] * (capacity + 1)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    rows = max(GROUP, sum(count) // (GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    deals = spark.createDataFrame([(w, -(-n // rows)) for w, n in enumerate(count) if n], "length long, deals long")
    pieces = pieces.join(F.broadcast(deals), "length").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("deals"))).drop("deals")
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("rid"))
    ranked = pieces.withColumn("rank", rank)
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = ranked.join(starts, ["length", "part"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    runs = spark.createDataFrame(plan(count, capacity), "w long, first long, times long, sequence long, offset long")
    return (
        placed.join(F.broadcast(runs), (F.col("length") == F.col("w")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    )
