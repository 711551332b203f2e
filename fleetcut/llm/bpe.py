"""Byte-level BPE by monoid tree reduction: encode halves, join them by re-encoding a boundary window."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from functools import lru_cache
from typing import Any

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetcut.llm import _common as C

#: Cached words, pieces, subtrees and pairs of a Python worker, of each; two generations of it bound memory to about 200 MB.
CACHE = 200_000
#: Code points of a leaf of the text tree, ids of a leaf of the decoding tree. A leaf of a piece's tree is one byte.
TEXT_LEAF, DECODE_LEAF = 256, 64
#: Subtrees of a piece of so many bytes at most are remembered.
MEMO = 16

_SAFE = regex.compile(r"(?<=\S)[ \n]")
_DOUBLE = re.compile(r"\s\s")
#: Marks the first word of a text, which has no space before it; no text holds a lone surrogate.
_FIRST = "\ud800"


class PieceEncoder:
    """BPE of one piece (a match of the split pattern), given ranks of byte strings.

    The leaves are single bytes. A token sequence is the encoding of its bytes if and only if each pair of neighbours is the
    encoding of theirs. So when two encoded halves meet, only a window at the boundary is encoded again, and it grows
    until the pairs at its edges are encodings of themselves; nothing outside can change then.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.joins = 0
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self._known: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, leftmost first, until none can merge."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is merged away
        prev = list(range(-1, n - 1))
        heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                prev[k] = i
                r = ranks.get(piece[i : end[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:k])
                if r is not None:
                    heapq.heappush(heap, (r, p, i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' bytes; they are stable side by side if it is (a, b)."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes from theirs: the monoid's operation, with () as its unit."""
        if not left or not right:
            return left or right
        self.joins += 1
        i, j = len(left) - 1, 1
        window = self.pair(left[i], right[0])
        while True:
            left_ok = i == 0 or self.pair(left[i - 1], window[0]) == (left[i - 1], window[0])
            right_ok = j == len(right) or self.pair(window[-1], right[j]) == (window[-1], right[j])
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            if not left_ok:
                i = max(0, 2 * i - len(left))
            if not right_ok:
                j = min(len(right), 2 * j)
            window = self.merge(b"".join([self.tokens[t] for t in left[i:] + right[:j]]))

    def tree(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) < 2:
            return (self.ranks[piece],) if piece else ()
        known = self._known.get(piece)
        if known is None:
            half = len(piece) // 2
            known = self.join(self.tree(piece[:half]), self.tree(piece[half:]))
            if len(piece) <= MEMO:
                if len(self._known) > CACHE:
                    self._known.clear()
                self._known[piece] = known
        return known

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """A piece that is a token is that token, whatever its merges would give."""
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else (whole,)


class Generations:
    """A bounded dictionary: when the young half is full it becomes the old one; what is still in use moves back."""

    def __init__(self, limit: int = CACHE):
        self.young: dict = {}
        self.old: dict = {}
        self.limit = limit

    def missing(self, keys: set) -> list:
        """Move known keys to the young half, return the rest. Call it before reading keys from `young`."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        out = []
        for k in keys.difference(self.young):
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self.young[k] = v
        return out


class WordCache:
    """Ids (little-endian unsigned 32-bit) of texts that stand alone, from their space- and line-separated words.

    A match of the split pattern never has white space after other characters, so before a lone space or newline a text
    can be cut, whatever stands around it. Leaves with two white-space characters in a row are split whole. Words are made
    of pieces, which many_pieces(list of str) encodes.
    """

    def __init__(self, split, many_pieces):
        self.split, self.many_pieces = split, many_pieces
        self.words, self.pieces = Generations(), Generations()

    def _lists(self, pieces: list[list[str]]) -> list[bytes]:
        unseen = self.pieces.missing({p for x in pieces for p in x})
        known = self.pieces.young
        known.update(zip(unseen, self.many_pieces(unseen), strict=True))
        return [b"".join([known[p] for p in x]) for x in pieces]

    @staticmethod
    def _words(text: str) -> list[str]:
        words = text.replace("\n", " \n").split(" ")
        words[0] = _FIRST + words[0]
        return words

    def learn(self, texts: list[str]) -> None:
        """Encode the unseen words of texts. Leaves of a text with white space in a row are split whole instead."""
        unseen = self.words.missing({w for t in texts for w in self._words(t)})
        if unseen:
            split = [self.split(w[1:] if w[:1] == _FIRST else w if w[:1] == "\n" else " " + w) for w in unseen]
            self.words.young.update(zip(unseen, self._lists(split), strict=True))

    def encode(self, text: str) -> bytes:
        if _DOUBLE.search(text):
            return self._lists([self.split(text)])[0]
        words = self._words(text)
        try:
            return b"".join(map(self.words.young.__getitem__, words))
        except KeyError:
            self.learn([text])
            return b"".join(map(self.words.young.__getitem__, words))


class TextEncoder:
    """Ids of a whole text. A tree node holds (head, ids, tail): ids of what lies between the first and the last safe cut,
    and the texts outside them, which a neighbour can still change. Joining encodes the window tail + head again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = PieceEncoder(ranks)
        self.cache = WordCache(regex.compile(pattern).findall, self._many)
        self.joins = 0

    def _many(self, pieces: list[str]) -> list[bytes]:
        return [array("I", self.pieces.encode(p.encode("utf-8", "replace"))).tobytes() for p in pieces]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text up its tree; the words of a batch are learned together."""
        self.cache.learn(texts)
        return [self.encode(t) for t in texts]

    def _leaf(self, text: str) -> tuple[str, bytes, str] | str:
        first = _SAFE.search(text)
        if not first:
            return text
        at = first.start()
        last = max(text.rfind(" "), text.rfind("\n"))
        while last > at and text[last - 1].isspace():
            last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
        return text[:at], self.cache.encode(text[at:last]) if last > at else b"", text[max(last, at) :]

    def join(self, a: Any, b: Any) -> Any:
        self.joins += 1
        if isinstance(a, str) and isinstance(b, str):
            return self._leaf(a + b)
        if isinstance(a, str):
            cut = self._leaf(a + b[0])
            return (a + b[0], b[1], b[2]) if isinstance(cut, str) else (cut[0], cut[1] + self.cache.encode(cut[2]) + b[1], b[2])
        if isinstance(b, str):
            cut = self._leaf(a[2] + b)
            return (a[0], a[1], a[2] + b) if isinstance(cut, str) else (a[0], a[1] + self.cache.encode(cut[0]) + cut[1], cut[2])
        return a[0], a[1] + self.cache.encode(a[2] + b[0]) + b[1], b[2]

    def _tree(self, text: str) -> Any:
        if len(text) <= TEXT_LEAF:
            return self._leaf(text)
        half = len(text) // 2
        return self.join(self._tree(text[:half]), self._tree(text[half:]))

    def encode(self, text: str) -> bytes:
        node = self._tree(text)
        if isinstance(node, str):
            return self.cache.encode(node) if node else b""
        return self.cache.encode(node[0]) + node[1] + self.cache.encode(node[2])

    def decode(self, ids: bytes) -> bytes:
        """Concatenate the tokens' bytes up a tree of halves."""
        if len(ids) <= 4 * DECODE_LEAF:
            return b"".join(map(self.pieces.tokens.__getitem__, array("I", ids)))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (array of int).

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded bytes. Null
    text counts as empty (0 tokens, hashes of nothing). Repeated rows and null ids give a row each; an empty table
    none. A document is encoded whole in one task; rows need no shuffle. The vocabulary file must be on every executor.
    """
    import pyarrow as pa

    C.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        import numpy as np

        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for part in C.slices(batch):
                counts, hashes, decoded, ids = [], [], [], []
                for packed in enc.encode_many([x or "" for x in part.column(1).to_pylist()]):
                    counts.append(len(packed) // 4)
                    hashes.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(packed)).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(packed, "<i4"))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        C.trim()

    return C.clean(docs, id_col, text_col).mapInArrow(run, T.StructType(fields))
