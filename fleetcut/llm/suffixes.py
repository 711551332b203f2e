"""Suffix-array dedup: the Burrows-Wheeler transform of a collection and its common prefixes, built column by column.

Texts are cut into pieces at anchors (the k-mer of smallest hash of each window of `span` bytes), so equal windows meet in one collection,
whatever texts they come from. A collection is built as for short reads: each round inserts one symbol of every piece, from its last to its
first, by one sequential pass over two files, the transform and the common prefixes, which it writes anew.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.llm import _common as C
from fleetcut.llm.words import mix

#: Bytes of a repeated string; of an anchor.
SPAN, K = 50, 24
#: Bytes of a text that are hashed at once; anchor keys that a task gathers before it writes them, and of a bucket.
CHUNK, KEYS, BUCKET = 1 << 19, 1 << 21, 1 << 21
#: Bytes of the pieces of a collection; rows of a block of its files; bytes of a file that stay in memory.
COLLECTION, BLOCK, SPOOL = 12 << 20, 1 << 19, 4 << 20
#: The place of a null id in the order of ids: the last.
LAST = (1 << 63) - 1
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _minima(raw: bytes, span: int) -> np.ndarray:
    """For each window of `span` bytes the smallest hash of its k-mers."""
    n = len(raw)
    eights = np.ascontiguousarray(np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(8), np.uint8), (n, 8), (1, 1))).view(np.uint64).ravel()
    m = n - K + 1
    h = eights[:m] * _A
    for i in range(8, K, 8):
        h ^= h >> np.uint64(29)
        h += eights[i : i + m]
        h *= _A
    h ^= h >> np.uint64(32)
    h *= _B
    width, have = span - K + 1, 1
    while have * 2 <= width:
        h, have = np.minimum(h[:-have], h[have:]), have * 2
    return np.minimum(h[: len(h) - width + have], h[width - have :]) if have < width else h


def _runs(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with the same anchor in a text: the text, the first window's place there, the number of windows (span - K + 1 at most), the
    anchor's hash. All texts are hashed as one; windows across their borders do not count."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    if not len(texts) or ends[-1] < span:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    h = _minima(b"".join(texts), span)
    fresh = np.empty(len(h), bool)
    fresh[0] = True
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    borders = np.concatenate((ends - lengths, ends - span + 1))  # where the windows of a text begin, and those that cross its end
    fresh[borders[(borders >= 0) & (borders < len(h))]] = True
    at = np.flatnonzero(fresh)
    count = np.diff(at, append=len(h))
    which = np.searchsorted(ends, at, "right")
    own = at + span <= ends[which]
    at, count, which = at[own], count[own], which[own]
    width = span - K + 1
    if len(count) and count.max() > width:  # equal anchors in a row, as in white space: further pieces
        n = -(-count // width)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, which, count = np.repeat(at, n) + width * step, np.repeat(which, n), np.minimum(np.repeat(count, n) - width * step, width)
    return which, at - (ends - lengths)[which], count, h[at]


def pieces(text: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, windows and anchor's hash of each piece of a text. What anchor a window has depends on its own bytes only; so long texts are hashed in chunks."""
    parts = [(lo, _runs([text[lo : lo + CHUNK + span - 1]], span)) for lo in range(0, max(1, len(text) - span + 1), CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*((at + lo, count, h) for lo, (_, at, count, h) in parts), strict=True))


def anchored(texts: list[bytes], span: int):
    """(text number, place, windows, anchor's hash) of the pieces of some texts: those of a slice together, long texts alone and in chunks."""
    if sum(map(len, texts)) <= CHUNK:
        return _runs(texts, span)
    parts = [(i, pieces(t, span)) for i, t in enumerate(texts)]
    return tuple(np.concatenate(x) for x in zip(*((np.full(len(p[0]), i), *p) for i, p in parts), strict=True))


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """A bucket of `bits` bits above 32 bits of an anchor's hash. Anchors are minima, so their bits are mixed anew."""
    h = mix(h)
    low = h & np.uint64(0xFFFFFFFF)
    return low if not bits else (h >> np.uint64(64 - bits)) << np.uint64(32) | low


def _bits(key: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and mask of a key in a Bloom filter of a power of two of words."""
    z, one = mix(key), np.uint64(1)
    mask = one << (z >> np.uint64(40) & np.uint64(63)) | one << (z >> np.uint64(46) & np.uint64(63)) | one << (z >> np.uint64(52) & np.uint64(63))
    return z & np.uint64(words - 1), mask


class Tape:
    """A file of bytes that is written and read in sequence; a short one stays in memory, a long one is an unnamed file among Spark's own spills."""

    def __init__(self, spool: int = SPOOL):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file = tempfile.SpooledTemporaryFile(spool, dir=folder if os.path.isdir(folder) else None)

    def write(self, values: np.ndarray) -> None:
        self.file.write(values.tobytes())

    def blocks(self, size: int):
        self.file.seek(0)
        while data := self.file.read(size):
            yield np.frombuffer(data, np.uint8)

    def close(self) -> None:
        self.file.close()


class Collection:
    """Transform and common prefixes of the suffixes of some strings. Symbols are bytes of UTF-8 (which never holds 255) plus one; 0 is what precedes a
    string's first symbol. The rows of the empty suffixes come first, in the order of the strings. A string has 255 symbols at most."""

    def __init__(self, strings: list[bytes], block: int = BLOCK, spool: int = SPOOL):
        self.n, self.block, self.spool = len(strings), block, spool
        lengths = np.fromiter(map(len, strings), np.int64, self.n)
        longest = int(lengths.max(initial=0))
        flat = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
        self.columns = np.zeros((longest + 1, self.n), np.uint8)  # column j: the symbol before the suffix of length j
        place = np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(len(flat))
        self.columns[place, np.repeat(np.arange(self.n), lengths)] = flat
        self.symbols, self.prefixes = Tape(spool), Tape(spool)
        self.symbols.write(self.columns[0])
        self.prefixes.write(np.zeros(self.n, np.uint8))
        self.total = np.bincount(self.columns[0], minlength=256)
        self.places, self.edges = np.arange(block, dtype=np.uint32) << np.uint32(1), np.arange(256, dtype=np.uint32) << np.uint32(24)
        at, who = np.arange(self.n), np.arange(self.n)  # rows of the symbols that came last, and whose they are
        for j in range(1, longest + 1):
            at, who = self._insert(at, who, self.columns[j])

    def _insert(self, at: np.ndarray, who: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round: the suffixes that begin with the symbols at rows `at` get their rows, and the symbols before them are written there."""
        base = self.n - self.total[0] + np.cumsum(self.total) - self.total  # first row of the suffixes that begin with each symbol, less symbol 0
        seen, run, open_ = np.zeros(256, np.int64), np.full(256, 255, np.uint8), np.zeros(256, bool)
        rows, whose, changed, values, lo, k = [], [], [], [], 0, 0
        for s, p in zip(self.symbols.blocks(self.block), self.prefixes.blocks(self.block), strict=True):
            hi = lo + len(s)
            end = k + int(np.searchsorted(at[k:], hi))
            key = s.astype(np.uint32) << np.uint32(24) | self.places[: len(s)]  # symbol, place, and whether the symbol came last
            key[at[k:end] - lo] |= np.uint32(1)
            key.sort()
            edges = np.searchsorted(key, self.edges)
            counts = np.append(edges[1:], len(key)) - edges
            syms = np.flatnonzero(counts)
            first, last = edges[syms], edges[syms] + counts[syms] - 1
            fresh = (key & np.uint32(1)).astype(bool)
            touched = fresh.copy()  # a new suffix changes its own prefix and that of the next one with the same first symbol
            touched[1:] |= fresh[:-1]
            touched[first] = fresh[first] | open_[syms]
            fresh[: counts[0]] = touched[: counts[0]] = False
            got = np.flatnonzero(touched)
            mine = key[got]
            of, place, new = mine >> np.uint32(24), (mine & np.uint32(0xFFFFFF)) >> np.uint32(1), fresh[got]
            row = (base + seen - edges)[of] + got
            rows.append(row[new])
            whose.append(who[k + np.searchsorted(at[k:end], place[new] + lo)])
            heads = got == edges[of]
            left = np.where(heads, 0, ((key[got - 1] & np.uint32(0xFFFFFF)) >> np.uint32(1)) + 1)
            padded = np.append(p, np.uint8(255))
            least = np.minimum.reduceat(padded, np.stack((left, place + 1), 1).ravel())[::2] if len(got) else np.empty(0, np.uint8)
            least[heads] = np.minimum(least[heads], run[of[heads]])
            value = np.minimum(least, 254) + np.uint8(1)
            value[heads & (seen[of] == 0)] = 0
            changed.append(row)
            values.append(value)
            tail = ((key[last] & np.uint32(0xFFFFFF)) >> np.uint32(1)).astype(np.int64) + 1
            ends = np.minimum.reduceat(padded, np.stack((tail, np.full(len(tail), len(p))), 1).ravel())[::2]
            run = np.minimum(run, p.min())
            run[syms] = ends
            open_[syms] = fresh[last]
            seen += counts
            lo, k = hi, end
        rows, whose = np.concatenate(rows), np.concatenate(whose)
        by = np.argsort(rows, kind="stable")
        rows, whose = rows[by], whose[by]
        changed, values = np.concatenate(changed), np.concatenate(values)
        by = np.argsort(changed, kind="stable")
        self._rewrite(rows, column[whose], changed[by], values[by])
        self.total += np.bincount(column[whose], minlength=256)
        return rows, whose

    def _rewrite(self, rows: np.ndarray, symbols: np.ndarray, changed: np.ndarray, values: np.ndarray) -> None:
        """Both files anew: new symbols at their rows, and the common prefixes that have changed."""
        before, rows_before = rows - np.arange(len(rows)), int(self.total.sum())
        out_s, out_p, lo, start = Tape(self.spool), Tape(self.spool), 0, 0
        for s, p in zip(self.symbols.blocks(self.block), self.prefixes.blocks(self.block), strict=True):
            hi = lo + len(s)
            a, b = np.searchsorted(before, (lo, hi))
            b = len(before) if hi == rows_before else b
            size = len(s) + b - a
            old = np.ones(size, bool)
            old[rows[a:b] - start] = False
            out = np.empty(size, np.uint8)
            out[old], out[~old] = s, symbols[a:b]
            out_s.write(out)
            out[old] = p
            c, d = np.searchsorted(changed, (start, start + size))
            out[changed[c:d] - start] = values[c:d]
            out_p.write(out)
            lo, start = hi, start + size
        self.symbols.close()
        self.prefixes.close()
        self.symbols, self.prefixes = out_s, out_p

    def groups(self, span: int):
        """For each length from the longest suffix down to `span`: the strings that have a suffix so long, and a number of it that equals another's
        if their first `span` bytes are equal. The rows come by following the symbols of each string through the transform."""
        s = np.concatenate([*self.symbols.blocks(self.block)]) if self.n else np.empty(0, np.uint8)
        group = np.concatenate([[0], np.cumsum(np.concatenate([*self.prefixes.blocks(self.block)])[1:] < span, dtype=np.int32)]) if self.n else s
        self.symbols.close()
        self.prefixes.close()
        order = np.argsort(s, kind="stable")[int(self.total[0]) :]
        to = np.empty(len(s), np.int32)
        to[order] = np.arange(self.n, self.n + len(order), dtype=np.int32)
        del order
        row, who = np.arange(self.n), np.arange(self.n)
        for j in range(len(self.columns) - 1):
            alive = self.columns[j][who] > 0
            row, who = to[row[alive]], who[alive]
            if j + 1 >= span:
                yield j + 1, who, group[row]


def earlier_windows(strings: list[bytes], first: np.ndarray, span: int = SPAN, block: int = BLOCK, spool: int = SPOOL) -> np.ndarray:
    """For each string the bits of its windows that also occur in a string of smaller `first`."""
    built = Collection(strings, block, spool)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    found = list(built.groups(span))
    bits = np.zeros(len(strings), np.int64)
    if found:
        least = np.full(max(int(g.max(initial=0)) for _, _, g in found) + 1, LAST)
        for _, who, g in found:
            np.minimum.at(least, g, first[who])
        for j, who, g in found:
            late = least[g] < first[who]
            bits[who[late]] |= np.int64(1) << (lengths[who[late]] - j)
    return bits


def _texts(batch: pa.RecordBatch, column: int):
    return C.slices(batch, column, rows=4096, limit=CHUNK)


def _anchor_blocks(bits: int, span: int):
    """Texts to blocks (bucket, 32-bit keys): each anchor once for a text, twice at most for all that a task has gathered."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        keys = keys[np.concatenate(([True, True], keys[2:] != keys[:-2]))[: len(keys)]]
        bucket = (keys >> np.uint64(32)).astype(np.int32)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.record_batch([pa.array(bucket[at]), pa.array([x.tobytes() for x in np.split(low, at[1:])], pa.binary())], ["bucket", "keys"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in _texts(batch, 0):
                which, _, _, h = anchored(part.column(0).to_pylist(), span)
                if len(h):
                    _, once = np.unique(mix(h + which.astype(np.uint64) * _G), return_index=True)  # once for each text
                    held.append(_short(h[once], bits))
                    n += len(once)
                if n >= KEYS:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)
        C.trim()

    return run


def _repeated_keys(batches):
    """Blocks sorted by bucket to the keys that they hold twice or more, bucket by bucket."""

    def out(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        low = np.sort(np.frombuffer(b"".join(held), np.uint32))
        low = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64)
        return pa.record_batch([pa.array(low | np.int64(bucket) << np.int64(32))], ["key"])

    now, held = None, []
    for batch in batches:
        for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield out(now, held)
                held = []
            now = bucket
            held.append(keys)
    if held:
        yield out(now, held)


def _filter_cells(words: int):
    def run(batches):
        for batch in batches:
            w, m = _bits(batch.column(0).to_numpy().astype(np.uint64), words)
            yield pa.record_batch([pa.array((w >> np.uint64(13)).astype(np.int32)), pa.array((w & np.uint64(8191)).astype(np.int32)), pa.array(m.view(np.int64))], ["chunk", "w", "m"])

    return run


def _filter_chunks(batches):
    """Cells sorted by chunk to the 8,192 words of each chunk."""
    now, table = None, np.zeros(8192, np.uint64)
    for batch in batches:
        chunk, w, m = (c.to_numpy() for c in batch.columns)
        edges = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(chunk) else []
        for a, b in zip(edges, [*edges[1:], len(chunk)], strict=True):
            if now is not None and chunk[a] != now:
                yield pa.record_batch([pa.array([now], pa.int32()), pa.array([table.tobytes()])], ["chunk", "bits"])
                table = np.zeros(8192, np.uint64)
            now = int(chunk[a])
            np.bitwise_or.at(table, w[a:b], m[a:b].view(np.uint64))
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([table.tobytes()])], ["chunk", "bits"])


def _candidates(bloom, bits: int, words: int, span: int):
    """Texts (did, mark, text) to the pieces (h, piece, did) whose anchor may be repeated."""

    def run(batches):
        table = bloom.value
        for batch in batches:
            for part in _texts(batch, 2):
                texts = part.column(2).to_pylist()
                which, start, count, h = anchored(texts, span)
                w, m = _bits(_short(h, bits), words)
                keep = np.flatnonzero((table[w] & m) == m)
                if len(keep):
                    which, start, end = which[keep], start[keep], start[keep] + count[keep] + span - 1
                    raws = [texts[i][a:b] for i, a, b in zip(which.tolist(), start.tolist(), end.tolist(), strict=True)]
                    yield pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(raws, pa.binary()), part.column(0).take(pa.array(which))], ["h", "piece", "did"])
        C.trim()

    return run


def _places(bloom, hot, bits: int, words: int, span: int):
    """Texts to places of pieces (key, did, mark, start, windows, bits). What is known of a frequent piece is looked up here: of its places only those that
    lose something stay, with null for the key, and runs that are lost whole are one place with bits -1."""

    def run(batches):
        table, known = bloom.value, hot.value
        for batch in batches:
            for part in _texts(batch, 2):
                texts, dids = part.column(2).to_pylist(), part.column(0).to_pylist()
                which, start, count, h = anchored(texts, span)
                w, m = _bits(_short(h, bits), words)
                keep = np.flatnonzero((table[w] & m) == m)
                out: list[tuple] = []
                last, begin, length = -1, -1, 0
                for i, a, n in zip(which[keep].tolist(), start[keep].tolist(), count[keep].tolist(), strict=True):
                    if length and (i != last or a > begin + length):
                        out.append((None, last, begin, length, -1))
                        length = 0
                    key = xxhash.xxh3_128_digest(texts[i][a : a + n + span - 1])
                    found = known.get(key)
                    if found is None:
                        out.append((key, i, a, n, None))
                    elif dids[i] > found[0]:
                        if not length:
                            last, begin = i, a
                        length += n
                    elif found[1]:
                        out.append((None, i, a, n, found[1]))
                if length:
                    out.append((None, last, begin, length, -1))
                if out:
                    key, i, *more = zip(*out, strict=True)
                    i, types = pa.array(i), (pa.int64(), pa.int32(), pa.int64())
                    columns = [pa.array(key, pa.binary()), part.column(0).take(i), part.column(1).take(i), *[pa.array(c, t) for c, t in zip(more, types, strict=True)]]
                    yield pa.record_batch(columns, ["key", "did", "mark", "start", "windows", "bits"])
        C.trim()

    return run


def _collections(span: int):
    """Pieces sorted by anchor (h, piece, first, n) to (key, first, n, bits), one collection after the other; an anchor's pieces stay together. A piece whose
    anchor no other has shares no window with any, so it needs no insertion."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        strings, first, anchor = [x[1] for x in held], np.array([x[2] for x in held], np.int64), np.array([x[0] for x in held], np.int64)
        same = anchor[1:] == anchor[:-1]
        some = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        bits = np.zeros(len(held), np.int64)
        if len(some):
            bits[some] = earlier_windows([strings[i] for i in some], first[some], span)
        return pa.record_batch(
            [pa.array(list(map(xxhash.xxh3_128_digest, strings)), pa.binary()), pa.array(first), pa.array([x[3] for x in held], pa.int64()), pa.array(bits)],
            ["key", "first", "n", "bits"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= COLLECTION and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield out(held)
        C.trim()

    return run


def _spans(lengths: np.ndarray, found, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each maximal removed run of some texts, in order: the text, begin and end there. All texts stand in one row, a place apart, so runs of two never meet."""
    counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    flat = found.flatten()
    start, windows, bits = (flat.field(c).to_numpy() for c in ("start", "windows", "bits"))
    base = np.cumsum(lengths + 1) - lengths - 1
    at = np.repeat(base, counts) + start
    whole = bits == -1
    width = np.arange(windows[~whole].max(initial=0))
    which, o = np.nonzero((bits[~whole, None] >> width & 1).astype(bool) & (width < windows[~whole, None]))
    single = at[~whole][which] + o
    begin, end = np.concatenate((at[whole], single)), np.concatenate((at[whole] + windows[whole], single + 1)) + (span - 1)
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1]))[: len(begin)])
    begin, end = begin[first], end[np.append(first[1:], len(end)) - 1] if len(first) else end
    of = np.searchsorted(base, begin, "right") - 1
    return of, begin - base[of], end - base[of]


def _kept(span: int):
    """Texts with their removed windows to what is left of them."""

    def run(batches):
        import hashlib

        for batch in batches:
            for part in C.slices(batch, 1, rows=4096, limit=4 << 20):
                texts = part.column(1).to_pylist()
                lengths = np.fromiter(map(len, texts), np.int64, len(texts))
                of, begin, end = _spans(lengths, part.column(2), span)
                n_spans = np.bincount(of, minlength=len(texts))
                edges = np.concatenate(([0], np.cumsum(n_spans)))
                gone = np.concatenate(([0], np.cumsum(end - begin)))[edges]
                removed = np.stack((begin, end), 1).ravel()
                cuts, digests = removed.tolist(), []
                for text, a, b in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    digest, at = hashlib.sha256(), 0
                    for k in range(2 * a, 2 * b, 2):
                        digest.update(text[at : cuts[k]])
                        at = cuts[k + 1]
                    digest.update(text[at:] if at else text)
                    digests.append(digest.hexdigest())
                yield pa.record_batch(
                    [part.column(0), pa.array(lengths), pa.array(np.diff(gone)), pa.array(n_spans), pa.array(digests), pa.ListArray.from_arrays(pa.array(2 * edges, pa.int32()), pa.array(removed))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
                )
        C.trim()

    return run


def _hot_windows(hot: DataFrame, span: int) -> DataFrame:
    """The same result (key, first, n, bits) for anchors with too many pieces for one task: every window is a string of its own, equal ones are combined
    before they shuffle, and what that says comes back to the pieces by a skew-safe join."""

    def windows(batches):
        for batch in batches:
            for part in C.slices(batch, 0, rows=2048, limit=1 << 18):
                key, which, of, at, firsts, ns = [], [], [], [], [], []
                for piece, first, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    name = xxhash.xxh3_128_digest(piece)
                    for o in range(len(piece) - span + 1):
                        key.append(name)
                        which.append(xxhash.xxh3_128_digest(piece[o : o + span]))
                        at.append(o)
                        firsts.append(first)
                        ns.append(n)
                yield pa.record_batch(
                    [pa.array(key, pa.binary()), pa.array(which, pa.binary()), pa.array(at, pa.int32()), pa.array(firsts, pa.int64()), pa.array(ns, pa.int64())],
                    ["key", "window", "at", "first", "n"],
                )

    rows = C.stage(hot.select("piece", "first", "n").mapInArrow(windows, "key binary, window binary, at int, first bigint, n bigint"), "windows")
    least = C.stage(rows.groupBy("window").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("held")), "least")
    back = C.lookup(rows, least, "window", "held", rows.count())
    one = F.when(F.col("least") < F.col("first"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at"))).otherwise(F.lit(0).cast("bigint"))
    return back.groupBy("key").agg(F.min("first").alias("first"), F.min("n").alias("n"), F.bit_or(one).alias("bits"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (places of the removed runs, begin and end in turn).

    A byte is removed if a string of `span` bytes covers it that also starts in a document of smaller id. Texts are UTF-8 bytes; null counts as empty;
    texts shorter than `span` stay whole. The id is an integer; null comes after all others; rows that share an id do not remove one another's bytes.
    An empty table gives no rows; other columns are ignored. `span` is 32 to 64.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    if not 32 <= span <= 64:
        raise ValueError("span must be 32 to 64")
    base = C.clean(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    base = base.withColumn("did", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))).withColumn("mark", F.xxhash64("text"))
    size = base.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(30, (size * 2 // (span - K + 2) // BUCKET).bit_length())
    blocks = base.select("text").mapInArrow(_anchor_blocks(bits, span), "bucket int, keys binary")
    keys = C.stage(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated_keys, "key bigint"), "anchors")
    words = C.filter_words(keys.count())
    cells = keys.mapInArrow(_filter_cells(words), "chunk int, w int, m bigint").repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros(words, np.uint64)
    for chunk, packed in cells.mapInArrow(_filter_chunks, "chunk int, bits binary").collect():  # MAX_WORDS words at most
        part = table[chunk * 8192 : (chunk + 1) * 8192]
        part[:] = np.frombuffer(packed, np.uint64)[: len(part)]
    bloom = spark.sparkContext.broadcast(table)
    C.release(spark)

    read = base.select("did", "mark", "text")
    found = read.mapInArrow(_candidates(bloom, bits, words, span), "h bigint, piece binary, did bigint")
    distinct = C.stage(found.groupBy("h", "piece").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")), "pieces", "zstd")
    C.release(spark)
    n_pieces = distinct.count()
    anchors = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > C.hot_limit(n_pieces)).select("h")
    anchors = C.stage(anchors, "hot")  # HOT_KEYS at most
    some = distinct.join(F.broadcast(anchors), "h", "left_anti").select("h", "piece", "first", "n")
    built = C.stage(
        some.repartition("h").sortWithinPartitions("h").mapInArrow(_collections(span), "key binary, first bigint, n bigint, bits bigint"), "built"
    )
    if not anchors.isEmpty():
        hot = distinct.join(F.broadcast(anchors), "h", "left_semi").select("piece", "first", "n")
        built = built.unionByName(C.stage(_hot_windows(hot, span), "built"))
    C.release(spark)

    n_places = built.agg(F.sum("n")).first()[0] or 0
    C.unstage(distinct)
    often = F.col("n") > max(64, n_places // C.HOT_KEYS)  # fewer than HOT_KEYS pieces
    hot = spark.sparkContext.broadcast({bytes(r["key"]): (r["first"], r["bits"]) for r in built.filter(often).select("key", "first", "bits").collect()})
    places = C.stage(read.mapInArrow(_places(bloom, hot, bits, words, span), "key binary, did bigint, mark bigint, start bigint, windows int, bits bigint"), "places")
    rest = places.filter("key IS NOT NULL").drop("bits").join(built.filter(~often).drop("n"), "key")
    rest = rest.withColumn("bits", F.when(F.col("did") > F.col("first"), F.lit(-1).cast("bigint")).otherwise(F.col("bits"))).filter("bits <> 0")
    columns = ["did", "mark", "start", "windows", "bits"]
    gone = places.filter("key IS NULL").select(*columns).unionByName(rest.select(*columns))
    gone = C.stage(gone.groupBy("did", "mark").agg(F.collect_set(F.struct("start", "windows", "bits")).alias("gone")), "gone")
    hot.destroy()
    C.unstage(places)
    bloom.destroy()
    C.release(spark)
    joined = base.join(gone, ["did", "mark"], "left").select("doc_id", "text", "gone")
    kind = dict(base.dtypes)["doc_id"]
    return joined.mapInArrow(
        _kept(span), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>"
    )
