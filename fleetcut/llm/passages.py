"""Substring dedup by collinear chaining: shared k-mer seeds, gap-costed chains through a Fenwick tree, chain alignment."""

from __future__ import annotations

from bisect import bisect_left
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.llm import _common as C
from fleetcut.llm.exact_dedup import normalised
from fleetcut.llm.words import WordSums, mix

#: Words of a seed. Seeds whose hash is a multiple of SAMPLE are taken wherever they stand, and the smallest of any WINDOW seeds in a
#: row, so any K + WINDOW - 1 equal words share one, and edited passages share a SAMPLE-th of their equal runs' seeds.
K, WINDOW, SAMPLE = 5, 24, 6
#: Seeds that a document must share with a source to be aligned with it; seeds over which equal runs are told apart.
ANCHORS, AHEAD = 2, 256
#: A source that is broadcast to its users has so many words at most, and there are so many of them at most: 32 MiB.
HOT_WORDS, HOT_SOURCES = 1 << 14, 500
#: A gap between two seeds costs so many words for each word of it, and for each word that the two sides differ in length.
GAP, SHIFT = 0.05, 0.5
#: Words that differ in a row end an extension; the least share of equal words in a passage.
STOP, IDENTITY = 8, 0.8


_FACTORS = mix(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)


def seeds_of(words: np.ndarray) -> np.ndarray:
    """Hash of each run of K words, one finaliser for a run; words are hashes already."""
    n = len(words) - K + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = words[:n] * _FACTORS[0]
    for i in range(1, K):
        out += words[i : n + i] * _FACTORS[i]
    return mix(out)


def first_smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest value of each window of `size` values, the first on ties; windows of twice the width come from two of the width before."""
    at, best, wide = np.arange(len(values)), values, 1
    while wide < size:
        step = min(wide, size - wide)
        later = best[step:] < best[:-step]
        at, best = np.where(later, at[step:], at[:-step]), np.where(later, best[step:], best[:-step])
        wide += step
    return at


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, from hashes of runs of half its width."""
    out, wide = mix(words + np.uint64(size)), 1
    while wide < size:
        step = min(wide, size - wide)
        out = mix(mix(out[:-step]) + out[step:])
        wide += step
    return out


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the sampled seeds and of the smallest seed of every window of WINDOW seeds (the first on ties), in order."""
    if len(words) < K:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    seeds = seeds_of(words)
    taken = seeds % np.uint64(SAMPLE) == 0
    if len(seeds) <= WINDOW:
        taken[seeds.argmin()] = True
    else:
        taken[first_smallest(seeds, WINDOW)] = True
    at = np.flatnonzero(taken)
    return seeds[at], at


class Places:
    """Where each run of K words stands in a text."""

    def __init__(self, words: np.ndarray):
        self.runs = seeds_of(words.astype(np.uint64))

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.runs, kind="stable")

    @cached_property
    def sorted(self) -> np.ndarray:
        return self.runs[self.order]


def anchor(places: np.ndarray, here: Places, there: Places) -> np.ndarray:
    """Anchors (place here, place there) of the seeds at places. A seed that stands often there is anchored where most of the seeds
    behind it go on (told over AHEAD seeds; of those, nearest to the last anchor's diagonal), so repeats cost no product of places."""
    keys = here.runs[places]
    lo, hi = np.searchsorted(there.sorted, keys), np.searchsorted(there.sorted, keys, "right")
    if (hi - lo <= 1).all():
        one = hi > lo
        return np.column_stack([places[one], there.order[lo[one]]])
    out, i, n, last = [], 0, len(places), None
    while i < n:
        if hi[i] == lo[i]:
            i += 1
            continue
        x, ys, j = int(places[i]), there.order[lo[i] : hi[i]], i + 1
        while len(ys) > 1 and j < min(n, i + AHEAD):
            ahead = ys + (int(places[j]) - x)
            inside = ahead < len(there.runs)
            going = ys[inside][there.runs[ahead[inside]] == keys[j]]
            if not len(going):
                break
            ys, j = going, j + 1
        y = int(ys[0] if last is None else ys[np.abs(x - ys - last).argmin()])
        last = x - y
        while i < n:
            at = int(places[i]) - last
            if not 0 <= at < len(there.runs) or there.runs[at] != keys[i]:
                break
            out.append((int(places[i]), at))
            i += 1
    return np.array(out, np.int64).reshape(-1, 2)


class Fenwick:
    """Largest value, with who set it, over any prefix."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def update(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def prefix(self, i: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


class Fenwick2:
    """Largest value, with who set it, over any prefix of two coordinates: a Fenwick tree of sparse ones."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.best: dict[tuple[int, int], tuple[float, int]] = {}

    def update(self, i: int, j: int, value: float, who: int) -> None:
        i += 1
        while i <= self.n:
            k = j + 1
            while k <= self.m:
                if value > self.best.get((i, k), (float("-inf"), -1))[0]:
                    self.best[i, k] = (value, who)
                k += k & -k
            i += i & -i

    def prefix(self, i: int, j: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while i > 0:
            k = j
            while k > 0:
                out = max(out, self.best.get((i, k), out))
                k -= k & -k
            i -= i & -i
        return out


def chains(segments: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of segments (place here, place there, length) that ascend on both sides, best first.

    A chain scores its words less GAP for each word skipped on either side and SHIFT for each word that the diagonals
    differ. With i = here, j = there, the cost of a step is GAP * (di + dj) + SHIFT * |di - dj|, so once both places are
    added to the score the best predecessor is a prefix maximum on each side of the diagonal i - j. Segments come by their
    start here and enter once they end before it. On a diagonal no smaller, ending before here implies ending before
    there, so one Fenwick tree over diagonals serves; on a smaller one the end there is a second coordinate.
    """
    segs = sorted(segments)
    n = len(segs)
    if n == 1:
        return [segs]
    ends = sorted({s[1] + s[2] for s in segs})
    diagonals = sorted({s[0] - s[1] for s in segs})
    up, down = Fenwick2(len(diagonals), len(ends)), Fenwick(len(diagonals))
    score, before = [0.0] * n, [-1] * n
    pending = sorted(range(n), key=lambda k: segs[k][0] + segs[k][2])
    p = 0
    for k in sorted(range(n), key=lambda k: segs[k][0]):
        i, j, size = segs[k]
        while p < n and segs[pending[p]][0] + segs[pending[p]][2] <= i:
            q = pending[p]
            ei, ej = segs[q][0] + segs[q][2], segs[q][1] + segs[q][2]
            d = bisect_left(diagonals, ei - ej)
            up.update(d, bisect_left(ends, ej), score[q] + GAP * (ei + ej) + SHIFT * (ei - ej), q)
            down.update(len(diagonals) - 1 - d, score[q] + GAP * (ei + ej) - SHIFT * (ei - ej), q)
            p += 1
        d = bisect_left(diagonals, i - j)
        best, who = 0.0, -1
        for q in (up.prefix(d + 1, bisect_left(ends, j + 1))[1], down.prefix(len(diagonals) - d)[1]):
            if q >= 0:
                di, dj = i - segs[q][0] - segs[q][2], j - segs[q][1] - segs[q][2]
                gain = score[q] - GAP * (di + dj) - SHIFT * abs(di - dj)
                if gain > best:
                    best, who = gain, q
        score[k], before[k] = best + size, who
    used, out = [False] * n, []
    for k in sorted(range(n), key=lambda k: -score[k]):
        if used[k]:
            continue
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(segs[k])
            k = before[k]
        out.append(chain[::-1])
    return out


def _run(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Extend along a diagonal: words taken and how many of them are equal, up to STOP different ones in a row."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    off = np.flatnonzero(~same)
    taken = n
    if len(off) >= STOP:
        hit = np.flatnonzero(off[STOP - 1 :] - off[: len(off) - STOP + 1] == STOP - 1)
        if len(hit):
            taken = int(off[hit[0]])
    while taken and not same[taken - 1]:
        taken -= 1
    return taken, int(np.count_nonzero(same[:taken]))


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in a best alignment of two gaps of any length, by bit-parallel dynamic programming (one bit a word of b)."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        if at := row & places.get(x, 0):
            row = (row + at | row - at) & full
    return len(b) - row.bit_count()


def align(a: np.ndarray, b: np.ndarray, anchors: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, start there, end there, equal words) of at least `least` words, from anchors (here, there)."""
    order = np.lexsort((anchors[:, 0], anchors[:, 0] - anchors[:, 1]))
    x, y = anchors[order, 0], anchors[order, 1]
    new = np.r_[True, (np.diff(x - y) != 0) | (np.diff(x) > K)]
    first = np.flatnonzero(new)
    final = np.r_[first[1:], len(x)] - 1
    segments = list(zip(x[first].tolist(), y[first].tolist(), (x[final] - x[first] + K).tolist(), strict=True))
    out: list[tuple[int, int, int, int, int]] = []
    for chain in chains(segments):
        i, j, size = chain[0]
        if any(lo <= i and i + size <= hi and lo2 <= j and j + size <= hi2 for lo, hi, lo2, hi2, _ in out):
            continue
        back, same = _run(a[:i][::-1], b[:j][::-1])
        lo, lo2, equal = i - back, j - back, same + size
        at, at2 = i + size, j + size
        for i, j, size in chain[1:]:
            gap = _lcs(a[at:i], b[at2:j])
            wide = max(i - at, j - at2)
            if wide - gap > max(STOP, (1 - IDENTITY) * (equal + gap + size)):
                ahead, same = _run(a[at:i], b[at2:j])
                out.append((lo, at + ahead, lo2, at2 + ahead, equal + same))
                back, same = _run(a[at + ahead : i][::-1], b[at2 + ahead : j][::-1])
                lo, lo2, equal = i - back, j - back, same
            else:
                equal += gap
            equal += size
            at, at2 = i + size, j + size
        ahead, same = _run(a[at:], b[at2:])
        out.append((lo, at + ahead, lo2, at2 + ahead, equal + same))
    found: list[tuple[int, int, int, int, int]] = []
    for p in sorted(set(out)):
        if p[1] - p[0] >= least and p[4] >= IDENTITY * max(p[1] - p[0], p[3] - p[2]) and not (found and p[1] <= found[-1][1]):
            found.append(p)
    return found


def _map_words(docs: DataFrame, what: str) -> DataFrame:
    """what = seeds: rows (doc_id, seed, place); words: one row (doc_id, words) with 32-bit word hashes."""
    import pyarrow as pa

    seeds = what == "seeds"
    more = [T.StructField("seed", T.LongType()), T.StructField("place", T.IntegerType())] if seeds else [T.StructField("words", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], *more])

    def run(batches):
        hashes = WordSums()
        for batch in batches:
            for part in C.slices(batch):
                texts = [hashes.of(t) for t in part.column(1).to_pylist()]
                if not seeds:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([(w >> np.uint64(32)).astype("<u4").tobytes() for w in texts], pa.binary())], schema.fieldNames())
                    continue
                found = [minimisers(w) for w in texts]
                src = np.repeat(np.arange(len(texts)), [len(p) for _, p in found])
                key = np.concatenate([h for h, _ in found]).view(np.int64)
                place = np.concatenate([p for _, p in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(src, pa.int64())), pa.array(key), pa.array(place)], schema.fieldNames())
        hashes.clear()
        C.trim()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def open_windows(n: int, least: int, places: np.ndarray, hashes: np.ndarray, earlier: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Start, and place of the first own seed, of each window of `least` of n words that an earlier document may hold and
    that no span covers. A window's own seeds are those that its words alone choose: they lie from the smallest of its
    first WINDOW seeds to the smallest of its last, every copy of the window has them, and all must be earlier ones."""
    wide = least - K + 1
    if n < least or wide < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    dense = np.full(n - K + 1, ~np.uint64(0))
    dense[places] = hashes
    size = min(WINDOW, wide)
    smallest = first_smallest(dense, size)
    start = np.arange(n - least + 1)
    first, last = smallest[start], smallest[start + wide - size]
    chosen, known = np.zeros(len(dense) + 1, np.int64), np.zeros(len(dense) + 1, np.int64)
    chosen[places + 1], known[places + 1] = 1, earlier
    chosen, known = chosen.cumsum(), known.cumsum()
    seen = chosen[last + 1] - chosen[first]
    ok = (chosen[first + 1] > chosen[first]) & (seen > 0) & (known[last + 1] - known[first] == seen)
    for lo, hi in spans:
        ok[lo : max(lo, hi - least + 1)] = False
    return start[ok], first[ok]


def _open_windows(seeds: DataFrame, known: DataFrame, texts: DataFrame, found: DataFrame, least: int, id_type: str) -> DataFrame:
    """Rows (doc_id, start, seed, ahead): windows that no row of `found` covers though an earlier document may hold them.
    seed: the window's first own seed, `ahead` words behind its start."""
    import pyarrow as pa

    told = known.filter("source_id < doc_id").select("doc_id", "place", "seed")
    ids = C.stage(told.select(F.xxhash64("doc_id").alias("h")).distinct(), "told")
    words = C.filter_words(ids.count())
    bloom = C.stage(C.bloom_of(ids, "h", words), "bloom")
    own = C.probe(seeds.select("doc_id", "place", "seed"), F.xxhash64("doc_id"), bloom, words, "maybe").filter("maybe").drop("maybe")
    both = own.withColumn("earlier", F.lit(False)).unionByName(told.withColumn("earlier", F.lit(True)))
    mine = both.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "earlier", "seed"))).alias("seeds"))
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    sizes = texts.select("doc_id", (F.length("words") / 4).cast("int").alias("n"))
    rows = mine.join(sizes, "doc_id").join(spans, "doc_id", "left")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                seeds_, spans_ = part.column("seeds")[0].values, part.column("spans")[0].values
                places, hashes = seeds_.field("place").to_numpy().astype(np.int64), seeds_.field("seed").to_numpy().view(np.uint64)
                earlier = seeds_.field("earlier").to_numpy(zero_copy_only=False)
                last = np.r_[places[1:] != places[:-1], True][: len(places)]  # of a place's two rows that which says it is an earlier one
                places, hashes, earlier = places[last], hashes[last], earlier[last]
                covered = [] if spans_ is None else list(zip(spans_.field("start_word").to_pylist(), spans_.field("end_word").to_pylist(), strict=True))
                start, place = open_windows(part.column("n")[0].as_py(), least, places, hashes, earlier, covered)
                seed = hashes[np.searchsorted(places, place)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(np.zeros(len(start), np.int64))), pa.array(start), pa.array(seed), pa.array((place - start).astype(np.int32))],
                    ["doc_id", "start", "seed", "ahead"],
                )

    return rows.select("doc_id", "seeds", "spans", "n").mapInArrow(run, f"doc_id {id_type}, start long, seed long, ahead int")


def _window_keys(places: DataFrame, texts: DataFrame, least: int, id_type: str) -> DataFrame:
    """Rows (doc_id, start, window): a hash of the `least` words from each start."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                words = np.frombuffer(part.column("words")[0].as_buffer(), "<u4").astype(np.uint64)
                starts = part.column("starts")[0].values.to_numpy()
                starts = starts[(starts >= 0) & (starts + least <= len(words))]
                keys = window_hashes(words, least)[starts].view(np.int64) if len(starts) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array([0] * len(starts), pa.int64())), pa.array(starts, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "start", "window"])

    rows = places.groupBy("doc_id").agg(F.collect_set("start").alias("starts")).join(texts, "doc_id")
    return rows.select("doc_id", "starts", "words").mapInArrow(run, f"doc_id {id_type}, start long, window long")


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least `least` words that a document shares with an earlier one, exactly or nearly.

    Rows: doc_id, start_word, end_word, source_id, source_start, source_end, n_equal. Words are lower-cased (A-Z). Texts
    with equal words are one class: its smallest id takes part, and each other member gets one row for its whole text if it is
    long enough. Each seed points to its smallest document only, a star, so anchors grow with the text and not
    with the pairs of documents that share a passage. A document is compared with the sources its own seeds name. Windows
    of `least` words that no such passage covers, though an earlier document may hold them, are then looked up whole and
    point to the smallest document that holds the window, so every window that an earlier document shares is covered
    (if it has K + WINDOW - 1 words or more).

    Null or short texts and null ids have no passages; equal rows are one document, and of an id with different texts that of the smallest
    digest takes part; of ties the smallest id or place is the source. Long texts are compared whole; other columns are ignored; an empty
    table gives no rows.
    """
    C.small_batches(docs.sparkSession)
    base = C.clean(docs, id_col, text_col).filter("doc_id is not null and text is not null")
    digest = F.sha2(F.trim(normalised(F.col("text"))).cast("binary"), 256)
    keyed = C.stage(base.select("doc_id", digest.alias("key")), "keys")
    several = C.stage(keyed.groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("z")).filter("first <> z").drop("z"), "several")
    if not several.isEmpty():
        words = C.filter_words(several.count())
        bloom = C.stage(C.bloom_of(several.select(F.xxhash64("doc_id").alias("h")), "h", words), "bloom")
        marked = C.probe(base, F.xxhash64("doc_id"), bloom, words, "maybe")
        firsts = marked.filter("maybe").select("doc_id", "text").join(several, "doc_id", "left").filter(F.col("first").isNull() | (F.col("first") == digest))
        base = marked.filter("not maybe").select("doc_id", "text").unionByName(firsts.select("doc_id", "text"))
        keyed = C.stage(base.select("doc_id", digest.alias("key")), "keys")
    total = keyed.count()
    classes = C.stage(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    copies = C.lookup(keyed, classes.filter("members > 1"), "key", "members", total).filter("doc_id <> rep").select("doc_id", "rep").distinct()
    copies = C.stage(copies, "copies")
    words = C.filter_words(copies.count())
    bloom = C.stage(C.bloom_of(copies.select(F.xxhash64("doc_id").alias("h")), "h", words), "bloom")
    marked = C.probe(base, F.xxhash64("doc_id"), bloom, words, "maybe")
    drop = copies.select("doc_id").distinct()
    reps = marked.filter("not maybe").select("doc_id", "text").unionByName(marked.filter("maybe").select("doc_id", "text").join(drop, "doc_id", "left_anti"))

    seeds = C.stage(_map_words(reps, "seeds"), "seeds")
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("source_id <> last")
    shared = C.stage(shared.drop("last"), "shared")
    C.release(docs.sparkSession)
    n_shared, n_rows = shared.agg(F.count(F.lit(1)), F.sum("n")).first()
    words = C.filter_words(n_shared)
    bloom = C.stage(C.bloom_of(shared.select("seed"), "seed", words), "bloom")
    hot = F.col("n") > C.hot_limit(n_rows or 0)  # HOT_KEYS at most; their sources come to each seed once, as it is read
    firsts = F.broadcast(shared.filter(hot).select(F.col("seed").alias("__k"), F.col("source_id").alias("first")))
    marked = seeds.join(firsts, F.col("seed") == F.col("__k"), "left").drop("__k")
    maybe = C.stage(C.probe(marked, F.col("seed"), bloom, words, "maybe").filter("maybe").drop("maybe"), "maybe")
    told = maybe.filter("first IS NOT NULL").withColumnRenamed("first", "source_id")
    rest = maybe.filter("first IS NULL").drop("first").join(shared.filter(~hot).drop("n"), "seed")
    known = C.stage(told.unionByName(rest), "known")
    for table in (keyed, maybe, shared):
        C.unstage(table)
    C.release(docs.sparkSession)
    uses = known.filter("doc_id <> source_id").groupBy("doc_id", "source_id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    pairs = uses.filter(F.size("places") >= ANCHORS)
    pairs = C.stage(pairs, "pairs")
    C.release(docs.sparkSession)

    ends = pairs.select("doc_id").unionByName(pairs.select(F.col("source_id").alias("doc_id"))).distinct()
    ends = C.stage(ends, "ends")
    words = C.filter_words(ends.count())
    bloom = C.stage(C.bloom_of(ends.select(F.xxhash64("doc_id").alias("h")), "h", words), "bloom")
    some = C.probe(reps, F.xxhash64("doc_id"), bloom, words, "maybe").filter("maybe").select("doc_id", "text")
    texts = C.stage(_map_words(some, "words").join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "words", "zstd")
    by_source = pairs.groupBy("source_id").agg(F.count(F.lit(1)).alias("uses"))
    sources = C.stage(by_source.join(texts.select(F.col("doc_id").alias("source_id"), F.col("words").alias("source_words")), "source_id"), "sources")
    C.release(docs.sparkSession)
    small = F.length("source_words") <= 4 * HOT_WORDS
    joined = C.lookup(pairs.join(texts, "doc_id"), sources, "source_id", "uses", pairs.count(), most=HOT_SOURCES, small=small)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        source, there = None, None
        for batch in batches:
            for part in C.slices(batch, 3, 256):
                src, got = [], []
                for row, (places, one, two) in enumerate(zip(part.column(2), part.column(3), part.column(4), strict=True)):
                    a, b = np.frombuffer(one.as_buffer(), "<u4"), np.frombuffer(two.as_buffer(), "<u4")
                    if source is None or not np.array_equal(source, b):
                        source, there = b.copy(), Places(b)
                    at = anchor(places.values.to_numpy().astype(np.int64), Places(a), there)
                    for p in align(a, b, at, least) if len(at) else ():
                        src.append(row)
                        got.append(p)
                take = pa.array(src, pa.int64())
                cols = [pa.array([p[i] for p in got], pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), cols[0], cols[1], part.column(1).take(take), *cols[2:]],
                    ["doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "n_equal"],
                )
        C.trim()

    schema = f"doc_id {id_type}, start_word long, end_word long, source_id {id_type}, source_start long, source_end long, n_equal long"
    cols = ["doc_id", "source_id", "places", "words", "source_words"]
    star = C.stage(joined.select(*cols).mapInArrow(run, schema), "star")
    for table in (pairs, sources):
        C.unstage(table)
    C.release(docs.sparkSession)
    # a window shared with an earlier document has its first seed there at the same distance from its start
    gaps = C.stage(_open_windows(seeds, known, texts, star, least, id_type), "open")
    C.unstage(seeds)
    C.release(docs.sparkSession)
    asked = C.stage(gaps.groupBy("seed").agg(F.collect_set("ahead").alias("aheads")), "asked")
    words = C.filter_words(asked.count())
    bloom = C.stage(C.bloom_of(asked.select("seed"), "seed", words), "bloom")
    holders = C.probe(known, F.col("seed"), bloom, words, "maybe").filter("maybe").join(asked, "seed")
    starts = holders.select("doc_id", F.explode(F.transform("aheads", lambda x: (F.col("place") - x).cast("bigint"))).alias("start")).distinct()
    windows = C.stage(_window_keys(starts, texts, least, id_type), "windows")
    C.release(docs.sparkSession)
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("f"))
    wanted = windows.join(gaps.select("doc_id", "start").distinct(), ["doc_id", "start"], "left_semi").join(first, "window").filter("f.doc_id < doc_id")
    steps = F.array(*[F.lit(k) for k in sorted({*range(0, least - K + 1, K), max(0, least - K)})])
    at = F.explode(F.transform(steps, lambda k: (F.col("start") + k).cast("int"))).alias("place")
    further = wanted.select("doc_id", F.col("f.doc_id").alias("source_id"), at).groupBy("doc_id", "source_id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    further = further.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("source_id"), F.col("words").alias("source_words")), "source_id")
    fuzzy = star.unionByName(further.select(*cols).mapInArrow(run, schema)).distinct()
    n = F.size(F.split(F.trim(normalised(F.col("text"))), " ")).cast("long")
    lengths = C.probe(base, F.xxhash64("doc_id"), C.stage(C.bloom_of(copies.select(F.xxhash64("rep").alias("h")), "h", C.filter_words(copies.count())), "bloom"), C.filter_words(copies.count()), "maybe")
    lengths = lengths.filter("maybe").select(F.col("doc_id").alias("rep"), n.alias("n")).groupBy("rep").agg(F.max("n").alias("n"))
    per_rep = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("k"))
    whole = C.lookup(copies, C.stage(per_rep.join(lengths, "rep"), "lengths"), "rep", "k", total).filter(F.col("n") >= least)
    zero = F.lit(0).cast("long")
    exact = whole.select("doc_id", zero.alias("start_word"), F.col("n").alias("end_word"), F.col("rep").alias("source_id"), zero.alias("source_start"), F.col("n").alias("source_end"), F.col("n").alias("n_equal"))
    return fuzzy.unionByName(exact)
