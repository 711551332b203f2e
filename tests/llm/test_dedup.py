"""Exact and near dedup and repeated passages against brute force; nulls, ties, repeated rows, empty tables."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fleetcut.llm import _common as C
from fleetcut.llm.exact_dedup import drop_exact_copies, exact_groups
from fleetcut.llm.minhash import band_keys, near_groups, signature
from fleetcut.llm.passages import Fenwick, align, chains, repeated_passages
from fleetcut.llm.words import WordHashes, mix, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent):
    sets = {d: shingle_set(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_exact_groups(docs_of):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (7, ""), (8, " "), (1, "x" * 50_000), (2, "x" * 50_000), (None, "a b"), (6, "é b"), (11, "once"), (11, "once")]
    out = exact_groups(docs_of(rows)).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.kept): r for r in out}
    assert by[3, True].group_size == 4 and by[5, False].keep_id == 3 and by[9, False].keep_id == 3 and by[None, False].keep_id == 3
    assert by[4, True].group_size == 2 and by[7, False].keep_id == 4 and by[8, True].group_size == 1
    assert by[1, True].keep_id == 1 and by[2, False].keep_id == 1 and by[6, True].group_size == 1
    assert sorted(r.kept for r in out if r.doc_id == 11) == [False, True]
    assert exact_groups(docs_of([])).count() == 0


def test_drop_exact_copies_keeps_columns(docs_of):
    df = docs_of([(5, "a  b"), (3, "a\tb"), (4, None), (7, ""), (9, "z"), (9, "z")])
    out = drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 9]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 5000).select(F.xxhash64("id").alias("h"))
    bloom = C.bloom_of(keys, "h", C.filter_words(5000))
    rows = spark.range(0, 50_000)
    hit = C.probe(rows, F.xxhash64("id"), bloom, C.filter_words(5000), "hit").filter("hit")
    assert hit.filter("id < 5000").count() == 5000 and hit.count() < 5000 + 45_000 * 0.05
    full = C.probe(rows, F.xxhash64("id"), C.bloom_of(keys, "h", 1), 1, "hit").filter("hit and id < 5000")
    assert full.count() == 5000


def test_lookup_broadcasts_only_hot_keys(spark):
    rows = spark.range(0, 9000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id"))).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    assert C.lookup(rows, table, "k", "n", 9000).filter("(k = 0 and m = 0) or k = m").count() == 9000


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.comp for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(v) == c for v, c in got.items())
    assert set(got) == {v for a, b in edges if a != b for v in (a, b)}


def test_near_groups_equal_brute_force(docs_of):
    random.seed(11)
    letters = "abcdefghijklmnop"
    base = [[random.choice(letters) + random.choice(letters) for _ in range(n)] for n in (6, 30, 60)]
    rows = []
    for i in range(150):
        w = list(random.choice(base)) if i % 4 else [random.choice(letters) for _ in range(random.randint(0, 7))]
        for _ in range(random.randint(0, 5)):
            if w:
                w[random.randrange(len(w))] = random.choice(letters).upper()
        rows.append((i, "  ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "A B"), (904, "a b"), (905, "word " * 20_000), (906, "WORD " * 19_000)]
    for size in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs_of(rows), size).collect()}
        assert got == brute_components(rows, size, 80)


def test_near_groups_edges(docs_of):
    assert near_groups(docs_of([])).count() == 0
    out = {(r.doc_id, r.component_id, r.kept) for r in near_groups(docs_of([(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, None)]), 2).collect()}
    assert out == {(None, None, True), (2, 2, True), (1, 1, True)}


def test_signature_estimates_similarity():
    random.seed(5)
    for n in (3, 40, 2000):
        a = {mix(np.array([random.getrandbits(64)], np.uint64))[0] for _ in range(n)}
        b = set(sorted(a)[: int(n * 0.8)])
        x, y = (signature(np.array(sorted(s), np.uint64), 960) for s in (a, b))
        assert abs(float(np.mean(x == y)) - len(b) / len(a)) < 0.17
    same = signature(np.array(sorted(a), np.uint64), 240)
    assert (band_keys(same, 40, 6) == band_keys(same.copy(), 40, 6)).all() and len(set(band_keys(same, 40, 6).tolist())) == 40


def test_shingles_of_short_texts():
    h = WordHashes()
    assert len(shingles(h.of("a b"), 5)) == 1 and len(shingles(h.of(""), 5)) == 0 and len(shingles(h.of("a b c d e f"), 5)) == 2
    assert shingles(h.of("A b"), 2)[0] == shingles(h.of("a\nB"), 2)[0]


def test_fenwick_and_chains():
    random.seed(8)
    for _ in range(50):
        values = [random.random() for _ in range(20)]
        tree = Fenwick(20)
        for i, v in enumerate(values):
            tree.update(i, v, i)
        k = random.randint(1, 20)
        assert tree.prefix(k)[0] == max(values[:k])
    chain = chains([(0, 0, 20), (25, 24, 20), (50, 200, 10), (60, 60, 30)])[0]
    assert chain == [(0, 0, 20), (25, 24, 20), (60, 60, 30)]


def test_chains_equal_the_quadratic_recurrence():
    from fleetcut.llm import passages as P

    gain = lambda s, q, k: s - P.GAP * (k[0] - q[0] - q[2] + k[1] - q[1] - q[2]) - P.SHIFT * abs(k[0] - k[1] - q[0] + q[1])

    def best(segs):
        """Score of the best chain by trying every predecessor."""
        score = []
        for k in sorted(segs):
            before = [gain(s, q, k) for s, q in score if q[0] + q[2] <= k[0] and q[1] + q[2] <= k[1]]
            score.append((k[2] + max([0.0, *before]), k))
        return max(s for s, _ in score)

    def value(chain):
        out = 0.0
        for at, k in enumerate(chain):
            out = k[2] + (max(0.0, gain(out, chain[at - 1], k)) if at else 0.0)
        return out

    random.seed(15)
    assert chains([(200, 0, 40), (0, 200, 40), (245, 245, 30), (280, 282, 30)])[0] == [(245, 245, 30), (280, 282, 30)]
    for _ in range(1000):
        reach = random.choice((30, 100, 400))
        segs = list({(random.randrange(reach), random.randrange(reach), random.randint(5, 40)) for _ in range(random.randint(1, 40))})
        got = chains(segs)
        assert sorted(s for c in got for s in c) == sorted(segs)
        assert abs(value(got[0]) - best(segs)) < 1e-9


def test_long_gaps_align_exactly():
    from fleetcut.llm.passages import _lcs

    rng = np.random.default_rng(4)
    for n in (5, 60, 300):
        a, b = rng.integers(0, 40, n).astype(np.uint32), rng.integers(0, 40, n + 7).astype(np.uint32)
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
        assert _lcs(a, b) == row[-1]


def test_alignment_bridges_edits():
    random.seed(6)
    words = np.array([random.getrandbits(31) for _ in range(300)], np.uint32)
    other = np.concatenate([words[100:160], [7], words[160:170], words[172:220]]).astype(np.uint32)
    where = {int(w): i for i, w in enumerate(other)}
    anchors = np.array([(i, where[int(words[i])]) for i in range(300) if int(words[i]) in where and i % 5 == 0 and all(int(words[i + k]) in where and where[int(words[i + k])] == where[int(words[i])] + k for k in range(10) if i + 10 < 300)])
    assert align(words, other, anchors, 50) == [(100, 220, 0, 119, 118)]


def test_repeated_passages_cover_every_shared_window(docs_of):
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    passage, other = [word() for _ in range(60)], [word() for _ in range(90)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(random.randint(0, 120))]
        if i % 3 == 0:
            k = random.randint(0, len(w))
            w[k:k] = passage
        if i % 5 == 0:
            w += other[: random.randint(40, 90)]
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1].replace(" ", "\n")), (200, None), (201, ""), (202, "few words")]
    got = defaultdict(set)
    for r in repeated_passages(docs_of(rows)).collect():
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50
        got[r.doc_id].update(range(r.start_word, r.end_word))
    words = {d: (t or "").split() for d, t in rows}
    windows = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 50):
            windows[tuple(w[i : i + 51])].add(d)
    for d, w in words.items():
        need = {j for i in range(len(w) - 50) if min(windows[tuple(w[i : i + 51])]) < d for j in range(i, i + 51)}
        assert need <= got.get(d, set()), d
    clean = {d for d, w in words.items() if d % 3 and d % 5 and d < 100}
    assert not clean & set(got)
    assert repeated_passages(docs_of([])).count() == 0


def test_mosaics_and_repeats_keep_their_passages(docs_of):
    """Pieces of a passage that also stand in earlier documents, or often in the source, do not hide the passage."""
    random.seed(31)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows, want = [], {}
    for i in range(0, 400, 10):
        x, y = some(26), some(26)
        rows += [(i, some(9) + x + some(9)), (i + 1, some(9) + y + some(9)), (i + 2, some(20) + x + y + some(5)), (i + 3, some(7) + x + y + some(30))]
        want[i + 3] = set(range(7, 59))
    # each half stands first, in the middle and last in the source, but joined only in the middle
    x, y = some(26), some(26)
    rows += [(500, y + some(60) + x + some(60) + x + y + some(60) + y + some(60) + x), (501, some(11) + x + y + some(11))]
    want[501] = set(range(11, 63))
    got = defaultdict(set)
    for r in repeated_passages(docs_of([(i, " ".join(w)) for i, w in rows])).collect():
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert set(got) == set(want) and all(want[d] <= got[d] for d in want)


def edited(words, rate, word):
    """Words with a share `rate` of them replaced, dropped or doubled with new ones, at random places."""
    out = []
    for i, w in enumerate(words):
        draw = random.random()
        if draw >= rate or i < 2 or i >= len(words) - 2:
            out.append(w)
        elif draw < 0.7 * rate:
            out.append(word())
        elif draw < 0.85 * rate:
            out += [w, word()]
    return out


def test_edited_passages_are_found(docs_of):
    """Recall on passages of 60 to 150 words that are equal by 0.8 to 0.9 with their source."""
    from fleetcut.llm.passages import _lcs

    random.seed(77)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    rows, want = [], {}
    code = lambda words: np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint32)
    for i in range(0, 600, 2):
        passage = some(random.randint(60, 150))
        rows.append((i, some(random.randint(0, 80)) + passage + some(20)))
        before = some(random.randint(0, 60))
        other = edited(passage, random.uniform(0.1, 0.2), word)
        rows.append((i + 1, before + other + some(random.randint(0, 60))))
        want[i + 1] = (i, len(before), len(before) + len(other), _lcs(code(passage), code(other)) >= 0.8 * max(len(passage), len(other)))
    got = defaultdict(int)
    for r in repeated_passages(docs_of([(i, " ".join(w)) for i, w in rows])).collect():
        assert r.doc_id in want and r.source_id == want[r.doc_id][0], "clean documents are left alone"
        lo, hi = want[r.doc_id][1:3]
        got[r.doc_id] += max(0, min(hi, r.end_word) - max(lo, r.start_word))
    caught = [got[d] >= 0.5 * (hi - lo) for d, (_, lo, hi, alike) in want.items() if alike]
    assert len(caught) > 200 and sum(caught) >= 0.9 * len(caught)


def test_seeds_that_a_source_repeats(docs_of):
    """An edited passage is found in the middle of a source that repeats each of its seeds, and constant text costs no product of places."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    passage = some(80)
    parts = [passage[k : k + 16] for k in range(0, 80, 16)]
    source = [w for p in reversed(parts) for w in p + some(3)] + some(40) + passage + some(40) + [w for p in reversed(parts) for w in p + some(3)]
    rows = [(1, source), (2, some(10) + passage[:40] + [word()] + passage[41:] + some(10)), (3, ["word"] * 30_000), (4, ["word"] * 29_000 + some(5))]
    out = repeated_passages(docs_of([(i, " ".join(w)) for i, w in rows])).collect()
    assert any(r.doc_id == 2 and r.start_word <= 10 and r.end_word >= 90 and r.source_id == 1 for r in out)
    assert any(r.doc_id == 4 and r.start_word == 0 and r.end_word >= 29_000 for r in out) and all(r.doc_id in (2, 4) for r in out)


def test_passages_of_odd_tables(docs_of, spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    text = " ".join(word() for _ in range(70))
    rows = [(None, text), (1, text), (2, text.upper()), (3, None), (4, text), (4, text), (5, text + " x"), (5, "a b c"), (6, " ")]
    df = docs_of(rows).withColumn("words", F.lit("clash")).withColumn("seed", F.lit(1)).withColumn("place", F.lit(2))
    out = repeated_passages(df).collect()
    assert {(r.doc_id, r.source_id, r.start_word, r.end_word) for r in out if r.doc_id != 5} == {(2, 1, 0, 70), (4, 1, 0, 70)}
    assert {(r.source_id, r.end_word) for r in out if r.doc_id == 5} in ({(1, 70)}, set())
    assert repeated_passages(df.limit(0)).count() == 0


def test_near_groups_lose_few_links(docs_of):
    """Recall of links of similarity 0.8 to 0.85 for sets of 4 to 400 shingles."""
    random.seed(41)
    rows, pairs = [], []
    for i in range(0, 800, 2):
        n = random.choice((4, 9, 20, 60, 150, 400))
        a = [f"w{i}x{k}" for k in range(n + 1)]
        shared = -(-8 * n // 9)  # of two sets of n shingles that share s, the similarity is s / (2 n - s)
        b = a[: shared + 1] + [f"v{i}x{k}" for k in range(n - shared)]
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        pairs.append((i, i + 1))
    comp = {r.doc_id: r.component_id for r in near_groups(docs_of(rows), 2).collect()}
    linked = sum(comp[a] == comp[b] == a for a, b in pairs)
    assert linked == len(pairs)
    assert len({comp[a] for a, _ in pairs}) == len(pairs)


def test_near_groups_of_ids_with_several_texts(docs_of):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, b + " more"), (7, a + " x"), (7, b), (9, "else"), (9, None)]
    df = docs_of(rows).withColumn("n", F.lit(0)).withColumn("key", F.lit("clash")).withColumn("bands", F.lit(1))
    got = {(r.doc_id, r.component_id) for r in near_groups(df, 2).collect()}
    assert got == {(1, 1), (2, 1), (7, 1), (9, 9)}


def test_mixed_buckets_meet_by_rare_shingles(spark):
    """Many documents of one template under the threshold, a few of them alike: the exact join finds these and no others."""
    from fleetcut.llm import minhash as M

    random.seed(6)
    members = []
    for i in range(120):
        own = set(random.sample(range(10**6), 30))
        members.append((i, i, sorted(set(range(70)) | own)))
    alike = members[3][2][:96] + [-5, -6, -7, -8]
    members.append((500, 500, sorted(alike)))
    rows = spark.createDataFrame([(m, c, len(s), s) for m, c, s in members], "m long, comp long, n long, items array<bigint>")
    assert {r.m for r in M._may_link(rows, 80).collect()} == {3, 500}
    bucket = rows.select(F.lit(1).alias("key"), "m", "comp")
    got = {tuple(sorted((r.a, r.b))) for r in M._meet_in_blocks(bucket, rows, 80).collect()}
    want = {(a[0], b[0]) for a in members for b in members if a[0] < b[0] and 100 * len(set(a[2]) & set(b[2])) >= 80 * len(set(a[2]) | set(b[2]))}
    assert got == want == {(3, 500)}


def test_window_minima_and_hashes_by_doubling():
    """The same places as by looking at every window whole, and equal hashes for equal windows only."""
    from fleetcut.llm import passages as P

    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 23, 24, 50):
        for n in (size, size + 1, 200):
            v = rng.integers(0, 9, n).astype(np.uint64)
            view = np.lib.stride_tricks.sliding_window_view(v, size)
            assert P.first_smallest(v, size).tolist() == (view.argmin(1) + np.arange(len(view))).tolist()
            v = rng.integers(0, 2, n).astype(np.uint64)
            keys = [tuple(x) for x in np.lib.stride_tricks.sliding_window_view(v, size).tolist()]
            pairs = set(zip(keys, P.window_hashes(v, size).tolist(), strict=True))
            assert len(pairs) == len(set(keys)) == len({h for _, h in pairs})


def test_words_are_hashed_by_array_arithmetic():
    """Equal words have equal hashes wherever they stand, different ones do not; over blocks, long words, white space of all kinds, letters of any case."""
    from fleetcut.llm import passages as P
    from fleetcut.llm.words import WordSums

    rnd, sums = random.Random(41), WordSums()
    for block in (7, 64, 1 << 16):
        sums.BLOCK = block
        known: dict[str, int] = {}
        for _ in range(300):
            words = ["".join(rnd.choice("abAB\x00é𠮷 \ud800") for _ in range(rnd.randint(1, 9 if rnd.random() < 0.95 else 300))) for _ in range(rnd.randint(0, 40))]
            text = "".join(w + rnd.choice([" ", "\t", "\n ", "\x0b", "\f\r"]) for w in words)
            got = sums.of(text if rnd.random() < 0.5 else text.strip(" \t\n\x0b\f\r")).tolist()
            keys = [w.translate({65: 97, 66: 98}).replace("\ud800", "?") for w in words]
            assert len(got) == len(keys) and all(known.setdefault(k, h) == h for k, h in zip(keys, got, strict=True))
        assert len(set(known.values())) == len(known)
    assert [len(sums.of(t)) for t in (None, "", " \n")] == [0, 0, 0]
    words = sums.of(" ".join(rnd.choice("abc") for _ in range(3000)))
    runs = [tuple(words[i : i + P.K].tolist()) for i in range(len(words) - P.K + 1)]
    pairs = set(zip(runs, P.seeds_of(words).tolist(), strict=True))
    assert len(pairs) == len({r for r, _ in pairs}) == len({h for _, h in pairs})


def test_frequent_seeds_get_their_source_as_they_are_read(docs_of, monkeypatch):
    """Each seed row is kept once, a frequent seed's row with its first document beside it; the passages are those of a plain lookup."""
    rnd = random.Random(17)
    some = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage = some(60)
    rows = [(i, " ".join(some(12) + passage + some(9))) for i in range(9)] + [(20, " ".join(some(70)))]
    plain = sorted(repeated_passages(docs_of(rows)).collect())
    staged, stage = {}, C.stage

    def seen(df, tag, codec=None):
        out = stage(df, tag, codec)
        if tag == "maybe":
            staged["rows"] = out.collect()
        return out

    monkeypatch.setattr(C, "stage", seen)
    monkeypatch.setattr(C, "hot_limit", lambda total: 3)
    assert sorted(repeated_passages(docs_of(rows)).collect()) == plain and {r.doc_id for r in plain} == set(range(1, 9))
    held = defaultdict(list)
    for r in staged["rows"]:
        held[r.seed].append(r)
    assert any(len(x) == 9 for x in held.values())
    assert all(r.first == (min(y.doc_id for y in x) if len(x) > 3 else None) for x in held.values() for r in x)
