"""Repair of conversations, removal of repeated strings, the prefix trie, and texts that once ended or hung a job."""

import hashlib
import itertools
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fleetcut.llm import repair as R
from fleetcut.llm import suffixes as S
from fleetcut.llm import trie as Z
from fleetcut.llm.html_text import extract_main_text
from fleetcut.llm.packing import pack_documents
from fleetcut.llm.queries import damaged, rebuilt


def cheapest(codes):
    """Least cost and ASCII-least audit by a table over all prefixes."""
    table = {0: (0, "")}
    for initial, fault in [*codes, (None, None)]:
        for _ in range(3):
            for q, (c, a) in list(table.items()):
                to = R.LEADS[q][R.SAYS[q][0]]
                table[to] = min(table.get(to, (1 << 30, "")), (c + 2, a + "I"))
        if initial is None:
            return min(table[q] for q in (0, 3) if q in table)
        new = {}
        for q, (c, a) in table.items():
            moves = [(c + 3, a + "D", q)]
            if fault != 1:
                late = fault == 2
                if initial in R.LEADS[q]:
                    moves.append((c + late, a + "K", R.LEADS[q][initial]))
                moves.append((c + 2 + late, a + "R", R.LEADS[q][R.SAYS[q][0]]))
            for cost, audit, to in moves:
                new[to] = min(new.get(to, (1 << 30, "")), (cost, audit))
        table = new


def test_edits_are_cheapest_and_least(monkeypatch):
    random.seed(7)
    for codes in itertools.product([("s", 0), ("u", 0), ("a", 0), ("", 0), ("u", 1), ("a", 2)], repeat=3):
        assert R.cheapest_edits(list(codes)) == cheapest(codes), codes
    for block in (3, 64):
        monkeypatch.setattr(R, "BLOCK", block)
        for _ in range(150):
            codes = [(random.choice(["s", "u", "a", "u", "a", ""]), random.choice([0, 0, 0, 1, 2])) for _ in range(random.randint(0, 30))]
            assert R.cheapest_edits(codes) == cheapest(codes), codes
    start = time.time()
    long = [(random.choice("ua"), random.choice([0, 0, 0, 0, 1, 2])) for _ in range(5000)]
    assert R.cheapest_edits(long) == cheapest(long) and time.time() - start < 30


CONV = "conv_id long, turn int, role string, text string, text_sha256 string, fault string, nth string"


def conversation_rows(rows):
    return [(*r, "x", "x", "x") for r in rows]


def test_conversations_are_repaired(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."), (1, 3, "user", "Well?"), (1, 3, "user", "Well?"), (1, 4, "assistant", " \t"), (1, 5, "assistant", "no end"),
        (2, None, None, None), (2, 1, "tool", "x."), (None, 0, "user", "q."), (None, 1, "assistant", "a!"), (3, 2, "user", "u." * 3000), (3, 2, "user", "u." * 3000),
    ]
    df = spark.createDataFrame(conversation_rows(rows), CONV)
    ids = spark.createDataFrame([(1,), (2,), (None,), (9,)], "c long")
    got = {r.conv_id: r for r in R.repair_conversations(df, ids=ids).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.audit, one.cost) == (1, 1, 1, 1, 2, "KKKDDK", 7)
    assert one.repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Hi.\nuser:Well?\nassistant:no end").hexdigest()
    assert (got[2].gaps, got[2].blank, got[2].audit, got[2].cost) == (0, 1, "DD", 6)
    assert got[None].audit == "KK" and got[9].audit == "" and got[9].repaired_sha256 == hashlib.sha256().hexdigest() and set(got) == {1, 2, None, 9}
    steps = {(r.conv_id, r.step): (r.edit, r.role, r.text) for r in R.repair_conversations(df, steps=True).collect()}
    assert steps[1, 2] == ("K", "user", "Well?") and steps[1, 3] == ("D", None, "Well?") and steps[3, 2] == ("I", "assistant", "")
    assert R.repair_conversations(df.limit(0)).count() == 0


def test_long_conversations_wait_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD", 50)
    messages = R._Messages()
    for i in range(40):
        messages.add("user", f"text {i}")
    assert messages.file and [t for _, t in messages] == [f"text {i}" for i in range(40)]


def test_damage_follows_the_checksum(spark, small):
    import zlib

    rows = spark.read.parquet(f"{small}/conversations.parquet")
    want = []
    for r in rows.collect():
        fate = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in r.text if c not in ".!?") if fate == 2 else r.text
        want += [(r.conv_id, r.turn, "user" if fate == 4 else r.role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(tuple, damaged(rows).drop("copy").collect())) == sorted(want)


def test_windows_of_a_collection_equal_brute_force():
    random.seed(1)
    for _ in range(200):
        letters, span = random.choice(["ab", "abc", "abcdefgh", "a", "aé"]), random.randint(1, 6)
        strings = ["".join(random.choice(letters) for _ in range(random.randint(1, 14))).encode() for _ in range(random.randint(1, 12))]
        first = np.array([random.randint(0, 5) for _ in strings])
        got = S.earlier_windows(strings, first, span, block=random.choice([1, 2, 3, 7, 1000]), spool=random.choice([1, 4096]))
        want = [sum(1 << o for o in range(len(s) - span + 1) if any(s[o : o + span] in t and first[k] < first[i] for k, t in enumerate(strings))) for i, s in enumerate(strings)]
        assert list(got) == want


def test_pieces_hold_every_window_once(monkeypatch):
    random.seed(2)
    for chunk in (1 << 19, 64):
        monkeypatch.setattr(S, "CHUNK", chunk)
        for text in (b"", b"x" * 49, b"x" * 50, b"a" * 3000, b"ab" * 700, bytes(random.randrange(97, 123) for _ in range(2000)), b"x" * 20 + b"hello world" * 300):
            start, count, _ = S.pieces(text)
            assert [a + k for a, n in zip(start, count, strict=True) for k in range(n)] == list(range(len(text) - 49)) and max(count, default=0) <= 27


def removed_plain(rows, span=50):
    first: dict[bytes, int] = {}
    raw = [((S.LAST if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            first[w] = min(first.get(w, S.LAST), i)
    out = []
    for (i, _), (did, b) in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < did:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), bytes(gone).replace(b"\0\1", b"\0|").count(b"|") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_repeated_strings_are_removed(docs_of, spark, monkeypatch, hot):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(2, 8)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = [(i, " ".join(word() for _ in range(random.randint(0, 20))) + random.choice([*passage, "", passage[0] + passage[1]]) + " ".join(word() for _ in range(12))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1]), (103, "y" * 400), (104, "z" + "y" * 300), (None, rows[1][1]), (None, rows[1][1] + "!"), (7, rows[3][1] + "other")]
    monkeypatch.setattr(S.C, "hot_limit", lambda total: hot)
    out = S.remove_repeats(docs_of(rows))
    assert sorted([tuple(r)[:5] for r in out.collect()], key=repr) == removed_plain(rows)
    text = {r.doc_id: (r.removed, r.n_removed) for r in out.filter("doc_id is not null").collect()}
    assert all(sum(b - a for a, b in zip(x[::2], x[1::2], strict=True)) == n for x, n in text.values())
    assert S.remove_repeats(docs_of([])).count() == 0


def test_repeats_in_long_white_space(docs_of, spark):
    start = time.time()
    rows = [(1, "a" + " " * 1_000_000), (2, "b" + " " * 60), (3, "\n" * 2_000_000)]
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 60, 3: 0} and time.time() - start < 60


def test_two_fattest():
    for b in range(1, 70):
        for a in range(b):
            best = max(range(a + 1, b + 1), key=lambda x: x & -x)
            assert Z.two_fattest(a, b) == best


def test_exit_nodes_and_members():
    random.seed(5)
    for _ in range(100):
        trie, paths = Z.ZFastTrie(), []
        for name in range(25):
            turns = [random.choice("ab") for _ in range(random.randint(0, 12))]
            if paths and random.random() < 0.5:
                turns = random.choice(paths)[: random.randint(0, 12)] + turns[:3]
            paths.append(turns)
            keys = [Z.ROOT, *["".join(turns[: d + 1]).encode() for d in range(len(turns))]]
            node, depth = trie.exit_node(keys)
            known = {tuple(p[:d]) for p in paths[:-1] for d in range(len(p) + 1)}
            assert depth == max(d for d in range(len(turns) + 1) if tuple(turns[:d]) in known or d == 0)
            trie.insert(name, keys)
        count, least = trie.members()
        for node in range(1, len(trie.top)):
            for d in range(trie.top[node] + 1, trie.end[node] + 1):
                prefix = trie.paths[trie.path[node]][d].decode()
                inside = [i for i, p in enumerate(paths) if "".join(p[:d]) == prefix and len(p) >= d]
                assert (count[node], least[node]) == (len(inside), min(inside))


def trie_plain(paths):
    """paths: conv to list of (role, text)."""
    nodes: dict[tuple, list[int]] = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [q for q in nodes if q[: len(prefix)] == prefix]
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(prefix))))
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(len(q) == len(prefix) + 1 for q in below),
            sum(not any(x[: len(q)] == q and len(x) > len(q) for x in below) for q in below), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


@pytest.mark.parametrize("batch", [50_000, 4])
def test_trie_equals_plain(spark, monkeypatch, batch):
    monkeypatch.setattr(Z, "BATCH", batch)
    monkeypatch.setattr(Z, "IDS", 3)
    random.seed(batch)
    paths = {}
    for c in [*range(-3, 25), 100, 150, 237]:
        head = random.choice(list(paths.values()))[: random.randint(0, 6)] if paths and random.random() < 0.7 else []
        paths[c] = head + [(random.choice("us"), random.choice(["", "a", "bé", "long text"])) for _ in range(random.randint(0, 3))]
    paths[30], paths[31] = paths[24], [("u", "x")] * 9
    rows = [(c, d, r, t, "x", "x", "x") for c, p in paths.items() for d, (r, t) in enumerate(p)] + [(None, 0, "u", "x", "x", "x", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, place int, role string, text string, key string, depth string, tokens string")
    out = Z.prefix_trie(turns, spark.createDataFrame([(c,) for c in [*paths, None]], "c long"))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == sorted(trie_plain(paths), key=lambda r: r[:2])
    assert Z.prefix_trie(turns.limit(0), spark.createDataFrame([], "c long")).count() == 0


def test_rebuilt_conversations(spark):
    import zlib

    rows = [(c, t, "u", f"{c}-{t}") for c in (0, 1, 2, 99, 101, 205, 200) for t in range(c % 4 + 2)] + [(3, None, None, None), (3, 0, "a", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    own = {c: [(r or "", t or "") for _, r, t in sorted(((-1 if k is None else k, r, t) for i, k, r, t in rows if i == c), key=lambda x: x[0])] for c in {r[0] for r in rows}}
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    got: dict[int, list] = {c: [] for c in own}
    for r in rebuilt(df).orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == want


@pytest.mark.parametrize("unit", [" ", "\n", "a", "1"])
def test_very_long_runs_are_packed(docs_of, spark, unit):
    from tokenizers import Tokenizer

    start = time.time()
    text = "b " + unit * 2_000_000
    out = pack_documents(docs_of([(1, text), (2, "x <|endoftext|>" + unit * 100)]), P.path("byte_bpe_50k.json"), P.PATTERN).filter("doc_id = 1")
    n = out.agg(F.sum("length")).first()[0]
    assert time.time() - start < 40
    assert n == len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids) + 1


def test_pages_of_unclosed_tags_end(spark):
    start = time.time()
    pages = [(i, "u", (unit * 1_000_000)[:1_000_000]) for i, unit in enumerate(("<a ", '<p a="', "<!--", "</p", "<script>", "<script></script ", "<p a='>"))]
    pages.append((99, "u", "<html><body><article><p>" + "A sentence of some words here. " * 20 + "</p></article><a "))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert time.time() - start < 60 and got[99].startswith("A sentence") and len(got) == 8


def test_removed_runs_of_a_slice_are_found_at_once():
    """The runs of many texts by array arithmetic equal those of a loop over every removed window; what is left and its digest follow."""
    import pyarrow as pa

    rnd, span = random.Random(19), 50
    kind = pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int32()), ("bits", pa.int64())]))
    rows = [(1, b"", None), (2, b"x" * 30, None), (3, b"y" * 50, [{"start": 0, "windows": 1, "bits": -1}])]
    for i in range(4, 300):
        text, at, gone = bytes(rnd.choices(b"abc", k=rnd.randint(50, 700))), 0, []
        while (room := len(text) - span + 1 - at) > 0:
            n = min(room, rnd.randint(1, 27))
            if rnd.random() < 0.5:
                gone.append({"start": at, "windows": n, "bits": rnd.choice((-1, rnd.getrandbits(n)))})
            at += n + rnd.choice((0, 0, 0, 60))
        rnd.shuffle(gone)
        rows.append((i, text, gone or None))
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), kind), strict=True)], ["doc_id", "text", "gone"])
    got = [r for out in S._kept(span)([batch.slice(0, 7), batch.slice(7), batch.slice(0, 2)]) for r in out.to_pylist()]
    assert len(got) == len(rows) + 2
    for (doc, text, gone), r in zip([*rows, *rows[:2]], got, strict=True):
        lost = {x["start"] + o + k for x in gone or () for o in range(x["windows"]) if x["bits"] == -1 or x["bits"] >> o & 1 for k in range(span)}
        ends = [k for k in range(len(text) + 1) if (k in lost) != (k - 1 in lost)]
        left = bytes(c for k, c in enumerate(text) if k not in lost)
        assert r == {"doc_id": doc, "n_bytes": len(text), "n_removed": len(lost), "n_spans": len(ends) // 2, "kept_sha256": hashlib.sha256(left).hexdigest(), "removed": ends}
