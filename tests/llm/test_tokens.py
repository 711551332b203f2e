"""BPE against the tiktoken library, packing against the tokenizers library and an exhaustive search."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetcut.llm import bpe
from fleetcut.llm.packing import best_fit, pack_documents, plan, reduce_by_dominance

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.TextEncoder(RANKS, P.PATTERN)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stlare1²#$éßñ　\x85\x1c"), st.characters(blacklist_categories=("Cs",))), max_size=80))
def test_texts_encode_as_the_library_does(text):
    assert ids(ENCODER.encode(text)) == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text.encode()


def test_small_leaves_join_right(monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_LEAF", 7)
    monkeypatch.setattr(bpe, "DECODE_LEAF", 3)
    encoder = bpe.TextEncoder(RANKS, P.PATTERN)
    random.seed(1)
    for k in range(3000):
        text = "".join(random.choice("aab th'sé\n 12" if k % 2 else "ab") for _ in range(random.randint(0, 60)))
        assert ids(encoder.encode(text)) == REFERENCE.encode_ordinary(text), text
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_long_runs():
    text = "a" * 30_000 + "é" * 2_000 + " " * 999 + "xyz" * 3_000 + " \n \n" + "日本" * 500
    assert ids(ENCODER.encode(text)) == REFERENCE.encode_ordinary(text)
    assert ids(ENCODER.encode("x \0abc \0")) == REFERENCE.encode_ordinary("x \0abc \0")


def test_pieces_come_from_joins_of_bytes():
    """The tree's leaves are bytes, so that even ordinary words are made by joins; any two halves join to the whole."""
    random.seed(2)
    pieces = bpe.PieceEncoder(RANKS)
    for n in range(500):
        piece = bytes(random.choice(b"abcdeth ") for _ in range(random.randint(2, 40)))
        cut = random.randint(0, len(piece))
        assert pieces.tree(piece) == pieces.merge(piece) == pieces.join(pieces.merge(piece[:cut]), pieces.merge(piece[cut:]))
    assert all(pieces.tree(token) == (rank,) for token, rank in list(RANKS.items())[::50])


def test_ordinary_texts_go_through_the_tree(spark):
    encoder = bpe.TextEncoder(RANKS, P.PATTERN)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, packed in zip(texts, encoder.encode_many([t or "" for t in texts])):
        assert ids(packed) == REFERENCE.encode_ordinary(text or "")
    assert encoder.joins > len(texts) and encoder.pieces.joins > 1000


def test_caches_keep_what_is_in_use():
    g = bpe.Generations(3)
    for k in range(40):
        for x in g.missing({k, "hot"}):
            g.young[x] = x
        assert g.young["hot"] == "hot" and g.young[k] == k
    assert len(g.young) + len(g.old) <= 10


def test_encode_documents(docs_of):
    rows = [(1, "Hello the world's  end"), (2, None), (3, ""), (3, ""), (None, "x\ty"), (4, "word " * 9000)]
    out = bpe.encode_documents(docs_of(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows for e in [REFERENCE.encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert all(REFERENCE.decode(r.ids) == (dict(rows)[r.doc_id] or "") for r in out)
    assert bpe.encode_documents(docs_of([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def fewest(items, capacity):
    @lru_cache(None)
    def f(mask):
        if not mask:
            return 0
        i = mask.bit_length() - 1
        rest = mask & ~(1 << i)
        js = [j for j in range(i) if rest >> j & 1]
        best = 99
        for k in range(5):
            for c in itertools.combinations(js, k):
                if items[i] + sum(items[j] for j in c) <= capacity:
                    best = min(best, 1 + f(rest & ~sum(1 << j for j in c)))
        return best

    return f((1 << len(items)) - 1)


def test_reduction_keeps_an_optimum():
    random.seed(3)
    for _ in range(150):
        items = [random.randint(3, 20) for _ in range(9)]
        count = [items.count(w) for w in range(21)]
        fixed = reduce_by_dominance(count, 20)
        rest = tuple(w for w in range(21) for _ in range(count[w]))
        assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(tuple(items), 20)


def test_plan_places_every_rank_once():
    random.seed(4)
    for _ in range(30):
        count = [0] + [random.choice([0, 0, 1, 3, 50]) for _ in range(64)]
        runs = plan(count, 64)
        for w in range(1, 65):
            taken = sorted((first, times) for v, first, times, _, _ in runs if v == w)
            at = 0
            for first, times in taken:
                assert first == at
                at += times
            assert at == count[w]
        load = {}
        for w, _, times, seq, offset in runs:
            for k in range(times):
                load.setdefault(seq + k, []).append((offset, w))
        for pieces in load.values():
            end = 0
            for offset, w in sorted(pieces):
                assert offset == end
                end += w
            assert end <= 64
        low = -(-sum(w * n for w, n in enumerate(count)) // 64)
        assert low <= len(load) <= 1.3 * low + 2
    assert best_fit([0] * 65, 64) == []


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack_documents(docs_of, spark, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, "the of and " * (i % 9) + "<|endoftext|>" * (i % 2)) for i in range(60)] + [(100, None), (101, ""), (102, "word " * 5000), (103, "x"), (103, "x"), (None, "n")]
    out = pack_documents(docs_of(rows), P.path("byte_bpe_50k.json"), P.PATTERN, capacity).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    text = dict(rows)
    assert sum(r.length for r in out) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for r in out:
        whole = np.array(tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == capacity
    assert pack_documents(docs_of([]), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    plain = pack_documents(docs_of([(1, "a<|endoftext|>b")]), P.path("byte_bpe_50k.json"), P.PATTERN, capacity, added_tokens=False).collect()
    tok.encode_special_tokens = True
    assert sum(r.length for r in plain) == len(tok.encode("a<|endoftext|>b", add_special_tokens=False).ids) + 1 == 10


def test_a_common_length_is_spread(docs_of, spark, monkeypatch):
    from fleetcut.llm import packing

    monkeypatch.setattr(packing, "GROUP", 5)
    out = pack_documents(docs_of([(i, "x" if i % 3 else "the of") for i in range(300)]), P.path("byte_bpe_50k.json"), P.PATTERN, 64).collect()
    assert len(out) == 300 and len({(r.sequence_id, r.offset) for r in out}) == 300
    assert len({r.sequence_id for r in out}) == -(-sum(r.length for r in out) // 64)
