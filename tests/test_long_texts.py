"""Long segments: work grows with a text, not with its square."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from fleetcut.functions import text as X
from fleetcut.operators import verify as V


def test_fillers_leave_a_long_segment_in_time_that_grows_with_it(spark):
    text = "abc the def on " * 2000
    segments = spark.createDataFrame([(1, "s0001", 0, 0, 1_000_000, text), (1, "s0002", 1, 1_000_000, 1_001_000, None)], "project_id long, segment_id string, ord long, start_ms long, end_ms long, text string")
    cuts = spark.createDataFrame([(1, 100_000, 200_000, "filler", "approved"), (1, 150_000, 250_000, "filler", "approved"), (1, 1_000_100, 1_000_200, "filler", "approved")], "project_id long, start_ms long, end_ms long, reason string, status string")
    words = spark.createDataFrame([(1, "the", "strong", 1), (1, "on", "weak", 2)], "project_id long, word string, tier string, place long")
    start = time.time()
    got = {r.segment_id: r.said for r in V.without_fillers(segments, cuts, words).collect()}
    flat, scale, out, at = text.replace(" ", ""), 22_000 / 1_000_000, [], 0
    assert len(flat) == 22_000
    while at < len(flat):
        word = next((w for w in ("the", "on") if flat.startswith(w, at)), None)
        size = len(word or "x")
        # every filler touching one of the cuts goes, but for those at the text's very ends
        if not (word and at + size < len(flat) and at < 250_000 * scale and at + size > 100_000 * scale):
            out.append(flat[at : at + size])
        at += size
    assert got["s0001"] == "".join(out) and len(got["s0001"]) < 22_000 and not got["s0002"]
    assert time.time() - start < 60


def test_scripts_of_many_pairs_are_those_of_each(spark):
    random.seed(5)
    word = lambda most: "".join(random.choice("abcd😀") for _ in range(random.randint(0, most)))
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("a" * 63, "b" * 63), *[(word(n), word(n)) for n in (3, 12, 40, 63) for _ in range(400)]]
    assert [tuple(map(int, r)) for r in X.edit_scripts(pairs)] == [X.edit_script(*p) for p in pairs]
    pairs = [(word(60), word(60)) for _ in range(20_000)]
    start = time.time()
    X.edit_scripts(pairs)
    together, start = time.time() - start, time.time()
    for p in pairs:
        X.edit_script(*p)
    assert together < (time.time() - start) / 2


def test_width_counts_every_wide_range(spark):
    wide = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.east_asian_width(chr(c)) in "WF"]
    texts = [(0, ""), (1, "abc"), (2, "".join(wide)), (3, "aあ한é漢😀b"), (4, None), (5, "".join(chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF))]
    got = {r.i: r.w for r in spark.createDataFrame(texts, "i int, t string").select("i", X.text_width(F.col("t")).alias("w")).collect()}
    one = lambda t: t if t is None else sum(1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5 for c in t)
    assert got == {i: one(t) for i, t in texts}


def test_python_gets_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for step in (lambda: X.nfkc(F.col("t")), lambda: V.compare(spark.createDataFrame([(1, "a", "b")], "project_id long, expected string, actual string"))):
        spark.conf.set(key, "256m")
        step()
        assert int(spark.conf.get(key).removesuffix("b")) <= 4 << 20
