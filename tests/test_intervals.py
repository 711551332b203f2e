"""Interval algebra and the cut timeline against hand-made cases and a plain rendering of the definitions."""

import random

import pytest
from pyspark.sql import functions as F

from fleetcut.functions.time import iou, to_ms
from fleetcut.operators import intervals as I
from fleetcut.operators import timeline as T

SPAN = "project_id long, start_ms long, end_ms long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def lcg_sets():
    """Literal cut sets, and twelve from a seeded generator."""
    sets = [[], [(1000, 2000)], [(0, 500)], [(9500, 10000)], [(1000, 2000), (2000, 3000)], [(1000, 4000), (2000, 3000)]]
    for s in range(1, 13):
        v, cuts = s * 7919 + 1, []
        for _ in range(6):
            ends = []
            for _ in range(2):
                v = (v * 1103515245 + 12345) % 2**31
                ends.append(round(v / 2**31 * 10, 3))
            a, b = sorted(ends)
            if a < b:
                cuts.append((round(a * 1000), round(b * 1000)))
        sets.append(sorted(cuts))
    return sets


def merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def removed(t, merged):
    return sum(max(0, min(b, t) - a) for a, b in merged if a < t)


@pytest.fixture(scope="module")
def world(spark):
    sets = lcg_sets()
    cuts = spark.createDataFrame([(i, a, b) for i, s in enumerate(sets) for a, b in s], SPAN)
    projects = spark.createDataFrame([(i, 10000) for i in range(len(sets))], "project_id long, duration_ms long")
    return sets, cuts, projects


def test_to_ms_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (0.0025,), (1.2344999,)], "s double")
    assert [r[0] for r in df.select(to_ms(F.col("s"))).collect()] == [round(x * 1000) for x in (0.0005, 0.0015, 0.0025, 1.2344999)]


def test_iou_is_over_the_hull(spark):
    df = spark.createDataFrame([(0, 10, 5, 15), (0, 10, 20, 30), (0, 10, 0, 10), (5, 5, 5, 5)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(iou(*map(F.col, "abcd"))).collect()] == [5 / 15, 0.0, 1.0, 0.0]


def test_merge_and_complement(world):
    sets, cuts, projects = world
    assert rows(I.merge_spans(cuts), "project_id", "start_ms", "end_ms") == [(i, *m) for i, s in enumerate(sets) for m in merge(s)]
    want = []
    for i, s in enumerate(sets):
        at = 0
        for a, b in [*merge(s), (10000, 10000)]:
            if at < a:
                want.append((i, at, a))
            at = max(at, b)
    assert rows(I.complement(cuts, projects), "project_id", "start_ms", "end_ms") == want


def test_subtract(world, spark):
    sets, cuts, _ = world
    spans = spark.createDataFrame([(i, k, k * 900, k * 900 + 1500) for i in range(len(sets)) for k in range(8)], "project_id long, k long, start_ms long, end_ms long")
    want = []
    for i, s in enumerate(sets):
        for k in range(8):
            lo, hi = k * 900, k * 900 + 1500
            at = lo
            for a, b in [*[m for m in merge(s) if m[0] < hi and m[1] > lo], (hi, hi)]:
                if at < min(a, hi):
                    want.append((i, k, at, min(a, hi)))
                at = max(at, b)
    assert rows(I.subtract(spans, cuts, "project_id", "k"), "project_id", "k", "start_ms", "end_ms") == sorted(want)


def test_bin_join_equals_range_join(world, spark):
    sets, cuts, _ = world
    spans = spark.createDataFrame([(i, k * 700, k * 700 + 2500) for i in range(len(sets)) for k in range(10)], SPAN)
    cols = ("project_id", "start_ms", "b_start_ms", "b_end_ms")
    assert rows(I.bin_join(spans, cuts, 1000), *cols) == rows(I.range_join(spans, cuts), *cols)


def test_mapping_invariants(world, spark):
    """Monotone, continuous, total length, and inverse after forward."""
    sets, cuts, projects = world
    merged = I.merge_spans(cuts)
    points = spark.createDataFrame([(i, t) for i in range(len(sets)) for t in range(0, 10001, 125)], "project_id long, t_ms long")
    out = T.forward(points, merged)
    got = rows(out, "project_id", "t_ms", "mapped_ms")
    assert got == sorted((i, t, t - removed(t, merge(s))) for i, s in enumerate(sets) for t in range(0, 10001, 125))
    by = {(p, t): m for p, t, m in got}
    for (p, t), m in by.items():
        if t >= 125:
            assert 0 <= m - by[p, t - 125] <= 125
    total = {r["project_id"]: r["cut_duration_ms"] for r in T.removed_duration(cuts, projects).collect()}
    assert all(by[i, 10000] == total[i] for i in range(len(sets)))
    back = T.inverse(out.select("project_id", "t_ms", F.col("mapped_ms").alias("u_ms")), merged, projects)
    for r in back.collect():
        s = merge(sets[r["project_id"]])
        inside = [c for c in s if c[0] <= r["t_ms"] <= c[1]]
        if r["u_ms"] == total[r["project_id"]]:
            assert r["source_ms"] == 10000
        else:
            assert r["source_ms"] == (inside[0][0] if inside else r["t_ms"])


def test_map_segments_never_overlap_and_lose_nothing(world, spark):
    sets, cuts, _ = world
    segs = spark.createDataFrame([(i, f"s{k:04d}", k, k * 500, k * 500 + 500) for i in range(len(sets)) for k in range(20)], "project_id long, segment_id string, ord long, start_ms long, end_ms long")
    entries, warnings = T.map_segments(segs, cuts)
    e = rows(entries, "project_id", "start_ms", "end_ms", "segment_id")
    dropped = {(r["project_id"], r["segment_id"]) for r in warnings.collect() if r["kind"] == "dropped_by_cut"}
    assert {(p, s) for p, _, _, s in e} | dropped == {(i, f"s{k:04d}") for i in range(len(sets)) for k in range(20)}
    assert not {(p, s) for p, _, _, s in e} & dropped
    for (p, _, b, _), (q, a, _, _) in zip(e, e[1:]):
        assert p != q or b < a or b == a == 0 or b <= a


def test_frames_shrink_inwards(spark):
    cuts = spark.createDataFrame([(1, "c0001", 10010, 20020), (2, "c0001", 39, 79), (2, "c0002", 41, 79)], "project_id long, cut_id string, start_ms long, end_ms long")
    projects = spark.createDataFrame([(1, "30000/1001"), (2, "25/1")], "project_id long, fps string")
    assert rows(T.align_to_frames(cuts, projects), "project_id", "cut_id", "first_frame", "last_frame") == [(1, "c0001", 300, 600)]


def test_random_asof(spark):
    random.seed(2)
    marks = sorted(random.sample(range(1000), 30))
    points = [random.randrange(1000) for _ in range(60)] + marks[:5]
    m = spark.createDataFrame([(1, t, i) for i, t in enumerate(marks)], "project_id long, at long, i long")
    p = spark.createDataFrame([(1, k, t) for k, t in enumerate(points)], "project_id long, k long, t long")
    for inclusive in (True, False):
        got = {r["k"]: r["mark_i"] for r in I.asof(p, m, "t", "at", ["i"], inclusive).collect()}
        for k, t in enumerate(points):
            before = [i for i, x in enumerate(marks) if (x <= t if inclusive else x < t)]
            assert got[k] == (before[-1] if before else None)
