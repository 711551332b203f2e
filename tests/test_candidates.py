"""Matching, upsert and overlap resolution against a plain greedy loop, ties included; speech and gate checks."""

import random

import pytest
from pyspark.sql import functions as F

from fleetcut.operators import candidates as C
from fleetcut.operators import gates as G
from fleetcut.operators import speech as S

CUT = "project_id long, cut_id string, start_ms long, end_ms long, reason string, confidence double, status string, note string"
CAND = "project_id long, ord long, start_ms long, end_ms long, reason string, confidence double, status string, note string"


def hull_iou(a, b):
    return max(0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))


@pytest.fixture(scope="module")
def world(spark):
    random.seed(7)
    cuts, cands = [], []
    for p in range(40):
        for k in range(random.randint(0, 9)):
            a = random.randrange(0, 40) * 100
            cuts.append((p, f"c{k + 1:04d}", a, a + random.randint(2, 8) * 100, random.choice(["silence", "filler", "manual"]), 0.5, random.choice(["approved", "proposed", "rejected"]), f"n{k}"))
        for k in range(random.randint(0, 9)):
            a = random.randrange(0, 40) * 100
            cands.append((p, k, a, a + random.randint(2, 8) * 100, random.choice(["silence", "filler"]), 0.9, random.choice(["approved", "proposed"]), None))
    return cuts, cands, spark.createDataFrame(cuts, CUT), spark.createDataFrame(cands, CAND)


def greedy(cuts, cands):
    out = {}
    for p in {c[0] for c in cands}:
        scored = sorted((-hull_iou(k[2:4], c[2:4]), k[1], c[1]) for k in cands if k[0] == p for c in cuts if c[0] == p and c[4] == k[4] and hull_iou(k[2:4], c[2:4]) >= 0.5)
        seen = set()
        for _, k, c in scored:
            if (p, k) not in out and c not in seen:
                out[p, k] = c
                seen.add(c)
    return out


def test_pair_up(world):
    cuts, cands, dc, dk = world
    assert {(r.project_id, r.ord): r.cut_id for r in C.pair_up(dc, dk).collect()} == greedy(cuts, cands)


def test_merge_and_resolve(world):
    cuts, cands, dc, dk = world
    pairs, want = greedy(cuts, cands), {}
    old = {(c[0], c[1]): c for c in cuts}
    for p in {c[0] for c in cuts} | {c[0] for c in cands}:
        number = max([int(c[1][1:]) for c in cuts if c[0] == p], default=0)
        for k in sorted(x for x in cands if x[0] == p):
            if (p, k[1]) in pairs:
                e = old[p, pairs[p, k[1]]]
                want[p, e[1]] = (k[2], k[3], k[4], 0.9, e[6], e[7], "matched")
            else:
                number += 1
                want[p, f"c{number:04d}"] = (*k[2:8], "added")
        for c in (x for x in cuts if x[0] == p):
            if c[1] not in {v for (q, _), v in pairs.items() if q == p} and (c[6] != "proposed" or c[4] == "manual"):
                want[p, c[1]] = (*c[2:8], "kept")
    merged = C.merge_cuts(dc, dk)
    got = {(r.project_id, r.cut_id): (r.start_ms, r.end_ms, r.reason, r.confidence, r.status, r.note, r.origin) for r in merged.collect()}
    assert got == want
    demoted = set()
    for p in {k[0] for k in want}:
        taken = []
        for fresh, a, b, i in sorted((v[6] == "added", v[0], v[1], i) for (q, i), v in want.items() if q == p and v[4] == "approved"):
            if any(min(b, d) > max(a, c) for c, d in taken):
                demoted.add((p, i))
            else:
                taken.append((a, b))
    resolved = C.resolve_overlaps(merged).collect()
    assert {(r.project_id, r.cut_id) for r in resolved if r.demoted} == demoted
    assert all(r.status == "proposed" for r in resolved if r.demoted)
    counts = {r.project_id: r for r in C.merge_counts(dc, dk, merged).collect()}
    for p, r in counts.items():
        assert r.matched == sum(q == p for q, _ in pairs) and r.matched + r.kept + r.dropped == sum(c[0] == p for c in cuts)


def test_summary_has_every_project(world, spark):
    _, _, dc, dk = world
    merged = C.merge_cuts(dc, dk)
    spoken = spark.createDataFrame([(p, 0, 500) for p in range(40)], "project_id long, start_ms long, end_ms long")
    out = C.detect_summary(dc, dk, merged, C.resolve_overlaps(merged), spoken)
    assert out.count() == len({r.project_id for r in dc.select("project_id").union(dk.select("project_id")).collect()})


def test_unmatched_silence_cut_removes_no_speech(spark):
    cuts = spark.createDataFrame([(1, "c0001", 0, 300, "silence", 0.9, "approved", None), (1, "c0002", 900, 1300, "silence", 0.9, "approved", None)], CUT)
    spoken = spark.createDataFrame([(1, 1000, 2000)], "project_id long, start_ms long, end_ms long")
    assert {r.cut_id: r.speech_ms for r in C.speech_overlaps(cuts, spoken).collect()} == {"c0001": 0, "c0002": 300}
    assert [r.item_id for r in G.g06_speech(cuts, spoken).collect()] == ["c0002"]


def test_faults_are_refused_for_the_right_reason(spark):
    """A mid-word cut, overlapping approved cuts, a swapped source, a skipped repair: each gate names its own."""
    projects = spark.createDataFrame([(1, 60000)], "project_id long, duration_ms long")
    segs = spark.createDataFrame([(1, "s0001", 0, 1000, 4000), (1, "s0002", 1, 10000, 14000), (1, "s0003", 2, 20000, 24000)], "project_id long, segment_id string, ord long, start_ms long, end_ms long")
    regions = spark.createDataFrame([(1, 1000, 4000), (1, 10000, 14000), (1, 20000, 24000)], "project_id long, start_ms long, end_ms long")
    spoken = S.spoken_spans(segs, regions)
    mid = spark.createDataFrame([(1, "c0001", 3000, 5000, "silence", 0.9, "approved", None), (1, "c0002", 4500, 9600, "silence", 0.9, "approved", None)], CUT)
    assert [r.gate for r in G.g06_speech(mid, spoken).collect()] == ["G06"]
    assert [r.item_id for r in G.g04_approved_overlap(mid).collect()] == ["c0002"]
    assert G.g07_outside_speech(segs, regions).count() == 0
    renders = spark.createDataFrame([(1, -22.24, -14.0)], "project_id long, lufs double, target_lufs double")
    assert G.g17_loudness(renders).collect()[0].value == 8.24
    with pytest.raises(G.GateError, match="c0002: G04"):
        G.assert_gates(G.g04_approved_overlap(mid))
    assert G.assert_gates(G.g04_approved_overlap(mid), mode="advisory").count() == 1
    assert G.g01_intervals(mid, projects, "cut_id").count() == 0


def test_noise_floor_without_power_is_null(spark):
    frames = spark.createDataFrame([(1, 500, 0.0), (2, 500, 0.01)], "project_id long, t_ms long, power double")
    silences = spark.createDataFrame([(1, 0, 1000), (2, 0, 1000)], "project_id long, start_ms long, end_ms long")
    projects = spark.createDataFrame([(1,), (2,), (3,)], "project_id long")
    assert {r.project_id: (r.level_db, r.n_frames) for r in S.noise_floor(frames, silences, projects).collect()} == {1: (None, 1), 2: (-20.0, 1), 3: (None, 0)}


def test_ids_keep_all_their_digits(spark):
    cut = "project_id long, cut_id string, start_ms long, end_ms long, reason string, confidence double, status string, note string"
    cand = "project_id long, ord long, start_ms long, end_ms long, reason string, confidence double, status string, note string"
    existing = spark.createDataFrame([(1, "c9999", 0, 100, "manual", 1.0, "approved", None)], cut)
    new = spark.createDataFrame([(1, k, 1000 * (k + 1), 1000 * (k + 1) + 500, "silence", 0.9, "approved", None) for k in range(2)], cand)
    merged = C.merge_cuts(existing, new)
    assert sorted(r.cut_id for r in merged.collect()) == ["c10000", "c10001", "c9999"]
    with pytest.raises(G.GateError, match="G21"):
        G.assert_gates(G.g21_id_space(merged))
    summary = C.detect_summary(existing, new, merged, C.resolve_overlaps(merged), merged.limit(0).select("project_id", "start_ms", "end_ms")).first()
    assert (summary.first_id, summary.last_id, summary.next_id, summary.cuts_total, summary.silence_detected, summary.silence_ms) == ("c9999", "c10001", 10002, 3, 2, 1000)
    many = spark.range(1, 10_003).selectExpr("1L as project_id", "id as start_ms", "id + 1 as end_ms", "'x' as text")
    numbered = S.build_segments(many, spark.createDataFrame([(1, 10**6)], "project_id long, duration_ms long"), ["start_ms"])
    assert numbered.select("segment_id").distinct().count() == 10_002 and numbered.filter("segment_id = 's10002'").count() == 1


def test_the_first_cut_of_the_file_covers(spark):
    from fleetcut.operators import timeline as T

    cuts = spark.createDataFrame([(1, "c0009", 0, 0, 1000, "approved"), (1, "c0002", 1, 0, 2000, "approved")], "project_id long, cut_id string, ord long, start_ms long, end_ms long, status string")
    segments = spark.createDataFrame([(1, "s0001", 100, 900), (1, "s0002", 100, 1900), (1, "s0003", 5000, 6000)], "project_id long, segment_id string, start_ms long, end_ms long")
    assert {r.segment_id: r.cut_id for r in T.covering_cut(segments, cuts).collect()} == {"s0001": "c0009", "s0002": "c0002", "s0003": None}


def test_a_talk_at_the_id_limit(spark):
    """9,999 cuts and as many segments of one talk, within a minute each."""
    import time

    from fleetcut.operators import timeline as T

    base = spark.range(9999)
    cuts = base.selectExpr("1L as project_id", "format_string('c%04d', id + 1) as cut_id", "id as ord", "id * 1000 as start_ms", "id * 1000 + 300 as end_ms", "'silence' as reason", "'approved' as status")
    segments = base.selectExpr("1L as project_id", "format_string('s%04d', id + 1) as segment_id", "id as ord", "id * 1000 + 200 as start_ms", "id * 1000 + 900 as end_ms", "'x' as text")
    regions, projects = segments.select("project_id", "start_ms", "end_ms"), spark.createDataFrame([(1, 10**7)], "project_id long, duration_ms long")
    for run in (
        lambda: T.map_segments(segments, cuts)[0], lambda: T.review_context(cuts, segments), lambda: S.quiet(segments, regions, projects),
        lambda: T.forward(segments.select("project_id", F.col("start_ms").alias("t_ms")), cuts), lambda: C.resolve_overlaps(cuts),
    ):
        start = time.time()
        assert run().count() == 9999
        assert time.time() - start < 60


def test_review_context_by_brute_force(spark):
    from fleetcut.operators import timeline as T

    random.seed(23)
    segs = [(p, f"s{k:04d}", a, a + random.randint(1, 60)) for p in (1, 2) for k in range(40) for a in (random.randint(0, 300),)]
    cuts = [(p, f"c{k:04d}", a, a + random.randint(1, 80)) for p in (1, 2, 3) for k in range(20) for a in (random.randint(0, 300),)]
    got = T.review_context(spark.createDataFrame(cuts, "project_id long, cut_id string, start_ms long, end_ms long"), spark.createDataFrame(segs, "project_id long, segment_id string, start_ms long, end_ms long"))
    for r in got.collect():
        c0, c1 = next((a, b) for p, i, a, b in cuts if (p, i) == (r.project_id, r.cut_id))
        mine = sorted((a, b, i) for p, i, a, b in segs if p == r.project_id)
        kept = [s for s in mine if not (s[0] >= c0 and s[1] <= c1)]
        assert r.removed_ids == [i for a, b, i in mine if a >= c0 and b <= c1]
        assert r.before_id == max((s for s in kept if s[0] < c0), default=(0, 0, None))[2] and r.after_id == min((s for s in kept if s[1] > c1), default=(0, 0, None))[2]


def test_number_rows_and_longest_piece(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 10, 20), (1, 30, 40)], "project_id long, start_ms long, end_ms long")
    assert [r.row_id for r in C.number_rows(df, "s", ["start_ms"]).orderBy("start_ms").collect()] == ["s0001", "s0002", "s0003"]
    assert C.longest_piece(df, "project_id").select(F.col("start_ms")).collect()[0][0] == 10
