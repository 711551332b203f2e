"""Canonical JSON and its hashes against the standard library, flattened documents, gates in one pass, sweeps against brute force."""

import hashlib
import json
import random
import struct
import time

from pyspark.sql import functions as F

from fleetcut.functions.canonical import canonical_json, double_text
from fleetcut.operators import candidates as C
from fleetcut.operators import gates as G
from fleetcut.operators import intervals as I
from fleetcut.operators import report as R
from fleetcut.operators import speech as S
from fleetcut.plans import registry
from fleetcut.plans.fixtures import Fleet

SPAN = "project_id long, id string, start_ms long, end_ms long"


def canonical(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def test_doubles_have_their_shortest_text(spark):
    random.seed(3)
    values = [0.0, -0.0, 1.0, 0.1, 1e-05, 1.5e-07, 0.0001, 0.00012, 1e7, 12345678.0, 1e15, 1e16, 1.5e16, -14.0, 1e23, 2.0**-44, 5e-324, 1.7976931348623157e308, 1 / 3, 0.30000000000000004, 100.0, None]
    values += [round(random.uniform(-1000, 1000), random.randint(0, 6)) for _ in range(300)] + [random.uniform(0, 1) * 10.0 ** random.randint(-20, 20) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", double_text("x").alias("t")).collect()
    for r in got:
        assert r.t is None if r.x is None else struct.pack("d", float(r.t)) == struct.pack("d", r.x) and len(r.t) <= len(repr(r.x)) + 2, r
    plain = [r for r in got if r.x is not None and len(repr(r.x).replace("-", "").replace(".", "").lstrip("0")) <= 16 and "e" not in repr(r.x)]
    assert len(plain) > 250 and all(r.t == repr(r.x) for r in plain)


def test_hashes_equal_the_standard_library(spark):
    texts = ["plain", "", 'q"b\\s', "tab\tnl\n\r\b\f\x00\x1f\x7f", "é モデル ￿", "😀 pair 𝒳", "line end", "trailing\n"]
    rows = [(i, t, (t, 0.00001 * i, i % 2 == 0, None if i == 3 else i), {t: i * 0.5, "a": 1e16}, [t, None]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "project_id long, t string, s struct<z:string,a:double,m:boolean,n:int>, k map<string,double>, l array<string>")
    for r in df.select("*", canonical_json(df.select("t", "s", "k", "l").schema).alias("c"), R.params_hash(df, "t", "s").alias("h")).collect():
        assert r.c == canonical({"t": r.t, "s": r.s.asDict(), "k": r.k, "l": r.l})
        assert r.h == hashlib.sha256(canonical({"t": r.t, "s": r.s.asDict()}).encode()).hexdigest()


def leaves(x, path=""):
    if isinstance(x, dict):
        return [y for k, v in x.items() if k != "generated_at" for y in leaves(v, f"{path}.{k}" if path else k)]
    v = len(x) if isinstance(x, list) else int(x) if isinstance(x, bool) else x
    return [(path, None if v is None else str(v), float(v) if isinstance(v, (int, float)) else None)]


def test_documents_flatten_like_a_walk(spark):
    docs = [
        {"a": {"b": 1, "flags": [1, {"deep": [2]}]}, "ok": True, "generated_at": "x", "t": None}, {}, {"x": {}}, {"s": 'quote " { [ \\', "n": -0.5, "e": 1e-07, "big": 12345678901234567890, "one": 1.0},
        {"l1": {"l2": {"l3": {"l4": {"generated_at": 1, "v": "é😀"}}}}}, {"list": []}, {"wide": {f"k{i}": i for i in range(300)}},
    ]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(docs)] + [(99, None)], "project_id long, doc string")
    got = {(r.project_id, r.path, r.value, r.number) for r in R.flatten_runs(df).collect()}
    assert got == {(i, *x) for i, d in enumerate(docs) for x in leaves(d) if d or x[0]}


def spans(n, seed, ids="s", long=40, projects=3):
    random.seed(seed)
    return [(random.randrange(projects), f"{ids}{i}", s := random.randrange(400), s + random.randrange(1, long)) for i in range(n)]


def over(a, b):
    return max(0, min(a[3], b[3]) - max(a[2], b[2])) if a[0] == b[0] else 0


def test_sweeps_equal_brute_force(spark):
    for seed, (n, m) in enumerate([(40, 60), (1, 0), (30, 1), (60, 60)]):
        a, b = spans(n, seed), spans(m, seed + 50, "b", 90)
        da, db = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
        got = {r.id: r.covered_ms for r in I.covered_ms(da, db, "project_id", "id").collect()}
        assert got == {x[1]: sum(over(x, y) for y in b) for x in a}
        weighted = {r.id: r.w_sum for r in I.weight_touching(da, db.withColumn("w", F.length("id") * 7), "w", "project_id", "id", out="w_sum").collect()}
        assert weighted == {x[1]: sum(7 * len(y[1]) for y in b if over(x, y)) for x in a}
        pairs = sorted((r.id, r.b_id) for r in I.range_join(da, db, bin_ms=random.choice([7, 50, 1000])).collect())
        assert pairs == sorted((x[1], y[1]) for x in a for y in b if over(x, y))
        held = {r.id: r.inside for r in I.inside(da, db, "start_ms", bin_ms=random.choice([9, 64, 100_000])).collect()}
        assert held == {x[1]: any(y[0] == x[0] and y[2] <= x[2] < y[3] for y in b) for x in a}
        both = {(p, t) for x in a for p, t in [(x[0], t) for t in range(x[2], x[3])]} & {(y[0], t) for y in b for t in range(y[2], y[3])}
        out = I.intersect_spans(da, db).collect()
        assert {(r.project_id, t) for r in out for t in range(r.start_ms, r.end_ms)} == both
        assert len(out) == sum((p, t - 1) not in both for p, t in both)


def test_a_long_talk_is_swept(spark):
    """Ten hours with 3.6 million frames and 9,999 silences, and 9,999 cuts against as many segments."""
    start = time.time()
    frames = spark.range(3_600_000).select(F.lit(1).cast("long").alias("project_id"), (F.col("id") * 10).alias("t_ms"), F.lit(0.5).alias("power"))
    silences = spark.range(9_999).select(F.lit(1).cast("long").alias("project_id"), (F.col("id") * 3600).alias("start_ms"), (F.col("id") * 3600 + 1000).alias("end_ms"))
    r = S.noise_floor(frames, silences, spark.createDataFrame([(1,)], "project_id long")).first()
    assert r.n_frames == 9_999 * 100 and abs(r.level_db + 3.0103) < 1e-3
    cuts = silences.select("project_id", F.concat(F.lit("c"), F.col("start_ms").cast("string")).alias("cut_id"), "start_ms", "end_ms", F.lit("silence").alias("reason"), F.lit(0.5).alias("confidence"), F.lit("approved").alias("status"), F.lit(None).cast("string").alias("note"))
    cands = silences.select("project_id", (F.col("start_ms") / 3600).cast("long").alias("ord"), (F.col("start_ms") + 20).alias("start_ms"), F.col("end_ms"), F.lit("silence").alias("reason"), F.lit(0.9).alias("confidence"), F.lit("approved").alias("status"), F.lit(None).cast("string").alias("note"))
    merged = C.merge_cuts(cuts, cands)
    assert merged.filter("origin = 'matched'").count() == 9_999
    assert C.resolve_overlaps(merged).filter("demoted").count() == 0
    assert I.covered_ms(cuts, silences, "project_id", "cut_id").agg(F.sum("covered_ms")).first()[0] == 9_999_000
    assert time.time() - start < 120


def test_greedy_steps_equal_plain(spark):
    random.seed(8)
    cut = "project_id long, cut_id string, start_ms long, end_ms long, reason string, status string, origin string"
    rows = [(p, f"c{i:04d}", s := random.randrange(300), s + random.randrange(0, 30), "silence", random.choice(["approved", "approved", "proposed"]), random.choice(["kept", "added"])) for p in range(4) for i in range(40)]
    taken, want = {}, set()
    for r in sorted((r for r in rows if r[5] == "approved"), key=lambda r: (r[0], r[6] == "added", r[2], r[3], r[1])):
        mine = taken.setdefault(r[0], [])
        if any(min(r[3], e) > max(r[2], s) for s, e in mine):
            want.add((r[0], r[1]))
        else:
            mine.append((r[2], r[3]))
    got = {(r.project_id, r.cut_id) for r in C.resolve_overlaps(spark.createDataFrame(rows, cut)).filter("demoted").collect()}
    assert got == want and want


def test_one_pass_gates_equal_their_single_gates(spark):
    f = Fleet(spark, "/root/testdata/sf0.001")
    projects, segments, cuts = f.projects, f.segments.withColumn("ord", F.col("turn")), f.cuts.withColumn("confidence", F.lit(2.0))
    cuts = cuts.unionByName(cuts.filter("project_id % 4 = 1")).withColumn("end_ms", F.when(F.col("project_id") % 5 == 2, F.col("start_ms")).otherwise(F.col("end_ms")))
    telops = f.telops.withColumn("start_ms", F.when(F.col("idx") % 2 == 0, F.lit(10**9)).otherwise(F.col("start_ms")))
    singles = [
        G.g01_intervals(segments, projects, "segment_id"), G.g01_intervals(cuts, projects, "cut_id"), G.g02_fields(cuts), G.g02_fields(segments, "segments"), G.g02_fields(telops, "telops"),
        G.g03_unique(segments, "segment_id"), G.g03_unique(cuts, "cut_id"), G.g04_approved_overlap(cuts), G.g05_regions(f.regions), G.g13_telop_fields(telops, projects),
    ]
    want = sorted((tuple(r) for df in singles for r in df.collect()), key=repr)
    assert sorted(map(tuple, G.g26_artifacts(projects, segments, f.regions, cuts, telops).collect()), key=repr) == want and {w[1] for w in want} >= {"G01", "G02", "G03", "G04", "G13"}


def test_first_violators_are_bounded(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 2).alias("project_id"), F.format_string("s%07d", F.col("id")).alias("segment_id"))
    out = G.first_violators(rows, "segment_id")
    assert sorted(tuple(r) for r in out.collect()) == [(k, ",".join(f"s{i:07d}" for i in range(k, 10, 2)), 500_000) for k in (0, 1)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert set(registry.queries()) >= {"t02_sample_violations"}
