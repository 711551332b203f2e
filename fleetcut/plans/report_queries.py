"""Queries of reports, provenance, run comparison and recogniser benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.operators import gates as G
from fleetcut.operators import report as R
from fleetcut.operators import timeline as T
from fleetcut.operators.speech import outside_speech
from fleetcut.plans.fixtures import Fleet
from fleetcut.plans.register import query
from fleetcut.plans.stored import stored
from fleetcut.sources import tables as S


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("project_id", F.col("project_id").cast("bigint"))


_BY_REASON = """(SELECT coalesce(c.project_id, f.project_id) AS project_id, coalesce(c.reason, f.reason) AS reason, coalesce(n, 0) AS n, round(coalesce(sec, 0), 3) AS sec, coalesce(approved, 0) AS approved, coalesce(proposed, 0) AS proposed, coalesce(rejected, 0) AS rejected
 FROM (SELECT project_id, reason, count(*) AS n, sum((end_ms - start_ms) / 1000.0) AS sec, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'proposed') AS proposed, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM cuts GROUP BY project_id, reason) c
 FULL JOIN (SELECT p.project_id, r.reason FROM projects p CROSS JOIN (VALUES ('silence'), ('filler'), ('manual')) r(reason)) f ON f.project_id = c.project_id AND f.reason = c.reason)"""


@query(f"SELECT * FROM {_BY_REASON} z")
def a01_cuts_by_reason(f: Fleet) -> DataFrame:
    return R.cuts_by_reason(f.cuts, f.projects)


@query("SELECT project_id, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'proposed') AS proposed, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM cuts GROUP BY project_id")
def a02_status_counts(f: Fleet) -> DataFrame:
    return R.status_counts(f.cuts)


@query("SELECT project_id, round(sum(end_ms - start_ms) / 1000.0, 3) AS approved_sec FROM cuts WHERE status = 'approved' GROUP BY project_id")
def a03_approved_seconds(f: Fleet) -> DataFrame:
    return R.approved_seconds(f.cuts)


@query("SELECT p.project_id, coalesce(r.n, 0) AS regions, coalesce(s.n, 0) AS segments, round(coalesce(r.ms, 0) / 1000.0, 3) AS speech_sec, round(coalesce(r.ms, 0) / CAST(p.duration_ms AS DOUBLE), 4) AS speech_ratio, (10 + p.project_id % 30) / 100.0 AS realtime_factor FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, sum(end_ms - start_ms) AS ms FROM speech_regions GROUP BY project_id) r ON r.project_id = p.project_id LEFT JOIN (SELECT project_id, count(*) AS n FROM segments GROUP BY project_id) s ON s.project_id = p.project_id")
def a07_transcribe_summary(f: Fleet) -> DataFrame:
    runs = f.projects.select("project_id", (F.col("duration_ms") / 100000.0 * (10 + F.col("project_id") % 30)).alias("elapsed_s"))
    return R.transcribe_summary(f.regions, f.segments, f.projects, runs)


@query("SELECT project_id, segment_id, count(*) AS n FROM patches GROUP BY project_id, segment_id HAVING count(*) > 1")
def a10_duplicate_ids(f: Fleet) -> DataFrame:
    from fleetcut.operators.gates import duplicate_ids

    return duplicate_ids(f.patches, "segment_id")


_NOISE = "(SELECT project_id, -60.0 + (project_id % 13) / 4.0 AS before_rms_db, CASE WHEN project_id % 5 <> 1 THEN -63.0 + (project_id % 29) / 4.0 END AS after_rms_db FROM projects)"


def noise(f: Fleet) -> DataFrame:
    after = F.when(F.col("project_id") % 5 != 1, F.lit(-63.0) + (F.col("project_id") % 29) / 4.0)
    return f.projects.select("project_id", (F.lit(-60.0) + (F.col("project_id") % 13) / 4.0).alias("before_rms_db"), after.alias("after_rms_db"))


@query(f"SELECT project_id, round_even(after_rms_db - before_rms_db, 2) AS delta_db, round_even(after_rms_db - before_rms_db, 2) < 0 AS improved FROM {_NOISE} n")
def p13_floor_section(f: Fleet) -> DataFrame:
    return R.floor_section(noise(f))


_RENDERS = "(SELECT project_id, CASE WHEN project_id % 4 <> 3 THEN duration_ms / 1250.0 END AS duration_s, duration_ms / 1000.0 AS source_s, CASE WHEN project_id % 3 <> 2 THEN -14.0 - (project_id % 8) / 8.0 END AS lufs FROM projects)"


def renders(f: Fleet) -> DataFrame:
    p = F.col("project_id")
    return f.projects.select(
        "project_id", F.when(p % 4 != 3, F.col("duration_ms") / 1250.0).alias("duration_s"), (F.col("duration_ms") / 1000.0).alias("source_s"),
        F.when(p % 3 != 2, F.lit(-14.0) - (p % 8) / 8.0).alias("lufs"),
    )


@query(f"SELECT project_id, round_even(1 - duration_s / source_s, 3) AS reduction FROM {_RENDERS} r")
def p14_reduction(f: Fleet) -> DataFrame:
    return renders(f).select("project_id", R.reduction(F.col("source_s"), F.col("duration_s")).alias("reduction"))


@query(f"SELECT r.project_id, round_even(r.lufs - n.after_rms_db, 2) AS above_floor FROM {_RENDERS} r JOIN {_NOISE} n ON n.project_id = r.project_id")
def p15_output_floor(f: Fleet) -> DataFrame:
    return renders(f).join(noise(f), "project_id").select("project_id", R.output_floor(F.col("lufs"), F.col("after_rms_db")).alias("above_floor"))


@query("SELECT DISTINCT reason FROM (SELECT CASE WHEN project_id % 6 = 1 THEN 'breath' ELSE reason END AS reason FROM cuts) z WHERE reason NOT IN ('silence', 'filler', 'manual')")
def u03_extra_reasons(f: Fleet) -> DataFrame:
    return R.extra_reasons(f.cuts.withColumn("reason", F.when(F.col("project_id") % 6 == 1, "breath").otherwise(F.col("reason"))))


def levels(f: Fleet) -> DataFrame:
    """Integrated loudness at three points, the target and the floor of the processed audio; one talk in five has no floor, one in seven no measurement."""
    p = F.col("project_id")
    return f.projects.filter("project_id % 7 <> 4").select(
        "project_id", (F.lit(-20.0) - p % 16 / 4.0).alias("source_lufs"), (F.lit(-14.5) - p % 8 / 8.0).alias("processed_lufs"), F.when(p % 3 != 2, F.lit(-14.0) - p % 8 / 8.0).alias("rendered_lufs"),
        F.when(p % 5 != 1, F.lit(-63.0) + p % 29 / 4.0).alias("processed_floor_db"), F.lit(-14.0).alias("target_lufs"),
    )


def artifacts(f: Fleet) -> DataFrame:
    """A still of both edges of each approved cut, and a digest clip of the talks that have one."""
    cuts = T.approved(f.cuts)
    stills = cuts.select("project_id", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("edge"), "cut_id").select("project_id", F.concat("cut_id", F.lit("-"), "edge", F.lit(".png")).alias("path"))
    digests = f.projects.filter("project_id % 2 = 0").select("project_id", F.lit("digest.mp4").alias("path"), (F.col("duration_ms") % 10000).alias("length_ms"))
    return R.artifact_section(stills, digests, T.review_windows(cuts, f.projects))


def report(f: Fleet) -> DataFrame:
    subtitles = f.segments.groupBy("project_id").agg(F.count(F.lit(1)).alias("entries"))
    return R.project_report(f.projects, renders(f).filter("duration_s is not null"), f.cuts, noise(f), subtitles, levels(f), artifacts(f))


@query(f"""SELECT p.project_id, round(p.duration_ms / 1000.0, 3) AS source_sec, r.duration_s AS rendered_sec, round_even(1 - r.duration_s / (p.duration_ms / 1000.0), 3) AS reduction, s.n AS entries, c.n AS cuts, round_even(n.after_rms_db - n.before_rms_db, 2) AS delta_db,
 CASE WHEN p.project_id % 7 <> 4 THEN round_even(-20.0 - (p.project_id % 16) / 4.0, 2) END AS source_lufs, CASE WHEN p.project_id % 7 <> 4 AND p.project_id % 3 <> 2 THEN round_even(-14.0 - (p.project_id % 8) / 8.0, 2) END AS rendered_lufs,
 CASE WHEN p.project_id % 7 <> 4 AND p.project_id % 5 <> 1 THEN round_even(-14.5 - (p.project_id % 8) / 8.0 - (-63.0 + (p.project_id % 29) / 4.0), 2) END AS below_programme_db,
 CASE WHEN a.n IS NOT NULL OR p.project_id % 2 = 0 THEN coalesce(2 * a.n, 0) END AS boundaries_png, CASE WHEN p.project_id % 2 = 0 THEN (p.duration_ms % 10000) / 1000.0 END AS digest_sec
 FROM projects p JOIN {_RENDERS} r ON r.project_id = p.project_id JOIN (SELECT project_id, count(*) AS n FROM segments GROUP BY project_id) s ON s.project_id = p.project_id LEFT JOIN (SELECT project_id, count(*) AS n FROM cuts GROUP BY project_id) c ON c.project_id = p.project_id JOIN {_NOISE} n ON n.project_id = p.project_id
 LEFT JOIN (SELECT project_id, count(*) AS n FROM cuts WHERE status = 'approved' GROUP BY project_id) a ON a.project_id = p.project_id""".replace("c.n AS cuts", "coalesce(c.n, 0) AS cuts"))
def a16_project_report(f: Fleet) -> DataFrame:
    r = report(f)
    total = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return r.select(
        "project_id", F.round("duration.source_sec", 3).alias("source_sec"), "duration.rendered_sec", "duration.reduction", "subtitles.entries", total.alias("cuts"), "noise_floor.delta_db",
        F.col("loudness.source").alias("source_lufs"), F.col("loudness.rendered").alias("rendered_lufs"), "output_floor.below_programme_db", "artifacts.boundaries_png", F.col("artifacts.boundary_digest_sec").alias("digest_sec"),
    )


@query()
def k04_statistics_documents(f: Fleet) -> DataFrame:
    return R.statistics_documents(report(f), "2024-01-01T00:00:00Z")


@query(f"SELECT r.project_id, coalesce(c.n, 0) AS cuts_applied, r.duration_s, round((r.duration_s - r.source_s) * 1000, 3) AS delta_ms, r.lufs, coalesce(w.n, 0) AS warnings FROM {_RENDERS} r LEFT JOIN (SELECT project_id, count(*) AS n FROM cuts WHERE status = 'approved' GROUP BY project_id) c ON c.project_id = r.project_id LEFT JOIN (SELECT project_id, count(*) AS n FROM segments WHERE end_ms - start_ms < 800 GROUP BY project_id) w ON w.project_id = r.project_id")
def a17_render_summary(f: Fleet) -> DataFrame:
    return R.render_summary(renders(f).withColumn("expected_s", F.col("source_s")), f.cuts, f.segments.filter("end_ms - start_ms < 800"))


_STAGES = ["audio_fix", "transcribe", "correct", "detect", "render", "report"]


def stages(f: Fleet) -> DataFrame:
    """Stages that ran in each talk's last run: some skipped, some failed."""
    s = f.projects.select("project_id", F.posexplode(F.array(*map(F.lit, _STAGES))).alias("ord", "stage"))
    s = s.filter("(project_id + ord * 5) % 7 <> 3").withColumn("warnings", (F.col("project_id") * 3 + F.col("ord")) % 4)
    return s.withColumn("error", F.when((F.col("project_id") + F.col("ord")) % 9 == 5, "broken"))


_STAGE_ROWS = "(SELECT p.project_id, s.ord, s.stage, (p.project_id * 3 + s.ord) % 4 AS warnings, (p.project_id + s.ord) % 9 = 5 AS failed, (p.project_id + s.ord * 5) % 7 <> 3 AS ran FROM projects p CROSS JOIN (VALUES (0, 'audio_fix'), (1, 'transcribe'), (2, 'correct'), (3, 'detect'), (4, 'render'), (5, 'report')) s(ord, stage))"


@query(f"SELECT project_id, string_agg(stage, ',' ORDER BY ord) FILTER (WHERE ran) AS ran, coalesce(string_agg(stage, ',' ORDER BY ord) FILTER (WHERE NOT ran), '') AS skipped, CAST(sum(warnings) FILTER (WHERE ran) AS BIGINT) AS warnings, min_by(stage, ord) FILTER (WHERE ran AND failed) AS first_failed FROM {_STAGE_ROWS} z GROUP BY project_id")
def a18_run_outcome(f: Fleet) -> DataFrame:
    return R.run_outcome(stages(f), _STAGES)


def _profiles(f: Fleet, *changes: str) -> DataFrame:
    """Profiles written and read again, with a name beyond ASCII and numbers of every size; `changes`: sections that every third project has otherwise."""
    p, model = F.col("project_id"), F.concat(F.lit("モデル😀 \"q\" "), F.col("project_id").cast("string"))
    other = lambda r, now, then: F.when(p % 3 == r, then).otherwise(now) if changes else now
    pad = F.when(p % 2 == 0, F.lit(0.00001)).when(p % 5 == 1, F.lit(1e-7)).otherwise(F.lit(1234567.25)) * 1.0
    doc = F.struct(
        F.struct(other(0, F.lit(80), F.lit(81)).alias("highpass_hz")).alias("audio"), F.struct(F.when(p % 4 != 0, other(2, model, F.lit("old"))).otherwise(other(2, F.lit("a"), F.lit("old"))).alias("model")).alias("asr"),
        F.struct(other(0, F.lit(0.6), F.lit(0.7)).alias("min_duration"), pad.alias("pad_pre")).alias("silence"), F.struct(other(2, F.lit(18), F.lit(19)).alias("crf")).alias("render"),
    )
    return _number(S.read_profiles(f.spark, stored(f, "profile", f.projects.select("project_id", F.to_json(doc).alias("document")))))


_HASHES = """(SELECT project_id, 'audio_fix' AS stage, '{"audio":{"denoise":"deepfilternet","highpass_hz":80,"loudnorm":{"i":-14.0,"lra":11.0,"tp":-1.0}}}' AS doc FROM projects
 UNION ALL SELECT project_id, 'transcribe', '{"asr":{"backend":"whisper.cpp","language":"ja","model":"' || CASE WHEN project_id % 4 <> 0 THEN '\\u30e2\\u30c7\\u30eb\\ud83d\\ude00 \\"q\\" ' || project_id ELSE 'a' END || '","vad":"silero-v5"}}' FROM projects
 UNION ALL SELECT project_id, 'correct', '{}' FROM projects UNION ALL SELECT project_id, 'report', '{}' FROM projects
 UNION ALL SELECT project_id, 'detect', '{"filler":{"enable_weak":false,"require_adjacent_silence":0.2},"silence":{"min_cut_duration":0.4,"min_duration":0.6,"pad_post":0.3,"pad_pre":' || CASE WHEN project_id % 2 = 0 THEN '1e-05' WHEN project_id % 5 = 1 THEN '1e-07' ELSE '1234567.25' END || ',"threshold":"4%"}}' FROM projects
 UNION ALL SELECT project_id, 'render', '{"render":{"boundary_fade":0.01,"crf":18,"preset":"slow","verify_asr_mode":"gate"},"subtitle":{"max_chars_per_line":20,"max_cps":8.0,"max_lines":2,"min_display":0.8}}' FROM projects)"""


@query(f"SELECT project_id, stage, sha256(doc) AS params_sha256 FROM {_HASHES} h")
def h15_params_hash(f: Fleet) -> DataFrame:
    """Of every stage the hash of its profile sections, beyond ASCII and with small numbers."""
    return R.stage_hashes(_profiles(f))


def records(f: Fleet) -> tuple[DataFrame, DataFrame]:
    """Recorded and current parameter hashes of the stages, from profiles: every third record is of other parameters, some are absent."""
    ord_ = F.array_position(F.array(*map(F.lit, _STAGES)), F.col("stage")) - 1
    return R.stage_hashes(_profiles(f, "changed")).filter((F.col("project_id") * 2 + ord_) % 5 != 4), R.stage_hashes(_profiles(f))


_DAG = "(VALUES ('transcribe', 'audio_fix'), ('correct', 'transcribe'), ('detect', 'audio_fix'), ('detect', 'transcribe'), ('render', 'audio_fix'), ('render', 'transcribe'), ('render', 'detect'), ('report', 'detect'), ('report', 'render'))"


@query(f"""+ st AS (SELECT p.project_id, s.ord, s.stage FROM projects p CROSS JOIN (VALUES (0, 'audio_fix'), (1, 'transcribe'), (2, 'correct'), (3, 'detect'), (4, 'render'), (5, 'report')) s(ord, stage) WHERE (p.project_id * 2 + s.ord) % 5 <> 4)
 SELECT a.project_id, a.stage, d.upstream FROM st a JOIN {_DAG} d(stage, upstream) ON d.stage = a.stage JOIN st b ON b.project_id = a.project_id AND b.stage = d.upstream WHERE (b.project_id + b.ord) % 3 = 0""")
def j37_stale(f: Fleet) -> DataFrame:
    return R.stale(*records(f))


@query("SELECT project_id, project_id % 7 = 3 AS missing, project_id % 7 <> 3 AND project_id % 5 = 1 AS mismatch FROM projects")
def j41_source_drift(f: Fleet) -> DataFrame:
    p = f.projects.select("project_id", F.concat(F.lit("/talks/"), F.col("project_id").cast("string")).alias("path"), F.sha2(F.col("project_id").cast("string"), 256).alias("sha256"))
    found = F.when(F.col("project_id") % 5 == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256"))
    return R.source_drift(p, p.filter("project_id % 7 <> 3").select("path", found.alias("found")))


@query("SELECT project_id, 'cuts' AS input FROM projects p WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.project_id = p.project_id AND c.reason = 'manual') UNION ALL SELECT project_id, 'telops' FROM projects p WHERE NOT EXISTS (SELECT 1 FROM telops t WHERE t.project_id = p.project_id AND t.idx > 2)")
def j43_missing_inputs(f: Fleet) -> DataFrame:
    return R.missing_inputs(f.projects, {"cuts": f.cuts.filter("reason = 'manual'"), "telops": f.telops.filter("idx > 2")})


def run_docs(f: Fleet) -> DataFrame:
    """Two archived runs of each talk as JSON: counts of its cuts, a list of warnings, a path that only the second has."""
    n = T.approved(f.cuts).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("project_id").cast("string")
    head = lambda k, flag: F.concat(F.lit('{"generated_at":"r'), F.lit(k), F.lit('","cuts":{"applied":'), F.col("n").cast("string"), F.lit(',"ok":'), F.lit(flag), F.lit("}"))
    first = F.concat(head("1", "true"), F.lit(',"warnings":["a"],"name":"t'), p, F.lit('","floor":null}'))
    second = F.concat(head("2", "false"), F.lit(',"warnings":['), F.when(F.col("project_id") % 2 == 0, '"a","b"').otherwise('"a"'), F.lit('],"name":"t'), p, F.lit('","floor":null,"extra":{"flags":3}}'))
    return n.select("project_id", F.lit("run").alias("run"), F.lit(1).alias("written_at"), first.alias("doc")).unionByName(n.select("project_id", F.lit("run-02").alias("run"), F.lit(2).alias("written_at"), second.alias("doc")))


@query("""+ n AS (SELECT project_id, count(*) AS n FROM cuts WHERE status = 'approved' GROUP BY project_id), r(run) AS (VALUES ('run'), ('run-02'))
 SELECT project_id, run, path, value FROM (SELECT project_id, run, 'cuts.applied' AS path, CAST(n AS VARCHAR) AS value FROM n, r UNION ALL SELECT project_id, run, 'cuts.ok', CASE WHEN run = 'run' THEN '1' ELSE '0' END FROM n, r
 UNION ALL SELECT project_id, run, 'warnings', CASE WHEN run = 'run-02' AND project_id % 2 = 0 THEN '2' ELSE '1' END FROM n, r UNION ALL SELECT project_id, run, 'name', 't' || CAST(project_id AS VARCHAR) FROM n, r
 UNION ALL SELECT project_id, run, 'floor', NULL FROM n, r UNION ALL SELECT project_id, 'run-02', 'extra.flags', '3' FROM n) z""")
def h17_flatten_json(f: Fleet) -> DataFrame:
    return R.flatten_runs(run_docs(f)).select("project_id", "run", "path", "value")


@query("""+ n AS (SELECT project_id FROM cuts WHERE status = 'approved' GROUP BY project_id) SELECT project_id, path, before, after, delta, alert FROM (SELECT project_id, 'cuts.ok' AS path, '1' AS before, '0' AS after, CAST(-1 AS DOUBLE) AS delta, false AS alert FROM n
 UNION ALL SELECT project_id, 'warnings', '1', '2', CAST(1 AS DOUBLE), true FROM n WHERE project_id % 2 = 0 UNION ALL SELECT project_id, 'extra.flags', NULL, '3', NULL, false FROM n) z""")
def j42_compare_runs(f: Fleet) -> DataFrame:
    leaves = R.flatten_runs(R.recent_runs(run_docs(f)).select("project_id", "place", "doc"))
    return R.compare_runs(leaves.filter("place = 2"), leaves.filter("place = 1"))


@query("+ n AS (SELECT project_id FROM cuts WHERE status = 'approved' GROUP BY project_id) SELECT project_id, path FROM n, (VALUES ('cuts.applied'), ('cuts.ok'), ('warnings'), ('name'), ('floor'), ('extra.flags')) v(path)")
def u05_all_paths(f: Fleet) -> DataFrame:
    runs = R.flatten_runs(run_docs(f).select("project_id", "run", "doc"))
    return R.all_paths(runs.filter("run = 'run'"), runs.filter("run = 'run-02'"))


@query("SELECT user_id AS project_id, run, CAST(place AS BIGINT) AS place FROM (SELECT user_id, concat('r', lpad(CAST(event_id AS VARCHAR), 8, '0')) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, concat('r', lpad(CAST(event_id AS VARCHAR), 8, '0')) DESC) AS place FROM events) z WHERE place <= 2")
def w08_recent_runs(f: Fleet) -> DataFrame:
    runs = f.table("events").select(F.col("user_id").alias("project_id"), F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("run"), F.col("ts").alias("written_at"))
    return R.recent_runs(runs).select("project_id", "run", "place")


@query("""+ q AS (SELECT n_regionkey, n_nationkey, 'run' || CAST(n_regionkey AS VARCHAR) AS label FROM nation), u AS (SELECT DISTINCT 'run' || CAST(r_regionkey AS VARCHAR) AS label, r_regionkey AS used FROM region)
 SELECT label, n_nationkey AS ord, CASE WHEN k = 1 THEN label ELSE label || '-' || lpad(CAST(k AS VARCHAR), 2, '0') END AS name FROM (SELECT q.label, q.n_nationkey, u.used + row_number() OVER (PARTITION BY q.label ORDER BY q.n_nationkey) AS k FROM q JOIN u ON u.label = q.label) z""")
def k05_archive_labels(f: Fleet) -> DataFrame:
    requests = f.table("nation").select(F.concat(F.lit("run"), F.col("n_regionkey").cast("string")).alias("label"), F.col("n_nationkey").alias("ord"))
    region = f.table("region").filter("r_regionkey > 0").select("r_regionkey", F.explode(F.sequence(F.lit(1), F.col("r_regionkey").cast("int"))).alias("k"))
    used = region.select(F.concat(F.lit("run"), F.col("r_regionkey").cast("string"), F.when(F.col("k") == 1, "").otherwise(F.concat(F.lit("-"), F.lpad(F.col("k").cast("string"), 2, "0")))).alias("label"))
    return R.archive_labels(requests, used)


@query("""+ sg AS (SELECT *, {'id': segment_id, 'start': round(start_ms / 1000.0, 3), 'end': round(end_ms / 1000.0, 3), 'text': text} AS s FROM segments),
 p AS (SELECT c.project_id, c.cut_id, sg.s, sg.segment_id, sg.start_ms, sg.end_ms, sg.start_ms >= c.start_ms AND sg.end_ms <= c.end_ms AS inside, sg.start_ms < c.start_ms AS bef, sg.end_ms > c.end_ms AS aft FROM cuts c LEFT JOIN sg ON sg.project_id = c.project_id),
 x AS (SELECT project_id, cut_id, coalesce(list(s ORDER BY start_ms, end_ms, segment_id) FILTER (WHERE inside), []) AS removed, max_by(s, start_ms) FILTER (WHERE NOT inside AND bef) AS bef, min_by(s, start_ms) FILTER (WHERE NOT inside AND aft) AS aft FROM p GROUP BY project_id, cut_id)
 SELECT c.project_id, CAST(row_number() OVER (PARTITION BY c.project_id ORDER BY c.start_ms, c.end_ms, c.cut_id) AS BIGINT) AS place, c.cut_id, CAST(to_json({'id': c.cut_id, 'start': round(c.start_ms / 1000.0, 3), 'end': round(c.end_ms / 1000.0, 3),
 'duration': round((c.end_ms - c.start_ms) / 1000.0, 3), 'reason': c.reason, 'status': c.status, 'confidence': CAST(0.5 AS DOUBLE), 'note': CASE WHEN c.project_id % 2 = 0 THEN 'note ' || c.cut_id END, 'removed': x.removed, 'before': x.bef, 'after': x.aft}) AS VARCHAR) AS payload
 FROM cuts c JOIN x ON x.project_id = c.project_id AND x.cut_id = c.cut_id""")
def k07_review_rows(f: Fleet) -> DataFrame:
    noted = f.cuts.withColumn("confidence", F.lit(0.5)).withColumn("note", F.when(F.col("project_id") % 2 == 0, F.concat(F.lit("note "), "cut_id")))
    return T.review_rows(noted, f.segments)


# Recogniser benchmarks: four candidates with two runs each, measured from the events of groups of users


def bench_runs(f: Fleet) -> DataFrame:
    e = f.table("events").select((F.col("user_id") % 4).alias("c"), (F.col("event_id") % 2 + 1).cast("int").alias("run"), "value", "user_id")
    name = F.element_at(F.array(*map(F.lit, ("small", "small+vad", "large", "large+vad"))), (F.col("c") + 1).cast("int"))
    g = e.groupBy(name.alias("candidate"), "run").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return g.select("candidate", "run", F.round(0.04 + F.col("n") % 7 / 500.0, 6).alias("cer"), (F.col("n") % 11 + 20.0).alias("wall_seconds"), F.lit(298.92).alias("duration_s"), (F.col("users") % 5).alias("hallucinations"), (F.col("n") * 1000).alias("peak_rss_bytes"), (F.col("candidate") == "large+vad").alias("unavailable"))


_BENCH = """+ g AS (SELECT CASE user_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'small+vad' WHEN 2 THEN 'large' ELSE 'large+vad' END AS candidate, CAST(event_id % 2 + 1 AS INT) AS run, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2),
 b AS (SELECT candidate, run, round(0.04 + (n % 7) / 500.0, 6) AS cer, n % 11 + 20.0 AS wall_seconds, users % 5 AS hallucinations, n * 1000 AS peak_rss_bytes, candidate = 'large+vad' AS unavailable FROM g WHERE run = 2)"""


@query(_BENCH + " SELECT candidate, CAST(cer AS DOUBLE) AS cer, CAST(wall_seconds AS DOUBLE) AS wall_seconds, hallucinations, peak_rss_bytes, unavailable, round(CAST(wall_seconds AS DOUBLE) / 298.92, 4) AS rtf FROM b")
def a13_bench_rows(f: Fleet) -> DataFrame:
    return R.bench_rows(bench_runs(f)).drop("duration_s")


@query(_BENCH + ", ok AS (SELECT * FROM b WHERE NOT unavailable), near AS (SELECT * FROM ok WHERE (cer - (SELECT min(cer) FROM ok)) * 100 <= 1.0 + 1e-9) SELECT (SELECT candidate FROM near ORDER BY wall_seconds, candidate LIMIT 1) AS candidate, (SELECT count(*) FROM near) AS tied")
def a12_choose(f: Fleet) -> DataFrame:
    return R.choose(R.bench_rows(bench_runs(f)))


@query(_BENCH + " SELECT a.candidate, CAST(a.cer AS DOUBLE) AS cer_off, CAST(a.wall_seconds AS DOUBLE) AS wall_off, CAST(v.cer AS DOUBLE) AS cer_on, CAST(v.wall_seconds AS DOUBLE) AS wall_on FROM b a JOIN b v ON v.candidate = a.candidate || '+vad'")
def a14_compare_vad(f: Fleet) -> DataFrame:
    return R.compare_vad(R.bench_rows(bench_runs(f)))


@query("SELECT project_id, cut_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY end_ms - start_ms, cut_id) AS k FROM cuts) z WHERE k = 1")
def t05_best_by(f: Fleet) -> DataFrame:
    return R.best_by(f.cuts.withColumn("len", F.col("end_ms") - F.col("start_ms")), "cut_id", "len", "cut_id")


@query("SELECT project_id, array_to_string(list_slice(list(segment_id ORDER BY segment_id), 1, 5), ',') AS sample, count(*) AS n FROM segments s WHERE NOT EXISTS (SELECT 1 FROM speech_regions r WHERE r.project_id = s.project_id AND s.start_ms >= r.start_ms - 100 AND s.start_ms <= r.end_ms + 100) GROUP BY project_id")
def t02_sample_violations(f: Fleet) -> DataFrame:
    return G.first_violators(outside_speech(f.segments, f.regions), "segment_id")


@query("SELECT project_id, segment_id, kind, CAST(row_number() OVER (PARTITION BY project_id ORDER BY segment_id, kind) AS BIGINT) AS place FROM (SELECT project_id, segment_id, 'short' AS kind FROM segments WHERE end_ms - start_ms < 2500 UNION ALL SELECT project_id, segment_id, 'empty' FROM segments WHERE (project_id + turn) % 11 = 0) z")
def t04_order_warnings(f: Fleet) -> DataFrame:
    short = f.segments.filter("end_ms - start_ms < 2500").select("project_id", "segment_id", F.lit("short").alias("kind"))
    return R.order_warnings(short, f.segments.filter("(project_id + turn) % 11 = 0").select("project_id", "segment_id", F.lit("empty").alias("kind")))
