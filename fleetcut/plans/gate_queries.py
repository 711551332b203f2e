"""Queries of the data-quality gates: the violating rows of a fleet with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.operators import correct as K
from fleetcut.operators import gates as G
from fleetcut.operators import subtitles as U
from fleetcut.operators import timeline as T
from fleetcut.plans.fixtures import Fleet
from fleetcut.plans.register import query
from fleetcut.plans.speech_queries import _COV, _NEAR, _PHRASES, SPOKEN, phrases, reviewed, spoken
from fleetcut.plans.text_queries import _SHIFTED, MISSING, entries, flags, presets, shifted
from fleetcut.plans.timeline_queries import merged, segments


def faulty(f: Fleet) -> DataFrame:
    """Cuts with a broken field in a few rows."""
    k = F.col("start_ms") % 17
    c = reviewed(f)
    c = c.withColumn("status", F.when(k == 3, "maybe").otherwise(F.col("status"))).withColumn("confidence", F.when(k == 5, 1.5).otherwise(F.col("confidence")))
    return c.withColumn("end_ms", F.when(k == 7, F.col("start_ms")).otherwise(F.col("end_ms"))).withColumn("cut_id", F.when(k == 9, F.lit("x1")).otherwise(F.col("cut_id")))


def keys(df: DataFrame) -> DataFrame:
    return df.select("project_id", "item_id")


@query("SELECT c.project_id, CASE WHEN c.start_ms % 17 = 9 THEN 'x1' ELSE cut_id END AS item_id FROM cuts c JOIN projects p ON p.project_id = c.project_id WHERE c.start_ms % 17 = 7 OR NOT (c.start_ms < c.end_ms AND c.start_ms >= 0 AND c.end_ms <= p.duration_ms)")
def g01_intervals(f: Fleet) -> DataFrame:
    return keys(G.g01_intervals(faulty(f), f.projects, "cut_id"))


@query("SELECT project_id, CASE WHEN start_ms % 17 = 9 THEN 'x1' ELSE cut_id END AS item_id, CASE start_ms % 17 WHEN 3 THEN 'status: one of approved, proposed, rejected' WHEN 5 THEN 'confidence: between 0 and 1' ELSE 'cut_id: pattern' END AS message FROM cuts WHERE start_ms % 17 IN (3, 5, 9)")
def g02_fields(f: Fleet) -> DataFrame:
    return G.g02_fields(faulty(f)).select("project_id", "item_id", "message")


@query("SELECT project_id, segment_id AS item_id, CAST(count(*) AS DOUBLE) AS value FROM patches GROUP BY project_id, segment_id HAVING count(*) > 1")
def g03_unique(f: Fleet) -> DataFrame:
    return G.g03_unique(f.patches, "segment_id").select("project_id", "item_id", "value")


@query("SELECT project_id, cut_id AS item_id FROM (SELECT *, max(end_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, cut_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM cuts WHERE status = 'approved') z WHERE start_ms < prev")
def g04_approved_overlap(f: Fleet) -> DataFrame:
    return keys(G.g04_approved_overlap(f.cuts))


@query("SELECT project_id, CAST(start_ms AS VARCHAR) AS item_id FROM (SELECT *, lag(end_ms) OVER (PARTITION BY project_id ORDER BY start_ms) AS prev FROM (SELECT project_id, start_ms, end_ms + 700 AS end_ms FROM speech_regions) y) z WHERE start_ms < prev")
def g05_regions(f: Fleet) -> DataFrame:
    return keys(G.g05_regions(f.regions.withColumn("end_ms", F.col("end_ms") + 700)))


@query(SPOKEN + ", q AS (SELECT project_id, cut_id, start_ms, end_ms + 400 AS end_ms FROM cuts WHERE reason = 'silence') SELECT c.project_id, c.cut_id AS item_id, CAST(sum(least(c.end_ms, p.end_ms) - greatest(c.start_ms, p.start_ms)) AS DOUBLE) AS value FROM q c JOIN spoken p ON p.project_id = c.project_id AND p.start_ms < c.end_ms AND c.start_ms < p.end_ms GROUP BY c.project_id, c.cut_id HAVING sum(least(c.end_ms, p.end_ms) - greatest(c.start_ms, p.start_ms)) > 200")
def g06_speech(f: Fleet) -> DataFrame:
    return G.g06_speech(f.cuts.withColumn("end_ms", F.col("end_ms") + 400), spoken(f)).select("project_id", "item_id", "value")


@query(f"SELECT project_id, segment_id AS item_id FROM segments s WHERE NOT {_NEAR}")
def g07_outside_speech(f: Fleet) -> DataFrame:
    return keys(G.g07_outside_speech(f.segments, f.regions))


@query(f"SELECT project_id, segment_id AS item_id FROM segments s WHERE EXISTS (SELECT 1 FROM {_PHRASES} p(phrase) WHERE contains(s.text, p.phrase)) AND {_COV} < 0.5 * (end_ms - start_ms)")
def g08_hallucinations(f: Fleet) -> DataFrame:
    return keys(G.g08_hallucinations(f.segments, f.regions, phrases(f)))


@query("SELECT project_id, CAST(project_id AS VARCHAR) AS item_id FROM projects p WHERE NOT EXISTS (SELECT 1 FROM speech_regions r WHERE r.project_id = p.project_id AND r.end_ms - r.start_ms > 3000)")
def g09_no_speech(f: Fleet) -> DataFrame:
    return keys(G.g09_no_speech(f.projects, f.regions.filter("end_ms - start_ms > 3000")))


@query("SELECT DISTINCT project_id, segment_id AS item_id, 'unknown id' AS message FROM patches a WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.project_id = a.project_id AND s.segment_id = a.segment_id) UNION ALL SELECT project_id, segment_id, 'repeated id' FROM patches GROUP BY project_id, segment_id HAVING count(*) > 1")
def g10_patches(f: Fleet) -> DataFrame:
    return G.g10_patches(K.check_patches(f.patches, f.segments)).select("project_id", "item_id", "message")


@query(f"SELECT s.project_id, s.segment_id AS item_id FROM segments s LEFT JOIN {_SHIFTED} a ON a.project_id = s.project_id AND a.turn = s.turn WHERE a.segment_id IS NULL OR a.start_ms <> s.start_ms")
def g11_shape(f: Fleet) -> DataFrame:
    return keys(G.g11_shape(K.shape_diff(segments(f), shifted(f))))


@query("SELECT project_id, CAST(idx AS VARCHAR) AS item_id FROM telops WHERE style_preset = 'missing' AND project_id % 4 <> 0")
def g12_telop_names(f: Fleet) -> DataFrame:
    mapped, _ = T.map_segments(segments(f), T.approved(f.cuts))
    shown = U.resolve_telops(f.telops, mapped, f.segments, presets(f), merged(f), f.projects)
    return keys(G.g12_telop_names(shown.filter("problem in ('unknown preset', 'unknown segment')")))


@query("SELECT t.project_id, CAST(t.idx AS VARCHAR) AS item_id FROM telops t JOIN projects p ON p.project_id = t.project_id WHERE t.segment_id IS NULL AND (t.project_id % 6 = 1 OR t.start_ms * 3 > p.duration_ms)")
def g13_telop_fields(f: Fleet) -> DataFrame:
    t = f.telops.withColumn("duration_ms", F.when(F.col("project_id") % 6 != 1, F.col("duration_ms"))).withColumn("start_ms", F.col("start_ms") * 3)
    return keys(G.g13_telop_fields(t, f.projects))


@query(MISSING + " SELECT project_id, 'G14' AS gate, segment_id AS item_id, CAST(start_ms AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold, 'entry not in the subtitle file' AS message FROM lost")
def g14_missing_entries(f: Fleet) -> DataFrame:
    e = entries(f)
    srt = e.filter("(project_id + start_ms) % 9 <> 4").select("project_id", F.col("ord").alias("n"), "start_ms", "end_ms", "text")
    return G.g14_missing_entries(U.missing_entries(e, srt))


def measured(f: Fleet) -> DataFrame:
    """Measurements of each talk's render: lengths off by up to 60 ms, streams by up to 80 ms, loudness by up to 1.5."""
    p, d = F.col("project_id"), F.col("duration_ms") / 1000.0
    fps = F.when(p % 2 == 0, 25.0).otherwise(30000.0 / 1001.0)
    return f.projects.select(
        "project_id", fps.alias("fps"), d.alias("expected_s"), (d + (p % 7) / 100.0).alias("duration_s"), d.alias("video_s"), (d + (p % 9) / 100.0).alias("audio_s"),
        (F.lit(-14.0) - (p % 13) / 8.0).alias("lufs"), F.lit(-14.0).alias("target_lufs"), (d + (p % 7) / 100.0 + (p % 3) / 40.0).alias("preview_s"), d.alias("before_s"), (d + (p % 4) / 1000.0).alias("after_s"),
    )


_DELTA = "SELECT project_id, CAST(project_id AS VARCHAR) AS item_id, value FROM (SELECT project_id, {value} AS value, CASE WHEN project_id % 2 = 0 THEN 40.0 ELSE 33.367 END AS frame FROM projects) z WHERE value > {limit}"


def measures(df: DataFrame) -> DataFrame:
    return df.select("project_id", "item_id", "value")


@query(_DELTA.format(value="CAST((project_id % 7) * 10 AS DOUBLE)", limit="frame"))
def g15_length(f: Fleet) -> DataFrame:
    return measures(G.g15_length(measured(f)))


@query(_DELTA.format(value="CAST((project_id % 9) * 10 AS DOUBLE)", limit="50"))
def g16_streams(f: Fleet) -> DataFrame:
    return measures(G.g16_streams(measured(f)))


@query(_DELTA.format(value="round((project_id % 13) / 8.0, 2)", limit="0.5"))
def g17_loudness(f: Fleet) -> DataFrame:
    return measures(G.g17_loudness(measured(f)))


@query(_DELTA.format(value="CAST(project_id % 4 AS DOUBLE)", limit="1"))
def g18_repaired_length(f: Fleet) -> DataFrame:
    return measures(G.g18_repaired_length(measured(f)))


@query(_DELTA.format(value="CAST((project_id % 3) * 25 AS DOUBLE)", limit="frame"))
def g19_preview(f: Fleet) -> DataFrame:
    return measures(G.g19_preview(measured(f)))


@query("SELECT project_id, CAST(project_id AS VARCHAR) AS item_id FROM projects WHERE project_id % 10 = 3")
def g20_something_left(f: Fleet) -> DataFrame:
    whole = f.projects.filter("project_id % 10 = 3").select("project_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit("approved").alias("status"))
    return keys(G.g20_something_left(f.cuts.select("project_id", "start_ms", "end_ms", "status").unionByName(whole), f.projects))


@query("SELECT project_id, CAST(project_id AS VARCHAR) AS item_id, CAST(max(CAST(substr(cut_id, 2) AS BIGINT)) * 2500 AS DOUBLE) AS value FROM cuts GROUP BY project_id HAVING max(CAST(substr(cut_id, 2) AS BIGINT)) * 2500 > 9999")
def g21_id_space(f: Fleet) -> DataFrame:
    many = f.cuts.withColumn("cut_id", F.concat(F.lit("c"), (F.substring("cut_id", 2, 9).cast("bigint") * 2500).cast("string")))
    return measures(G.g21_id_space(many))


@query()
def g22_flags(f: Fleet) -> DataFrame:
    modes = f.projects.select("project_id", F.when(F.col("project_id") % 3 == 0, "advisory").otherwise("gate").alias("mode"))
    return G.g22_flags(flags(f), modes)


@query("SELECT project_id, CAST(project_id AS VARCHAR) AS item_id, CASE WHEN project_id % 7 = 3 THEN 'source is missing' ELSE 'source has changed' END AS message FROM projects WHERE project_id % 7 = 3 OR project_id % 5 = 1")
def g23_fingerprint(f: Fleet) -> DataFrame:
    from fleetcut.plans.report_queries import j41_source_drift

    return G.g23_fingerprint(j41_source_drift(f)).select("project_id", "item_id", "message")


@query("SELECT project_id, CAST(start_ms AS VARCHAR) AS item_id FROM (SELECT *, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM (SELECT project_id, turn, start_ms, end_ms, (turn * 7 + project_id) % 5 AS k FROM segments) y WINDOW w AS (PARTITION BY project_id ORDER BY k, turn)) z WHERE start_ms < ps OR end_ms < pe")
def g24_raw_order(f: Fleet) -> DataFrame:
    raw = f.segments.select("project_id", "start_ms", "end_ms", F.struct(((F.col("turn") * 7 + F.col("project_id")) % 5).alias("k"), "turn").alias("file_ord"))
    return keys(G.g24_raw_order(raw, "file_ord"))


@query("SELECT project_id, CAST(project_id AS VARCHAR) AS item_id FROM projects WHERE project_id % 6 = 2")
def g25_comparable(f: Fleet) -> DataFrame:
    texts = f.projects.select("project_id", F.lit("a").alias("expected"), F.when(F.col("project_id") % 6 != 2, "b").otherwise("").alias("actual"))
    return keys(G.g25_comparable(texts))


@query()
def g26_artifacts(f: Fleet) -> DataFrame:
    return G.g26_artifacts(f.projects, f.segments, f.regions, faulty(f), f.telops)


