"""Queries of interval algebra and of the cut timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.functions.time import iou, overlap, to_ms
from fleetcut.operators import intervals as I
from fleetcut.operators import timeline as T
from fleetcut.plans.fixtures import Fleet
from fleetcut.plans.register import query

_ISLANDS = """(SELECT {k}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(f) OVER (PARTITION BY {k} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT {k}, start_ms, end_ms, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY {k} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM {t}) a) b GROUP BY {k}, g)"""


def islands(table: str, keys: str = "project_id") -> str:
    return _ISLANDS.format(k=keys, t=table)


_APPROVED = "(SELECT * FROM cuts WHERE status = 'approved')"
MERGED = f"+ merged AS {islands(_APPROVED)}"
#: Removed before a moment, by the definition.
_F = "({t} - coalesce((SELECT sum(greatest(0, least(m.end_ms, {t}) - m.start_ms)) FROM merged m WHERE m.project_id = {a}.project_id AND m.start_ms < {t}), 0))"
MAPPED = MERGED + """, img AS (SELECT s.project_id, s.segment_id, s.turn AS ord,
 s.start_ms - coalesce(sum(greatest(0, least(m.end_ms, s.start_ms) - m.start_ms)), 0) AS start_ms,
 s.end_ms - coalesce(sum(greatest(0, least(m.end_ms, s.end_ms) - m.start_ms)), 0) AS end_ms,
 coalesce(bool_or(m.start_ms <= s.start_ms AND m.end_ms >= s.end_ms), false) AS dropped
 FROM segments s LEFT JOIN merged m ON m.project_id = s.project_id AND m.start_ms < s.end_ms GROUP BY s.project_id, s.segment_id, s.turn, s.start_ms, s.end_ms),
entries AS (SELECT project_id, segment_id, ord, start_ms, CASE WHEN end_ms >= n THEN greatest(start_ms, n - 1) ELSE end_ms END AS end_ms
 FROM (SELECT *, lead(start_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, ord) AS n FROM img WHERE NOT dropped) z)"""


def merged(f: Fleet) -> DataFrame:
    return I.merge_spans(T.approved(f.cuts))


def segments(f: Fleet) -> DataFrame:
    return f.segments.withColumnRenamed("turn", "ord")


@query(f"SELECT * FROM {islands('cuts')} q")
def j01_merge_spans(f: Fleet) -> DataFrame:
    return I.merge_spans(f.cuts)


_COMPLEMENT = """+ m AS {m}, e AS (SELECT project_id, start_ms, end_ms FROM m UNION ALL SELECT project_id, duration_ms, duration_ms FROM projects),
 g AS (SELECT project_id, coalesce(max(end_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, start_ms AS end_ms FROM e)
 SELECT * FROM g WHERE start_ms < end_ms"""


@query(_COMPLEMENT.format(m=islands("speech_regions")))
def j02_complement(f: Fleet) -> DataFrame:
    return I.complement(f.regions, f.projects)


@query(
    """+ pts AS (SELECT s.project_id, s.segment_id, s.start_ms AS lo, s.end_ms AS hi, greatest(s.start_ms, c.start_ms) AS start_ms, least(s.end_ms, c.end_ms) AS end_ms
 FROM segments s JOIN cuts c ON c.project_id = s.project_id AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms),
 e AS (SELECT project_id, segment_id, start_ms, end_ms FROM pts UNION ALL SELECT project_id, segment_id, end_ms, end_ms FROM segments),
 g AS (SELECT e.project_id, e.segment_id, greatest(s.start_ms, coalesce(max(e.end_ms) OVER (PARTITION BY e.project_id, e.segment_id ORDER BY e.start_ms, e.end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.start_ms)) AS start_ms, e.start_ms AS end_ms
 FROM e JOIN segments s ON s.project_id = e.project_id AND s.segment_id = e.segment_id) SELECT * FROM g WHERE start_ms < end_ms"""
)
def j03_subtract(f: Fleet) -> DataFrame:
    return I.subtract(f.segments, f.cuts, "project_id", "segment_id")


@query("SELECT s.project_id, s.segment_id, c.cut_id, greatest(0, least(s.end_ms, c.end_ms) - greatest(s.start_ms, c.start_ms)) AS overlap_ms FROM segments s JOIN cuts c ON c.project_id = s.project_id AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms")
def j05_overlap(f: Fleet) -> DataFrame:
    return I.range_join(f.segments, f.cuts).select("project_id", "segment_id", F.col("b_cut_id").alias("cut_id"), overlap(*map(F.col, ("start_ms", "end_ms", "b_start_ms", "b_end_ms"))).alias("overlap_ms"))


@query("""SELECT a.project_id, a.ord, c.cut_id, round(CASE WHEN greatest(a.end_ms, c.end_ms) > least(a.start_ms, c.start_ms) THEN
 CAST(greatest(0, least(a.end_ms, c.end_ms) - greatest(a.start_ms, c.start_ms)) AS DOUBLE) / (greatest(a.end_ms, c.end_ms) - least(a.start_ms, c.start_ms)) ELSE 0.0 END, 9) AS iou
 FROM candidates a JOIN cuts c ON c.project_id = a.project_id AND c.reason = a.reason AND a.start_ms < c.end_ms AND c.start_ms < a.end_ms""")
def j06_iou(f: Fleet) -> DataFrame:
    pairs = I.range_join(f.candidates, f.cuts).filter("reason = b_reason")
    score = iou(*map(F.col, ("start_ms", "end_ms", "b_start_ms", "b_end_ms")))
    return pairs.select("project_id", "ord", F.col("b_cut_id").alias("cut_id"), F.round(score, 9).alias("iou"))


@query("SELECT s.project_id, s.segment_id, r.start_ms AS region_ms, greatest(0, least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms)) AS overlap_ms FROM segments s JOIN speech_regions r ON r.project_id = s.project_id AND r.start_ms < s.end_ms AND s.start_ms < r.end_ms")
def j05_bin_join(f: Fleet) -> DataFrame:
    pairs = I.bin_join(f.segments, f.regions, 5000)
    return pairs.select("project_id", "segment_id", F.col("b_start_ms").alias("region_ms"), overlap(*map(F.col, ("start_ms", "end_ms", "b_start_ms", "b_end_ms"))).alias("overlap_ms"))


@query(MERGED + f", p AS (SELECT project_id, segment_id, start_ms AS t_ms FROM segments) SELECT p.*, CAST({_F.format(t='p.t_ms', a='p')} AS BIGINT) AS mapped_ms FROM p")
def j13_forward(f: Fleet) -> DataFrame:
    return T.forward(f.segments.select("project_id", "segment_id", F.col("start_ms").alias("t_ms")), merged(f))


_INVERSE_POINTS = "SELECT s.project_id, s.segment_id, CAST(s.end_ms - coalesce((SELECT sum(greatest(0, least(m.end_ms, s.end_ms) - m.start_ms)) FROM merged m WHERE m.project_id = s.project_id AND m.start_ms < s.end_ms), 0) AS BIGINT) AS u_ms FROM segments s"


@query(
    MERGED + f""", p AS ({_INVERSE_POINTS}), w AS (SELECT project_id, start_ms, end_ms, start_ms - coalesce(sum(end_ms - start_ms) OVER (PARTITION BY project_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS image FROM merged)
 SELECT p.project_id, p.segment_id, p.u_ms, CAST(p.u_ms + coalesce((SELECT sum(w.end_ms - w.start_ms) FROM w WHERE w.project_id = p.project_id AND w.image < p.u_ms), 0) AS BIGINT) AS source_ms FROM p"""
)
def j14_inverse(f: Fleet) -> DataFrame:
    points = T.forward(f.segments.select("project_id", "segment_id", "end_ms"), merged(f), "end_ms", "u_ms").drop("end_ms")
    return T.inverse(points, merged(f), f.projects)


@query(_COMPLEMENT.format(m=islands(_APPROVED)))
def j15_keeps(f: Fleet) -> DataFrame:
    return I.keeps(T.approved(f.cuts), f.projects)


@query(MERGED + " SELECT s.project_id, s.segment_id FROM segments s WHERE EXISTS (SELECT 1 FROM merged m WHERE m.project_id = s.project_id AND m.start_ms <= s.start_ms AND m.end_ms >= s.end_ms)")
def j16_swallowed(f: Fleet) -> DataFrame:
    return T.swallowed(f.segments, merged(f)).select("project_id", "segment_id")


#: The cuts as a file lists them: in half of the projects from the last to the first.
FILED = "(SELECT *, CAST(substr(cut_id, 2) AS BIGINT) * CASE WHEN project_id % 2 = 0 THEN 1 ELSE -1 END AS ord FROM cuts)"


def filed(f: Fleet) -> DataFrame:
    return f.sql(f"SELECT * FROM {FILED.replace('FROM cuts', 'FROM {cuts}')}", cuts=f.cuts)


@query(f"SELECT s.project_id, s.segment_id, min_by(c.cut_id, c.ord) AS cut_id FROM segments s LEFT JOIN {FILED} c ON c.project_id = s.project_id AND c.status = 'approved' AND c.start_ms <= s.start_ms AND c.end_ms >= s.end_ms GROUP BY s.project_id, s.segment_id")
def j17_covering_cut(f: Fleet) -> DataFrame:
    return T.covering_cut(f.segments, filed(f))


@query(MERGED + """ SELECT s.project_id, s.segment_id, coalesce((SELECT max(m.end_ms) FROM merged m WHERE m.project_id = s.project_id AND m.start_ms <= s.start_ms AND s.start_ms < m.end_ms), s.start_ms) AS clip_start_ms,
 coalesce((SELECT min(m.start_ms) FROM merged m WHERE m.project_id = s.project_id AND m.start_ms < s.end_ms AND s.end_ms <= m.end_ms), s.end_ms) AS clip_end_ms FROM segments s""")
def j18_clip_ends(f: Fleet) -> DataFrame:
    return T.clip_ends(f.segments.select("project_id", "segment_id", "start_ms", "end_ms"), merged(f)).select("project_id", "segment_id", "clip_start_ms", "clip_end_ms")


@query(MAPPED + " SELECT project_id, segment_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM entries")
def j19_map_segments(f: Fleet) -> DataFrame:
    return T.map_segments(segments(f), T.approved(f.cuts))[0].select("project_id", "segment_id", "start_ms", "end_ms")


@query(MAPPED + """ SELECT project_id, segment_id, kind FROM (SELECT project_id, segment_id, 'dropped_by_cut' AS kind FROM img WHERE dropped
 UNION ALL SELECT project_id, segment_id, 'min_display' FROM entries WHERE end_ms - start_ms < 800) z""")
def j19_mapping_warnings(f: Fleet) -> DataFrame:
    return T.map_segments(segments(f), T.approved(f.cuts))[1].select("project_id", "segment_id", "kind")


@query("SELECT project_id, cut_id, CAST(side AS INT) AS side, edge_ms FROM (SELECT project_id, cut_id, 0 AS side, start_ms AS edge_ms FROM cuts WHERE status = 'approved' UNION ALL SELECT project_id, cut_id, 1, end_ms FROM cuts WHERE status = 'approved') z")
def j31_cut_edges(f: Fleet) -> DataFrame:
    return T.cut_edges(f.cuts)


@query("""+ p AS (SELECT c.project_id, c.cut_id, s.segment_id, s.start_ms, s.end_ms, s.start_ms >= c.start_ms AND s.end_ms <= c.end_ms AS inside, s.start_ms < c.start_ms AS bef, s.end_ms > c.end_ms AS aft
 FROM cuts c LEFT JOIN segments s ON s.project_id = c.project_id)
 SELECT project_id, cut_id, coalesce(string_agg(segment_id, ',' ORDER BY start_ms, end_ms, segment_id) FILTER (WHERE inside), '') AS removed_ids,
 max_by(segment_id, start_ms) FILTER (WHERE NOT inside AND bef) AS before_id, min_by(segment_id, start_ms) FILTER (WHERE NOT inside AND aft) AS after_id FROM p GROUP BY project_id, cut_id""")
def j30_review_context(f: Fleet) -> DataFrame:
    return T.review_context(f.cuts, f.segments).withColumn("removed_ids", F.array_join("removed_ids", ","))


@query(MERGED + """ SELECT p.project_id, CAST(coalesce(sum(m.end_ms - m.start_ms), 0) AS BIGINT) AS removed_ms, CAST(p.duration_ms - coalesce(sum(m.end_ms - m.start_ms), 0) AS BIGINT) AS cut_duration_ms
 FROM projects p LEFT JOIN merged m ON m.project_id = p.project_id GROUP BY p.project_id, p.duration_ms""")
def p16_timeline_totals(f: Fleet) -> DataFrame:
    return T.removed_duration(T.approved(f.cuts), f.projects)


@query("SELECT event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events")
def p01_to_ms(f: Fleet) -> DataFrame:
    return f.table("events").select("event_id", to_ms(F.col("value")).alias("ms"))


@query("SELECT r.project_id, r.start_ms, least(r.end_ms, p.duration_ms - 1500) AS end_ms FROM speech_regions r JOIN projects p ON p.project_id = r.project_id WHERE r.start_ms < p.duration_ms - 1500")
def p02_clamp_regions(f: Fleet) -> DataFrame:
    from fleetcut.operators.speech import clamp_regions

    return clamp_regions(f.regions, f.projects.withColumn("duration_ms", F.col("duration_ms") - 1500))


@query("""+ r AS (SELECT c.project_id, c.cut_id, CAST(split_part(p.fps, '/', 1) AS DOUBLE) / CAST(split_part(p.fps, '/', 2) AS DOUBLE) AS rate, c.start_ms, c.end_ms FROM cuts c JOIN projects p ON p.project_id = c.project_id),
 q AS (SELECT *, CAST(ceil(round_even(start_ms / 1000.0 * rate * 1e6, 0) / 1e6) AS BIGINT) AS first_frame, CAST(floor(round_even(end_ms / 1000.0 * rate * 1e6, 0) / 1e6) AS BIGINT) AS last_frame FROM r)
 SELECT project_id, cut_id, first_frame, last_frame, round(first_frame / rate, 6) AS start_s, round(last_frame / rate, 6) AS end_s FROM q WHERE first_frame < last_frame""")
def p05_align_to_frames(f: Fleet) -> DataFrame:
    return T.align_to_frames(f.cuts, f.projects).select("project_id", "cut_id", "first_frame", "last_frame", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("SELECT project_id, start_ms, end_ms FROM speech_regions WHERE end_ms - start_ms >= 2000")
def p07_min_duration(f: Fleet) -> DataFrame:
    from fleetcut.operators.speech import min_duration

    return min_duration(f.regions, 2000).select("project_id", "start_ms", "end_ms")


@query(_COMPLEMENT.format(m=islands("speech_regions")).replace("SELECT * FROM g WHERE start_ms < end_ms", "SELECT project_id, start_ms + 300 AS start_ms, end_ms - 300 AS end_ms FROM g WHERE start_ms < end_ms AND end_ms - start_ms - 600 >= 400"))
def p08_pad_silences(f: Fleet) -> DataFrame:
    from fleetcut.operators.speech import pad_spans

    return pad_spans(I.complement(f.regions, f.projects))


@query(_COMPLEMENT.format(m=islands("speech_regions")).replace("SELECT * FROM g WHERE start_ms < end_ms", "SELECT project_id, start_ms + 100 AS start_ms, end_ms - 100 AS end_ms FROM g WHERE end_ms - start_ms > 200"))
def p09_floor_intervals(f: Fleet) -> DataFrame:
    from fleetcut.operators.speech import floor_intervals

    return floor_intervals(I.complement(f.regions, f.projects))


_WINDOWS = "SELECT c.project_id, c.cut_id, greatest(0, c.start_ms - 2000) AS start_ms, least(p.duration_ms, c.end_ms + 2000) AS end_ms FROM cuts c JOIN projects p ON p.project_id = c.project_id"


@query(_WINDOWS)
def p10_review_windows(f: Fleet) -> DataFrame:
    return T.review_windows(f.cuts, f.projects)


@query("SELECT project_id, cut_id, start_ms, end_ms, reason FROM cuts WHERE status = 'approved'")
def p11_approved(f: Fleet) -> DataFrame:
    return T.approved(f.cuts).drop("status")


@query(f"SELECT project_id, CAST(sum(end_ms - start_ms) + count(*) * 500 AS BIGINT) AS digest_ms FROM ({_WINDOWS}) w GROUP BY project_id")
def p12_digest_length(f: Fleet) -> DataFrame:
    return T.digest_length(T.review_windows(f.cuts, f.projects))


@query(_COMPLEMENT.format(m=islands("speech_regions")).replace("SELECT * FROM g WHERE start_ms < end_ms", "SELECT project_id, start_ms + 300 AS start_ms, end_ms - 300 AS end_ms, 'silence' AS reason, CAST(0.95 AS DOUBLE) AS confidence, 'approved' AS status FROM g WHERE start_ms < end_ms AND end_ms - start_ms - 600 >= 400"))
def p18_silence_candidates(f: Fleet) -> DataFrame:
    from fleetcut.operators.candidates import silence_candidates
    from fleetcut.operators.speech import pad_spans

    return silence_candidates(pad_spans(I.complement(f.regions, f.projects))).select("project_id", "start_ms", "end_ms", "reason", "confidence", "status")


@query(MAPPED.replace("CASE WHEN end_ms >= n THEN greatest(start_ms, n - 1) ELSE end_ms END", "CASE WHEN end_ms >= n THEN greatest(start_ms, n - 1) ELSE end_ms END") + " SELECT project_id, segment_id, CAST(CASE WHEN end_ms >= n THEN greatest(start_ms, n - 1) ELSE end_ms END AS BIGINT) AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, turn) AS n FROM (SELECT project_id, segment_id, turn, start_ms, end_ms + 1500 AS end_ms FROM segments) y) z")
def w01_separate(f: Fleet) -> DataFrame:
    return T.separate(segments(f).withColumn("end_ms", F.col("end_ms") + 1500)).select("project_id", "segment_id", "end_ms")


@query(MERGED + " SELECT project_id, start_ms, end_ms, CAST(coalesce(sum(end_ms - start_ms) OVER w, 0) AS BIGINT) AS removed_before, CAST(start_ms - coalesce(sum(end_ms - start_ms) OVER w, 0) AS BIGINT) AS image_ms FROM merged WINDOW w AS (PARTITION BY project_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w02_removed_prefix(f: Fleet) -> DataFrame:
    return I.removed_prefix(merged(f))


@query("SELECT project_id, cut_id, start_ms, prev_end FROM (SELECT *, max(end_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, cut_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM cuts WHERE status = 'approved') z WHERE start_ms < prev_end")
def w04_approved_overlaps(f: Fleet) -> DataFrame:
    from fleetcut.operators.gates import approved_overlaps

    return approved_overlaps(f.cuts)


@query("SELECT project_id, start_ms, prev_end FROM (SELECT *, lag(end_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms) AS prev_end FROM (SELECT project_id, start_ms, end_ms + 700 AS end_ms FROM speech_regions) y) z WHERE start_ms < prev_end")
def w05_region_disorder(f: Fleet) -> DataFrame:
    from fleetcut.operators.gates import region_disorder

    return region_disorder(f.regions.withColumn("end_ms", F.col("end_ms") + 700), "start_ms", "end_ms")


@query("SELECT project_id, turn, start_ms, prev_start FROM (SELECT *, lag(start_ms) OVER w AS prev_start, lag(end_ms) OVER w AS prev_end FROM (SELECT project_id, turn, start_ms, end_ms, (turn * 7 + project_id) % 5 AS k FROM segments) y WINDOW w AS (PARTITION BY project_id ORDER BY k, turn)) z WHERE start_ms < prev_start OR end_ms < prev_end")
def w06_raw_disorder(f: Fleet) -> DataFrame:
    from fleetcut.operators.gates import raw_disorder

    raw = f.segments.select("project_id", "turn", "start_ms", "end_ms", F.struct(((F.col("turn") * 7 + F.col("project_id")) % 5).alias("k"), "turn").alias("file_ord"))
    return raw_disorder(raw, "file_ord").select("project_id", "turn", "start_ms", "prev_start")


@query("SELECT project_id, concat('k', lpad(CAST(row_number() OVER (PARTITION BY project_id ORDER BY start_ms, end_ms) + 3 AS VARCHAR), 4, '0')) AS row_id, start_ms FROM speech_regions")
def w07_number_rows(f: Fleet) -> DataFrame:
    from fleetcut.operators.candidates import number_rows

    return number_rows(f.regions, "k", ["start_ms", "end_ms"], start=4).select("project_id", "row_id", "start_ms")


@query("SELECT project_id, cut_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, cut_id) AS BIGINT) AS place FROM cuts")
def t01_timeline_order(f: Fleet) -> DataFrame:
    return T.timeline_order(f.cuts, "cut_id").select("project_id", "cut_id", "place")


@query("""SELECT project_id, segment_id, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY project_id, segment_id ORDER BY end_ms - start_ms DESC, start_ms) AS k FROM (
 SELECT project_id, segment_id, start_ms, end_ms FROM (SELECT e.project_id, e.segment_id, greatest(s.start_ms, coalesce(max(e.end_ms) OVER (PARTITION BY e.project_id, e.segment_id ORDER BY e.start_ms, e.end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.start_ms)) AS start_ms, e.start_ms AS end_ms
 FROM (SELECT s.project_id, s.segment_id, greatest(s.start_ms, c.start_ms) AS start_ms, least(s.end_ms, c.end_ms) AS end_ms FROM segments s JOIN cuts c ON c.project_id = s.project_id AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms
 UNION ALL SELECT project_id, segment_id, end_ms, end_ms FROM segments) e JOIN segments s ON s.project_id = e.project_id AND s.segment_id = e.segment_id) g WHERE start_ms < end_ms) h) i WHERE k = 1""")
def t03_longest_piece(f: Fleet) -> DataFrame:
    from fleetcut.operators.candidates import longest_piece

    return longest_piece(I.subtract(f.segments, f.cuts, "project_id", "segment_id"), "project_id", "segment_id")


@query(MAPPED + """, d AS (SELECT project_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS r FROM merged GROUP BY project_id),
 w AS (SELECT e.*, length(s.text) / ((e.end_ms - e.start_ms) / 1000.0) AS cps FROM entries e JOIN segments s ON s.project_id = e.project_id AND s.segment_id = e.segment_id WHERE e.end_ms > e.start_ms)
 SELECT p.project_id, CAST(p.duration_ms - coalesce(d.r, 0) AS BIGINT) AS cut_duration_ms, (SELECT count(*) FROM entries e WHERE e.project_id = p.project_id) AS entries,
 (SELECT count(*) FROM img i WHERE i.project_id = p.project_id AND i.dropped) AS dropped_by_cut, (SELECT count(*) FROM entries e WHERE e.project_id = p.project_id AND e.end_ms - e.start_ms < 800) AS min_display,
 (SELECT count(*) FROM w WHERE w.project_id = p.project_id AND w.cps > 16) AS max_cps FROM projects p LEFT JOIN d ON d.project_id = p.project_id""")
def m1_talk_after_cuts(f: Fleet) -> DataFrame:
    """Flagship: each talk's length after its approved cuts, the entries that survive and those that need attention."""
    entries, warnings = T.map_segments(segments(f), T.approved(f.cuts))
    text = entries.join(f.segments.select("project_id", "segment_id", "text"), ["project_id", "segment_id"])
    fast = F.try_divide(F.length("text"), (F.col("end_ms") - F.col("start_ms")) / 1000.0) > 16
    per = text.groupBy("project_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(fast).alias("max_cps"))
    kinds = warnings.groupBy("project_id").agg(F.count_if(F.col("kind") == "dropped_by_cut").alias("dropped_by_cut"), F.count_if(F.col("kind") == "min_display").alias("min_display"))
    total = T.removed_duration(T.approved(f.cuts), f.projects).select("project_id", "cut_duration_ms")
    out = total.join(per, "project_id", "left").join(kinds, "project_id", "left")
    return out.select("project_id", "cut_duration_ms", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("entries", "dropped_by_cut", "min_display", "max_cps")])
