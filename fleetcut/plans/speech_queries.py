"""Queries of speech regions, fillers, cut candidates and the reviewed cuts they merge with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.operators import candidates as C
from fleetcut.operators import intervals as I
from fleetcut.operators import speech as S
from fleetcut.operators import timeline as T
from fleetcut.plans.fixtures import Fleet
from fleetcut.plans.register import query
from fleetcut.plans.timeline_queries import islands, segments

_INTER = "(SELECT s.project_id, greatest(s.start_ms, r.start_ms) AS start_ms, least(s.end_ms, r.end_ms) AS end_ms FROM segments s JOIN speech_regions r ON r.project_id = s.project_id AND r.start_ms < s.end_ms AND s.start_ms < r.end_ms)"
SPOKEN = f"+ spoken AS {islands(_INTER)}"
_COV = "coalesce((SELECT sum(least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms)) FROM speech_regions r WHERE r.project_id = s.project_id AND r.start_ms < s.end_ms AND s.start_ms < r.end_ms), 0)"
_NEAR = "EXISTS (SELECT 1 FROM speech_regions r WHERE r.project_id = s.project_id AND s.start_ms >= r.start_ms - 100 AND s.start_ms <= r.end_ms + 100)"
#: Letter groups that stand in for invented phrases in the generated prose.
PHRASES = ("tionou", "erentha", "eauxment")
_PHRASES = "(VALUES " + ", ".join(f"('{p}')" for p in PHRASES) + ")"


def phrases(f: Fleet) -> DataFrame:
    return f.spark.createDataFrame([(p,) for p in PHRASES], "phrase string")


def spoken(f: Fleet) -> DataFrame:
    return S.spoken_spans(f.segments, f.regions)


def reviewed(f: Fleet) -> DataFrame:
    """The fleet's cuts with the columns that an upsert carries on."""
    return f.cuts.withColumn("confidence", F.lit(0.5)).withColumn("note", F.concat(F.lit("note "), F.col("cut_id")))


def fresh(f: Fleet) -> DataFrame:
    return f.candidates.withColumn("note", F.lit(None).cast("string"))


@query(SPOKEN + " SELECT * FROM spoken")
def j04_spoken_spans(f: Fleet) -> DataFrame:
    return spoken(f)


@query(f"SELECT project_id, segment_id, CAST(c AS BIGINT) AS covered_ms, round(CAST(c AS DOUBLE) / (end_ms - start_ms), 9) AS coverage FROM (SELECT s.*, {_COV} AS c FROM segments s) z")
def j07_coverage(f: Fleet) -> DataFrame:
    return S.coverage(f.segments, f.regions).select("project_id", "segment_id", "covered_ms", F.round("coverage", 9).alias("coverage"))


@query(f"SELECT project_id, segment_id FROM segments s WHERE {_NEAR}")
def j08_starts_in_speech(f: Fleet) -> DataFrame:
    return S.starts_in_speech(f.segments, f.regions).select("project_id", "segment_id")


@query(f"SELECT project_id, segment_id FROM segments s WHERE NOT {_NEAR}")
def j09_outside_speech(f: Fleet) -> DataFrame:
    return S.outside_speech(f.segments, f.regions).select("project_id", "segment_id")


@query(f"""+ c AS (SELECT s.*, NOT {_NEAR} AS late, {_COV} AS cov, (SELECT min(r.start_ms) FROM speech_regions r WHERE r.project_id = s.project_id AND r.start_ms < s.end_ms AND s.start_ms < r.end_ms) AS first_ms FROM segments s)
 SELECT project_id, segment_id, CASE WHEN late AND cov >= 0.5 * (end_ms - start_ms) AND first_ms IS NOT NULL THEN first_ms ELSE start_ms END AS start_ms, late AND cov >= 0.5 * (end_ms - start_ms) AND first_ms IS NOT NULL AS anchored FROM c""")
def j10_anchor_starts(f: Fleet) -> DataFrame:
    return S.anchor_starts(f.segments, f.regions).select("project_id", "segment_id", "start_ms", "anchored")


@query(f"SELECT project_id, segment_id FROM segments s WHERE EXISTS (SELECT 1 FROM {_PHRASES} p(phrase) WHERE contains(s.text, p.phrase)) AND {_COV} < 0.5 * (end_ms - start_ms)")
def j11_hallucinations(f: Fleet) -> DataFrame:
    return S.hallucinations(f.segments, f.regions, phrases(f)).select("project_id", "segment_id")


_SILENCES = f"""+ m AS {islands('speech_regions')}, e AS (SELECT project_id, start_ms, end_ms FROM m UNION ALL SELECT project_id, duration_ms, duration_ms FROM projects),
 gaps AS (SELECT * FROM (SELECT project_id, coalesce(max(end_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, start_ms AS end_ms FROM e) g WHERE start_ms < end_ms)"""


@query(_SILENCES + " SELECT s.project_id, count(*) AS hallucinated FROM segments s WHERE EXISTS (SELECT 1 FROM gaps g WHERE g.project_id = s.project_id AND s.start_ms >= g.start_ms AND s.start_ms < g.end_ms) GROUP BY s.project_id")
def j12_started_in_silence(f: Fleet) -> DataFrame:
    return S.count_started_in_silence(f.segments, I.complement(f.regions, f.projects))


@query("""+ n AS (SELECT s.*, coalesce(lag(end_ms) OVER (PARTITION BY project_id ORDER BY turn), 0) AS prev_end, lead(start_ms) OVER (PARTITION BY project_id ORDER BY turn) AS next_start FROM segments s),
 q AS (SELECT n.*, p.duration_ms, (SELECT max(r.end_ms) FROM speech_regions r WHERE r.project_id = n.project_id AND r.end_ms <= n.start_ms) AS le, (SELECT min(r.start_ms) FROM speech_regions r WHERE r.project_id = n.project_id AND r.start_ms >= n.end_ms) AS fs FROM n JOIN projects p ON p.project_id = n.project_id)
 SELECT project_id, segment_id, greatest(0, start_ms - greatest(prev_end, coalesce(le, 0))) AS quiet_before_ms, greatest(0, least(coalesce(next_start, duration_ms), coalesce(fs, coalesce(next_start, duration_ms))) - end_ms) AS quiet_after_ms FROM q""")
def j25_quiet(f: Fleet) -> DataFrame:
    return S.quiet(segments(f), f.regions, f.projects).select("project_id", "segment_id", "quiet_before_ms", "quiet_after_ms")


@query("""SELECT project_id, segment_id, count(*) AS n_regions, max(CASE WHEN i = 1 THEN e END) AS first_end_ms, max(CASE WHEN i = 2 THEN b END) AS second_start_ms, max(CASE WHEN j = 1 THEN b END) AS last_start_ms, max(CASE WHEN j = 2 THEN e END) AS before_last_end_ms
 FROM (SELECT s.project_id, s.segment_id, r.start_ms AS b, r.end_ms AS e, row_number() OVER (PARTITION BY s.project_id, s.segment_id ORDER BY r.start_ms, r.end_ms) AS i, row_number() OVER (PARTITION BY s.project_id, s.segment_id ORDER BY r.start_ms DESC, r.end_ms DESC) AS j
 FROM segments s JOIN speech_regions r ON r.project_id = s.project_id AND r.start_ms < s.end_ms AND s.start_ms < r.end_ms) z GROUP BY project_id, segment_id""")
def j26_regions_in(f: Fleet) -> DataFrame:
    return S.regions_in(f.segments, f.regions)


_FRAMES = "(SELECT user_id AS project_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 1000) AS BIGINT) % 40000 AS t_ms, abs(value) / 1000.0 AS power FROM events)"


@query(_SILENCES + f""" SELECT p.project_id, l.level_db, coalesce(l.n_frames, 0) AS n_frames FROM projects p LEFT JOIN (SELECT f.project_id, round(CASE WHEN avg(power) > 0 THEN 10 * log10(avg(power)) END, 6) AS level_db, count(*) AS n_frames FROM {_FRAMES} f
 WHERE EXISTS (SELECT 1 FROM gaps g WHERE g.project_id = f.project_id AND g.end_ms - g.start_ms > 200 AND f.t_ms >= g.start_ms + 100 AND f.t_ms < g.end_ms - 100) GROUP BY f.project_id) l ON l.project_id = p.project_id""")
def a08_noise_floor(f: Fleet) -> DataFrame:
    ms = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000).cast("bigint") % 40000
    frames = f.table("events").select(F.col("user_id").alias("project_id"), ms.alias("t_ms"), (F.abs("value") / 1000.0).alias("power"))
    out = S.noise_floor(frames, S.floor_intervals(I.complement(f.regions, f.projects)), f.projects)
    return out.withColumn("level_db", F.round("level_db", 6))


# Candidates and reviewed cuts


#: In the fleet no candidate has two partners and no cut two candidates, so the greedy matching is the pairs themselves.
_PAIRS = """pr AS (SELECT a.project_id, a.ord, c.cut_id FROM candidates a JOIN cuts c ON c.project_id = a.project_id AND c.reason = a.reason AND a.start_ms < c.end_ms AND c.start_ms < a.end_ms
 WHERE 2 * (least(a.end_ms, c.end_ms) - greatest(a.start_ms, c.start_ms)) >= greatest(a.end_ms, c.end_ms) - least(a.start_ms, c.start_ms))"""
_UPSERT = _PAIRS + """, top AS (SELECT project_id, max(CAST(substr(cut_id, 2) AS BIGINT)) AS n FROM cuts GROUP BY project_id), up AS (
 SELECT c.project_id, c.cut_id, a.start_ms, a.end_ms, a.reason, a.confidence, c.status, 'note ' || c.cut_id AS note, 'matched' AS origin FROM pr JOIN cuts c ON c.project_id = pr.project_id AND c.cut_id = pr.cut_id JOIN candidates a ON a.project_id = pr.project_id AND a.ord = pr.ord
 UNION ALL SELECT a.project_id, 'c' || lpad(CAST(coalesce(top.n, 0) + row_number() OVER (PARTITION BY a.project_id ORDER BY a.ord) AS VARCHAR), 4, '0'), a.start_ms, a.end_ms, a.reason, a.confidence, a.status, NULL, 'added'
 FROM candidates a LEFT JOIN top ON top.project_id = a.project_id WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.project_id = a.project_id AND pr.ord = a.ord)
 UNION ALL SELECT c.project_id, c.cut_id, c.start_ms, c.end_ms, c.reason, CAST(0.5 AS DOUBLE), c.status, 'note ' || c.cut_id, 'kept' FROM cuts c WHERE (c.status IN ('approved', 'rejected') OR c.reason = 'manual') AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.project_id = c.project_id AND pr.cut_id = c.cut_id))"""


@query(f"+ {_PAIRS} SELECT * FROM pr")
def j20_pair_up(f: Fleet) -> DataFrame:
    return C.pair_up(f.cuts, f.candidates)


@query(f"+ {_UPSERT} SELECT * FROM up")
def j21_merge_cuts(f: Fleet) -> DataFrame:
    return C.merge_cuts(reviewed(f), fresh(f))


@query()
def j22_resolve_overlaps(f: Fleet) -> DataFrame:
    return C.resolve_overlaps(C.merge_cuts(reviewed(f), fresh(f)))


@query(SPOKEN + " SELECT c.project_id, c.cut_id, CAST(coalesce(sum(CASE WHEN p.start_ms IS NOT NULL THEN least(c.end_ms, p.end_ms) - greatest(c.start_ms, p.start_ms) END), 0) AS BIGINT) AS speech_ms FROM cuts c LEFT JOIN spoken p ON p.project_id = c.project_id AND p.start_ms < c.end_ms AND c.start_ms < p.end_ms WHERE c.reason = 'silence' GROUP BY c.project_id, c.cut_id")
def j23_speech_overlaps(f: Fleet) -> DataFrame:
    return C.speech_overlaps(f.cuts, spoken(f))


@query(SPOKEN + """, q AS (SELECT project_id, start_ms - 700 AS start_ms, end_ms + 300 AS end_ms FROM cuts WHERE reason = 'silence'), v AS (
 SELECT s.project_id, s.segment_id, (SELECT sum(least(s.end_ms, q.end_ms) - greatest(s.start_ms, q.start_ms)) FROM q WHERE q.project_id = s.project_id AND q.start_ms < s.end_ms AND s.start_ms < q.end_ms) AS claimed,
 coalesce((SELECT sum(least(p.end_ms, q.end_ms) - greatest(p.start_ms, q.start_ms)) FROM spoken p JOIN q ON q.project_id = p.project_id AND q.start_ms < p.end_ms AND p.start_ms < q.end_ms WHERE p.project_id = s.project_id AND p.start_ms < s.end_ms AND s.start_ms < p.end_ms), 0) AS found FROM segments s)
 SELECT project_id, segment_id, CAST(claimed - found AS BIGINT) AS over_ms FROM v WHERE claimed - found > 200""")
def j24_segments_over_silence(f: Fleet) -> DataFrame:
    wide = f.cuts.withColumn("start_ms", F.col("start_ms") - 700).withColumn("end_ms", F.col("end_ms") + 300)
    return C.segments_over_silence(f.segments, wide, spoken(f))


@query("SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY src, ord) - 1 AS BIGINT) AS ord, start_ms, reason FROM (SELECT project_id, 0 AS src, ord, start_ms, reason FROM candidates UNION ALL SELECT project_id, 1, CAST(substr(cut_id, 2) AS BIGINT), start_ms, reason FROM cuts WHERE reason = 'filler') z")
def u01_all_candidates(f: Fleet) -> DataFrame:
    filler = reviewed(f).filter("reason = 'filler'").withColumn("ord", F.substring("cut_id", 2, 9).cast("bigint"))
    return C.all_candidates(fresh(f), filler).select("project_id", "ord", "start_ms", "reason")


@query()
def a04_detect_summary(f: Fleet) -> DataFrame:
    merged = C.merge_cuts(reviewed(f), fresh(f))
    return C.detect_summary(reviewed(f), fresh(f), merged, C.resolve_overlaps(merged), spoken(f))


# Fillers: letter groups that occur in the generated prose stand in for the words


STRONG, WEAK = ("the", "que", "ent"), ("on", "er")


def words(f: Fleet, weak: bool = True) -> DataFrame:
    from fleetcut.operators.fillers import filler_words

    packaged = f.spark.createDataFrame([(w, "strong") for w in STRONG] + [(w, "weak") for w in WEAK], "word string, tier string")
    own = f.projects.filter("project_id % 3 = 0").select("project_id", F.lit("on").alias("word"), F.lit("strong").alias("tier"))
    own = own.unionByName(f.projects.filter("project_id % 3 = 1").select("project_id", F.lit("tion").alias("word"), F.lit("weak").alias("tier")))
    return filler_words(f.projects, packaged, own, weak)


_WORDS = """+ packaged(word, tier) AS (VALUES ('the', 'strong'), ('que', 'strong'), ('ent', 'strong'), ('on', 'weak'), ('er', 'weak')),
 every AS (SELECT p.project_id, w.word, w.tier FROM projects p CROSS JOIN packaged w UNION ALL SELECT project_id, 'on', 'strong' FROM projects WHERE project_id % 3 = 0 UNION ALL SELECT project_id, 'tion', 'weak' FROM projects WHERE project_id % 3 = 1),
 words AS (SELECT project_id, word, min(tier) AS tier FROM every GROUP BY project_id, word)"""


@query(_WORDS + " SELECT project_id, word, tier, CAST(row_number() OVER (PARTITION BY project_id ORDER BY length(word) DESC, word) AS BIGINT) AS place FROM words")
def s16_filler_words(f: Fleet) -> DataFrame:
    return words(f)


@query(_WORDS + " SELECT project_id, word, tier FROM words")
def u04_merge_words(f: Fleet) -> DataFrame:
    return words(f).drop("place")


@query("""+ t AS (SELECT project_id, segment_id, regexp_replace(text, '[\\p{P}\\p{Z}\\p{S}\\p{C}]', '', 'g') AS t FROM segments),
 h AS (SELECT *, regexp_extract_all(t, 'ment|que|the|er|on') AS hits FROM t)
 SELECT project_id, segment_id, CAST(len(hits) AS BIGINT) AS n_hits, array_to_string(hits, ',') AS hits, t <> '' AND regexp_replace(t, 'ment|que|the|er|on', '', 'g') = '' AS is_whole,
 CASE WHEN regexp_matches(t, '^(ment|que|the|er|on)') THEN hits[1] END AS leading FROM h""")
def h04_filler_scan(f: Fleet) -> DataFrame:
    from fleetcut.operators.fillers import scan_fixed

    out = scan_fixed(f.segments, ["que", "the", "on", "er", "ment"], ascii_only=True)
    return out.select("project_id", "segment_id", F.size("hits").cast("bigint").alias("n_hits"), F.array_join(F.col("hits.word"), ",").alias("hits"), "is_whole", F.col("leading.word").alias("leading"))


@query()
def j27_filler_spans(f: Fleet) -> DataFrame:
    from fleetcut.operators.fillers import filler_spans

    return filler_spans(segments(f), f.regions, f.projects, words(f))


@query()
def j28_trim_candidates(f: Fleet) -> DataFrame:
    from fleetcut.operators.fillers import filler_spans, trim_candidates

    return trim_candidates(filler_spans(segments(f), f.regions, f.projects, words(f)), fresh(f))


@query()
def j29_filler_candidates(f: Fleet) -> DataFrame:
    from fleetcut.operators.fillers import filler_candidates

    return filler_candidates(segments(f), f.regions, f.projects, words(f), fresh(f))[0]


@query("""SELECT project_id, cut_id, CAST(CASE WHEN p = 'whole' THEN CASE WHEN t = 'strong' THEN 0.8 ELSE 0.6 END ELSE CASE WHEN t = 'strong' THEN 0.6 ELSE 0.4 END END AS DOUBLE) AS confidence FROM (
 SELECT project_id, cut_id, CASE WHEN start_ms % 3 = 0 THEN 'whole' WHEN start_ms % 3 = 1 THEN 'leading' ELSE 'trailing' END AS p, CASE WHEN end_ms % 2 = 0 THEN 'strong' ELSE 'weak' END AS t FROM cuts WHERE reason = 'filler') z""")
def p17_filler_confidence(f: Fleet) -> DataFrame:
    from fleetcut.operators.fillers import filler_confidence

    place = F.when(F.col("start_ms") % 3 == 0, "whole").when(F.col("start_ms") % 3 == 1, "leading").otherwise("trailing")
    tier = F.when(F.col("end_ms") % 2 == 0, "strong").otherwise("weak")
    return f.cuts.filter("reason = 'filler'").select("project_id", "cut_id", filler_confidence(place, tier).alias("confidence"))


_TOUCH = "SELECT s.project_id, s.segment_id, c.cut_id FROM segments s JOIN cuts c ON c.project_id = s.project_id AND c.status = 'approved' AND c.reason = 'filler' AND c.start_ms < s.end_ms AND c.end_ms > s.start_ms"


@query(_TOUCH)
def j34_touching_fillers(f: Fleet) -> DataFrame:
    cuts = T.approved(f.cuts).filter("reason = 'filler'")
    return I.range_join(f.segments, cuts).select("project_id", "segment_id", F.col("b_cut_id").alias("cut_id"))
