"""Speech regions against segments: coverage, anchoring, hallucinations, silences and their padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.functions.matching import has_match
from fleetcut.operators.intervals import PID, asof, covered_ms, inside, intersect_spans, merge_spans, range_join

#: How far outside a region a start still counts as spoken; the share of a segment that speech has to cover.
START_TOLERANCE_MS, MIN_COVERAGE = 100, 0.5


def clamp_regions(regions: DataFrame, projects: DataFrame) -> DataFrame:
    out = regions.join(projects.select(PID, "duration_ms"), PID).filter("start_ms < duration_ms")
    return out.withColumn("end_ms", F.least("end_ms", "duration_ms")).drop("duration_ms")


def shift_segments(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """Times relative to a region become absolute; what starts after the region's end is dropped, ends are clipped to it."""
    r = regions.select(PID, "region_ord", F.col("start_ms").alias("r0"), F.col("end_ms").alias("r1"))
    out = raw.join(r, [PID, "region_ord"]).withColumn("start_ms", F.col("r0") + F.col("start_ms")).withColumn("end_ms", F.least("r1", F.col("r0") + F.col("end_ms")))
    return out.filter("start_ms < r1").drop("r0", "r1")


def build_segments(raw: DataFrame, projects: DataFrame, order: list[str]) -> DataFrame:
    """Trimmed text, ends clipped to the duration, empty and void rows dropped, then numbered s0001, s0002, ..."""
    out = raw.join(projects.select(PID, "duration_ms"), PID)
    text = F.regexp_replace(F.col("text"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    out = out.withColumn("text", text).withColumn("end_ms", F.least("end_ms", "duration_ms")).filter("text <> '' and start_ms < end_ms").drop("duration_ms")
    number = F.row_number().over(Window.partitionBy(PID).orderBy(*order))
    return out.withColumn("segment_id", F.format_string("s%04d", number))


def min_duration(spans: DataFrame, least_ms: int) -> DataFrame:
    return spans.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def pad_spans(spans: DataFrame, pre_ms: int = 300, post_ms: int = 300, min_cut_ms: int = 400) -> DataFrame:
    """Silences shrunk by the padding that stays around speech, those still long enough to cut."""
    out = spans.withColumn("start_ms", F.col("start_ms") + post_ms).withColumn("end_ms", F.col("end_ms") - pre_ms)
    return min_duration(out, min_cut_ms)


def floor_intervals(spans: DataFrame, guard_ms: int = 100) -> DataFrame:
    """Silences without their edges, only where more than both guards is left."""
    out = spans.filter(F.col("end_ms") - F.col("start_ms") > 2 * guard_ms)
    return out.withColumn("start_ms", F.col("start_ms") + guard_ms).withColumn("end_ms", F.col("end_ms") - guard_ms)


def edl_spans(clips: DataFrame) -> DataFrame:
    """Clips in timebase units (num/den) as milliseconds, merged."""
    rate = F.split("timebase", "/")
    fps = rate[0].cast("double") / F.coalesce(rate.getItem(1).cast("double"), F.lit(1.0))
    ms = lambda c: F.rint(c / F.col("rate") * 1000).cast("bigint")
    out = clips.withColumn("rate", fps).filter("rate > 0")
    return merge_spans(out.select(PID, ms(F.col("offset")).alias("start_ms"), ms(F.col("offset") + F.col("dur")).alias("end_ms")))


def spoken_spans(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """What transcript and detector both take for speech."""
    return intersect_spans(segments, regions)


def coverage(segments: DataFrame, regions: DataFrame) -> DataFrame:
    out = covered_ms(segments, regions, PID, "segment_id")
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("covered_ms"), F.col("end_ms") - F.col("start_ms")), F.lit(0.0)))


def _starts_spoken(segments: DataFrame, regions: DataFrame, tolerance_ms: int, out: str) -> DataFrame:
    near = regions.select(PID, (F.col("start_ms") - tolerance_ms).alias("start_ms"), (F.col("end_ms") + tolerance_ms + 1).alias("end_ms"))
    return inside(segments, near, "start_ms", out)


def starts_in_speech(segments: DataFrame, regions: DataFrame, tolerance_ms: int = START_TOLERANCE_MS) -> DataFrame:
    return _starts_spoken(segments, regions, tolerance_ms, "__in").filter("__in").drop("__in")


def outside_speech(segments: DataFrame, regions: DataFrame, tolerance_ms: int = START_TOLERANCE_MS) -> DataFrame:
    return _starts_spoken(segments, regions, tolerance_ms, "__in").filter("not __in").drop("__in")


def anchor_starts(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Segments that start outside speech but are mostly spoken start with their first region; `anchored` says which."""
    placed = _starts_spoken(coverage(segments, regions), regions, START_TOLERANCE_MS, "spoken")
    first = range_join(segments.select(PID, "segment_id", "start_ms", "end_ms"), regions.select(PID, "start_ms", "end_ms")).groupBy(PID, "segment_id").agg(F.min("b_start_ms").alias("first_ms"))
    move = ~F.col("spoken") & (F.col("coverage") >= MIN_COVERAGE) & F.col("first_ms").isNotNull()
    out = placed.join(first, [PID, "segment_id"], "left").withColumn("anchored", move)
    return out.withColumn("start_ms", F.when(F.col("anchored"), F.col("first_ms")).otherwise(F.col("start_ms"))).drop("spoken", "first_ms", "covered_ms", "coverage")


def hallucinations(segments: DataFrame, regions: DataFrame, phrases: DataFrame) -> DataFrame:
    """Segments with a known invented phrase that speech covers less than half of; phrases may differ by project (a column project_id)."""
    said = has_match(segments, phrases.withColumnRenamed("phrase", "word"))
    return coverage(said, regions).filter(F.col("coverage") < MIN_COVERAGE).drop("covered_ms", "coverage")


def count_started_in_silence(segments: DataFrame, silences: DataFrame) -> DataFrame:
    """Per project, segments whose start lies in a silence [start, end)."""
    return inside(segments, silences, "start_ms").filter("inside").groupBy(PID).agg(F.count(F.lit(1)).alias("hallucinated"))


def quiet(segments: DataFrame, regions: DataFrame, projects: DataFrame) -> DataFrame:
    """quiet_before_ms and quiet_after_ms of each segment, bounded by its neighbours and by speech."""
    by = Window.partitionBy(PID).orderBy("ord")
    s = segments.withColumn("prev_end", F.lag("end_ms", 1, 0).over(by)).withColumn("next_start", F.lead("start_ms").over(by))
    ends = regions.select(PID, F.col("end_ms").alias("last_end"))
    starts = regions.select(PID, F.col("start_ms").alias("first_start"), (-F.col("start_ms")).alias("back"))
    near = asof(s, ends, "start_ms", "last_end", ["last_end"]).withColumnRenamed("mark_last_end", "last_end")
    near = asof(near.withColumn("back_end", -F.col("end_ms")), starts, "back_end", "back", ["first_start"]).withColumnRenamed("mark_first_start", "first_start")
    out = near.drop("back_end").join(projects.select(PID, "duration_ms"), PID)
    zero = F.lit(0).cast("bigint")
    before = F.greatest(zero, F.col("start_ms") - F.greatest(F.col("prev_end"), F.coalesce("last_end", zero)))
    after = F.greatest(zero, F.least(F.coalesce("next_start", "duration_ms"), F.coalesce("first_start", F.coalesce("next_start", "duration_ms"))) - F.col("end_ms"))
    return out.withColumn("quiet_before_ms", before).withColumn("quiet_after_ms", after).drop("prev_end", "next_start", "last_end", "first_start", "duration_ms")


def regions_in(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Per segment: how many regions overlap it, and the bounds of the first two and the last two."""
    pairs = range_join(segments.select(PID, "segment_id", "start_ms", "end_ms"), regions.select(PID, "start_ms", "end_ms"))
    found = pairs.groupBy(PID, "segment_id").agg(F.array_sort(F.collect_list(F.struct(F.col("b_start_ms").alias("s"), F.col("b_end_ms").alias("e")))).alias("r"))
    at = lambda i: F.try_element_at("r", F.lit(i))
    return found.select(
        PID, "segment_id", F.size("r").cast("bigint").alias("n_regions"), at(1)["e"].alias("first_end_ms"), at(2)["s"].alias("second_start_ms"), at(-1)["s"].alias("last_start_ms"), at(-2)["e"].alias("before_last_end_ms")
    )


def noise_floor(frames: DataFrame, silences: DataFrame, projects: DataFrame) -> DataFrame:
    """Level in dB of the frames (project_id, t_ms, power) inside guarded silences, of every project; null without frames or power."""
    within = inside(frames, silences, "t_ms").filter("inside")
    mean = F.avg("power")
    levels = within.groupBy(PID).agg(F.when(mean > 0, 10 * F.log10(mean)).alias("level_db"), F.count(F.lit(1)).alias("n_frames"))
    return projects.select(PID).join(levels, PID, "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0).cast("bigint")))
