"""Mapping between the original and the cut timeline, and of subtitle segments onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.operators.intervals import PID, asof, asof_ends, merge_spans, range_join, removed_prefix

#: Milliseconds between entries that would touch; the display time below which an entry is reported.
SEPARATION_MS, MIN_DISPLAY_MS = 1, 800


def approved(cuts: DataFrame) -> DataFrame:
    return cuts.filter("status = 'approved'")


def removed_duration(cuts: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project: removed_ms by its merged cuts, and cut_duration_ms, what is left."""
    sums = merge_spans(cuts).groupBy(PID).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("removed_ms"))
    out = projects.select(PID, "duration_ms").join(sums, PID, "left")
    removed = F.coalesce("removed_ms", F.lit(0)).cast("bigint")
    return out.select(PID, removed.alias("removed_ms"), (F.col("duration_ms") - removed).alias("cut_duration_ms"))


def forward(points: DataFrame, merged: DataFrame, at: str = "t_ms", out: str = "mapped_ms") -> DataFrame:
    """Points on the cut timeline: less all that is removed before them; a point inside a cut falls on its start's image."""
    marks = removed_prefix(merged)
    found = asof(points, marks, at, "start_ms", ["start_ms", "end_ms", "removed_before"])
    inside = F.col(at) <= F.col("mark_end_ms")
    mapped = F.when(F.col("mark_start_ms").isNull(), F.col(at)).when(inside, F.col("mark_start_ms") - F.col("mark_removed_before")).otherwise(
        F.col(at) - F.col("mark_removed_before") - (F.col("mark_end_ms") - F.col("mark_start_ms"))
    )
    return found.select(*points.columns, mapped.cast("bigint").alias(out))


def inverse(points: DataFrame, merged: DataFrame, projects: DataFrame, at: str = "u_ms", out: str = "source_ms") -> DataFrame:
    """Points of the cut timeline on the original one; at a collapsed point the start of its cut, at the very end the end."""
    totals = removed_duration(merged, projects).join(projects.select(PID, "duration_ms"), PID)
    found = asof(points, removed_prefix(merged), at, "image_ms", ["start_ms", "end_ms", "removed_before"], inclusive=False)
    through = F.coalesce(F.col("mark_removed_before") + F.col("mark_end_ms") - F.col("mark_start_ms"), F.lit(0))
    last = F.col(at) == F.col("cut_duration_ms")
    mapped = F.when(last, F.col("duration_ms")).otherwise(F.col(at) + through)
    return found.join(totals, PID).select(*points.columns, mapped.cast("bigint").alias(out))


def swallowed(segments: DataFrame, merged: DataFrame) -> DataFrame:
    """Segments that one merged cut contains whole."""
    m = merged.select(F.col(PID).alias("m_pid"), F.col("start_ms").alias("m0"), F.col("end_ms").alias("m1"))
    return segments.join(m, (F.col(PID) == F.col("m_pid")) & (F.col("m0") <= F.col("start_ms")) & (F.col("m1") >= F.col("end_ms")), "left_semi")


def covering_cut(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """(project_id, segment_id, cut_id): the first approved cut, in file order (ord), that contains the segment; null if only a union does."""
    c = approved(cuts).select(F.col(PID).alias("c_pid"), "cut_id", F.col("ord").alias("c_ord"), F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1"))
    on = (F.col(PID) == F.col("c_pid")) & (F.col("c0") <= F.col("start_ms")) & (F.col("c1") >= F.col("end_ms"))
    return segments.join(c, on, "left").groupBy(PID, "segment_id").agg(F.min_by("cut_id", "c_ord").alias("cut_id"))


def clip_ends(segments: DataFrame, merged: DataFrame) -> DataFrame:
    """A start inside a cut moves to the cut's end, an end inside a cut to its start."""
    start = asof(segments, merged, "start_ms", "start_ms", ["start_ms", "end_ms"])
    start = start.withColumn("clip_start_ms", F.when(F.col("start_ms") < F.col("mark_end_ms"), F.col("mark_end_ms")).otherwise(F.col("start_ms"))).drop("mark_start_ms", "mark_end_ms")
    end = asof(start, merged, "end_ms", "start_ms", ["start_ms", "end_ms"], inclusive=False)
    return end.withColumn("clip_end_ms", F.when(F.col("end_ms") <= F.col("mark_end_ms"), F.col("mark_start_ms")).otherwise(F.col("end_ms"))).drop("mark_start_ms", "mark_end_ms")


def separate(entries: DataFrame) -> DataFrame:
    """Entries that touch or overlap the next one end a millisecond before it, but not before they start."""
    nxt = F.lead("start_ms").over(Window.partitionBy(PID).orderBy("start_ms", "end_ms", "ord"))
    end = F.when(F.col("end_ms") >= nxt, F.greatest(F.col("start_ms"), nxt - SEPARATION_MS)).otherwise(F.col("end_ms"))
    return entries.withColumn("end_ms", end)


def _images(segments: DataFrame, merged: DataFrame) -> DataFrame:
    """Both ends less what is removed before them, from the cuts' running sum; a start and an end inside one cut are dropped with it."""
    found = asof_ends(segments, removed_prefix(merged), (PID, "segment_id", "ord"), "start_ms", ["start_ms", "end_ms", "removed_before"])

    def image(end: str, mark: str) -> Column:
        m = F.col(mark)
        return (F.col(end) - F.coalesce(m["removed_before"] + F.least(m["end_ms"], F.col(end)) - m["start_ms"], F.lit(0))).cast("bigint").alias(end)

    dropped = F.coalesce(F.col("at_start.end_ms") >= F.col("end_ms"), F.lit(False))
    return found.select(PID, "segment_id", "ord", image("start_ms", "at_start"), image("end_ms", "at_end"), dropped.alias("dropped"))


def map_segments(segments: DataFrame, cuts: DataFrame, min_display_ms: int = MIN_DISPLAY_MS) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings): segments (project_id, segment_id, ord, start_ms, end_ms) on the cut timeline, those that a cut swallows
    dropped with a warning, the rest separated; entries shorter than min_display_ms stay and are reported."""
    images = _images(segments.select(PID, "segment_id", "ord", "start_ms", "end_ms"), merge_spans(cuts))
    entries = separate(images.filter("not dropped").drop("dropped"))
    lost = images.filter("dropped").select(PID, "segment_id", "ord", F.lit("dropped_by_cut").alias("kind"))
    short = entries.filter(F.col("end_ms") - F.col("start_ms") < min_display_ms).select(PID, "segment_id", "ord", F.lit("min_display").alias("kind"))
    return entries, lost.unionByName(short)


def align_to_frames(cuts: DataFrame, projects: DataFrame) -> DataFrame:
    """Cuts shrunk to whole frames: first_frame, last_frame and seconds as doubles; a cut without a whole frame is dropped."""
    rate = F.split("fps", "/")
    fps = rate[0].cast("double") / rate[1].cast("double")
    frame = lambda c: F.rint(F.col(c) / 1000.0 * F.col("rate") * 1e6) / 1e6
    out = cuts.join(projects.select(PID, fps.alias("rate")), PID)
    out = out.withColumn("first_frame", F.ceil(frame("start_ms")).cast("bigint")).withColumn("last_frame", F.floor(frame("end_ms")).cast("bigint"))
    out = out.filter("first_frame < last_frame")
    return out.withColumn("start_s", F.col("first_frame") / F.col("rate")).withColumn("end_s", F.col("last_frame") / F.col("rate")).drop("rate")


def review_windows(cuts: DataFrame, projects: DataFrame, margin_ms: int = 2000) -> DataFrame:
    out = cuts.join(projects.select(PID, "duration_ms"), PID)
    lo, hi = F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") - margin_ms), F.least(F.col("duration_ms"), F.col("end_ms") + margin_ms)
    return out.select(PID, "cut_id", lo.alias("start_ms"), hi.alias("end_ms"))


def digest_length(windows: DataFrame, gap_ms: int = 500) -> DataFrame:
    total = F.sum(F.col("end_ms") - F.col("start_ms")) + F.count(F.lit(1)) * gap_ms
    return windows.groupBy(PID).agg(total.cast("bigint").alias("digest_ms"))


def cut_edges(cuts: DataFrame) -> DataFrame:
    """Two rows for each approved cut: its edges."""
    edge = F.posexplode(F.array("start_ms", "end_ms")).alias("side", "edge_ms")
    return approved(cuts).select(PID, "cut_id", edge)


def review_context(cuts: DataFrame, segments: DataFrame) -> DataFrame:
    """Per cut: the segments it removes (removed_ids, an array in timeline order), the last kept segment that starts before it and the first
    kept one that ends after it, in the order (start, end, id)."""
    c = cuts.select(PID, "cut_id", "start_ms", "end_ms", (-F.col("end_ms")).alias("back"))
    order = F.struct("start_ms", "end_ms", "segment_id")
    starts = segments.groupBy(PID, "start_ms").agg(F.max(order)["segment_id"].alias("before_id"))
    # of all segments that end at or behind a moment the first: a running minimum from the last end backwards
    behind = Window.partitionBy(PID).orderBy(F.desc("end_ms")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = segments.select(PID, (-F.col("end_ms")).alias("back_ms"), F.min(order).over(behind)["segment_id"].alias("after_id")).distinct()
    out = asof(c, starts, "start_ms", "start_ms", ["before_id"], inclusive=False)
    out = asof(out.withColumnRenamed("mark_before_id", "before_id"), ends, "back", "back_ms", ["after_id"], inclusive=False)
    inside = range_join(c.select(PID, "cut_id", "start_ms", "end_ms"), segments.select(PID, "segment_id", "start_ms", "end_ms")).filter("b_start_ms >= start_ms and b_end_ms <= end_ms")
    item = F.struct("b_start_ms", "b_end_ms", F.col("b_segment_id").alias("id"))
    removed = inside.groupBy(PID, "cut_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["id"]).alias("removed_ids"))
    out = out.join(removed, [PID, "cut_id"], "left")
    return out.select(PID, "cut_id", F.coalesce("removed_ids", F.expr("cast(array() as array<string>)")).alias("removed_ids"), "before_id", F.col("mark_after_id").alias("after_id"))


def review_rows(cuts: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """The review listing: one row per cut (project_id, place, cut_id, payload), in the order (start, end, id), payload its JSON. Without
    a transcript what a cut removes and stands between is null, with one it is a list, maybe empty."""
    second = lambda ms: F.round(F.col(ms) / 1000.0, 3)
    seg = "struct<id:string,start:double,end:double,text:string>"
    if segments is None:
        rows = cuts.withColumn("removed", F.lit(None).cast(f"array<{seg}>")).withColumn("before", F.lit(None).cast(seg)).withColumn("after", F.lit(None).cast(seg))
    else:
        told = segments.select(PID, "segment_id", F.struct(F.col("segment_id").alias("id"), second("start_ms").alias("start"), second("end_ms").alias("end"), "text").alias("s"))
        context = review_context(cuts, segments)
        each = context.select(PID, "cut_id", F.posexplode("removed_ids").alias("k", "segment_id")).join(told, [PID, "segment_id"])
        removed = each.groupBy(PID, "cut_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("removed"))
        side = lambda df, key, out: df.join(told.select(PID, F.col("segment_id").alias(key), F.col("s").alias(out)), [PID, key], "left")
        rows = cuts.join(side(side(context, "before_id", "before"), "after_id", "after"), [PID, "cut_id"], "left").join(removed, [PID, "cut_id"], "left")
        rows = rows.withColumn("removed", F.coalesce("removed", F.expr(f"cast(array() as array<{seg}>)")))
    length = F.round((F.col("end_ms") - F.col("start_ms")) / 1000.0, 3)
    fields = [F.col("cut_id").alias("id"), second("start_ms").alias("start"), second("end_ms").alias("end"), length.alias("duration"), "reason", "status", "confidence", "note", "removed", "before", "after"]
    place = F.row_number().over(Window.partitionBy(PID).orderBy("start_ms", "end_ms", "cut_id")).cast("bigint")
    return rows.select(PID, place.alias("place"), "cut_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def timeline_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows with their place in a project's timeline: by start, end and the tie columns."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(PID).orderBy("start_ms", "end_ms", *ties)).cast("bigint"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    return range_join(a, b)
