"""The re-transcription check: what a render should say, what is missing, and which cut it lies at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.functions.alignment import align_texts
from fleetcut.functions.batches import small_batches
from fleetcut.functions.text import cer_rate, edit_counts, normalise
from fleetcut.functions.time import round_half_even
from fleetcut.operators.fillers import scan
from fleetcut.operators.intervals import PID, asof, range_join
from fleetcut.operators.timeline import MIN_DISPLAY_MS, approved, cut_edges, inverse, map_segments, removed_duration

WINDOW_MS = 2000


def without_fillers(segments: DataFrame, cuts: DataFrame, words: DataFrame) -> DataFrame:
    """Segments' text without the fillers that approved filler cuts took out; an untouched segment keeps its raw text.

    A cut that reaches the segment's start took the filler it opens with; else one that reaches its end took the one it ends with; one
    inside takes the fillers it covers at an even pace.
    """
    fillers = approved(cuts).filter("reason = 'filler'").select(PID, "start_ms", "end_ms")
    touching = range_join(segments.select(PID, "segment_id", "start_ms", "end_ms"), fillers).groupBy(PID, "segment_id").agg(F.collect_list(F.struct(F.col("b_start_ms").alias("s"), F.col("b_end_ms").alias("e"))).alias("cuts"))
    s = scan(segments.join(touching, [PID, "segment_id"]), words)
    scale = F.length("t") / (F.col("end_ms") - F.col("start_ms"))
    span = lambda lo, hi: F.array(F.struct(lo.cast("int").alias("s"), hi.cast("int").alias("e")))

    def taken(c: Column) -> Column:
        covered = F.filter("inside", lambda h: (h["start"] < (c["e"] - F.col("start_ms")) * scale) & (h["end"] > (c["s"] - F.col("start_ms")) * scale))
        return (
            F.when((c["s"] <= F.col("start_ms")) & F.col("leading").isNotNull(), span(F.lit(0), F.col("leading.end")))
            .when((c["e"] >= F.col("end_ms")) & F.col("trailing").isNotNull(), span(F.col("trailing.start"), F.length("t")))
            .otherwise(F.transform(covered, lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e"))))
        )

    ranges = F.flatten(F.transform("cuts", taken))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    # one pass over the ranges in order, each evaluated once; what stands between them is taken whole
    kept = F.aggregate(
        F.array_sort(ranges), start,
        lambda acc, r: F.struct(F.greatest(acc["at"], r["e"]).alias("at"), F.when(r["s"] > acc["at"], F.array_append(acc["out"], F.substring(F.col("t"), acc["at"] + 1, r["s"] - acc["at"]))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.array_join(F.array_append(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t"))), ""),
    )
    said = s.select(PID, "segment_id", F.coalesce(kept, F.lit("")).alias("said"))
    return segments.join(said, [PID, "segment_id"], "left").withColumn("said", F.coalesce("said", "text"))


def expected_segments(segments: DataFrame, cuts: DataFrame, words: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Mapped segments with the normalised text a render should say and its place (offset) in the whole; empty ones are dropped.

    The least display time is always 0.8 s here, whatever the profile says.
    """
    entries, _ = map_segments(segments, approved(cuts), MIN_DISPLAY_MS)
    said = without_fillers(segments, cuts, words) if words is not None else segments.withColumn("said", F.col("text"))
    text = normalise(F.col("said"), ascii_only)
    rows = entries.join(said.select(PID, "segment_id", text.alias("said")), [PID, "segment_id"])
    by = Window.partitionBy(PID).orderBy("start_ms", "end_ms", "ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum(F.length("said")).over(by), F.lit(0)).cast("bigint"))
    return placed.filter("said <> ''")  # behind the window, as before it Spark would normalise each text a second time for the filter


def expected_text(expected: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("offset", "said")))
    return expected.groupBy(PID).agg(F.array_join(F.transform(parts, lambda x: x["said"]), "").alias("expected"))


def compare(texts: DataFrame) -> DataFrame:
    """texts (project_id, expected, actual) with the hunks that are missing and the errors of the alignment."""
    spark = texts.sparkSession
    small_batches(spark)
    # few bytes but much work a text: dealt out to a fixed number of partitions, which adaptive execution does not merge into a few tasks; by project, Spark
    # would drop the step where texts come from a grouping by project
    spread = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.withColumn("alignment", align_texts("expected", "actual"))


def missing_hunks(texts: DataFrame) -> DataFrame:
    # inner, Spark would put a filter on the hunks before the generator and align each text a second time for it
    return compare(texts).select(PID, F.inline_outer("alignment.hunks")).filter(F.col("index").isNotNull())


def alignment_cer(texts: DataFrame) -> DataFrame:
    """Not a minimal distance: from the same alignment as the hunks. Null for an empty expectation."""
    rate = F.when(F.length("expected") > 0, F.col("alignment.errors") / F.length("expected"))
    return compare(texts).select(PID, rate.alias("cer"))


def locate(hunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Hunks with the segment and the moment of the cut timeline at their first character, by an even pace within a segment."""
    e = expected.withColumn("n", F.length("said"))
    found = asof(hunks, e, "index", "offset", ["segment_id", "offset", "start_ms", "end_ms", "n"]).filter("mark_segment_id is not null")
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("index") - F.col("mark_offset")) / F.col("mark_n")))
    at = F.col("mark_start_ms") + ratio * (F.col("mark_end_ms") - F.col("mark_start_ms"))
    return found.select(*hunks.columns, F.col("mark_segment_id").alias("segment_id"), at.alias("at_ms"))


def flag_boundaries(located: DataFrame, cuts: DataFrame, merged: DataFrame, projects: DataFrame) -> DataFrame:
    """Hunks within 2 s of a cut's edge on the original timeline, with the nearest edge (the first on ties)."""
    total = removed_duration(merged, projects).select(PID, "cut_duration_ms")
    u = F.rint(F.least(F.greatest(F.col("at_ms"), F.lit(0.0)), F.col("cut_duration_ms").cast("double"))).cast("bigint")
    points = located.join(total, PID).select(PID, "index", F.col("text").alias("hunk"), u.alias("u_ms"))
    back = inverse(points, merged, projects)
    around = back.withColumn("start_ms", F.col("source_ms") - WINDOW_MS).withColumn("end_ms", F.col("source_ms") + WINDOW_MS + 1)
    edges = cut_edges(cuts).select(PID, "cut_id", "side", "edge_ms", F.col("edge_ms").alias("start_ms"), (F.col("edge_ms") + 1).alias("end_ms"))
    near = range_join(around, edges).select(PID, "index", "hunk", "source_ms", *[F.col(f"b_{c}").alias(c) for c in ("cut_id", "side", "edge_ms")])
    best = F.min_by(F.struct("cut_id", "edge_ms"), F.struct(F.abs(F.col("edge_ms") - F.col("source_ms")), "cut_id", "side")).alias("b")
    return near.groupBy(PID, "index", "hunk", "source_ms").agg(best).select(PID, "index", "hunk", "source_ms", F.col("b.cut_id").alias("cut_id"))


def verify_summary(projects: DataFrame, texts: DataFrame, flags: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per project: characters expected and heard, hunks, flags, boundaries, error rate and whether it passed (no flag)."""
    c = compare(texts)
    rate = round_half_even(F.when(F.length("expected") > 0, F.col("alignment.errors") / F.length("expected")), 4)
    base = c.select(PID, F.length("expected").cast("bigint").alias("expected_chars"), F.length("actual").cast("bigint").alias("actual_chars"), F.size("alignment.hunks").cast("bigint").alias("hunks"), rate.alias("cer"))
    n = lambda df, out: df.groupBy(PID).agg(F.count(F.lit(1)).alias(out))
    out = projects.select(PID).join(base, PID, "left").join(n(flags, "flags"), PID, "left").join(n(cut_edges(cuts), "boundaries"), PID, "left")
    return out.select(PID, "expected_chars", "actual_chars", "hunks", "cer", F.coalesce("flags", F.lit(0)).cast("bigint").alias("flags"), F.coalesce("boundaries", F.lit(0)).cast("bigint").alias("boundaries"), F.col("flags").isNull().alias("passed"))


def false_positive_rate(flags: DataFrame, cuts: DataFrame) -> DataFrame:
    """Flags over boundaries; null where there are no approved cuts."""
    edges = cuts.groupBy(PID).agg((F.count_if(F.col("status") == "approved") * 2).alias("boundaries"))
    n = flags.groupBy(PID).agg(F.count(F.lit(1)).alias("flags"))
    flagged = F.coalesce("flags", F.lit(0)).cast("bigint")
    return edges.join(n, PID, "left").select(PID, flagged.alias("flags"), "boundaries", F.try_divide(flagged, F.nullif("boundaries", F.lit(0))).alias("rate"))


def cer(pairs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Pairs (reference, hypothesis) with their normalised texts' minimal error rate; an empty reference has none."""
    a, b = normalise(F.col("reference"), ascii_only), normalise(F.col("hypothesis"), ascii_only)
    return pairs.withColumn("ref", a).withColumn("hyp", b).withColumn("cer", cer_rate(F.col("ref"), F.col("hyp")))


def cer_with_edits(pairs: DataFrame) -> DataFrame:
    return cer(pairs).withColumn("edits", edit_counts("ref", "hyp"))
