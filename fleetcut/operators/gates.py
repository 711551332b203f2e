"""Data-quality gates: each returns its violating rows (project_id, gate, item_id, value, threshold, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.operators.candidates import speech_overlaps
from fleetcut.operators.intervals import PID, complement
from fleetcut.operators.speech import hallucinations, outside_speech


class GateError(RuntimeError):
    """A gate found rows that must not be published."""


def violations(df: DataFrame, gate: str, item: Column, value: Column, threshold: Column | float | None, message: Column | str) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    said = message if isinstance(message, Column) else F.lit(message)
    return df.select(F.col(PID), F.lit(gate).alias("gate"), item.cast("string").alias("item_id"), value.cast("double").alias("value"), limit.cast("double").alias("threshold"), said.alias("message"))


def assert_gates(*gates: DataFrame, mode: str = "gate") -> DataFrame:
    """All violations as one table; in gate mode any of them stops the caller, which then publishes nothing."""
    rows = reduce(lambda a, b: a.unionByName(b), gates)
    if mode == "gate":
        first = rows.limit(5).collect()
        if first:
            raise GateError("; ".join(f"{r[PID]}/{r['item_id']}: {r['gate']} {r['message']}" for r in first))
    return rows


def first_violators(rows: DataFrame, item: str, n: int = 5) -> DataFrame:
    """(project_id, sample, n): the first n items of each project's violating rows, for a message, and how many there are. Tasks pass on n rows of a
    project at most (the rank's limit is applied before the shuffle) and a partial count."""
    place = F.row_number().over(Window.partitionBy(PID).orderBy(item))
    few = rows.select(PID, item).withColumn("__place", place).filter(F.col("__place") <= n)
    sample = few.groupBy(PID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", F.col(item).cast("string").alias("i")))), lambda x: x["i"]), ",").alias("sample"))
    return sample.join(rows.groupBy(PID).agg(F.count(F.lit(1)).alias("n")), PID)


def duplicate_ids(df: DataFrame, item: str) -> DataFrame:
    return df.groupBy(PID, item).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def approved_overlaps(cuts: DataFrame) -> DataFrame:
    """Approved cuts that start before an earlier one has ended."""
    by = Window.partitionBy(PID).orderBy("start_ms", "end_ms", "cut_id").rowsBetween(Window.unboundedPreceding, -1)
    return cuts.filter("status = 'approved'").withColumn("prev_end", F.max("end_ms").over(by)).filter("start_ms < prev_end").select(PID, "cut_id", "start_ms", "prev_end")


def region_disorder(regions: DataFrame, *order: str) -> DataFrame:
    by = Window.partitionBy(PID).orderBy(*order)
    return regions.withColumn("prev_end", F.lag("end_ms").over(by)).filter("start_ms < prev_end").select(PID, "start_ms", "prev_end")


def raw_disorder(raw: DataFrame, order: str) -> DataFrame:
    by = Window.partitionBy(PID).orderBy(order)
    out = raw.withColumn("prev_start", F.lag("start_ms").over(by)).withColumn("prev_end", F.lag("end_ms").over(by))
    return out.filter("start_ms < prev_start or end_ms < prev_end")


def g01_intervals(rows: DataFrame, projects: DataFrame, item: str) -> DataFrame:
    out = rows.join(projects.select(PID, "duration_ms"), PID).filter("not (start_ms < end_ms and start_ms >= 0 and end_ms <= duration_ms)")
    return violations(out, "G01", F.col(item), F.col("end_ms"), F.col("duration_ms"), "interval: not 0 <= start < end <= duration")


def _rules(table: str) -> tuple[Column, dict[str, Column]]:
    """What a row of a table is called, and its fields' patterns, enumerations and bounds; null where a field may be absent passes."""
    c, least = F.col, lambda name, low, strict=False: c(name) > low if strict else c(name) >= low
    pattern = lambda name, p: c(name).rlike(p)
    if table == "cuts":
        return c("cut_id"), {
            "cut_id: pattern": pattern("cut_id", r"^c\d{4}$"), "status: one of approved, proposed, rejected": c("status").isin("approved", "proposed", "rejected"),
            "confidence: between 0 and 1": c("confidence").isNull() | c("confidence").between(0, 1), "reason: not empty": F.length("reason") > 0,
        }
    if table == "segments":
        return c("segment_id"), {"segment_id: pattern": pattern("segment_id", r"^s\d{4}$"), "start: not negative": least("start_ms", 0), "text: missing": c("text").isNotNull()}
    if table == "telops":
        return c("idx"), {
            "segment_id: pattern": c("segment_id").isNull() | pattern("segment_id", r"^s\d{4}$"), "text: missing": c("text").isNotNull(),
            "start: not negative": c("start_ms").isNull() | least("start_ms", 0), "duration: positive": c("duration_ms").isNull() | least("duration_ms", 0, True),
        }
    if table == "styles":
        field = lambda k: F.try_element_at("fields", F.lit(k))
        number = lambda k, ok: field(k).isNull() | F.coalesce(ok(F.expr(f"try_cast(fields['{k}'] as double)")), F.lit(False))
        colours = ("primary_colour", "secondary_colour", "outline_colour", "back_colour")
        return c("preset"), {
            "preset: comma or line break": pattern("preset", r"^[^,\r\n]+$"), "fontsize: positive": number("fontsize", lambda x: x > 0), "alignment: between 1 and 9": number("alignment", lambda x: x.between(1, 9)),
            **{f"{k}: colour": field(k).isNull() | field(k).rlike(r"^&[Hh](?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$") for k in colours},
            **{f"{k}: not negative": number(k, lambda x: x >= 0) for k in ("outline", "shadow", "spacing", "margin_l", "margin_r", "margin_v")},
        }
    if table == "projects":
        return c(PID), {
            "sha256: pattern": pattern("sha256", "^[0-9a-f]{64}$"), "duration: not negative": least("duration_ms", 0), "fps: pattern": pattern("video.fps", r"^\d+/\d+$"),
            **{f"{k}: positive": least(k, 0, True) for k in ("video.width", "video.height", "audio.sample_rate", "audio.channels")},
        }
    if table == "profiles":
        return c(PID), {
            "audio.highpass_hz: not negative": least("audio.highpass_hz", 0), "asr.backend: unknown": c("asr.backend").isin("whisper.cpp", "mlx-whisper"), "asr.vad: unknown": c("asr.vad") == "silero-v5",
            **{f"{k}: not negative": least(k, 0) for k in ("silence.min_duration", "silence.pad_pre", "silence.pad_post", "silence.min_cut_duration", "filler.require_adjacent_silence", "render.boundary_fade", "subtitle.min_display")},
            "render.crf: between 0 and 51": c("render.crf").between(0, 51), "render.verify_asr_mode: unknown": c("render.verify_asr_mode").isin("advisory", "gate"),
            **{f"{k}: positive": least(k, 0, True) for k in ("subtitle.max_chars_per_line", "subtitle.max_lines", "subtitle.max_cps")},
        }
    raise ValueError(table)


def g02_fields(rows: DataFrame, table: str = "cuts") -> DataFrame:
    """Patterns, enumerations and bounds of cuts, segments, telops, styles, projects or profiles; every broken constraint is named in the message."""
    item, checks = _rules(table)
    said = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])), "; ")
    return violations(rows.withColumn("__said", said).filter("__said <> ''"), "G02", item, F.lit(None), None, F.col("__said"))


def g03_unique(df: DataFrame, item: str) -> DataFrame:
    return violations(duplicate_ids(df, item), "G03", F.col(item), F.col("n"), 1, "id: repeated")


def g04_approved_overlap(cuts: DataFrame) -> DataFrame:
    return violations(approved_overlaps(cuts), "G04", F.col("cut_id"), F.col("start_ms"), F.col("prev_end"), "approved cuts overlap")


def g05_regions(regions: DataFrame) -> DataFrame:
    return violations(region_disorder(regions, "ord" if "ord" in regions.columns else "start_ms"), "G05", F.col("start_ms"), F.col("start_ms"), F.col("prev_end"), "regions out of order")


def g06_speech(cuts: DataFrame, spoken: DataFrame, limit_ms: int = 200) -> DataFrame:
    return violations(speech_overlaps(cuts, spoken).filter(F.col("speech_ms") > limit_ms), "G06", F.col("cut_id"), F.col("speech_ms"), limit_ms, "silence cut removes speech")


def g07_outside_speech(segments: DataFrame, regions: DataFrame) -> DataFrame:
    return violations(outside_speech(segments, regions), "G07", F.col("segment_id"), F.col("start_ms"), None, "segment starts outside speech")


def g08_hallucinations(segments: DataFrame, regions: DataFrame, phrases: DataFrame) -> DataFrame:
    return violations(hallucinations(segments, regions, phrases), "G08", F.col("segment_id"), F.lit(None), 0.5, "known phrase over silence")


def g09_no_speech(projects: DataFrame, regions: DataFrame) -> DataFrame:
    return violations(projects.join(regions, PID, "left_anti"), "G09", F.col(PID), F.lit(0), 1, "no speech at all")


def g10_patches(problems: DataFrame) -> DataFrame:
    return violations(problems, "G10", F.col("segment_id"), F.lit(None), None, F.col("problem"))


def g11_shape(diff: DataFrame) -> DataFrame:
    return violations(diff, "G11", F.coalesce("before_id", "after_id"), F.col("ord"), None, "correction changed more than text")


def g12_telop_names(problems: DataFrame) -> DataFrame:
    return violations(problems, "G12", F.col("idx"), F.lit(None), None, F.col("problem"))


G13_SAYS = "telop needs a segment, or a start and a duration inside the talk"


def g13_telop_fields(telops: DataFrame, projects: DataFrame) -> DataFrame:
    placed = F.col("segment_id").isNotNull() | (F.col("start_ms").isNotNull() & F.col("duration_ms").isNotNull())
    limit = projects.select(F.col(PID).alias("p_pid"), F.col("duration_ms").alias("limit_ms"))
    bad = telops.join(limit, F.col(PID) == F.col("p_pid")).filter(~placed | (F.col("start_ms") > F.col("limit_ms")))
    return violations(bad, "G13", F.col("idx"), F.col("start_ms"), F.col("limit_ms"), G13_SAYS)


def g14_missing_entries(missing: DataFrame) -> DataFrame:
    return violations(missing, "G14", F.col("segment_id"), F.col("start_ms"), None, "entry not in the subtitle file")


def g15_length(renders: DataFrame) -> DataFrame:
    out = renders.withColumn("delta", F.round(F.abs(F.col("duration_s") - F.col("expected_s")) * 1000, 3)).withColumn("frame", F.round(F.lit(1000.0) / F.col("fps"), 3))
    return violations(out.filter("delta > frame"), "G15", F.col(PID), F.col("delta"), F.col("frame"), "output is off by more than a frame")


def g16_streams(renders: DataFrame, limit_ms: float = 50.0) -> DataFrame:
    out = renders.withColumn("delta", F.round(F.abs(F.col("video_s") - F.col("audio_s")) * 1000, 3))
    return violations(out.filter(F.col("delta") > limit_ms), "G16", F.col(PID), F.col("delta"), limit_ms, "streams differ in length")


def g17_loudness(renders: DataFrame, limit: float = 0.5) -> DataFrame:
    out = renders.withColumn("delta", F.round(F.abs(F.col("lufs") - F.col("target_lufs")), 2))
    return violations(out.filter(F.col("delta") > limit), "G17", F.col(PID), F.col("delta"), limit, "loudness is off its target")


def g18_repaired_length(lengths: DataFrame, limit_ms: float = 1.0) -> DataFrame:
    out = lengths.withColumn("delta", F.round(F.abs(F.col("after_s") - F.col("before_s")) * 1000, 3))
    return violations(out.filter(F.col("delta") > limit_ms), "G18", F.col(PID), F.col("delta"), limit_ms, "repaired audio changed length")


def g19_preview(previews: DataFrame) -> DataFrame:
    out = previews.withColumn("delta", F.round(F.abs(F.col("preview_s") - F.col("duration_s")) * 1000, 3)).withColumn("frame", F.round(F.lit(1000.0) / F.col("fps"), 3))
    return violations(out.filter("delta > frame"), "G19", F.col(PID), F.col("delta"), F.col("frame"), "preview is off by more than a frame")


def g20_something_left(cuts: DataFrame, projects: DataFrame) -> DataFrame:
    return violations(projects.join(complement(cuts.filter("status = 'approved'"), projects), PID, "left_anti"), "G20", F.col(PID), F.lit(0), None, "cuts leave nothing")


def g21_id_space(cuts: DataFrame, limit: int = 9999) -> DataFrame:
    n = cuts.groupBy(PID).agg(F.max(F.substring("cut_id", 2, 9).cast("bigint")).alias("n"))
    return violations(n.filter(F.col("n") > limit), "G21", F.col(PID), F.col("n"), limit, "too many cuts for the id format")


def g22_flags(flags: DataFrame, modes: DataFrame) -> DataFrame:
    """Boundary flags of projects in gate mode; advisory ones pass."""
    n = flags.groupBy(PID).agg(F.count(F.lit(1)).alias("n")).join(modes.filter("mode = 'gate'").select(PID), PID)
    return violations(n, "G22", F.col(PID), F.col("n"), 0, "boundaries flagged")


def g23_fingerprint(drift: DataFrame) -> DataFrame:
    return violations(drift.filter("missing or mismatch"), "G23", F.col(PID), F.lit(None), None, F.when(F.col("missing"), "source is missing").otherwise("source has changed"))


def g24_raw_order(raw: DataFrame, order: str) -> DataFrame:
    return violations(raw_disorder(raw, order), "G24", F.col("start_ms"), F.col("start_ms"), F.col("prev_start"), "recogniser rows out of order")


def g25_comparable(texts: DataFrame) -> DataFrame:
    empty = (F.coalesce(F.length("expected"), F.lit(0)) == 0) | (F.coalesce(F.length("actual"), F.lit(0)) == 0)
    return violations(texts.filter(empty), "G25", F.col(PID), F.lit(0), None, "nothing to compare")


def _said(gate: str, wrong: Column, item: Column, value: Column, threshold: Column, message: Column | str) -> Column:
    """A violation of one rule, null where the rule holds."""
    said = message if isinstance(message, Column) else F.lit(message)
    out = F.struct(F.lit(gate).alias("gate"), item.cast("string").alias("item_id"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), said.alias("message"))
    return F.when(F.coalesce(wrong, F.lit(False)), out)


def _rules_of(rows: DataFrame, rules: list[Column]) -> DataFrame:
    return rows.select(PID, F.inline(F.array_compact(F.array(*rules))))


def _fields(table: str) -> Column:
    item, checks = _rules(table)
    said = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])), "; ")
    return _said("G02", said != "", item, F.lit(None), F.lit(None), said)


def g26_artifacts(projects: DataFrame, segments: DataFrame, regions: DataFrame, cuts: DataFrame, telops: DataFrame) -> DataFrame:
    """Every schema gate of a project's tables at once, before any stage runs: G01 to G05 and G13.

    Each table is read once and shuffled once by project; the rules of a row make one array of violations, and rules that look at neighbours share
    that shuffle.
    """
    ends = projects.select(PID, "duration_ms")
    interval = lambda item: _said("G01", F.col("duration_ms").isNotNull() & ~((F.col("start_ms") < F.col("end_ms")) & (F.col("start_ms") >= 0) & (F.col("end_ms") <= F.col("duration_ms"))), F.col(item), F.col("end_ms"), F.col("duration_ms"), "interval: not 0 <= start < end <= duration")

    def counted(rows: DataFrame, item: str) -> DataFrame:
        by = Window.partitionBy(PID, item)
        return rows.join(ends, PID, "left").withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__k", F.row_number().over(by.orderBy("start_ms", "end_ms")))

    repeated = lambda item: _said("G03", (F.col("__n") > 1) & (F.col("__k") == 1), F.col(item), F.col("__n"), F.lit(1), "id: repeated")
    approved = F.when(F.col("status") == "approved", F.col("end_ms"))
    before = Window.partitionBy(PID).orderBy("start_ms", "end_ms", "cut_id").rowsBetween(Window.unboundedPreceding, -1)
    c = counted(cuts, "cut_id").withColumn("__prev", F.max(approved).over(before))
    overlap = _said("G04", (F.col("status") == "approved") & (F.col("start_ms") < F.col("__prev")), F.col("cut_id"), F.col("start_ms"), F.col("__prev"), "approved cuts overlap")
    r = regions.withColumn("__prev", F.lag("end_ms").over(Window.partitionBy(PID).orderBy("ord" if "ord" in regions.columns else "start_ms")))
    t = telops.join(ends.withColumnRenamed("duration_ms", "duration_ms_end"), PID, "left")
    placed = F.col("segment_id").isNotNull() | (F.col("start_ms").isNotNull() & F.col("duration_ms").isNotNull())
    return reduce(lambda a, b: a.unionByName(b), [
        _rules_of(counted(segments, "segment_id"), [interval("segment_id"), _fields("segments"), repeated("segment_id")]),
        _rules_of(c, [interval("cut_id"), _fields("cuts"), repeated("cut_id"), overlap]),
        _rules_of(r, [_said("G05", F.col("start_ms") < F.col("__prev"), F.col("start_ms"), F.col("start_ms"), F.col("__prev"), "regions out of order")]),
        _rules_of(t, [_fields("telops"), _said("G13", F.col("duration_ms_end").isNotNull() & (~placed | (F.col("start_ms") > F.col("duration_ms_end"))), F.col("idx"), F.col("start_ms"), F.col("duration_ms_end"), G13_SAYS)]),
    ])
