"""Reports over a fleet: counts, durations, provenance, documents and the difference between runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.functions.canonical import canonical_json, double_text
from fleetcut.functions.time import round_half_even
from fleetcut.operators.intervals import PID
from fleetcut.operators.timeline import digest_length
from fleetcut.operators.verify import cer

LOUDNESS_TOLERANCE = 0.5
LEVELS = "project_id string, source_lufs double, processed_lufs double, rendered_lufs double, processed_floor_db double, target_lufs double"
ARTIFACTS = "project_id string, artifacts struct<boundaries_png:bigint,boundary_digest:string,boundary_digest_sec:double,boundary_digest_expected_sec:double>"
REASONS, STATUSES = ("silence", "filler", "manual"), ("approved", "proposed", "rejected")
# Fixed values of the data model: the stages whose output a stage consumes, and the profile sections that change a stage's output.
UPSTREAM = {
    "audio_fix": (),
    "transcribe": ("audio_fix",),
    "correct": ("transcribe",),
    "detect": ("audio_fix", "transcribe"),
    "render": ("audio_fix", "transcribe", "detect"),
    "report": ("detect", "render"),
}
SECTIONS = {"audio_fix": ("audio",), "transcribe": ("asr",), "correct": (), "detect": ("silence", "filler"), "render": ("render", "subtitle"), "report": ()}


def cuts_by_reason(cuts: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project and reason: count, seconds and one count per status; the three fixed reasons are always there."""
    fixed = projects.select(PID, F.explode(F.array(*map(F.lit, REASONS))).alias("reason"))
    length = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    sums = cuts.groupBy(PID, "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("sec"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    z = lambda c: F.coalesce(c, F.lit(0))
    return fixed.join(sums, [PID, "reason"], "full").select(PID, "reason", z("n").cast("bigint").alias("n"), F.round(z("sec"), 3).alias("sec"), *[z(s).cast("bigint").alias(s) for s in STATUSES])


def status_counts(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy(PID).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def approved_seconds(cuts: DataFrame) -> DataFrame:
    """Raw lengths of approved cuts: where they overlap, both count."""
    return cuts.filter("status = 'approved'").groupBy(PID).agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0, 3).alias("approved_sec"))


def extra_reasons(cuts: DataFrame) -> DataFrame:
    return cuts.select("reason").distinct().filter(~F.col("reason").isin(*REASONS))


def floor_section(noise: DataFrame) -> DataFrame:
    """Change of the noise floor and whether it improved; null where either level is missing."""
    delta = round_half_even(F.col("after_rms_db") - F.col("before_rms_db"), 2)
    return noise.select(PID, delta.alias("delta_db"), (delta < 0).alias("improved"))


def reduction(source_s: Column, rendered_s: Column) -> Column:
    return round_half_even(1 - F.try_divide(rendered_s, source_s), 3)


def output_floor(lufs: Column, floor_db: Column) -> Column:
    """How far the floor lies under the programme; null where either is missing."""
    return round_half_even(lufs - floor_db, 2)


def transcribe_summary(regions: DataFrame, segments: DataFrame, projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Per project: regions, segments, speech and the recogniser's time over the audio's (runs: project_id, elapsed_s; null without one)."""
    r = regions.groupBy(PID).agg(F.count(F.lit(1)).alias("regions"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    s = segments.groupBy(PID).agg(F.count(F.lit(1)).alias("segments"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = projects.join(r, PID, "left").join(s, PID, "left").join(runs.select(PID, "elapsed_s"), PID, "left")
    factor = round_half_even(F.try_divide(F.col("elapsed_s"), F.col("duration_ms") / 1000.0), 3).alias("realtime_factor")
    return out.select(PID, z("regions").alias("regions"), z("segments").alias("segments"), F.round(z("ms") / 1000.0, 3).alias("speech_sec"), F.round(F.try_divide(z("ms"), F.col("duration_ms")), 4).alias("speech_ratio"), factor)


def render_summary(renders: DataFrame, cuts: DataFrame, warnings: DataFrame) -> DataFrame:
    c, w = status_counts(cuts).select(PID, F.col("approved").alias("cuts_applied")), warnings.groupBy(PID).agg(F.count(F.lit(1)).alias("warnings"))
    out = renders.join(c, PID, "left").join(w, PID, "left")
    delta = F.round((F.col("duration_s") - F.col("expected_s")) * 1000, 3)
    return out.select(PID, F.coalesce("cuts_applied", F.lit(0)).cast("bigint").alias("cuts_applied"), "duration_s", delta.alias("delta_ms"), "lufs", F.coalesce("warnings", F.lit(0)).cast("bigint").alias("warnings"))


def loudness_section(levels: DataFrame) -> DataFrame:
    """levels (project_id, source_lufs, processed_lufs, rendered_lufs, processed_floor_db, target_lufs): the integrated loudness at three
    points beside the target, and the floor of the processed audio, absolute and under the programme; null where a level is missing."""
    lufs = F.struct(
        *[round_half_even(F.col(f"{k}_lufs"), 2).alias(k) for k in ("source", "processed", "rendered")], F.col("target_lufs").alias("target"), F.lit(LOUDNESS_TOLERANCE).alias("tolerance"),
    )
    floor = F.struct(round_half_even(F.col("processed_floor_db"), 2).alias("rms_db"), output_floor(F.col("processed_lufs"), F.col("processed_floor_db")).alias("below_programme_db"))
    return levels.select(PID, lufs.alias("loudness"), F.when(F.col("processed_floor_db").isNotNull() & F.col("processed_lufs").isNotNull(), floor).alias("output_floor"))


def artifact_section(stills: DataFrame, digests: DataFrame, windows: DataFrame) -> DataFrame:
    """Boundary stills (project_id, path) counted, the digest (project_id, path, length_ms) and the length that its windows make."""
    n = stills.groupBy(PID).agg(F.count(F.lit(1)).alias("boundaries_png"))
    out = n.join(digests.select(PID, F.col("path").alias("boundary_digest"), (F.col("length_ms") / 1000.0).alias("boundary_digest_sec")), PID, "full")
    out = out.join(digest_length(windows).select(PID, (F.col("digest_ms") / 1000.0).alias("boundary_digest_expected_sec")), PID, "full")
    cols = ("boundary_digest", "boundary_digest_sec", "boundary_digest_expected_sec")
    return out.select(PID, F.struct(F.coalesce("boundaries_png", F.lit(0)).alias("boundaries_png"), *cols).alias("artifacts"))


def project_report(
    projects: DataFrame, renders: DataFrame, cuts: DataFrame, noise: DataFrame, subtitles: DataFrame, levels: DataFrame | None = None, artifacts: DataFrame | None = None,
) -> DataFrame:
    """One row of sections per project; a missing input gives a null section and never a failure.

    levels: see loudness_section; artifacts: what artifact_section gives.
    """
    r = renders.select(PID, F.struct("duration_s", "lufs").alias("render"))
    by = cuts_by_reason(cuts, projects).groupBy(PID).agg(F.array_sort(F.collect_list(F.struct("reason", "n", "sec", *STATUSES))).alias("cuts"))
    floor = floor_section(noise).select(PID, F.struct("delta_db", "improved").alias("noise_floor"))
    subs = subtitles.select(PID, F.struct(*[c for c in subtitles.columns if c != PID]).alias("subtitles"))
    out = projects.select(PID, "duration_ms")
    levels = projects.sparkSession.createDataFrame([], LEVELS) if levels is None else levels
    artifacts = projects.sparkSession.createDataFrame([], ARTIFACTS) if artifacts is None else artifacts
    empty = lambda df: df.withColumn(PID, F.col(PID).cast(projects.schema[PID].dataType))
    for section in (r, by, floor, subs, empty(loudness_section(levels)), empty(artifacts)):
        out = out.join(section, PID, "left")
    seconds = F.col("duration_ms") / 1000.0
    return out.withColumn("duration", F.struct(seconds.alias("source_sec"), F.col("render.duration_s").alias("rendered_sec"), reduction(seconds, F.col("render.duration_s")).alias("reduction"))).drop("duration_ms")


def statistics_documents(report: DataFrame, generated_at: str) -> DataFrame:
    """The report as one JSON document per project, version 2, every key always there."""
    cols = [c for c in report.columns if c != PID]
    doc = F.to_json(F.struct(F.lit("2").alias("version"), F.lit(generated_at).alias("generated_at"), *cols), {"ignoreNullFields": "false"})
    return report.select(PID, doc.alias("document"))


def run_outcome(stages: DataFrame, planned: list[str]) -> DataFrame:
    """Per run: the stages that ran, those skipped, warnings and the first that failed (project_id, ord, stage, error, warnings)."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "stage"))), lambda x: x["stage"])
    out = stages.groupBy(PID).agg(names.alias("ran"), F.sum("warnings").cast("bigint").alias("warnings"), F.min(F.when(F.col("error").isNotNull(), F.struct("ord", "stage")))["stage"].alias("first_failed"))
    skipped = F.array_except(F.array(*map(F.lit, planned)), F.col("ran"))
    return out.select(PID, F.array_join("ran", ",").alias("ran"), F.array_join(skipped, ",").alias("skipped"), "warnings", "first_failed")


def params_hash(rows: DataFrame, *sections: str) -> Column:
    """SHA-256 of the canonical JSON of some columns of a table, as one object."""
    return F.sha2(canonical_json(T.StructType([rows.schema[n] for n in sections])), 256)


def stage_hashes(profiles: DataFrame) -> DataFrame:
    """(project_id, stage, params_sha256): of each stage the hash of the profile sections that decide its output."""
    stages = [F.struct(F.lit(stage).alias("stage"), params_hash(profiles, *names).alias("params_sha256")) for stage, names in SECTIONS.items()]
    return profiles.select(PID, F.inline(F.array(*stages)))


def stale(records: DataFrame, current: DataFrame) -> DataFrame:
    """Warnings (project_id, stage, upstream): a recorded upstream hash is not that of today's profile. No record, no warning.

    records and current: (project_id, stage, params_sha256).
    """
    rows = [(s, u) for s, ups in UPSTREAM.items() for u in ups]
    edges = F.broadcast(records.sparkSession.createDataFrame(rows, "stage string, upstream string"))
    have = records.select(PID, "stage").join(edges, "stage")
    old = records.select(PID, F.col("stage").alias("upstream"), "params_sha256")
    new = current.select(PID, F.col("stage").alias("upstream"), F.col("params_sha256").alias("now"))
    return have.join(old, [PID, "upstream"]).join(new, [PID, "upstream"]).filter("params_sha256 <> now").select(PID, "stage", "upstream")


def source_drift(projects: DataFrame, hashes: DataFrame) -> DataFrame:
    """projects (project_id, path, sha256) against hashes (path, found): missing files and changed ones."""
    out = projects.join(hashes, "path", "left")
    return out.select(PID, F.col("found").isNull().alias("missing"), F.coalesce(F.col("found") != F.col("sha256"), F.lit(False)).alias("mismatch"))


def missing_inputs(projects: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Warnings (project_id, input) for optional tables that have no row of a project."""
    rows = None
    for name, df in sorted(tables.items()):
        one = projects.select(PID).join(df.select(PID).distinct(), PID, "left_anti").select(PID, F.lit(name).alias("input"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def flatten_runs(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Dotted paths of each document's leaves: (keys, path, value, number). A list gives its length, a truth value 0 or 1; generated_at is left out.

    A document is parsed once, to VARIANT. How deep the deepest goes is counted first; then each level of objects is exploded, so leaves stream as rows and
    no document's leaves are gathered.
    """
    keys = [c for c in docs.columns if c != doc]
    bare = F.regexp_replace(F.regexp_replace(doc, r'"(?:[^"\\]|\\.)*+"', ""), r"[^{}\[\]]+", "")
    steps = F.aggregate(
        F.regexp_extract_all(bare, F.lit("."), F.lit(0)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, c: F.struct((acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most")), lambda acc: acc["most"],
    )
    depth = docs.agg(F.max(steps)).first()[0] or 0
    members = lambda: F.try_variant_get("v", "$", "map<string,variant>")
    level = docs.filter(F.col(doc).isNotNull()).select(*keys, F.lit("").alias("path"), F.parse_json(doc).alias("v"))
    found = None
    for _ in range(depth + 1):
        level = level.withColumn("m", members())
        leaves = level.filter("m IS NULL").select(*keys, "path", "v")
        found = leaves if found is None else found.unionByName(leaves)
        level = level.select(*keys, "path", F.explode("m").alias("k", "v")).filter("k <> 'generated_at'")
        level = level.select(*keys, F.when(F.col("path") == "", F.col("k")).otherwise(F.concat("path", F.lit("."), "k")).alias("path"), "v")
    kind = F.schema_of_variant("v")
    items = F.size(F.try_variant_get("v", "$", "array<variant>")).cast("double")
    number = F.when(kind.startswith("ARRAY"), items).when(kind == "BOOLEAN", F.variant_get("v", "$", "boolean").cast("double")).when(~kind.isin("STRING", "VOID"), F.try_variant_get("v", "$", "double"))
    leaves = found.withColumn("number", number)
    long = kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")  # integers beyond 64 bits
    value = F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).when(kind.startswith("ARRAY") | (kind == "BOOLEAN"), F.col("number").cast("bigint").cast("string"))
    value = value.when(kind == "BIGINT", F.try_variant_get("v", "$", "bigint").cast("string")).when(long, F.try_variant_get("v", "$", "decimal(38,0)").cast("string")).otherwise(double_text("number"))
    return leaves.select(*keys, "path", value.alias("value"), "number")


def all_paths(*runs: DataFrame) -> DataFrame:
    """The paths that any of the flattened runs of a project has."""
    rows = [r.select(PID, "path") for r in runs]
    return reduce(lambda a, b: a.unionByName(b), rows).distinct()


def order_warnings(*warnings: DataFrame) -> DataFrame:
    """Warnings (project_id, segment_id, kind) of several sources in the order in which they are shown: by segment, then kind; `place` counts from 1."""
    rows = reduce(lambda a, b: a.unionByName(b), [w.select(PID, "segment_id", "kind") for w in warnings])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(PID).orderBy("segment_id", "kind")).cast("bigint"))


def recent_runs(runs: DataFrame, n: int = 2) -> DataFrame:
    """The last n runs of a project by (written_at, run); place 1 is the newest."""
    by = Window.partitionBy(PID).orderBy(F.desc("written_at"), F.desc("run"))
    return runs.withColumn("place", F.row_number().over(by).cast("bigint")).filter(F.col("place") <= n)


def compare_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Leaves that differ between two flattened runs (project_id, path, value, number); alert where a count named after a warning, flag or error grew."""
    p = previous.select(PID, "path", F.col("value").alias("before"), F.col("number").alias("n0"))
    c = current.select(PID, "path", F.col("value").alias("after"), F.col("number").alias("n1"))
    out = p.join(c, [PID, "path"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    delta = F.col("n1") - F.col("n0")
    grew = F.coalesce(delta > 0, F.lit(False)) & F.col("path").rlike("(?i)warning|flag|error")
    return out.select(PID, "path", "before", "after", delta.alias("delta"), grew.alias("alert"))


def archive_labels(requests: DataFrame, used: DataFrame) -> DataFrame:
    """The first free name of each label: label, label-02, label-03, ...; requests (label, ord), used (label)."""
    base = used.select(F.regexp_replace("label", r"-\d{2,}$", "").alias("label"), F.coalesce(F.nullif(F.regexp_extract("label", r"-(\d{2,})$", 1), F.lit("")).cast("int"), F.lit(1)).alias("k"))
    top = base.groupBy("label").agg(F.max("k").alias("top"))
    n = F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("label").orderBy("ord"))
    out = requests.join(top, "label", "left").withColumn("k", n)
    return out.select("label", "ord", F.when(F.col("k") == 1, F.col("label")).otherwise(F.format_string("%s-%02d", F.col("label"), F.col("k"))).alias("name"))


# Benchmarks of recognisers


def measure_runs(runs: DataFrame, segments: DataFrame, references: DataFrame, silences: DataFrame) -> DataFrame:
    """Runs (candidate, run, project_id, wall_seconds, duration_s, peak_rss_bytes, unavailable) with the error rate of their segments' text (candidate,
    run, project_id, ord, start_ms, end_ms, text) against the reference (project_id, reference), and the segments started in a silence."""
    keys = ["candidate", "run", PID]
    said = transcript_text(segments, *keys).withColumnRenamed("text", "hypothesis").join(references, PID)
    rate = cer(said).select(*keys, "cer")
    inside = segments.join(silences.select(F.col(PID).alias("q_pid"), F.col("start_ms").alias("q0"), F.col("end_ms").alias("q1")), (F.col(PID) == F.col("q_pid")) & (F.col("start_ms") >= F.col("q0")) & (F.col("start_ms") < F.col("q1")), "left_semi")
    n = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("hallucinations"))
    return runs.join(rate, keys, "left").join(n, keys, "left").withColumn("hallucinations", F.when(F.col("cer").isNotNull(), F.coalesce("hallucinations", F.lit(0).cast("bigint"))))


def bench_rows(runs: DataFrame) -> DataFrame:
    """Each candidate's last run (candidate, run, cer, wall_seconds, duration_s, hallucinations, peak_rss_bytes, unavailable)."""
    last = F.max_by(F.struct("cer", "wall_seconds", "duration_s", "hallucinations", "peak_rss_bytes", "unavailable"), "run").alias("r")
    rows = runs.groupBy("candidate").agg(last).select("candidate", "r.*")
    return rows.withColumn("rtf", F.round(F.try_divide(F.col("wall_seconds"), F.col("duration_s")), 4))


def choose(bench: DataFrame, tie_points: float = 1.0) -> DataFrame:
    """The candidate with the least wall time among those within tie_points (percent) of the lowest error rate."""
    ok = bench.filter("not unavailable and cer is not null")
    low = ok.agg(F.min("cer").alias("low"))
    near = ok.join(F.broadcast(low), (F.col("cer") - F.col("low")) * 100 <= tie_points + 1e-9)
    return near.agg(F.min_by("candidate", F.struct("wall_seconds", "candidate")).alias("candidate"), F.count(F.lit(1)).alias("tied"))


def compare_vad(bench: DataFrame, suffix: str = "+vad") -> DataFrame:
    """Candidates beside their re-run with voice detection, whose name has the suffix."""
    a = bench.filter(~F.col("candidate").endswith(suffix)).select("candidate", F.col("cer").alias("cer_off"), F.col("wall_seconds").alias("wall_off"))
    b = bench.filter(F.col("candidate").endswith(suffix)).select(F.expr(f"substring(candidate, 1, length(candidate) - {len(suffix)})").alias("candidate"), F.col("cer").alias("cer_on"), F.col("wall_seconds").alias("wall_on"))
    return a.join(b, "candidate")


def best_by(df: DataFrame, item: str, *order: str) -> DataFrame:
    return df.groupBy(PID).agg(F.min_by(item, F.struct(*order)).alias(item))


def transcript_text(segments: DataFrame, *keys: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return segments.groupBy(*(keys or (PID,))).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
