"""Readers: directories of many projects' JSON, SRT, log and media files, or packs of them, to tables, one job for the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetcut.functions.batches import small_batches
from fleetcut.functions.time import to_ms
from fleetcut.operators.intervals import PID
from fleetcut.operators.subtitles import STYLE_TYPES, parse_srt
from fleetcut.sources.documents import Shape, SourceError, bad_documents, project_of, raw_documents, read_json

__all__ = ["SourceError", "bad_documents"]


def instant(text: Column) -> Column:
    """A moment from text that names its offset from UTC; without one it is an error."""
    fail = F.raise_error(F.concat(F.lit("no offset in the time "), text)).cast("timestamp")
    return F.when(text.isNull() | text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.to_timestamp(text)).otherwise(fail)


_STAGE = "struct<done_at:string,params_sha256:string,tool_versions:map<string,string>>"
_SOURCE = "struct<path:string,sha256:string,duration:double,video:struct<codec:string,width:int,height:int,fps:string>,audio:struct<codec:string,sample_rate:int,channels:int>>"
_EDIT, _WORD = "struct<at:string,tool:string,before:string>", "struct<start:double,end:double,text:string>"
_CLIP = "struct<name:string,src:string,start:bigint,dur:bigint,offset:bigint,stream:int>"

#: Leaves of a profile that the operators read, with their packaged defaults.
PROFILE = {
    "audio": {"denoise": ("string", "deepfilternet"), "highpass_hz": ("int", 80), "loudnorm": {"i": ("double", -14.0), "tp": ("double", -1.0), "lra": ("double", 11.0)}},
    "asr": {"backend": ("string", "whisper.cpp"), "model": ("string", "large-v3-turbo"), "language": ("string", "ja"), "vad": ("string", "silero-v5")},
    "silence": {"threshold": ("string", "4%"), "min_duration": ("double", 0.6), "pad_pre": ("double", 0.3), "pad_post": ("double", 0.3), "min_cut_duration": ("double", 0.4)},
    "filler": {"enable_weak": ("boolean", False), "require_adjacent_silence": ("double", 0.2)},
    "render": {"crf": ("int", 18), "preset": ("string", "slow"), "boundary_fade": ("double", 0.01), "verify_asr_mode": ("string", "gate")},
    "subtitle": {"max_chars_per_line": ("int", 20), "max_lines": ("int", 2), "min_display": ("double", 0.8), "max_cps": ("double", 8.0)},
}


def _kind(x) -> str:
    return f"struct<{','.join(f'{k}:{_kind(v)}' for k, v in x.items())}>" if isinstance(x, dict) else x[0]


#: What each kind of document may hold. Words may carry further keys, as other recognisers add them; recogniser output and media logs are of other tools.
SHAPES = {
    "manifest": Shape(f"source {_SOURCE}, created_at string, stages map<string,{_STAGE}>", ("source",)),
    "profile": Shape(", ".join(f"{s} {_kind(x)}" for s, x in PROFILE.items())),
    "transcript": Shape(
        f"segments array<struct<id:string,start:double,end:double,text:string,source:string,edits:array<{_EDIT}>,words:array<{_WORD}>>>", ("segments",),
        "version string, audio_source string, asr struct<backend:string,model:string,vad:string>", ("segments.words",),
    ),
    "regions": Shape("segments array<struct<start:double,end:double>>", ("segments",), "version string, backend string"),
    "cuts": Shape("cuts array<struct<id:string,start:double,end:double,reason:string,confidence:double,status:string,note:string>>", ("cuts",)),
    "telops": Shape("telops array<struct<text:string,style_preset:string,segment_id:string,start:double,duration:double>>", ("telops",)),
    "styles": Shape(f"presets map<string,struct<{','.join(f'{k}:{t}' for k, t in STYLE_TYPES.items())}>>", ("presets",)),
    "noise_floor": Shape("silence_sec double, before_rms_db double, after_rms_db double, before struct<rms_db:double>, after struct<rms_db:double>"),
    "recogniser": Shape("transcription array<struct<offsets:struct<from:bigint,to:bigint>,text:string>>, segments array<struct<start:double,end:double,text:string>>", strict=False),
    "edl": Shape(
        f"version string, timebase string, v array<array<{_CLIP}>>, a array<array<{_CLIP}>>", ("timebase", "v", "a"),
        "background string, resolution array<int>, samplerate int, layout string", exactly=(("version", "3"),),
    ),
    "fillers": Shape("strong array<string>, weak array<string>"),
    "asr_dict": Shape("entries array<struct<correct:string,misrecognized:array<string>,yomi:string,confidence:string,note:string>>", ("entries",)),
    "patch": Shape("edits array<struct<segment_id:string,text:string>>", ("edits",)),
}


def read_projects(spark: SparkSession, glob: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, stage_records) of manifests."""
    m = read_json(spark, glob, SHAPES["manifest"])
    projects = m.select(PID, "source.path", "source.sha256", to_ms(F.col("source.duration")).alias("duration_ms"), "source.video", "source.audio", instant(F.col("created_at")).alias("created_at"))
    return projects, m.select(PID, F.explode("stages").alias("stage", "r")).select(PID, "stage", instant(F.col("r.done_at")).alias("done_at"), "r.params_sha256", "r.tool_versions")


def read_profiles(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """Profiles with the default in place of every absent field."""
    def full(x, path: str) -> Column:
        if isinstance(x, dict):
            return F.struct(*[full(v, f"{path}.{k}").alias(k) for k, v in x.items()])
        return F.coalesce(F.col(path), F.lit(x[1]).cast(x[0]))

    df = read_json(spark, glob, SHAPES["profile"])
    return df.select(PID, *[full(x, s).alias(s) for s, x in PROFILE.items()])


def _listed(df: DataFrame, column: str, out: str = "ord") -> DataFrame:
    return df.select(PID, F.posexplode(column).alias(out, "x")).select(PID, out, "x.*")


def _ms(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(f"{n}_ms", to_ms(F.col(n))).drop(n)
    return df


def read_transcripts(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """Segments in the document's order; words are the recogniser's, where it gave them."""
    df = read_json(spark, glob, SHAPES["transcript"])
    dated = F.transform("edits", lambda e: F.struct(instant(e["at"]).alias("at"), e["tool"].alias("tool"), e["before"].alias("before")))
    return _ms(_listed(df, "segments"), "start", "end").withColumnRenamed("id", "segment_id").withColumn("edits", dated)


def read_regions(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    return _ms(_listed(read_json(spark, glob, SHAPES["regions"]), "segments"), "start", "end")


def read_cuts(spark: SparkSession, glob: str | DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Cuts in file order; a project without the file has none."""
    df = read_json(spark, glob, SHAPES["cuts"])
    out = _ms(_listed(df, "cuts"), "start", "end").withColumnRenamed("id", "cut_id")
    return out if projects is None else out.join(projects.select(F.col(PID).cast("string").alias(PID)), PID, "left_semi")


def read_telops(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    df = read_json(spark, glob, SHAPES["telops"])
    return _ms(_listed(df, "telops", "idx"), "start", "duration")


def read_styles(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """A project's presets, the fields that it states as text."""
    df = read_json(spark, glob, SHAPES["styles"]).select(PID, F.explode("presets").alias("preset", "p"))
    stated = F.map_from_arrays(F.array(*map(F.lit, STYLE_TYPES)), F.array(*[F.col("p").getField(k).cast("string") for k in STYLE_TYPES]))
    return df.select(PID, "preset", F.map_filter(stated, lambda k, v: v.isNotNull()).alias("fields"))


def read_noise_floor(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """Levels before and after, as before_rms_db and after_rms_db or as rms_db of an object each."""
    df = read_json(spark, glob, SHAPES["noise_floor"])
    level = lambda side: F.coalesce(f"{side}_rms_db", f"{side}.rms_db").alias(f"{side}_rms_db")
    return df.select(PID, to_ms(F.col("silence_sec")).alias("silence_ms"), level("before"), level("after"))


def read_raw_segments(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """Recogniser output in either of two shapes: transcription[].offsets in ms, or segments[] in seconds."""
    df = read_json(spark, glob, SHAPES["recogniser"])
    a = F.transform("transcription", lambda x: F.struct((x["offsets"]["from"] / 1000.0).alias("start_s"), (x["offsets"]["to"] / 1000.0).alias("end_s"), x["text"].alias("text")))
    b = F.transform("segments", lambda x: F.struct(x["start"].alias("start_s"), x["end"].alias("end_s"), x["text"].alias("text")))
    rows = F.coalesce(a, b)
    none = F.raise_error(F.concat(F.lit("recogniser output of unknown shape in project "), F.col(PID)))
    return _listed(df.withColumn("rows", F.when(rows.isNull(), none.cast("array<struct<start_s:double,end_s:double,text:string>>")).otherwise(rows)), "rows")


def read_edl(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """Clips of version 3 edit lists: (list: v or a, track, ord, src, start, dur, offset, timebase). Unknown keys are refused."""
    df = read_json(spark, glob, SHAPES["edl"])
    lists = df.select(PID, "timebase", F.explode(F.create_map(F.lit("v"), F.col("v"), F.lit("a"), F.col("a"))).alias("list", "tracks"))
    tracks = lists.select(PID, "timebase", "list", F.posexplode("tracks").alias("track", "clips"))
    return tracks.select(PID, "timebase", "list", "track", F.posexplode("clips").alias("ord", "x")).select(PID, "list", "track", "ord", "x.src", "x.start", "x.dur", "x.offset", "timebase")


# Logs: one row (project_id, line text) or whole text per project


def vad_log_regions(logs: DataFrame) -> DataFrame:
    """Regions from detector logs; none at all is legal only if the detector says that it ran."""
    num = r"orig_start: *([0-9.]+).*?orig_end: *([0-9.]+)"
    s, e = F.regexp_extract_all("log", F.lit(num), F.lit(1)), F.regexp_extract_all("log", F.lit(num), F.lit(2))
    fail = F.raise_error(F.concat(F.lit("no detector output in the log of project "), F.col(PID).cast("string"))).cast("array<string>")
    found = F.when((F.size(s) == 0) & ~F.col("log").rlike("(?m)^whisper_vad"), fail).otherwise(s)
    z = logs.select(PID, F.posexplode(F.arrays_zip(found.alias("s"), e.alias("e"))).alias("ord", "x"))
    return z.select(PID, F.col("ord").cast("bigint").alias("ord"), to_ms(F.col("x.s").cast("double")).alias("start_ms"), to_ms(F.col("x.e").cast("double")).alias("end_ms"))


def silence_log_intervals(logs: DataFrame, durations: DataFrame, clamp_zero: bool = False, min_ms: int = 500) -> DataFrame:
    """Intervals of silence_start and silence_end marks; an open one closes at the duration, a second start replaces the first."""
    mark = r"silence_(start|end): *(-?[0-9.]+)"
    kind, value = F.regexp_extract_all("log", F.lit(mark), F.lit(1)), F.regexp_extract_all("log", F.lit(mark), F.lit(2))
    rows = logs.select(PID, F.posexplode(F.arrays_zip(kind.alias("k"), value.alias("v"))).alias("ord", "x")).select(PID, "ord", "x.k", F.col("x.v").cast("double").alias("v"))
    by = Window.partitionBy(PID).orderBy("ord")
    rows = rows.withColumn("nk", F.lead("k").over(by)).withColumn("nv", F.lead("v").over(by)).filter("k = 'start'").filter("nk is null or nk = 'end'")
    out = rows.join(durations.select(PID, "duration_ms"), PID)
    start = to_ms(F.col("v"))
    start = F.greatest(F.lit(0).cast("bigint"), start) if clamp_zero else start
    out = out.select(PID, start.alias("start_ms"), F.when(F.col("nk") == "end", to_ms(F.col("nv"))).otherwise(F.col("duration_ms")).alias("end_ms"))
    return out.filter(F.col("end_ms") - F.col("start_ms") >= min_ms)


def loudness_reports(logs: DataFrame) -> DataFrame:
    """The last JSON block with input_i of each log; the five numbers that a second pass needs must be there."""
    keys = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")
    block = F.element_at(F.filter(F.regexp_extract_all("log", F.lit(r"(?s)\{[^{}]*\}"), F.lit(0)), lambda b: F.contains(b, F.lit("input_i"))), -1)
    doc = F.from_json(block, ", ".join(f"{k} string" for k in keys))
    out = logs.select(PID, doc.alias("d"))
    value = lambda k: F.coalesce(F.expr(f"try_cast(d.{k} as double)"), F.raise_error(F.concat(F.lit(f"no {k} in the loudness log of project "), F.col(PID).cast("string"))).cast("double"))
    return out.select(PID, *[value(k).alias(k) for k in keys])


def rms_levels(logs: DataFrame) -> DataFrame:
    """Overall RMS level; null if it is not a finite number, an error if the log has none."""
    raw = F.regexp_extract("log", r"(?s)Overall.*?RMS level dB:\s*(\S+)", 1)
    fail = F.raise_error(F.concat(F.lit("no level in the log of project "), F.col(PID).cast("string"))).cast("string")
    number = F.when(raw == "", fail).when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), raw)
    return logs.select(PID, number.cast("double").alias("rms_db"))


def time_reports(logs: DataFrame) -> DataFrame:
    """Wall seconds and peak bytes of a time report; both are required."""
    wall, peak = F.regexp_extract("log", r"(?m)^\s*([0-9.]+) real", 1), F.regexp_extract("log", r"(?m)^\s*([0-9]+)\s+maximum resident set size", 1)
    need = lambda c: F.when(c == "", F.raise_error(F.lit("not a time report")).cast("string")).otherwise(c)
    return logs.select(PID, need(wall).cast("double").alias("wall_seconds"), need(peak).cast("bigint").alias("peak_rss_bytes"))


# Dictionaries, patches, runs, texts, subtitles, media


def read_asr_dict(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """Correction dictionaries in their order: (project_id, ord, correct, misrecognized, yomi, confidence, note), as apply_surface takes them."""
    return _listed(read_json(spark, glob, SHAPES["asr_dict"]), "entries")


def read_filler_words(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    df = read_json(spark, glob, SHAPES["fillers"])
    return df.select(PID, F.explode(F.create_map(F.lit("strong"), F.col("strong"), F.lit("weak"), F.col("weak"))).alias("tier", "words")).select(PID, F.explode("words").alias("word"), "tier")


def read_patches(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    return _listed(read_json(spark, glob, SHAPES["patch"]), "edits")


def read_runs(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    """Archived runs: the directory's name is the run, the file's time its age; the warnings that the run ended with are listed."""
    df = raw_documents(spark, glob).select(F.col("value").alias("doc"), F.col("path").alias("p"), "written_at")
    warnings = F.coalesce(F.from_json(F.get_json_object("doc", "$.run.warnings"), "array<string>"), F.expr("cast(array() as array<string>)"))
    return df.select(
        F.element_at(F.split("p", "/"), -3).alias(PID), F.element_at(F.split("p", "/"), -2).alias("run"), "written_at", "doc",
        F.get_json_object("doc", "$.stages.render.result.verify_asr").alias("verify_asr"), warnings.alias("warnings"),
    )


def read_texts(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    return raw_documents(spark, glob).select(project_of(F.col("path")).alias(PID), F.col("value").alias("text"))


def read_srt(spark: SparkSession, glob: str | DataFrame) -> DataFrame:
    return parse_srt(read_texts(spark, glob).withColumnRenamed("text", "document"))


def _open(path: str):
    """A file to read in sequence, local or in a store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return open(path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path, "rb")  # noqa: SIM115
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_stream(at)


def source_hashes(spark: SparkSession, glob: str, block: int = 4 << 20) -> DataFrame:
    """(path, length, found): SHA-256 of media files of any length. Spark lists the files without their content and deals them out; each task
    reads its files block by block, so memory is a block's."""
    import pyarrow as pa

    def run(batches):
        import hashlib

        for batch in batches:
            paths, found = batch.column(0).to_pylist(), []
            for path in paths:
                digest = hashlib.sha256()
                with _open(path) as f:
                    while data := f.read(block):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["path", "length", "found"])

    files = spark.read.format("binaryFile").load(glob).select("path", "length")
    return files.repartition("path").mapInArrow(run, "path string, length bigint, found string")


def packed_hashes(blocks: DataFrame) -> DataFrame:
    """(path, length, found): SHA-256 of media in a pack of blocks (sinks.pack_media), of any length and number. A file's blocks come to one task in their
    order and are let go as they are read; that all are there is checked by the file's length."""
    import pyarrow as pa

    def run(batches):
        import hashlib

        now, length, seen, digest = None, 0, 0, None

        def done():
            if seen != length:
                raise SourceError(f"{now}: blocks of {seen} bytes of {length}")
            return now, length, digest.hexdigest()

        for batch in batches:
            out = []
            for path, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if path != now:
                    if digest:
                        out.append(done())
                    now, length, seen, digest = path, size, 0, hashlib.sha256()
                digest.update(data.as_buffer())
                seen += len(data.as_buffer())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "length", "found"])
        if digest:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(done(), (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "length", "found"])

    small_batches(blocks.sparkSession)
    rows = blocks.select("path", "length", "n", "data").repartition("path").sortWithinPartitions("path", "n")
    return rows.mapInArrow(run, "path string, length bigint, found string")
