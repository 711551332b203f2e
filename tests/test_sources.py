"""Readers over generated project directories, log parsers, and writers that publish all or nothing."""

import json

import pytest
from pyspark.sql import functions as F

from fleetcut.operators import gates as G
from fleetcut.operators import report as R
from fleetcut.operators import subtitles as U
from fleetcut.sources import sinks, tables as S


@pytest.fixture(scope="module")
def fleet(tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    for p in range(20):
        d = root / f"talk{p:02d}"
        (d / "dictionaries").mkdir(parents=True)
        put = lambda name, doc, d=d: (d / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False), encoding="utf-8")
        put("manifest.json", {"source": {"path": f"/m/{p}.mp4", "sha256": "a" * 64, "duration": 60.5 + p, "video": {"codec": "h264", "width": 1920, "height": 1080, "fps": "25/1"}, "audio": {"codec": "aac", "sample_rate": 44100, "channels": 2}}, "created_at": "2024-01-01T00:00:00Z", "stages": {"audio": {"done_at": "2024-01-01T00:00:00Z", "params_sha256": "b" * 64, "tool_versions": {"x": "1"}}}})
        put("profile.json", {"silence": {"min_duration": 0.9}} if p % 2 else {})
        put("transcript.json", {"segments": [{"id": "s0001", "start": 1.0, "end": 4.0005, "text": "あ", "source": "asr", "edits": []}, {"id": "s0002", "start": 10, "end": 14, "text": "い", "source": "asr", "edits": []}]})
        put("vad.json", {"segments": [{"start": 1.0, "end": 4.0}]})
        if p != 3:
            put("cuts.json", {"cuts": [{"id": "c0001", "start": 4.4, "end": 9.6, "reason": "silence", "confidence": 0.95, "status": "approved", "note": None}]})
        put("telops.json", {"telops": [{"text": "t", "style_preset": "default", "segment_id": "s0001"}]})
        put("styles.json", {"presets": {"default": {"fontname": "Sans"}, "chapter": {"fontsize": 9}}})
        put("noise_floor.json", {"silence_sec": 119.641, "before": {"rms_db": -60.48}, "after": {"rms_db": None if p % 2 else -69.57}})
        put("asr.json", {"transcription": [{"offsets": {"from": 500, "to": 1500}, "text": "x"}]} if p % 2 else {"segments": [{"start": 0.5, "end": 1.5, "text": "x"}]})
        put("edl.json", {"version": "3", "timebase": "30/1", "background": "#000", "resolution": [1, 2], "samplerate": 48000, "layout": "stereo", "v": [], "a": [[{"name": "audio", "src": "a", "start": 0, "dur": 30, "offset": 60, "stream": 0}]]})
        put("patch.json", {"edits": [{"segment_id": "s0001", "text": "う"}] if p % 2 else []})
        put("dictionaries/fillers.json", {"strong": ["えっと"], "weak": []})
        put("out.srt", "1\n00:00:01,000 --> 00:00:04,000\none\ntwo\n\n2\n00:00:10,000 --> 00:00:14,000\nthree\n")
        (d / "runs" / "golden").mkdir(parents=True)
        put("dictionaries/asr-dict.json", {"version": "1", "entries": [{"correct": "C", "misrecognized": ["c"], "confidence": "always"}]})
        put("runs/golden/stats.json", {"run": {"warnings": ["late"]}, "stages": {"render": {"result": {"verify_asr": {"cer": 0.08}}}}})
    return root


def glob(root, name):
    return f"{root}/*/{name}"


def test_documents(spark, fleet):
    projects, stages = S.read_projects(spark, glob(fleet, "manifest.json"))
    r = projects.orderBy("project_id").first()
    assert projects.count() == 20 and (r.project_id, r.duration_ms, r.video.fps) == ("talk00", 60500, "25/1")
    assert stages.count() == 20 and stages.first().tool_versions == {"x": "1"}
    prof = {r.project_id: r for r in S.read_profiles(spark, glob(fleet, "profile.json")).collect()}
    assert prof["talk00"].silence.min_duration == 0.6 and prof["talk01"].silence.min_duration == 0.9 and prof["talk01"].subtitle.max_lines == 2
    t = S.read_transcripts(spark, glob(fleet, "transcript.json"))
    assert t.count() == 40 and [(r.ord, r.segment_id, r.end_ms) for r in t.filter("project_id = 'talk00'").orderBy("ord").collect()] == [(0, "s0001", round(4.0005 * 1000)), (1, "s0002", 14000)]
    assert S.read_regions(spark, glob(fleet, "vad.json")).count() == 20
    assert S.read_cuts(spark, glob(fleet, "cuts.json"), projects).count() == 19
    assert {r.start_ms for r in S.read_telops(spark, glob(fleet, "telops.json")).collect()} == {None}
    assert S.read_styles(spark, glob(fleet, "styles.json")).count() == 40
    assert R.floor_section(S.read_noise_floor(spark, glob(fleet, "noise_floor.json"))).groupBy("improved").count().count() == 2
    raw = S.read_raw_segments(spark, glob(fleet, "asr.json"))
    assert {(r.start_s, r.end_s) for r in raw.collect()} == {(0.5, 1.5)} and raw.count() == 20
    assert {(r.offset, r.dur, r.timebase) for r in S.read_edl(spark, glob(fleet, "edl.json")).collect()} == {(60, 30, "30/1")}
    assert S.read_patches(spark, glob(fleet, "patch.json")).count() == 10
    words = S.read_filler_words(spark, f"{fleet}/*/dictionaries/fillers.json")
    assert {(r.word, r.tier) for r in words.collect()} == {("えっと", "strong")} and words.select("project_id").distinct().count() == 20
    assert [(r.start_ms, r.text) for r in S.read_srt(spark, glob(fleet, "out.srt")).filter("project_id = 'talk05'").orderBy("n").collect()] == [(1000, "onetwo"), (10000, "three")]
    runs = S.read_runs(spark, f"{fleet}/*/runs/*/stats.json")
    assert runs.first().verify_asr == '{"cer":0.08}' and runs.first().run == "golden" and runs.first().warnings == ["late"]
    assert [(r.ord, r.misrecognized) for r in S.read_asr_dict(spark, f"{fleet}/talk01/dictionaries/asr-dict.json").collect()] == [(0, ["c"])]
    assert S.source_hashes(spark, glob(fleet, "out.srt")).select("found").distinct().count() == 1


def test_broken_documents_fail(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "vad.json").write_text("{not json")
    (tmp_path / "a" / "asr.json").write_text('{"other": 1}')
    (tmp_path / "a" / "edl.json").write_text('{"version": "1", "timebase": "30/1", "v": [], "a": [[{"src": "a", "start": 0, "dur": 3, "offset": 6}]]}')
    for read, name in ((S.read_regions, "vad.json"), (S.read_raw_segments, "asr.json"), (S.read_projects, "asr.json")):
        with pytest.raises(Exception, match="shape.* in project a"):
            out = read(spark, glob(tmp_path, name))
            (out[0] if isinstance(out, tuple) else out).collect()
    with pytest.raises(Exception, match="not of version 3 in project a"):
        S.read_edl(spark, glob(tmp_path, "edl.json")).select("timebase").collect()


def test_logs(spark):
    log = lambda *rows: spark.createDataFrame(list(rows), "project_id long, log string")
    ends = spark.createDataFrame([(1, 60000)], "project_id long, duration_ms long")
    text = "silence_start: -0.2\nsilence_end: 1.5\nsilence_start: 3\nsilence_start: 4\nsilence_end: 4.3\nsilence_start: 58"
    audio = S.silence_log_intervals(log((1, text)), ends)
    assert sorted((r.start_ms, r.end_ms) for r in audio.collect()) == [(-200, 1500), (58000, 60000)]
    bench = S.silence_log_intervals(log((1, text)), ends, clamp_zero=True, min_ms=0)
    assert sorted((r.start_ms, r.end_ms) for r in bench.collect()) == [(0, 1500), (4000, 4300), (58000, 60000)]
    assert S.vad_log_regions(log((1, "whisper_vad_x: nothing"))).count() == 0
    with pytest.raises(Exception, match="no detector output"):
        S.vad_log_regions(log((1, "something else"))).collect()
    with pytest.raises(Exception, match="no level"):
        S.rms_levels(log((1, "quiet"))).collect()
    assert S.loudness_reports(log((1, 'a {"input_i":"-9","input_tp":"1","input_lra":"2","input_thresh":"3","target_offset":"4"}'))).first().input_i == -9.0
    with pytest.raises(Exception, match="no input_tp"):
        S.loudness_reports(log((1, '{"input_i":"-9"}'))).collect()


def test_strange_documents_are_refused(spark, tmp_path):
    def put(name, doc):
        (tmp_path / "p1").mkdir(exist_ok=True)
        (tmp_path / "p1" / name).write_text(json.dumps(doc), encoding="utf-8")
        return f"{tmp_path}/*/{name}"

    cut = {"id": "c0001", "start": 0, "end": 1, "reason": "manual"}
    with pytest.raises(Exception, match="unknown keys: cuts.stat in project p1"):
        S.read_cuts(spark, put("cuts.json", {"version": "1", "cuts": [{**cut, "stat": "approved"}]})).collect()
    with pytest.raises(Exception, match="silence.mindur"):
        S.read_profiles(spark, put("profile.json", {"silence": {"mindur": 1}})).collect()
    with pytest.raises(Exception, match="unknown keys: preset in"):
        S.read_styles(spark, put("styles.json", {"presets": {"a": {}}, "preset": 1})).collect()
    with pytest.raises(Exception, match="unknown keys: presets.font in"):
        S.read_styles(spark, put("styles.json", {"presets": {"a": {"font": "x"}}})).collect()
    clip = {"name": "audio", "src": "a", "start": 0, "dur": 30, "offset": 60, "stream": 0}
    edl = {"version": "3", "timebase": "30/1", "background": "", "resolution": [], "samplerate": 1, "layout": "", "v": [], "a": [[clip]]}
    assert S.read_edl(spark, put("edl.json", edl)).count() == 1
    for wrong in ({**edl, "strange": 1}, {**edl, "a": [[{**clip, "speed": 2}]]}):
        with pytest.raises(Exception, match="unknown keys: (strange|a.speed) in"):
            S.read_edl(spark, put("edl.json", wrong)).collect()
    segment = {"id": "s0001", "start": 0, "end": 1, "text": "t", "source": "asr", "edits": [{"at": "2024-01-01T00:00:00", "tool": "dict", "before": "x"}]}
    with pytest.raises(Exception, match="no offset"):
        S.read_transcripts(spark, put("transcript.json", {"segments": [segment]})).collect()
    with pytest.raises(Exception, match="segments.edits.who"):
        S.read_transcripts(spark, put("transcript.json", {"segments": [{**segment, "edits": [{"who": 1}]}]})).collect()
    source = {"path": "m", "sha256": "a" * 64, "duration": 1.0, "video": {"codec": "h", "width": 1, "height": 0, "fps": "25"}, "audio": {"codec": "a", "sample_rate": 1, "channels": 1}}
    naive, _ = S.read_projects(spark, put("manifest.json", {"version": "1", "created_at": "2024-01-01T00:00:00", "source": source}))
    with pytest.raises(Exception, match="no offset"):
        naive.collect()
    good, stages = S.read_projects(spark, put("manifest.json", {"version": "1", "created_at": "2024-01-01T00:00:00+09:00", "source": source, "stages": {}}))
    assert good.selectExpr("unix_seconds(created_at)").first()[0] == 1704034800
    assert [r.message for r in G.g02_fields(good, "projects").collect()] == ["fps: pattern; video.height: positive"]
    profile = S.read_profiles(spark, put("profile.json", {"version": "1", "audio": {"loudnorm": {"i": -16}}, "render": {"crf": 60}}))
    r = profile.first()
    assert (r.audio.loudnorm.i, r.audio.loudnorm.tp, r.audio.denoise, r.asr.vad) == (-16.0, -1.0, "deepfilternet", "silero-v5")
    assert [r.message for r in G.g02_fields(profile, "profiles").collect()] == ["render.crf: between 0 and 51"]
    words = put("transcript.json", {"version": "1", "audio_source": "x", "asr": {"backend": "b", "model": "m", "vad": "v"}, "segments": [{"id": "s1", "start": 0, "end": 1, "text": "t", "words": [{"start": 0, "end": 1, "text": "t", "probability": 0.5, "more": {"a": [1]}}]}]})
    segments = S.read_transcripts(spark, words)
    assert segments.first().words[0].text == "t" and [r.message for r in G.g02_fields(segments, "segments").collect()] == ["segment_id: pattern"]
    styles = spark.createDataFrame([("p", "a,b", {"fontsize": "0", "primary_colour": "red"}), ("p", "ok", {"alignment": "9"})], "project_id string, preset string, fields map<string,string>")
    assert [r.message for r in G.g02_fields(styles, "styles").collect()] == ["preset: comma or line break; fontsize: positive; primary_colour: colour"]
    telops = spark.createDataFrame([("p", 0, "t", "s1", None, 0)], "project_id string, idx int, text string, segment_id string, start_ms long, duration_ms long")
    assert [r.message for r in G.g02_fields(telops, "telops").collect()] == ["segment_id: pattern; duration: positive"]


def test_bad_documents_are_named_and_the_rest_is_read(spark, tmp_path):
    bad = {3: "{not json", 5: "[1]", 7: '{"segments": [{"start": 0, "end": 1, "stop": 2}]}', 8: '{"version": "1"}', 9: '{"segments": [{"start": "x"}]}'}
    for p in range(12):
        (tmp_path / f"t{p}").mkdir()
        (tmp_path / f"t{p}" / "vad.json").write_text(bad.get(p, '{"segments": [{"start": 0, "end": 1}]}'))
    found = {r.project_id: r.problem for r in S.bad_documents(spark, glob(tmp_path, "vad.json"), S.SHAPES["regions"]).collect()}
    assert set(found) == {f"t{p}" for p in bad} and found["t7"] == "unknown keys: segments.stop" and found["t8"].endswith("no segments")
    assert S.read_json(spark, glob(tmp_path, "vad.json"), S.SHAPES["regions"], good_only=True).count() == 7
    plan = S.read_regions(spark, glob(tmp_path, "vad.json"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_names_of_presets_never_become_part_of_the_plan(spark, tmp_path):
    """A hundred thousand distinct names of presets over the fleet."""
    for p in range(100):
        (tmp_path / f"t{p}").mkdir()
        (tmp_path / f"t{p}" / "styles.json").write_text(json.dumps({"presets": {f"own {p} {k}": {"fontsize": k + 1} for k in range(1000)}}))
    styles = S.read_styles(spark, glob(tmp_path, "styles.json"))
    assert styles.select("preset").distinct().count() == 100_000
    assert len(styles._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_fingerprints_of_long_media(spark, tmp_path):
    """A sparse file of 3 GiB, which no cell could hold, within a block's memory."""
    import hashlib
    import os

    with open(tmp_path / "long media.bin", "wb") as f:
        f.write(b"head")
        f.seek(3 << 30)
        f.write(b"tail")
    (tmp_path / "short.bin").write_bytes(b"x")
    digest = hashlib.sha256(b"head")
    for _ in range(3 * 64):
        digest.update(bytes(16 << 20) if _ else bytes((16 << 20) - 4))
    digest.update(b"tail")
    got = {os.path.basename(r.path): (r.length, r.found) for r in S.source_hashes(spark, f"{tmp_path}/*.bin").collect()}
    assert got == {"long media.bin": ((3 << 30) + 4, digest.hexdigest()), "short.bin": (1, hashlib.sha256(b"x").hexdigest())}


def test_of_two_publishers_one_is_refused(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda x: spark.createDataFrame([(1, x)], "project_id long, x string")
    sinks.publish(rows("a"), path)
    seen = sinks.current_number(spark, path)
    sinks.publish(rows("b"), path, base=seen)
    with pytest.raises(sinks.PublishConflict):
        sinks.publish(rows("c"), path, base=seen)
    assert [r.x for r in sinks.published(spark, path).collect()] == ["b"] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2

    def overtaken(at):
        rows("late").write.parquet(at)
        sinks.publish(rows("first"), path)

    with pytest.raises(sinks.PublishConflict):
        sinks._commit(spark, path, "version", overtaken, sinks.current_number(spark, path))
    assert [r.x for r in sinks.published(spark, path).collect()] == ["first"]
    fs, at = sinks._fs(spark, path)
    fs.create(at(f"{path}/_current.{sinks.current_number(spark, path) + 1:010d}"), False).close()  # a writer that died before it said its version
    assert [r.x for r in sinks.published(spark, path).collect()] == ["first"]
    sinks.publish(rows("next"), path)
    assert [r.x for r in sinks.published(spark, path).collect()] == ["next"]
    docs = lambda x: spark.createDataFrame([(7, x), (8, x)], "project_id long, document string")
    sinks.publish_documents(docs("one"), str(tmp_path / "d"))
    sinks.publish_documents(docs("two"), str(tmp_path / "d"))
    assert {r.value.strip() for r in sinks.published(spark, str(tmp_path / "d")).collect()} == {"two"}


def test_publish_is_all_or_nothing(spark, tmp_path):
    cuts = "project_id long, cut_id string, start_ms long, end_ms long, status string"
    good = spark.createDataFrame([(1, "c0001", 0, 10, "approved")], cuts)
    bad = spark.createDataFrame([(1, "c0001", 0, 10, "approved"), (1, "c0002", 5, 20, "approved")], cuts)
    path = str(tmp_path / "cuts")
    sinks.publish(good, path, G.g04_approved_overlap(good))
    with pytest.raises(G.GateError):
        sinks.publish(bad, path, G.g04_approved_overlap(bad))
    assert sinks.published(spark, path).count() == 1

    def breaks(batches):
        yield from ()
        raise RuntimeError("half-way")

    with pytest.raises(Exception, match="half-way"):
        sinks.publish(good.mapInPandas(breaks, cuts), path)
    assert sinks.published(spark, path).collect() == good.collect()
    sinks.publish(bad, path, G.g04_approved_overlap(bad), mode="advisory")
    assert sinks.published(spark, path).count() == 2
    for _ in range(3):
        sinks.publish(good, path, partition_by="project_id")
    assert sinks.published(spark, path).count() == 1 and len([p for p in (tmp_path / "cuts").iterdir() if p.name.startswith("_current")]) == 2
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, str(tmp_path / "none"))
    docs = U.srt_documents(spark.createDataFrame([(7, "s1", 0, 1000, "x")], "project_id long, segment_id string, start_ms long, end_ms long, text string"))
    sinks.write_documents(docs, str(tmp_path / "srt"))
    assert "00:00:00,000" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "srt")).collect())
    sinks.archive_run(docs.withColumn("run", F.lit("a")), str(tmp_path / "runs"))
    sinks.archive_run(docs.withColumn("run", F.lit("b")), str(tmp_path / "runs"))
    with pytest.raises(FileExistsError):
        sinks.archive_run(docs.withColumn("run", F.lit("a")), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).select("run").distinct().count() == 2
