"""Text operators: normal forms, fillers, replacement, packing, error rates, alignment and the re-transcription check."""

import difflib
import random
import re
import time

from pyspark.sql import functions as F

from fleetcut.functions import text as X
from fleetcut.operators import correct as K
from fleetcut.operators import fillers as L
from fleetcut.operators import report as R
from fleetcut.operators import subtitles as U
from fleetcut.operators import verify as V

SEG = "project_id long, segment_id string, ord long, start_ms long, end_ms long, text string"


def entries(spark, rows, project=None):
    kind = "ord int, correct string, misrecognized array<string>, confidence string"
    listed = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(listed, kind) if project is None else spark.createDataFrame([(project, *r) for r in listed], f"project_id long, {kind}")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).collect()[0][0]


def test_normal_forms(spark):
    assert one(spark, "Ｈｅｌｌｏ、 World。！?", X.normalise) == "helloworld"
    assert one(spark, "え——ーーと、!", X.filler_normalise) == "えーと"
    assert one(spark, "くろーどabc・", X.normalise_reading) == "クロード"
    assert one(spark, "ab漢字ｶ", X.text_width) == 0.5 * 3 + 2
    assert one(spark, None, X.normalise) is None


def scan_plain(text, words):
    hits, i = [], 0
    while i < len(text):
        w = next((w for w in sorted(words, key=lambda w: (-len(w), w)) if text.startswith(w, i)), None)
        if w:
            hits.append((w, i, i + len(w)))
            i += len(w)
        else:
            i += 1
    return hits


def test_scan_is_leftmost_longest(spark):
    random.seed(4)
    words = ["a", "ab", "bca", "ccc"]
    texts = ["".join(random.choice("abc") for _ in range(random.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in L.scan_fixed(df, words).collect():
        hits = scan_plain(texts[r.i], words)
        assert [(h.word, h.start, h.end) for h in r.hits] == hits
        whole = bool(texts[r.i]) and sum(e - s for _, s, e in hits) == len(texts[r.i])
        assert r.is_whole == whole
        assert (r.leading is not None) == (not whole and bool(hits) and hits[0][1] == 0)
        assert (r.trailing is not None) == (not whole and bool(hits) and hits[-1][2] == len(texts[r.i]))


def test_filler_cuts(spark):
    """A whole segment reaches the padding on both sides; an opening filler ends with its region."""
    segs = spark.createDataFrame([(1, "s0001", 0, 1000, 2000, "えーと。"), (1, "s0002", 1, 5000, 9000, "えーと今日は"), (1, "s0003", 2, 12000, 13000, "まあね")], SEG)
    regions = spark.createDataFrame([(1, 1000, 2000), (1, 5000, 5600), (1, 6400, 9000), (1, 12000, 13000)], "project_id long, start_ms long, end_ms long")
    projects = spark.createDataFrame([(1, 20000)], "project_id long, duration_ms long")
    own = spark.createDataFrame([], "project_id long, word string, tier string")
    words = L.filler_words(projects, L.packaged_words(spark), own)
    assert "まあ" not in {r.word for r in words.collect()}
    got = {r.segment_id: (r.placement, r.start_ms, r.end_ms, r.confidence) for r in L.filler_spans(segs, regions, projects, words).collect()}
    assert got == {"s0001": ("whole", 700, 2300, 0.8), "s0002": ("leading", 4700, 5900, 0.6)}
    silence = spark.createDataFrame([(1, 2100, 4800)], "project_id long, start_ms long, end_ms long")
    cands, inside = L.filler_candidates(segs, regions, projects, words, silence)
    assert sorted((r.start_ms, r.end_ms) for r in cands.collect()) == [(700, 2100), (4800, 5900)]
    assert inside.collect()[0].in_sentence == 0


def test_surface_keeps_what_is_right_and_reports_context(spark):
    df = spark.createDataFrame([(1, "s1", 0, 0, 1, "クロードコードとクラウド、クロード コード")], SEG)
    r = K.apply_surface(df, entries(spark, [("CC", ["クロードコード", "クロード コード"], "always"), ("C", ["クラウド", "クロード"], "context")])).collect()[0]
    assert r.new_text == "CCとクラウド、CC"
    assert [(h.matched, h.applied) for h in r.hits] == [("クロードコード", True), ("クラウド", False), ("クロード コード", True)]


def surface_plain(text, rows):
    """Left to right, the longest misheard spelling at each place, earlier entries first; nothing is scanned again."""
    patterns = sorted(((w, correct, sure) for correct, wrong, sure in rows for w in wrong if w), key=lambda x: -len(x[0]))
    out, hits, i = "", [], 0
    while i < len(text):
        w, correct, sure = next((x for x in patterns if text.startswith(x[0], i)), (text[i], text[i], "always"))
        out += correct if sure == "always" else w
        if w != correct:
            hits.append((w, correct, sure == "always"))
        i += len(w)
    return out, hits


def test_correct_spellings_are_no_patterns(spark):
    for rows, text, want in (([("abc", ["bcd"], "always")], "abcd", "aabc"), ([("ノート", ["ノオト"], "always"), ("note", ["ノート"], "always")], "ノートを書く", "noteを書く")):
        r = K.apply_surface(spark.createDataFrame([(1, "s1", 0, 0, 1, text)], SEG), entries(spark, rows)).first()
        assert r.new_text == want == surface_plain(text, rows)[0] and len(r.hits) == 1


def test_dictionaries_of_projects_and_of_many_entries(spark, monkeypatch):
    from fleetcut.functions import matching as M

    random.seed(13)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(1, 5)))
    texts = ["".join(word() for _ in range(random.randint(0, 12))) for _ in range(120)] + ["", "a" * 5000]
    small = [(word().upper() if random.random() < 0.8 else word(), [word() for _ in range(random.randint(0, 3))] + [""] * (i % 4 == 0), random.choice(["always", "context"])) for i in range(12)]
    other = [("X", ["ab", "abc"], "always"), ("Y", ["abc"], "always"), ("ab", ["ab"], "context")]
    rows = [(i % 3, f"s{i}", i, 0, 1, t) for i, t in enumerate(texts)] + [(1, "null", 0, 0, 1, None)]
    df = spark.createDataFrame(rows, SEG)

    def check(out, of):
        for r in out.collect():
            if r.text is None:
                assert r.new_text is None or r.new_text == ""
                continue
            assert (r.new_text, [tuple(h) for h in r.hits or []]) == surface_plain(r.text, of(r.project_id)), r.text

    check(K.apply_surface(df, entries(spark, small)), lambda p: small)
    both = entries(spark, small, 0).unionByName(entries(spark, other, 1))
    check(K.apply_surface(df, both), lambda p: {0: small, 1: other}.get(p, []))
    monkeypatch.setattr(M, "MAX_WORDS", 3)
    check(K.apply_surface(df, entries(spark, small)), lambda p: small)
    monkeypatch.undo()
    many = [(f"<{i}>", [f"w{i:05d}"], "always") for i in range(10_000)]
    r = K.apply_surface(spark.createDataFrame([(1, "s", 0, 0, 1, "w00007 and w09999w1")], SEG), entries(spark, many)).first()
    assert r.new_text == "<7> and <9999>w1"
    assert M.has_match(df, spark.createDataFrame([("aaaaa",), ("",)], "word string")).count() == sum("aaaaa" in t for t in texts)


def test_reading_runs_are_longest_from_the_left(spark):
    toks = [("ク", "ク"), ("ロード", "ロード"), (" ", None), ("コード", "コード"), ("を", "ヲ"), ("クロード", "クロード")]
    rows, at = [], 0
    for i, (s, r) in enumerate(toks):
        rows.append((1, "s1", i, at, at + len(s), s, r))
        at += len(s)
    t = spark.createDataFrame(rows, "project_id long, segment_id string, ord int, begin int, end int, surface string, reading string")
    d = spark.createDataFrame([("クロードコード", "CC", 0), ("クロード", "C", 1), ("クロード", "X", 2)], "reading string, correct string, rank int")
    runs = K.apply_readings(t, d)
    assert sorted((r.first, r.last, r.correct) for r in runs.collect()) == [(1, 4, "CC"), (6, 6, "C")]
    text = "".join(s for s, _ in toks)
    seg = spark.createDataFrame([(1, "s1", 0, 0, 1, text)], SEG)
    assert K.replace_runs(seg, runs).collect()[0].new_text == "CCをC"


def test_readings_follow_the_surface_pass(spark):
    """The reading pass works on what the surface pass leaves, moved by its edits, and its hits are reported."""
    text = "thea in the house of the inthe"
    rows, at = [], 0
    for i, w in enumerate(re.findall(r"\S+|\s+", text)):
        rows.append((1, "s1", i, at, at + len(w), w, w if w.strip() else None))
        at += len(w)
    t = spark.createDataFrame(rows, "project_id long, segment_id string, ord int, begin int, end int, surface string, reading string")
    d = spark.createDataFrame([("inthe", "IN-THE", 0), ("ofthe", "OF-THE", 1)], "reading string, correct string, rank int")
    r = K.correct_segments(spark.createDataFrame([(1, "s1", 0, 0, 1, text)], SEG), entries(spark, [("THE END", ["thea"], "always"), ("HOUSE", ["house"], "context")]), t, d).first()
    assert r.new_text == "THE END IN-THE house OF-THE IN-THE"
    assert [(h.matched, h.correct, h.applied) for h in r.hits] == [("thea", "THE END", True), ("house", "HOUSE", False), ("in the", "IN-THE", True), ("of the", "OF-THE", True), ("inthe", "IN-THE", True)]
    plain = K.correct_segments(spark.createDataFrame([(1, "s1", 0, 0, 1, text)], SEG), entries(spark, [("x", ["y"], "always")]), t, d).first()
    assert plain.new_text == "thea IN-THE house OF-THE IN-THE" and len(plain.hits) == 3


def test_styles_and_documents_are_each_project_s_own(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    own = spark.createDataFrame([(1, "default", {"Fontsize": "20"}), (2, "default", {"Fontsize": "30", "Bold": "-1"}), (2, "mine", {"Fontname": "M"})], "project_id long, preset string, fields map<string,string>")
    styles = U.merge_styles({"default": {"Fontsize": "48", "Italic": "-1"}, "chapter": {}}, own, projects, {"Fontname": "Sans"})
    got = {(r.project_id, r.preset): r.fields for r in styles.collect()}
    assert got == {
        (1, "default"): {"Fontname": "Sans", "Fontsize": "20", "Italic": "-1"}, (2, "default"): {"Fontname": "Sans", "Fontsize": "30", "Italic": "-1", "Bold": "-1"},
        (1, "chapter"): {"Fontname": "Sans"}, (2, "chapter"): {"Fontname": "Sans"}, (2, "mine"): {"Fontname": "M"},
    }
    events = spark.createDataFrame([(2, 0, 3_600_000 * 12 + 1500, 3_600_000 * 12 + 2000, "mine", "hello, you")], "project_id long, idx long, show_ms long, hide_ms long, style_preset string, text string")
    docs = {r.project_id: r.document for r in U.ass_documents(events, styles, projects.selectExpr("project_id", "640 as width", "480 as height")).collect()}
    assert "Style: mine,M,48" in docs[2] and "mine" not in docs[1] and "Dialogue: 0,12:00:01.50,12:00:02.00,mine,,0,0,0,,hello, you" in docs[2]
    assert docs[1].count("\nStyle: ") == 2 and docs[2].count("\nStyle: ") == 3 and docs[1].count("\nFormat: ") == 2


def test_stored_styles_reach_the_style_line(spark, tmp_path):
    import json

    from fleetcut.sources import tables as S

    (tmp_path / "p1").mkdir()
    own = {"fontname": "Own", "fontsize": 99, "bold": True, "primary_colour": "&H112233", "outline": 2.5, "shadow": 1.0, "spacing": 0, "margin_v": 7, "alignment": 9}
    (tmp_path / "p1" / "styles.json").write_text(json.dumps({"version": "1", "presets": {"default": own, "bare": {}}}))
    projects = spark.createDataFrame([("p1",)], "project_id string")
    styles = U.merge_styles({"default": {"italic": "true"}}, S.read_styles(spark, f"{tmp_path}/*/styles.json"), projects, U.STYLE_DEFAULTS)
    lines = {r.preset: r.line for r in U.style_lines(styles).collect()}
    assert lines["default"] == "Style: default,Own,99,&H00112233,&H000000FF,&H00000000,&H00000000,-1,-1,0,0,100,100,0,0,1,2.5,1,9,40,40,7,1"
    assert lines["bare"] == "Style: bare,Hiragino Sans W6,64,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,3,0,8,40,40,60,1"


def test_patches_are_all_or_nothing(spark):
    segs = spark.createDataFrame([(1, "s1", 0, 0, 1, "a"), (1, "s2", 1, 2, 3, "b"), (2, "s1", 0, 0, 1, "a")], SEG)
    edits = spark.createDataFrame([(1, "s1", "A"), (2, "s1", "B"), (2, "s7", "C")], "project_id long, segment_id string, text string")
    got = {(r.project_id, r.segment_id): (r.text, [e.before for e in r.edits]) for r in K.apply_patches(segs, edits, "2025-05-05T00:00:00Z").collect()}
    assert got == {(1, "s1"): ("A", ["a"]), (1, "s2"): ("b", []), (2, "s1"): ("a", [])}
    assert {(r.project_id, r.problem) for r in K.check_patches(edits, segs).collect()} == {(2, "unknown id")}


def test_wrap_never_splits_a_phrase(spark):
    df = spark.createDataFrame([(["漢字漢字", "かな", "かなかな", "abcdef"],)], "p array<string>")
    lines = df.select(U.wrap(F.col("p"), 6, 2)).collect()[0][0]
    assert lines == ["漢字漢字かな", "かなかなabcdef"]


def test_srt_round_trip_and_missing_entries(spark):
    e = spark.createDataFrame([(1, "s0001", 0, 1500, "one\\Ntwo"), (1, "s0002", 3661001, 3662000, "three"), (1, "s0003", 3661001, 3662000, "three")], "project_id long, segment_id string, start_ms long, end_ms long, text string")
    doc = U.srt_documents(e).collect()[0].document
    assert doc.startswith("1\n00:00:00,000 --> 00:00:01,500\none\ntwo\n\n2\n01:01:01,001 --> ")
    back = U.parse_srt(U.srt_documents(e))
    assert [r.text for r in back.orderBy("n").collect()] == ["onetwo", "three", "three"]
    flat = e.withColumn("text", F.regexp_replace("text", r"\\N", ""))
    assert U.missing_entries(flat, back).count() == 0
    assert [r.segment_id for r in U.missing_entries(flat, back.filter("n <> 2")).collect()] == ["s0003"]
    colour = spark.createDataFrame([("&H80FF0A01",)], "c string").select(U.ass_colour(F.col("c")).alias("c")).collect()[0].c
    assert (colour.alpha, colour.blue, colour.green, colour.red) == (128, 255, 10, 1)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_and_alignment(spark):
    random.seed(9)
    pairs = [("".join(random.choice("abc") for _ in range(random.randint(0, 12))), "".join(random.choice("abc") for _ in range(random.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "project_id long, reference string, hypothesis string")
    for r in V.cer_with_edits(df).collect():
        a, b = pairs[r.project_id]
        assert r.edits.substitutions + r.edits.deletions + r.edits.insertions == levenshtein(a, b)
        assert r.cer == (levenshtein(a, b) / len(a) if a else None)
    t = df.select("project_id", F.col("reference").alias("expected"), F.col("hypothesis").alias("actual"))
    hunks = sorted((r.project_id, r["index"], r.text) for r in V.missing_hunks(t).collect())
    want = sorted((i, k, a[k:m]) for i, (a, b) in enumerate(pairs) for tag, k, m, _, _ in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag == "delete" and m - k >= 2)
    assert hunks == want


def test_boundary_window_is_two_seconds(spark):
    located = spark.createDataFrame([(1, 0, "ab", "s1", 8000.0), (2, 0, "ab", "s1", 7999.0)], "project_id long, index int, text string, segment_id string, at_ms double")
    cuts = spark.createDataFrame([(p, "c0001", 10000, 12000, "approved") for p in (1, 2)], "project_id long, cut_id string, start_ms long, end_ms long, status string")
    projects = spark.createDataFrame([(1, 30000), (2, 30000)], "project_id long, duration_ms long")
    got = V.flag_boundaries(located, cuts, cuts.select("project_id", "start_ms", "end_ms"), projects).collect()
    assert [(r.project_id, r.cut_id, r.source_ms) for r in got] == [(1, "c0001", 8000)]


def test_removed_fillers_leave_the_text(spark):
    segs = spark.createDataFrame([(1, "s0001", 0, 1000, 5000, "えーと今日は、ね"), (1, "s0002", 1, 6000, 9000, "あのー明日")], SEG)
    cuts = spark.createDataFrame([(1, "c1", 700, 1800, "filler", "approved"), (1, "c2", 5900, 6500, "filler", "proposed")], "project_id long, cut_id string, start_ms long, end_ms long, reason string, status string")
    projects = spark.createDataFrame([(1,)], "project_id long")
    words = L.filler_words(projects, L.packaged_words(spark), spark.createDataFrame([], "project_id long, word string, tier string"))
    got = {r.segment_id: r.said for r in V.without_fillers(segs, cuts, words).collect()}
    assert got == {"s0001": "今日はね", "s0002": "あのー明日"}


def test_flatten_and_compare_runs(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":1,"flags":[1,2]},"ok":true,"generated_at":"x","t":null}')], "project_id long, doc string")
    assert {(r.path, r.value) for r in R.flatten_runs(docs).collect()} == {("a.b", "1"), ("a.flags", "2"), ("ok", "1"), ("t", None)}
    after = spark.createDataFrame([(1, '{"a":{"b":1,"flags":[1,2,3]},"ok":false,"t":null}')], "project_id long, doc string")
    diff = {r.path: (r.delta, r.alert) for r in R.compare_runs(R.flatten_runs(docs), R.flatten_runs(after)).collect()}
    assert diff == {"a.flags": (1.0, True), "ok": (-1.0, False)}


def test_choose_breaks_ties_by_time(spark):
    b = spark.createDataFrame([("a", 0.050, 30.0, False), ("b", 0.060, 20.0, False), ("c", 0.0601, 1.0, False), ("d", 0.01, 1.0, True), ("e", None, 1.0, False)], "candidate string, cer double, wall_seconds double, unavailable boolean")
    assert R.choose(b).collect()[0].candidate == "b"


def test_registered_queries_read_whole_texts(spark):
    """Hunks, readings and edit counts reach the end of long texts; runs are compared with brute force."""
    from fleetcut.plans import text_queries as Q

    random.seed(21)
    texts = {1: "".join(random.choice("abcdef ") for _ in range(433)), 2: "abc" * 20, 3: "", 4: None, 5: "é" * 5 + "xy" * 45}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    class Tables:
        def table(self, name):
            return docs

    want = {}
    for d, t in texts.items():
        t = "".join(c for c in t or "" if c.isascii())
        for r in range(max(1, -(-len(t) // 60) - 1)):
            a, b = (t[60 * k : 60 * k + 60].replace(" ", "") for k in (r, r + 1))
            want[d, r] = levenshtein(a, b)
    got = {(r.doc_id, r.run): r.substitutions + r.deletions + r.insertions for r in Q.h12_edit_counts(Tables()).collect()}
    assert got == want and max(r for _, r in got) == 6
    assert {r.doc_id: len(r.reading or "") for r in Q.h03_normalise_reading(Tables()).collect()}[1] == sum(c in "aeiouAEIOU" for c in texts[1])


def test_heard_texts_are_whole(spark, monkeypatch):
    from fleetcut.plans import text_queries as Q

    said = "".join(random.Random(5).choice("abcdefghij") for _ in range(2500)) + "x"
    rows = spark.createDataFrame([(1, "s0001", 0, said)], "project_id long, segment_id string, offset long, said string")
    monkeypatch.setattr(Q, "expected", lambda f: rows)
    r = Q.heard(None).collect()[0]
    assert r.expected == said and r.actual == said[:40] + said[45:-1] + "k"


def test_edit_scripts_equal_the_table():
    """Against the plain table of (cost, substitutions, deletions, insertions), and quick on long texts."""
    def table(a, b):
        row = [(j, 0, 0, j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row = row, [(i, 0, i, 0)]
            for j, y in enumerate(b, 1):
                if x == y:
                    row.append(last[j - 1])
                    continue
                s, d, n = last[j - 1], last[j], row[j - 1]
                row.append(min((s[0] + 1, s[1] + 1, s[2], s[3]), (d[0] + 1, d[1], d[2] + 1, d[3]), (n[0] + 1, n[1], n[2], n[3] + 1), key=lambda t: t[0]))
        return row[-1][1:]

    random.seed(19)
    for _ in range(2000):
        a, b = ("".join(random.choice("abc"[: random.randint(1, 3)]) for _ in range(random.randint(0, 14))) for _ in range(2))
        assert sum(X.edit_script(a, b)) == sum(table(a, b)) and X.edit_script(a, b) == table(a, b), (a, b)
    long = "".join(random.choice("abcdefgh") for _ in range(6000))
    assert X.edit_script(long, long[:3000] + "zz" + long[3000:]) == (0, 0, 2)


def test_report_sections(spark):
    projects = spark.createDataFrame([(1, 10_000), (2, 20_000)], "project_id long, duration_ms long")
    none = lambda ddl: spark.createDataFrame([], ddl)
    cuts = none("project_id long, cut_id string, start_ms long, end_ms long, reason string, status string")
    renders, noise, subs = none("project_id long, duration_s double, lufs double"), none("project_id long, before_rms_db double, after_rms_db double"), none("project_id long, entries long")
    levels = spark.createDataFrame([(1, -22.241, -14.044, None, -69.571, -14.0)], R.LEVELS.replace("project_id string", "project_id long"))
    windows = spark.createDataFrame([(1, "c0001", 0, 4000), (1, "c0002", 6000, 9000)], "project_id long, cut_id string, start_ms long, end_ms long")
    artifacts = R.artifact_section(spark.createDataFrame([(1, "a.png"), (1, "b.png")], "project_id long, path string"), spark.createDataFrame([(1, "d.mp4", 8040)], "project_id long, path string, length_ms long"), windows)
    rows = {r.project_id: r for r in R.project_report(projects, renders, cuts, noise, subs, levels, artifacts).collect()}
    assert tuple(rows[1].loudness) == (-22.24, -14.04, None, -14.0, 0.5) and tuple(rows[1].output_floor) == (-69.57, 55.53)
    assert tuple(rows[1].artifacts) == (2, "d.mp4", 8.04, 8.0) and rows[2].loudness is None and rows[2].artifacts is None
    bare = R.project_report(projects, renders, cuts, noise, subs)
    assert all(r.loudness is None and r.artifacts is None and r.render is None for r in bare.collect())
    doc = R.statistics_documents(bare, "2025-01-01T00:00:00Z").first().document
    assert '"loudness":null' in doc and '"artifacts":null' in doc


def test_benchmark_rows_come_from_texts_and_silences(spark):
    runs = spark.createDataFrame([("a", 1, 7, 50.0, 100.0, 9, False), ("a", 2, 7, 20.0, 100.0, 9, False), ("b", 1, 7, 1.0, 100.0, 9, True)], "candidate string, run int, project_id long, wall_seconds double, duration_s double, peak_rss_bytes long, unavailable boolean")
    segments = spark.createDataFrame([("a", 2, 7, 1, 5000, 6000, "def"), ("a", 2, 7, 0, 0, 1000, "ABX "), ("a", 1, 7, 0, 0, 1000, "abcdef")], "candidate string, run int, project_id long, ord int, start_ms long, end_ms long, text string")
    references = spark.createDataFrame([(7, "abc def.")], "project_id long, reference string")
    silences = spark.createDataFrame([(7, 4900, 5500)], "project_id long, start_ms long, end_ms long")
    got = {r.candidate: r for r in R.bench_rows(R.measure_runs(runs, segments, references, silences)).collect()}
    assert (round(got["a"].cer, 6), got["a"].hallucinations, got["a"].rtf, got["b"].cer, got["b"].hallucinations) == (round(1 / 6, 6), 1, 0.2, None, None)


def test_alignment_equals_the_standard_matcher():
    """Blocks, ties and gaps on few letters, where ties abound; a talk of ten hours and texts of one unit repeated end soon."""
    from fleetcut.functions.alignment import gaps

    rnd = random.Random(31)
    for n in range(6000):
        letters = ("ab", "abc", "abcdefgh", "あい𠮷é")[n % 4]
        a = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 45)))
        b = "".join(c for c in a if rnd.random() > 0.2) if n % 3 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 45)))
        want = [(i, j, k, m) for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
        assert gaps(a, b) == want, (a, b)
    assert gaps("ab" * 40_000, "ac" * 40_000) == [(2 * i + 1, 2 * i + 2, 2 * i + 1, 2 * i + 2) for i in range(40_000)]
    assert gaps("a" * 90_000, "a" * 60_000) == [(60_000, 90_000, 60_000, 60_000)]
    talk = "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(150_000))
    assert gaps(talk, talk[:70_000] + talk[70_400:]) == [(70_000, 70_400, 70_000, 70_000)]


def test_long_blocks_need_no_automaton(monkeypatch):
    """Texts that share long blocks are aligned by pieces; blocks, ties and repeats are those of the automaton and of the standard matcher."""
    from fleetcut.functions import alignment as A

    rnd = random.Random(32)
    for n in range(1500):
        letters = ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz", "あい𠮷éabcd")[n % 4]
        a = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200)))
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 5)] = rnd.choice([[], [rnd.choice(letters)], b[: rnd.randint(0, 40)]])
        b = "".join(b)
        want = [(i, j, k, m) for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
        assert A.gaps(a, b) == want, (a, b)
    monkeypatch.setattr(A, "_automaton", None)
    talk = "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(20_000))
    assert A.gaps(talk, talk[:7_000] + talk[7_400:]) == [(7_000, 7_400, 7_000, 7_000)]


def test_texts_are_aligned_once_and_by_many_tasks(spark):
    """Few bytes from a grouping by project stay spread, and no filter on the hunks aligns or normalises a text a second time."""
    rows = spark.range(40).select(F.col("id").alias("project_id"), F.concat(F.lit("abcdefgh-"), F.col("id").cast("string")).alias("expected"))
    texts = rows.groupBy("project_id").agg(F.max("expected").alias("expected")).withColumn("actual", F.expr("substring(expected, 4)"))
    assert V.missing_hunks(texts)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert V.compare(texts).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.project_id, r["index"], r.text) for r in V.missing_hunks(texts).collect()) == [(p, 0, "abc") for p in range(40)]
    segs = spark.createDataFrame([(1, "s0001", 0, 0, 2000, "A b."), (1, "s0002", 1, 3000, 5000, " ?!"), (1, "s0003", 2, 6000, 8000, "Cd")], SEG)
    cuts = spark.createDataFrame([], "project_id long, cut_id string, start_ms long, end_ms long, reason string, status string")
    placed = V.expected_segments(segs, cuts, ascii_only=True).select("segment_id", "said", "offset")
    assert sorted(map(tuple, placed.collect())) == [("s0001", "ab", 0), ("s0003", "cd", 2)]
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(regexp_replace(") == 1, plan


def test_flags_are_the_nearest_edges_on_both_sides_of_time_bins(spark):
    """A hunk is flagged within two seconds of an edge, at exactly two as well, also where the window begins before zero or crosses a bin."""
    from fleetcut.operators import verify as V

    cuts = spark.createDataFrame([(1, "c0001", 60_000, 61_000, "approved"), (2, "c0001", 0, 500, "approved"), (3, "c0001", 90_000, 95_000, "approved")], "project_id long, cut_id string, start_ms long, end_ms long, status string")
    projects = spark.createDataFrame([(p, 200_000) for p in (1, 2, 3)], "project_id long, duration_ms long")
    at = {(1, 0): 58_000.0, (1, 1): 57_999.0, (1, 2): 62_000.0, (1, 3): 62_001.0, (2, 0): 100.0, (2, 1): 2_000.0, (2, 2): 2_001.0, (3, 0): 10.0}
    located = spark.createDataFrame([(p, i, "xx", t) for (p, i), t in at.items()], "project_id long, index int, text string, at_ms double")
    got = {(r.project_id, r["index"]): r.source_ms for r in V.flag_boundaries(located, cuts, cuts.select("project_id", "start_ms", "end_ms"), projects).collect()}
    assert got == {(1, 0): 58_000, (1, 2): 63_000, (2, 0): 600, (2, 1): 2_500}


def test_long_segments_are_read_in_one_pass(spark, monkeypatch):
    """Tokens of a segment were copied into each of its runs, so a long one took their square; a dictionary too long to broadcast gives the same. Checked by brute force."""
    random.seed(4)
    dictionary = {"inthe": "IN-THE", "the": "THE", "theof": "THE-OF"}
    d = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(dictionary.items())], "reading string, correct string, rank int")
    surface = {"thea": "THE", "ou": "oui"}

    def tokens(text):
        return [(m.start(), m.end(), m.group(), m.group().lower() if m.group().strip() else None) for m in re.finditer(r"\S+|\s+", text)]

    def plain(text):
        pieces, at, moved, edits = re.findall(r"thea|ou|.", text), 0, 0, []
        for p in pieces:
            if p in surface:
                edits.append((at, at + len(p), moved, surface[p]))
            at, moved = at + len(p), moved + len(surface.get(p, p))
        now = "".join(surface.get(p, p) for p in pieces)
        inverse = {v: k for k, v in dictionary.items()}
        after = [(m, m + len(to), inverse.get(to, "")) for _, _, m, to in edits]
        for b, e, _, r in tokens(text):
            if not any(x < e and y > b for x, y, _, _ in edits):
                by = sum(len(to) - (y - x) for x, y, _, to in edits if y <= b)
                after.append((b + by, e + by, r or ""))
        after.sort()
        out, done, i, hits = "", 0, 0, len(edits)
        while i < len(after):
            found = [n for n in range(1, 9) if i + n <= len(after) and after[i][2] and after[i + n - 1][2] and "".join(r for _, _, r in after[i : i + n]) in dictionary]
            if found:
                n = max(found)
                b, e, to = after[i][0], after[i + n - 1][1], dictionary["".join(r for _, _, r in after[i : i + n])]
                hits += now[b:e] != to
                out, done = out + now[done:b] + to, e
            i += max(found, default=1)
        return out + now[done:], hits

    texts = [" ".join(random.choice(["thea", "the", "of", "in", "house", "you", "-"]) for _ in range(n)) for n in (0, 1, 2, 40, 40, 40, 8000)]
    want = {i: plain(t) for i, t in enumerate(texts[:-1])}

    def got(texts):
        seg = spark.createDataFrame([(1, f"s{i}", i, 0, 1, t) for i, t in enumerate(texts)], SEG)
        t = spark.createDataFrame([(1, f"s{i}", k, *x) for i, text in enumerate(texts) for k, x in enumerate(tokens(text))], "project_id long, segment_id string, ord int, begin int, end int, surface string, reading string")
        rows = K.correct_segments(seg, entries(spark, [("THE", ["thea"], "always"), ("oui", ["ou"], "always")]), t, d).collect()
        return {int(r.segment_id[1:]): (r.new_text, len(r.hits)) for r in rows}, sorted(map(tuple, K.apply_readings(t, d).collect()))

    start = time.time()
    most, runs = got(texts)
    assert {i: most[i] for i in want} == want and most[6][0].count("THE") > 1000 and time.time() - start < 60
    few, short = got(texts[:-1])
    monkeypatch.setattr(K, "MAX_WORDS", 0)
    assert got(texts[:-1]) == (few, short) == (want, [r for r in runs if r[1] != "s6"])


def test_words_of_many_projects_make_few_batches(spark):
    """A batch gives one batch however many projects it holds; each project still meets its own words only."""
    from fleetcut.functions import matching as M

    rows = spark.createDataFrame([(i, f"s{i}", None if i % 50 == 7 else f"a{i % 3} b{i} a1") for i in range(3000)], "project_id long, segment_id string, text string")
    words = spark.createDataFrame([(i, f"a{i % 2}") for i in range(3000)] + [(i, f"b{i}") for i in range(0, 3000, 3)], "project_id long, word string")
    out = M.match_words(rows, words).cache()
    for r in out.collect():
        known = {f"a{r.project_id % 2}", *([f"b{r.project_id}"] if r.project_id % 3 == 0 else [])}
        if r.text is None:
            assert r.pieces is None
            continue
        assert "".join(p.was for p in r.pieces) == r.text
        assert [p.was for p in r.pieces if p.flag] == re.findall("|".join(sorted(known, key=len, reverse=True)), r.text)
