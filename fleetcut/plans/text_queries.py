"""Queries of text operators, corrections, subtitles and the re-transcription check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.functions import text as X
from fleetcut.operators import correct as K
from fleetcut.operators import subtitles as U
from fleetcut.operators import timeline as T
from fleetcut.operators import verify as V
from fleetcut.plans.fixtures import Fleet
from fleetcut.plans.register import query
from fleetcut.plans.speech_queries import words
from fleetcut.plans.stored import stored
from fleetcut.plans.timeline_queries import FILED, MAPPED, MERGED, filed, merged, segments
from fleetcut.sources import tables as S

_ASCII = "regexp_replace(text, '[^a-zA-Z ]', '', 'g')"


def ascii_text(column: str = "text"):
    return F.regexp_replace(column, "[^a-zA-Z ]", "")


def runs(f: Fleet) -> DataFrame:
    """Every run of 60 letters and spaces of each document with the next one, over the whole text; a text of one run has one row."""
    pieces = F.coalesce(F.regexp_extract_all(ascii_text(), F.lit(r"[\s\S]{1,60}"), F.lit(0)), F.expr("cast(array() as array<string>)"))
    t = f.table("documents").select("doc_id", pieces.alias("p"))
    piece = lambda i: F.coalesce(F.get("p", i), F.lit(""))
    both = F.transform(F.sequence(F.lit(0), F.greatest(F.size("p") - 2, F.lit(0))), lambda i: F.struct(piece(i).alias("reference"), piece(i + 1).alias("hypothesis")))
    return t.select("doc_id", F.posexplode(both).alias("run", "x")).select("doc_id", F.col("run").cast("bigint").alias("run"), "x.*")


#: Whole texts with their vowels as kana, so that wide characters, both kana and long marks are there to be measured.
_VOWELS, _KANA = "aeiouAEIOU", "あえいおうアエイオー"
_WITH_KANA = f"translate(text, '{_VOWELS}', '{_KANA}')"


def kana_text(column: str = "text"):
    return F.translate(column, _VOWELS, _KANA)


@query(f"SELECT doc_id, lower(regexp_replace({_WITH_KANA}, '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}、。!?.,]', '', 'g')) AS normalised FROM documents")
def h01_normalise(f: Fleet) -> DataFrame:
    return f.table("documents").select("doc_id", X.normalise(kana_text()).alias("normalised"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_WITH_KANA}, '[\\p{{P}}\\p{{Z}}\\p{{S}}\\p{{C}}]', '', 'g'), 'ー+', 'ー', 'g') AS normalised FROM documents")
def h02_filler_normalise(f: Fleet) -> DataFrame:
    return f.table("documents").select("doc_id", X.filler_normalise(kana_text()).alias("normalised"))


@query(f"SELECT doc_id, translate(regexp_replace({_WITH_KANA}, '[^あえいおうアエイオー]', '', 'g'), 'あえいおう', 'アエイオウ') AS reading FROM documents")
def h03_normalise_reading(f: Fleet) -> DataFrame:
    return f.table("documents").select("doc_id", X.normalise_reading(kana_text()).alias("reading"))


#: Letter groups of the generated prose in place of misheard names: (correct, misheard, confidence).
DICTIONARY = [("THE", ["thea", "thed"], "always"), ("tion", ["tian"], "always"), ("and", ["ond", "annd"], "context"), ("oui", ["ou"], "always")]
_TOKENS = "regexp_extract_all(text, 'annd|thea|thed|tian|ond|ou|[\\s\\S]')"


def dictionary(f: Fleet) -> DataFrame:
    """The entries as a document of each project, written and read again; every third project has one entry less."""
    rows = f.spark.createDataFrame([(i, *e) for i, e in enumerate(DICTIONARY)], "ord int, correct string, misrecognized array<string>, confidence string")
    own = f.projects.select("project_id").join(rows, F.expr("project_id % 3 <> 0 OR ord <> 3"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ord", "correct", "misrecognized", "confidence"))), lambda e: e.dropFields("ord"))
    docs = own.groupBy("project_id").agg(F.to_json(F.struct(entries.alias("entries"))).alias("document"))
    return S.read_asr_dict(f.spark, stored(f, "asr_dict", docs)).withColumn("project_id", F.col("project_id").cast("bigint"))


#: Pieces of each project's texts by its own dictionary: where a project lacks the last entry, its word is two letters.
_PIECES = f"t AS (SELECT project_id, segment_id, text, CASE WHEN project_id % 3 = 0 THEN regexp_extract_all(text, 'annd|thea|thed|tian|ond|[\\s\\S]') ELSE {_TOKENS} END AS p FROM segments)"


@query(
    f"""+ {_PIECES}
 SELECT project_id, segment_id, array_to_string(list_transform(p, lambda x: CASE x WHEN 'thea' THEN 'THE' WHEN 'thed' THEN 'THE' WHEN 'tian' THEN 'tion' WHEN 'ou' THEN 'oui' ELSE x END), '') AS new_text,
 CAST(len(list_filter(p, lambda x: x IN ('thea', 'thed', 'tian', 'ou'))) AS BIGINT) AS applied, CAST(len(list_filter(p, lambda x: x IN ('annd', 'ond'))) AS BIGINT) AS reported FROM t"""
)
def h05_surface(f: Fleet) -> DataFrame:
    out = K.apply_surface(f.segments, dictionary(f))
    n = lambda ok: F.size(F.filter("hits", lambda h: h["applied"] == ok)).cast("bigint")
    return out.select("project_id", "segment_id", "new_text", n(True).alias("applied"), n(False).alias("reported"))


@query("SELECT project_id, CAST(v.ord AS INT) AS ord, correct, confidence, CAST(v.n AS INT) AS n FROM projects, (VALUES (0, 'THE', 'always', 2), (1, 'tion', 'always', 1), (2, 'and', 'context', 2), (3, 'oui', 'always', 1)) v(ord, correct, confidence, n) WHERE project_id % 3 <> 0 OR v.ord <> 3")
def s15_dictionaries(f: Fleet) -> DataFrame:
    return dictionary(f).select("project_id", F.col("ord").cast("int").alias("ord"), "correct", "confidence", F.size("misrecognized").alias("n"))


def tokens(f: Fleet) -> DataFrame:
    """Words and gaps of each segment with a made-up reading: a word's lower-case letters; gaps have none."""
    parts = F.regexp_extract_all("text", F.lit(r"\S+|\s+"), F.lit(0))
    ends = F.aggregate(F.col("p"), F.expr("cast(array() as array<int>)"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x)))
    rows = f.segments.withColumn("p", parts).withColumn("e", ends).select("project_id", "segment_id", F.posexplode(F.arrays_zip("p", "e")).alias("ord", "x"))
    reading = F.nullif(F.lower(F.regexp_replace("x.p", r"[^A-Za-z]", "")), F.lit(""))
    return rows.select("project_id", "segment_id", "ord", (F.col("x.e") - F.length("x.p")).alias("begin"), F.col("x.e").alias("end"), F.col("x.p").alias("surface"), reading.alias("reading"))


def readings(f: Fleet) -> DataFrame:
    return f.spark.createDataFrame([("ofthe", "OF-THE", 0), ("the", "THE", 1), ("inthe", "IN-THE", 2), ("dela", "DE-LA", 3), ("theof", "THE-OF", 4)], "reading string, correct string, rank int")


@query()
def h06_readings(f: Fleet) -> DataFrame:
    return K.apply_readings(tokens(f), readings(f))


@query()
def h07_correct(f: Fleet) -> DataFrame:
    return K.correct_segments(f.segments, dictionary(f), tokens(f), readings(f)).select("project_id", "segment_id", "new_text", F.size("hits").cast("bigint").alias("hits"))


@query()
def a15_correction_summary(f: Fleet) -> DataFrame:
    return K.correction_summary(K.correct_segments(f.segments, dictionary(f), tokens(f), readings(f)))


@query(f"""+ {_PIECES}, u AS (SELECT *, array_to_string(list_transform(p, lambda x: CASE x WHEN 'thea' THEN 'THE' WHEN 'thed' THEN 'THE' WHEN 'tian' THEN 'tion' WHEN 'ou' THEN 'oui' ELSE x END), '') AS n FROM t)
 SELECT project_id, segment_id, CAST(len(list_filter(p, lambda x: x IN ('thea', 'thed', 'tian', 'ou') OR (x IN ('annd', 'ond') AND contains(n, x)))) AS BIGINT) AS pending FROM u""")
def h20_pending(f: Fleet) -> DataFrame:
    return K.pending_hits(K.apply_surface(f.segments, dictionary(f))).select("project_id", "segment_id", F.size("hits").cast("bigint").alias("pending"))


@query(f"SELECT doc_id, CAST(0.5 AS DOUBLE) * (length(text) + length(regexp_replace({_WITH_KANA}, '[^{_KANA}]', '', 'g'))) AS width FROM documents")
def h08_text_width(f: Fleet) -> DataFrame:
    return f.table("documents").select("doc_id", X.text_width(kana_text()).alias("width"))


def entries(f: Fleet) -> DataFrame:
    """Mapped entries with the letters of their text, which every engine measures alike."""
    mapped, _ = T.map_segments(segments(f), T.approved(f.cuts))
    return mapped.join(f.segments.select("project_id", "segment_id", ascii_text().alias("text")), ["project_id", "segment_id"])


_ENTRIES = MAPPED + f""", ent AS (SELECT e.project_id, e.segment_id, CAST(e.start_ms AS BIGINT) AS start_ms, CAST(e.end_ms AS BIGINT) AS end_ms, s.text FROM entries e JOIN (SELECT project_id, segment_id, {_ASCII} AS text FROM segments) s ON s.project_id = e.project_id AND s.segment_id = e.segment_id)"""


@query(_ENTRIES + " SELECT project_id, segment_id, round(CASE WHEN end_ms > start_ms THEN 0.5 * length(text) / ((end_ms - start_ms) / 1000.0) END, 6) AS cps_width, round(CASE WHEN end_ms > start_ms THEN length(text) / ((end_ms - start_ms) / 1000.0) END, 6) AS cps_chars FROM ent")
def h09_reading_speed(f: Fleet) -> DataFrame:
    e = entries(f)
    one = lambda units: F.round(X.cps(units, F.col("start_ms"), F.col("end_ms")), 6)
    return e.select("project_id", "segment_id", one(X.text_width(F.col("text"))).alias("cps_width"), one(F.length("text").cast("double")).alias("cps_chars"))


@query()
def h10_wrap(f: Fleet) -> DataFrame:
    phrases = F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0))
    return f.segments.select("project_id", "segment_id", F.array_join(U.wrap(phrases, 40, 2), "\\N").alias("wrapped"))


@query(_ENTRIES + """ SELECT project_id, segment_id, kind FROM (SELECT project_id, segment_id, 'max_cps' AS kind FROM ent WHERE end_ms > start_ms AND 0.5 * length(text) / ((end_ms - start_ms) / 1000.0) > 8.0
 UNION ALL SELECT project_id, segment_id, 'max_chars' FROM ent WHERE 0.5 * length(text) > 20.0) z""")
def h11_readability(f: Fleet) -> DataFrame:
    return U.readability(entries(f))


@query(f"""+ p AS (SELECT doc_id, regexp_extract_all({_ASCII}, '[\\s\\S]{{1,60}}') AS p FROM documents), r AS (SELECT doc_id, p, unnest(range(0, greatest(len(p) - 1, 1))) AS run FROM p),
 q AS (SELECT doc_id, run, lower(replace(coalesce(p[run + 1], ''), ' ', '')) AS a, lower(replace(coalesce(p[run + 2], ''), ' ', '')) AS b FROM r)
 SELECT doc_id, CAST(run AS BIGINT) AS run, round(CASE WHEN length(a) > 0 THEN CAST(levenshtein(a, b) AS DOUBLE) / length(a) END, 9) AS cer FROM q""")
def h12_cer(f: Fleet) -> DataFrame:
    return V.cer(runs(f), ascii_only=True).select("doc_id", "run", F.round("cer", 9).alias("cer"))


@query()
def h12_edit_counts(f: Fleet) -> DataFrame:
    return V.cer_with_edits(runs(f)).select("doc_id", "run", "edits.*")


# Patches


@query("SELECT DISTINCT project_id, segment_id, 'unknown id' AS problem FROM patches a WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.project_id = a.project_id AND s.segment_id = a.segment_id) UNION ALL SELECT project_id, segment_id, 'repeated id' FROM patches GROUP BY project_id, segment_id HAVING count(*) > 1")
def j38_check_patches(f: Fleet) -> DataFrame:
    return K.check_patches(f.patches, f.segments)


_PATCHED = """+ bad AS (SELECT project_id FROM patches a WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.project_id = a.project_id AND s.segment_id = a.segment_id) UNION SELECT project_id FROM (SELECT project_id FROM patches GROUP BY project_id, segment_id HAVING count(*) > 1) z),
 good AS (SELECT * FROM patches WHERE project_id NOT IN (SELECT project_id FROM bad))"""


@query(_PATCHED + " SELECT s.project_id, s.segment_id, coalesce(g.text, s.text) AS text, coalesce(g.text <> s.text, false) AS changed FROM segments s LEFT JOIN good g ON g.project_id = s.project_id AND g.segment_id = s.segment_id")
def j39_apply_patches(f: Fleet) -> DataFrame:
    return K.apply_patches(f.segments, f.patches, "2024-01-01T00:00:00Z").select("project_id", "segment_id", "text", "changed")


def shifted(f: Fleet) -> DataFrame:
    """The transcript with a few rows moved or lost, as a broken correction would leave it."""
    moved = F.when((F.col("project_id") + F.col("ord")) % 17 == 3, F.col("start_ms") + 1).otherwise(F.col("start_ms"))
    return segments(f).withColumn("start_ms", moved).filter("(project_id * 3 + ord) % 29 <> 5")


_SHIFTED = "(SELECT project_id, turn, segment_id, CASE WHEN (project_id + turn) % 17 = 3 THEN start_ms + 1 ELSE start_ms END AS start_ms, end_ms FROM segments WHERE (project_id * 3 + turn) % 29 <> 5)"


@query(f"SELECT s.project_id, s.turn AS ord, s.segment_id AS before_id, a.segment_id AS after_id FROM segments s LEFT JOIN {_SHIFTED} a ON a.project_id = s.project_id AND a.turn = s.turn WHERE a.segment_id IS NULL OR a.start_ms <> s.start_ms")
def j40_shape_diff(f: Fleet) -> DataFrame:
    return K.shape_diff(segments(f), shifted(f))


# Subtitles


@query(_ENTRIES + " SELECT project_id, count(*) FILTER (WHERE kind = 'max_cps') AS max_cps, count(*) FILTER (WHERE kind = 'max_chars') AS max_chars FROM (SELECT project_id, 'max_cps' AS kind FROM ent WHERE end_ms > start_ms AND 0.5 * length(text) / ((end_ms - start_ms) / 1000.0) > 8.0 UNION ALL SELECT project_id, 'max_chars' FROM ent WHERE 0.5 * length(text) > 20.0) z GROUP BY project_id")
def a05_warning_counts(f: Fleet) -> DataFrame:
    return U.warning_counts(U.readability(entries(f)), ["max_cps", "max_chars"])


@query(_ENTRIES + f""", d AS (SELECT i.project_id, i.segment_id, (SELECT min_by(c.cut_id, c.ord) FROM {FILED} c JOIN segments s ON s.project_id = c.project_id WHERE c.project_id = i.project_id AND s.segment_id = i.segment_id AND c.status = 'approved' AND c.start_ms <= s.start_ms AND c.end_ms >= s.end_ms) AS cut_id FROM img i WHERE i.dropped)
 SELECT p.project_id, (SELECT count(*) FROM ent e WHERE e.project_id = p.project_id) AS entries,
 coalesce((SELECT string_agg(segment_id || '/' || coalesce(cut_id, '-'), ',' ORDER BY segment_id) FROM d WHERE d.project_id = p.project_id), '') AS dropped,
 coalesce((SELECT string_agg(segment_id, ',' ORDER BY segment_id) FROM ent e WHERE e.project_id = p.project_id AND end_ms - start_ms < 800), '') AS min_display,
 coalesce((SELECT string_agg(segment_id, ',' ORDER BY segment_id) FROM ent e WHERE e.project_id = p.project_id AND end_ms > start_ms AND length(text) / ((end_ms - start_ms) / 1000.0) > 8.0), '') AS max_cps FROM projects p""")
def a06_subtitle_section(f: Fleet) -> DataFrame:
    e = entries(f)
    warnings = T.map_segments(segments(f), T.approved(f.cuts))[1]
    dropped = warnings.filter("kind = 'dropped_by_cut'").join(T.covering_cut(f.segments, filed(f)), ["project_id", "segment_id"])
    fast = e.filter(X.cps(F.length("text").cast("double"), F.col("start_ms"), F.col("end_ms")) > 8.0)
    return U.subtitle_section(f.projects, e, dropped, warnings.filter("kind = 'min_display'"), fast)


MISSING = _ENTRIES + """, f AS (SELECT project_id, start_ms, end_ms, text FROM ent WHERE (project_id + start_ms) % 9 <> 4), a AS (SELECT *, row_number() OVER (PARTITION BY project_id, start_ms, end_ms, text ORDER BY segment_id) AS k FROM ent), b AS (SELECT *, row_number() OVER (PARTITION BY project_id, start_ms, end_ms, text ORDER BY start_ms) AS k FROM f),
 lost AS (SELECT a.project_id, a.segment_id, a.start_ms FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.project_id = a.project_id AND b.start_ms = a.start_ms AND b.end_ms = a.end_ms AND b.text = a.text AND b.k = a.k))"""


@query(MISSING + " SELECT project_id, segment_id FROM lost")
def u02_missing_entries(f: Fleet) -> DataFrame:
    e = entries(f)
    srt = e.filter("(project_id + start_ms) % 9 <> 4").select("project_id", F.col("ord").alias("n"), "start_ms", "end_ms", "text")
    return U.missing_entries(e, srt).select("project_id", "segment_id")


_CLOCK = "lpad(CAST(({t}) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((({t}) // 60000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((({t}) // 1000) % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(({t}) % 1000 AS VARCHAR), 3, '0')"


@query(_ENTRIES + f""", n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, segment_id) AS n FROM ent)
 SELECT project_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {_CLOCK.format(t='start_ms')} || ' --> ' || {_CLOCK.format(t='end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS document FROM n GROUP BY project_id""")
def k02_srt_documents(f: Fleet) -> DataFrame:
    return U.srt_documents(entries(f))


@query(_ENTRIES + ", n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, segment_id) AS n FROM ent) SELECT project_id, n, start_ms, end_ms, trim(text) AS text FROM n")
def s20_srt_entries(f: Fleet) -> DataFrame:
    return U.parse_srt(U.srt_documents(entries(f)))


_PRESETS = {"default": {"fontname": "Sans", "fontsize": "48"}, "emphasis": {"fontsize": "64", "bold": "-1"}, "chapter": {"alignment": "8"}}


_DEFAULTS = {"fontname": "Serif", "fontsize": "40", "bold": "0"}
#: What projects say of their own styles: every third changes a packaged preset, every fourth adds one of its own, which telops name.
_OWN = """SELECT project_id, 'default' AS preset, 'fontsize' AS field, CAST(20 + project_id % 40 AS STRING) AS value FROM {projects} WHERE project_id % 3 = 1
 UNION ALL SELECT project_id, 'missing', 'fontname', concat('Own', CAST(project_id AS STRING)) FROM {projects} WHERE project_id % 4 = 0"""


def presets(f: Fleet) -> DataFrame:
    own = f.sql(_OWN, projects=f.projects).select("project_id", "preset", F.create_map("field", "value").alias("fields"))
    return U.merge_styles(_PRESETS, own, f.projects, _DEFAULTS)


_TELOPS = MAPPED + """, ok AS (SELECT project_id, v.preset FROM projects, (VALUES ('default'), ('emphasis'), ('chapter')) v(preset) UNION SELECT project_id, 'missing' FROM projects WHERE project_id % 4 = 0), tot AS (SELECT p.project_id, p.duration_ms - coalesce(sum(m.end_ms - m.start_ms), 0) AS cd FROM projects p LEFT JOIN merged m ON m.project_id = p.project_id GROUP BY p.project_id, p.duration_ms),
 r AS (SELECT t.project_id, t.idx, t.segment_id, t.text, t.style_preset, EXISTS (SELECT 1 FROM ok WHERE ok.project_id = t.project_id AND ok.preset = t.style_preset) AS styled, e.start_ms AS m0, e.end_ms AS m1, tot.cd, t.duration_ms,
 t.start_ms - coalesce((SELECT sum(greatest(0, least(m.end_ms, t.start_ms) - m.start_ms)) FROM merged m WHERE m.project_id = t.project_id AND m.start_ms < t.start_ms), 0) AS f0
 FROM telops t JOIN tot ON tot.project_id = t.project_id LEFT JOIN entries e ON e.project_id = t.project_id AND e.segment_id = t.segment_id)
"""
_SHOWN = """CAST(CASE WHEN segment_id IS NOT NULL THEN m0 ELSE f0 END AS BIGINT) AS show_ms, CAST(CASE WHEN segment_id IS NOT NULL THEN m1 ELSE least(f0 + duration_ms, cd) END AS BIGINT) AS hide_ms,
 CASE WHEN NOT styled THEN 'unknown preset' WHEN segment_id IS NOT NULL AND m0 IS NULL THEN 'removed by cut' WHEN segment_id IS NULL AND f0 >= least(f0 + duration_ms, cd) THEN 'nothing to show' END AS problem"""
_TELOPS_SHOWN = f"{_TELOPS}, shown AS (SELECT project_id, idx, text, style_preset, {_SHOWN} FROM r)"


@query(f"{_TELOPS} SELECT project_id, idx, {_SHOWN} FROM r")
def j35_resolve_telops(f: Fleet) -> DataFrame:
    mapped, _ = T.map_segments(segments(f), T.approved(f.cuts))
    return U.resolve_telops(f.telops, mapped, f.segments, presets(f), merged(f), f.projects).select("project_id", "idx", "show_ms", "hide_ms", "problem")


@query("""+ own AS (""" + _OWN.format(projects="projects") + """), p AS (SELECT project_id, v.* FROM projects, (VALUES ('default', '48', 'Sans', NULL), ('emphasis', '64', NULL, '-1'), ('chapter', NULL, NULL, NULL)) v(preset, size, font, bold))
 SELECT coalesce(p.project_id, o.project_id) AS project_id, coalesce(p.preset, o.preset) AS preset, coalesce(CASE WHEN o.field = 'fontsize' THEN o.value END, p.size, '40') AS size,
 coalesce(CASE WHEN o.field = 'fontname' THEN o.value END, p.font, 'Serif') AS font, coalesce(p.bold, '0') AS bold FROM p FULL JOIN own o ON o.project_id = p.project_id AND o.preset = p.preset""")
def j36_merge_styles(f: Fleet) -> DataFrame:
    return presets(f).select("project_id", "preset", F.col("fields")["fontsize"].alias("size"), F.col("fields")["fontname"].alias("font"), F.col("fields")["bold"].alias("bold"))


_ASS_TIME = "CAST({t} // 3600000 AS VARCHAR) || ':' || lpad(CAST(({t} // 60000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({t} // 1000) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(({t} % 1000) // 10 AS VARCHAR), 2, '0')"


@query(_TELOPS_SHOWN + f""", own AS ({_OWN.format(projects="projects")}), packed AS (SELECT project_id, v.* FROM projects, (VALUES ('default', '48', 'Sans', '0', '2'), ('emphasis', '64', 'Serif', '-1', '2'), ('chapter', '40', 'Serif', '0', '8')) v(preset, size, font, bold, alignment)),
 styles AS (SELECT coalesce(p.project_id, o.project_id) AS project_id, coalesce(p.preset, o.preset) AS preset, 'Style: ' || coalesce(p.preset, o.preset) || ',' || coalesce(CASE WHEN o.field = 'fontname' THEN o.value END, p.font, 'Serif') || ','
  || coalesce(CASE WHEN o.field = 'fontsize' THEN o.value END, p.size, '40') || ',&H00FFFFFF,&H000000FF,&H00000000,&H00000000,' || coalesce(p.bold, '0') || ',0,0,0,100,100,0,0,1,2,0,' || coalesce(p.alignment, '2') || ',10,10,10,1' AS line
  FROM packed p FULL JOIN own o ON o.project_id = p.project_id AND o.preset = p.preset),
 events AS (SELECT project_id, idx, 'Dialogue: ' || idx || ',' || {_ASS_TIME.format(t="show_ms")} || ',' || {_ASS_TIME.format(t="hide_ms")} || ',' || style_preset || ',,0,0,0,,' || text AS line FROM shown WHERE problem IS NULL)
 SELECT project_id, '[Script Info]' || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: 1920' || chr(10) || 'PlayResY: 1080' || chr(10) || chr(10) || '[V4+ Styles]' || chr(10)
 || 'Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding' || chr(10)
 || (SELECT string_agg(line, chr(10) ORDER BY preset) FROM styles s WHERE s.project_id = p.project_id) || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text' || chr(10)
 || coalesce((SELECT string_agg(line, chr(10) ORDER BY idx) FROM events e WHERE e.project_id = p.project_id), '') AS document FROM projects p""")
def k03_ass_documents(f: Fleet) -> DataFrame:
    mapped, _ = T.map_segments(segments(f), T.approved(f.cuts))
    shown = U.resolve_telops(f.telops, mapped, f.segments, presets(f), merged(f), f.projects).filter("problem is null")
    return U.ass_documents(shown, presets(f), f.projects.select("project_id", F.lit(1920).alias("width"), F.lit(1080).alias("height")))


# The re-transcription check


def expected(f: Fleet) -> DataFrame:
    ascii_segments = segments(f).withColumn("text", ascii_text())
    return V.expected_segments(ascii_segments, f.cuts, ascii_only=True)


_EXPECTED = _ENTRIES + ", x AS (SELECT e.*, lower(replace(text, ' ', '')) AS said, i.ord FROM ent e JOIN img i ON i.project_id = e.project_id AND i.segment_id = e.segment_id), y AS (SELECT *, CAST(coalesce(sum(length(said)) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM x WHERE said <> '')"


@query(_EXPECTED + " SELECT project_id, string_agg(said, '' ORDER BY off) AS expected FROM y GROUP BY project_id")
def a09_expected_text(f: Fleet) -> DataFrame:
    return V.expected_text(expected(f))


@query(_EXPECTED + " SELECT project_id, segment_id, off AS \"offset\" FROM y")
def w03_char_offsets(f: Fleet) -> DataFrame:
    return expected(f).select("project_id", "segment_id", "offset")


def heard(f: Fleet) -> DataFrame:
    """What a second recogniser might hear: the expected text without a few runs and with some letters changed."""
    t = V.expected_text(expected(f).filter("segment_id <> 's0005'"))
    actual = F.concat(F.substring("expected", 1, 40), F.translate(F.expr("substring(expected, 46)"), "xz", "ks"))
    return t.select("project_id", "expected", actual.alias("actual"))


@query()
def h13_missing_hunks(f: Fleet) -> DataFrame:
    return V.missing_hunks(heard(f))


@query()
def h14_alignment_cer(f: Fleet) -> DataFrame:
    return V.alignment_cer(heard(f))


@query()
def h16_without_fillers(f: Fleet) -> DataFrame:
    return V.without_fillers(segments(f), f.cuts, words(f)).select("project_id", "segment_id", "said")


_LOCATED = _EXPECTED + """, pts AS (SELECT project_id, unnest(range(0, CAST(max(off + length(said)) AS BIGINT), 37)) AS i FROM y GROUP BY project_id), loc AS (SELECT p.project_id, p.i, y.segment_id, y.start_ms AS s, y.end_ms AS e, y.off AS o, length(y.said) AS n
 FROM pts p ASOF JOIN y ON y.project_id = p.project_id AND y.off <= p.i)"""


@query(_LOCATED + ' SELECT project_id, i AS "index", segment_id, round(s + least(1.0, greatest(0.0, (i - o) / CAST(n AS DOUBLE))) * (e - s), 3) AS at_ms FROM loc')
def j33_locate(f: Fleet) -> DataFrame:
    e = expected(f)
    end = e.groupBy("project_id").agg(F.max(F.col("offset") + F.length("said")).alias("n"))
    points = end.select("project_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(37).cast("bigint"))).alias("index"))
    return V.locate(points, e).select("project_id", "index", "segment_id", F.round("at_ms", 3).alias("at_ms"))


def flags(f: Fleet) -> DataFrame:
    return V.flag_boundaries(V.locate(V.missing_hunks(heard(f)), expected(f)), f.cuts, merged(f), f.projects)


@query()
def j32_flag_boundaries(f: Fleet) -> DataFrame:
    return flags(f)


@query()
def a20_verify_summary(f: Fleet) -> DataFrame:
    return V.verify_summary(f.projects, heard(f), flags(f), f.cuts)


@query("""+ f AS (SELECT project_id, count(*) AS flags FROM segments WHERE (project_id + turn) % 8 = 1 GROUP BY project_id), e AS (SELECT project_id, CAST(2 * count(*) FILTER (WHERE status = 'approved') AS BIGINT) AS boundaries FROM cuts GROUP BY project_id)
 SELECT e.project_id, coalesce(f.flags, 0) AS flags, e.boundaries, round(CASE WHEN e.boundaries > 0 THEN coalesce(f.flags, 0) / CAST(e.boundaries AS DOUBLE) END, 9) AS rate FROM e LEFT JOIN f ON f.project_id = e.project_id""")
def a11_false_positive_rate(f: Fleet) -> DataFrame:
    out = V.false_positive_rate(f.segments.filter("(project_id + turn) % 8 = 1"), f.cuts)
    return out.withColumn("rate", F.round("rate", 9))


@query("SELECT project_id, string_agg(text, '' ORDER BY turn) AS text FROM segments GROUP BY project_id")
def a19_transcript_text(f: Fleet) -> DataFrame:
    from fleetcut.operators.report import transcript_text

    return transcript_text(segments(f))
