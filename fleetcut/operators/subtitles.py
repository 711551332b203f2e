"""Subtitles: packing, readability, telops, styles, files and their check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.functions.text import cps, text_width
from fleetcut.operators.intervals import PID
from fleetcut.operators.timeline import forward, removed_duration


def wrap(phrases: Column, max_chars: float = 20, max_lines: int = 2) -> Column:
    """Lines packed greedily from whole phrases; what does not fit goes into the last line."""
    start = F.expr("cast(array() as array<string>)")

    def step(lines: Column, p: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = last.isNotNull() & ((text_width(F.concat(last, p)) <= max_chars) | (F.size(lines) >= max_lines))
        return F.when(fits, F.array_append(F.slice(lines, F.lit(1), F.size(lines) - 1), F.concat(last, p))).otherwise(F.array_append(lines, p))

    return F.aggregate(phrases, start, step)


def readability(entries: DataFrame, max_cps: float = 8.0, max_chars: float = 20.0) -> DataFrame:
    """Warnings of entries (project_id, segment_id, start_ms, end_ms, text): too fast, a line too wide."""
    width = text_width(F.col("text"))
    rows = entries.withColumn("cps", cps(width, F.col("start_ms"), F.col("end_ms")))
    rows = rows.withColumn("widest", F.array_max(F.transform(F.split("text", r"\\N|\n"), lambda x: text_width(x))))
    kinds = F.array_compact(F.array(F.when(F.col("cps") > max_cps, "max_cps"), F.when(F.col("widest") > max_chars, "max_chars")))
    return rows.select(PID, "segment_id", F.explode(kinds).alias("kind"))


def warning_counts(warnings: DataFrame, kinds: list[str]) -> DataFrame:
    return warnings.groupBy(PID).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def subtitle_section(projects: DataFrame, entries: DataFrame, dropped: DataFrame, short: DataFrame, fast: DataFrame) -> DataFrame:
    """Per project: how many entries, and the lists of dropped (with cut id), short and fast ones; empty lists stay empty."""
    ids = lambda df, out, item: df.groupBy(PID).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias(out))
    n = entries.groupBy(PID).agg(F.count(F.lit(1)).alias("entries"))
    out = projects.select(PID).join(n, PID, "left")
    out = out.join(ids(dropped, "dropped", F.concat("segment_id", F.lit("/"), F.coalesce("cut_id", F.lit("-")))), PID, "left")
    out = out.join(ids(short, "min_display", F.col("segment_id")), PID, "left").join(ids(fast, "max_cps", F.col("segment_id")), PID, "left")
    return out.select(PID, F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("dropped", "min_display", "max_cps")])


def merge_styles(packaged: dict[str, dict[str, str]], own: DataFrame, projects: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Each project's presets (project_id, preset, fields): field by field its own (project_id, preset, fields map) win over the
    packaged ones, a short fixed list, and these over the defaults."""
    text = "map<string,string>"
    as_map = lambda fields: F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]).cast(text)
    shipped = F.explode(F.create_map(*[x for name, fields in packaged.items() for x in (F.lit(name), as_map(fields))])).alias("preset", "p")
    none = F.expr(f"cast(map() as {text})")
    both = projects.select(PID, shipped).join(own.withColumnRenamed("fields", "o"), [PID, "preset"], "full")
    win = lambda low, high: F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)
    return both.select(PID, "preset", win(win(as_map(defaults), F.coalesce("p", none)), F.coalesce("o", none)).alias("fields"))


def resolve_telops(telops: DataFrame, mapped: DataFrame, segments: DataFrame, presets: DataFrame, merged: DataFrame, projects: DataFrame) -> DataFrame:
    """Telops on the cut timeline: by segment if one is named (it wins), else by start and duration. `problem` says why one is not shown.

    presets: each project's own (merge_styles).
    """
    on = presets.select(PID, F.col("preset").alias("style_preset"), F.lit(True).alias("styled"))
    t = telops.join(on, [PID, "style_preset"], "left").join(segments.select(PID, "segment_id", F.lit(True).alias("known")), [PID, "segment_id"], "left")
    t = t.join(mapped.select(PID, "segment_id", F.col("start_ms").alias("m0"), F.col("end_ms").alias("m1")), [PID, "segment_id"], "left")
    placed = forward(t.filter("segment_id is null and start_ms is not null"), merged, "start_ms", "f0")
    t = t.filter("segment_id is not null or start_ms is null").withColumn("f0", F.lit(None).cast("bigint")).unionByName(placed)
    t = t.join(removed_duration(merged, projects).select(PID, "cut_duration_ms"), PID)
    by_id = F.col("segment_id").isNotNull()
    start = F.when(by_id, F.col("m0")).otherwise(F.col("f0"))
    end = F.when(by_id, F.col("m1")).otherwise(F.least(F.col("f0") + F.col("duration_ms"), F.col("cut_duration_ms")))
    problem = (
        F.when(F.col("styled").isNull(), "unknown preset").when(by_id & F.col("known").isNull(), "unknown segment")
        .when(by_id & F.col("m0").isNull(), "removed by cut").when(~by_id & (start >= end), "nothing to show")
    )
    return t.select(PID, "idx", "text", "style_preset", start.alias("show_ms"), end.alias("hide_ms"), problem.alias("problem"))


def clock(ms: Column, fraction: str = ",") -> Column:
    """HH:MM:SS and the milliseconds."""
    two = lambda c: F.format_string("%02d", c.cast("bigint"))
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(fraction), F.lpad((ms % 1000).cast("string"), 3, "0"))


def srt_documents(entries: DataFrame, wrapped: bool = True) -> DataFrame:
    r"""One SRT document per project; \N breaks a line, or is taken out if not wrapped."""
    n = F.row_number().over(Window.partitionBy(PID).orderBy("start_ms", "end_ms", "segment_id"))
    text = F.regexp_replace("text", r"\\N", "\n" if wrapped else "")
    block = F.concat(n.cast("string"), F.lit("\n"), clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), text, F.lit("\n"))
    rows = entries.select(PID, n.alias("n"), block.alias("b"))
    return rows.groupBy(PID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "\n").alias("document"))


def parse_srt(documents: DataFrame) -> DataFrame:
    """Entries (project_id, n, start_ms, end_ms, text without newlines) of SRT documents."""
    block = F.explode(F.split(F.regexp_replace("document", "\r\n", "\n"), r"\n\s*\n")).alias("b")
    line = r"(?s)(\d+):(\d+):(\d+)[,.](\d+) --> (\d+):(\d+):(\d+)[,.](\d+)[^\n]*\n(.*)$"
    part = lambda i: F.regexp_extract("b", line, i)
    ms = lambda i: ((part(i).cast("bigint") * 60 + part(i + 1).cast("bigint")) * 60 + part(i + 2).cast("bigint")) * 1000 + part(i + 3).cast("bigint")
    rows = documents.select(PID, block).filter(F.col("b").rlike(r"\d --> \d"))
    return rows.select(PID, F.regexp_extract("b", r"^\s*(\d+)", 1).cast("bigint").alias("n"), ms(1).alias("start_ms"), ms(5).alias("end_ms"), F.regexp_replace(F.trim(part(9)), r"\s*\n\s*", "").alias("text"))


def missing_entries(entries: DataFrame, srt: DataFrame) -> DataFrame:
    """Entries without a file event of the same (start, end, text); each event answers one entry."""
    key = [PID, "start_ms", "end_ms", "text"]
    rank = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    a, b = entries.withColumn("k", rank("segment_id")), srt.withColumn("k", rank("n")).select(*key, "k")
    return a.join(b, [*key, "k"], "left_anti").drop("k")


def ass_colour(literal: Column) -> Column:
    """&HAABBGGRR as alpha, red, green and blue numbers."""
    byte = lambda at: F.conv(F.substring(literal, at, 2), 16, 10).cast("int")
    return F.struct(byte(3).alias("alpha"), byte(9).alias("red"), byte(7).alias("green"), byte(5).alias("blue"))


# The fields of an ASS file's style and event lines, in their order, and what a style's omitted fields are.
STYLE_FIELDS = {
    "Fontname": "Sans", "Fontsize": "48", "PrimaryColour": "&H00FFFFFF", "SecondaryColour": "&H000000FF", "OutlineColour": "&H00000000", "BackColour": "&H00000000",
    "Bold": "0", "Italic": "0", "Underline": "0", "StrikeOut": "0", "ScaleX": "100", "ScaleY": "100", "Spacing": "0", "Angle": "0", "BorderStyle": "1",
    "Outline": "2", "Shadow": "0", "Alignment": "2", "MarginL": "10", "MarginR": "10", "MarginV": "10", "Encoding": "1",
}
#: The fields by which styles.json and merge_styles name a style, with their types; numbers and switches of an ASS line are written as it writes them.
STYLE_TYPES = {
    "fontname": "string", "fontsize": "int", "bold": "boolean", "italic": "boolean", "alignment": "int", "primary_colour": "string", "secondary_colour": "string",
    "outline_colour": "string", "back_colour": "string", "outline": "double", "shadow": "double", "spacing": "double", "margin_l": "int", "margin_r": "int", "margin_v": "int",
}
#: What a preset's fields are that neither the project nor the package states.
STYLE_DEFAULTS = {
    "fontname": "Hiragino Sans W6", "fontsize": "64", "bold": "false", "italic": "false", "alignment": "8", "primary_colour": "&H00FFFFFF", "secondary_colour": "&H000000FF",
    "outline_colour": "&H00000000", "back_colour": "&H00000000", "outline": "3.0", "shadow": "0.0", "spacing": "0.0", "margin_l": "40", "margin_r": "40", "margin_v": "60",
}
EVENT_FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")


def _stated(name: str) -> Column:
    """A style field of an ASS line, from the project's name for it or from the line's own."""
    key = "".join(k for k in STYLE_TYPES if k.replace("_", "") == name.lower())
    own = F.try_element_at("fields", F.lit(name))
    if not key:
        return own
    value = F.try_element_at("fields", F.lit(key))
    if STYLE_TYPES[key] == "boolean":
        value = F.when(value == "true", "-1").when(value == "false", "0").otherwise(value)
    elif STYLE_TYPES[key] == "double":
        value = F.regexp_replace(value, r"\.0+$", "")
    elif key.endswith("colour"):
        value = F.concat(F.lit("&H"), F.lpad(F.upper(F.regexp_replace(value, "^&[Hh]", "")), 8, "0"))
    return F.coalesce(value, own)


def style_lines(presets: DataFrame) -> DataFrame:
    """(project_id, preset, line): an ASS style line of each preset from its fields map, by the names of STYLE_TYPES or of STYLE_FIELDS."""
    fields = [F.coalesce(_stated(name), F.lit(default)) for name, default in STYLE_FIELDS.items()]
    return presets.select(PID, "preset", F.concat(F.lit("Style: "), F.concat_ws(",", "preset", *fields)).alias("line"))


def ass_documents(events: DataFrame, presets: DataFrame, sizes: DataFrame) -> DataFrame:
    """One ASS document per project: its presets (project_id, preset, fields) declared, one event per telop, layer = its place in the file."""
    listed = lambda df, item, out: df.groupBy(PID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["l"]), "\n").alias(out))
    styles = listed(style_lines(presets), F.struct("preset", F.col("line").alias("l")), "styles")
    time = lambda c: F.concat(F.floor(F.col(c) / 3600000).cast("string"), F.substring(F.regexp_extract(clock(F.col(c), "."), r"(:.*)$", 1), 1, 9))
    line = F.concat_ws(",", F.concat(F.lit("Dialogue: "), F.col("idx").cast("string")), time("show_ms"), time("hide_ms"), "style_preset", F.lit(""), F.lit("0"), F.lit("0"), F.lit("0"), F.lit(""), "text")
    out = sizes.join(listed(events, F.struct("idx", line.alias("l")), "lines"), PID, "left").join(styles, PID, "left")
    head = F.concat(F.lit("[Script Info]\nScriptType: v4.00+\nPlayResX: "), F.col("width").cast("string"), F.lit("\nPlayResY: "), F.col("height").cast("string"))
    return out.select(PID, F.concat_ws(
        "\n", head, F.lit("\n[V4+ Styles]"), F.lit("Format: Name, " + ", ".join(STYLE_FIELDS)), F.coalesce("styles", F.lit("")),
        F.lit("\n[Events]"), F.lit("Format: " + ", ".join(EVENT_FIELDS)), F.coalesce("lines", F.lit("")),
    ).alias("document"))
