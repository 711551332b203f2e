"""Corrections: dictionary replacement by surface and by reading, and reviewed patches."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.functions.batches import small_batches
from fleetcut.functions.matching import MAX_CHARS, MAX_WORDS, match_words
from fleetcut.operators.intervals import PID

#: Tokens of a reading run, at most.
MAX_RUN = 8


def apply_surface(segments: DataFrame, dictionary: DataFrame, keep_pieces: bool = False) -> DataFrame:
    """Replace misrecognised surfaces by a dictionary table (ord, correct, misrecognized, confidence; with project_id each project has its own).

    Leftmost, longest, earlier entries first on ties. `always` is replaced; `context` is only reported. A correct form is a pattern only if an entry
    lists it. Adds new_text and hits (matched, correct, applied), and pieces (was, now) if asked.
    """
    own = [PID] if PID in dictionary.columns else []
    words = dictionary.select(*own, "ord", "correct", "confidence", F.posexplode("misrecognized").alias("k", "word"))
    words = words.select(*own, "word", F.col("correct").alias("value"), (F.col("confidence") == "always").alias("flag"), F.struct("ord", "k").alias("rank"))
    df = match_words(segments, words, out="__p")
    now = lambda p: F.when(p["flag"], p["value"]).otherwise(p["was"])
    if keep_pieces:
        df = df.withColumn("pieces", F.transform("__p", lambda p: F.struct(p["was"].alias("was"), now(p).alias("now"))))
    hits = F.filter("__p", lambda p: p["value"].isNotNull() & (p["value"] != p["was"]))
    found = F.transform(hits, lambda p: F.struct(p["was"].alias("matched"), p["value"].alias("correct"), p["flag"].alias("applied")))
    return df.withColumn("new_text", F.array_join(F.transform("__p", now), "")).withColumn("hits", found).drop("__p")


def _arrays(tokens: DataFrame, *order: str) -> DataFrame:
    """The tokens of each segment as one array __tokens, in order; a token without a reading has an empty one."""
    token = F.struct(*order, F.coalesce("reading", F.lit("")).alias("r"))
    return tokens.groupBy(PID, "segment_id").agg(F.array_sort(F.collect_list(token)).alias("__tokens"))


def greedy_runs(begins: list, ends: list, said: list[str], known: Mapping[str, str | None], longest: int) -> list[tuple]:
    """Runs (first, last, begin, end, correct) of up to MAX_RUN tokens whose joined reading is known: the longest at each place, from the left. No known reading
    has over `longest` characters."""
    out, i, n = [], 0, len(said)
    while i < n:
        last = 0
        if said[i]:
            run = ""
            for m in range(i, min(i + MAX_RUN, n)):
                if said[m]:
                    run += said[m]
                    if len(run) > longest:
                        break
                    if run in known:
                        last, correct = m + 1, known[run]
        if last:
            out.append((i + 1, last, begins[i], ends[last - 1], correct))
        i = last or i + 1
    return out


def moved_tokens(begins: list[int], ends: list[int], said: list[str], pieces: list[tuple[str, str | None]], known: Mapping[str, str | None]) -> tuple[list[int], list[int], list[str]]:
    """The tokens of a text as the surface pass leaves it, given its pieces (was, now): those outside its edits move along, those that an edit touches give way to
    one token of the edit, with the reading that is known for its form."""
    starts, stops, shifts, out, was_at, now_at = [], [], [], [], 0, 0
    for was, now in pieces:
        was_end, now_end = was_at + len(was), now_at + len(now or "")
        if was != now:
            starts.append(was_at)
            stops.append(was_end)
            shifts.append(now_end - was_end)
            out.append((now_at, now_end, known.get(now) or ""))
        was_at, now_at = was_end, now_end
    if not starts:
        return begins, ends, said
    for b, e, r in zip(begins, ends, said, strict=True):
        k = bisect_right(stops, b)  # edits that are over where the token begins
        if k == len(starts) or starts[k] >= e:
            by = shifts[k - 1] if k else 0
            out.append((b + by, e + by, r))
    out.sort(key=lambda t: t[:2])
    return [t[0] for t in out], [t[1] for t in out], [t[2] for t in out]


def replaced(text: str, runs: list[tuple]) -> tuple[str, list[tuple[str, str]]]:
    """The text with its runs in their correct form, and (matched, correct) of each run that did not have it."""
    out, hits, at = [], [], 0
    for _, _, b, e, correct in runs:
        if correct is not None and text[b:e] != correct:
            out += [text[at:b], correct]
            hits.append((text[b:e], correct))
            at = e
    return "".join([*out, text[at:]]), hits


def _lists(column, *fields: str) -> list[tuple[list, ...]]:
    """Of an Arrow column of arrays of structs, for each row the list of each field; empty ones for null."""
    flat = [column.values.field(f).to_pylist() for f in fields]
    ends, valid = column.offsets.to_pylist(), column.is_valid().to_pylist()
    return [tuple(x[lo:hi] if ok else [] for x in flat) for lo, hi, ok in zip(ends[:-1], ends[1:], valid, strict=True)]


def _by_row(rows: DataFrame, f: Callable, out: str, kind: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with a column out of what f gives for each Arrow batch (a list), without the columns to drop."""
    small_batches(rows.sparkSession)
    names = [c for c in rows.columns if c not in drop]
    field = T.StructField(out, T._parse_datatype_string(kind))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(field.dataType)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(f(batch), arrow)], [*names, out])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in names], field]))


def _few(readings: DataFrame) -> bool:
    """Whether a reading dictionary is short enough to be broadcast."""
    n, chars = readings.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("reading") + F.length("correct")), F.lit(0))).first()
    return n <= MAX_WORDS and chars <= MAX_CHARS


def _own(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """rows with the readings, of a dictionary too long to broadcast, that the tokens of each spell (__own, a map), by a join on what they may spell."""
    one = readings.groupBy("reading").agg(F.min_by("correct", "rank").alias("correct"))
    places = rows.filter(F.size("__tokens") > 0).select(PID, "segment_id", F.explode(F.transform("__tokens", lambda _, i: F.transform(F.slice("__tokens", i + 1, MAX_RUN), lambda t: t["r"]))).alias("w"))
    runs = places.filter(F.col("w")[0] != "").select(PID, "segment_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n")).filter(F.col("w")[F.col("n") - 1] != "")
    hits = runs.select(PID, "segment_id", F.array_join(F.slice("w", F.lit(1), F.col("n")), "").alias("reading")).join(one, "reading").groupBy(PID, "segment_id").agg(F.map_from_entries(F.collect_set(F.struct("reading", "correct"))).alias("__own"))
    return rows.join(hits, [PID, "segment_id"], "left")


def _dictionary(readings: DataFrame, key: str, value: str):
    """A short dictionary for the executors; of equal keys the lowest rank counts."""
    one = readings.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, "rank").alias("v"))
    return readings.sparkSession.sparkContext.broadcast({r[key]: r["v"] for r in one.select(key, "v").collect()})


def _maps(batch, column: str) -> list[dict[str, str | None]]:
    return [dict(x or ()) for x in batch.column(column).to_pylist()]


def _longest(known: Mapping[str, str | None]) -> int:
    return max(map(len, known), default=0)


def apply_readings(tokens: DataFrame, readings: DataFrame) -> DataFrame:
    """Runs of up to 8 tokens whose joined reading is in the dictionary (reading, correct): the longest run, from the left.

    tokens: (project_id, segment_id, ord, begin, end, surface, reading). Tokens without a reading (punctuation, spaces) may lie
    inside a run, not at its ends. Returns non-overlapping runs (project_id, segment_id, first, last, begin, end, correct).
    A segment is one row and each of its tokens is looked at MAX_RUN times at most. A dictionary too long to broadcast is joined.
    """
    rows = _arrays(tokens, "ord", "begin", "end")
    listed = _dictionary(readings, "reading", "correct") if _few(readings) else None
    if listed is None:
        rows = _own(rows, readings)

    def found(batch) -> list:
        maps = [listed.value] * batch.num_rows if listed else _maps(batch, "__own")
        longest = [_longest(listed.value)] * batch.num_rows if listed else map(_longest, maps)
        return [[dict(zip(("first", "last", "begin", "end", "correct"), r, strict=True)) for r in greedy_runs(*t, m, n)] for t, m, n in zip(_lists(batch.column("__tokens"), "begin", "end", "r"), maps, longest, strict=True)]

    out = _by_row(rows, found, "runs", "array<struct<first:int,last:int,begin:int,end:int,correct:string>>", ("__tokens", "__own"))
    return out.select(PID, "segment_id", F.inline("runs"))


def replace_runs(segments: DataFrame, runs: DataFrame, column: str = "text") -> DataFrame:
    """Segments with the runs' characters replaced by their correct form."""
    lists = runs.groupBy(PID, "segment_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "correct"))).alias("r"))
    df = segments.join(lists, [PID, "segment_id"], "left")
    text = F.col(column)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("r", start, lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["begin"] - acc["at"]), x["correct"]).alias("out")),
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return df.withColumn("new_text", F.when(F.col("r").isNull(), text).otherwise(done)).drop("r")


def pending_hits(df: DataFrame, text: str = "new_text") -> DataFrame:
    """Hits that were applied, or whose text is still there."""
    return df.withColumn("hits", F.filter("hits", lambda h: h["applied"] | F.contains(F.col(text), h["matched"])))


def _tokens_of_edits(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """rows with the readings, of a dictionary too long to broadcast, of the forms that the surface pass put in (__forms, a map)."""
    known = readings.groupBy(F.col("correct").alias("form")).agg(F.min_by("reading", "rank").alias("reading"))
    forms = rows.select(PID, "segment_id", F.explode(F.array_distinct(F.transform(F.filter("__pieces", lambda p: p["was"] != p["now"]), lambda p: p["now"]))).alias("form"))
    lists = forms.join(known, "form").groupBy(PID, "segment_id").agg(F.map_from_entries(F.collect_set(F.struct("form", "reading"))).alias("__forms"))
    return rows.join(lists, [PID, "segment_id"], "left")


def correct_segments(segments: DataFrame, dictionary: DataFrame, tokens: DataFrame, readings: DataFrame) -> DataFrame:
    """By surface, then by reading over the texts that the surface pass leaves; tokens are those of the given texts.

    hits: the surface pass's, then the reading pass's, each in order; a run that already has the correct form is none.
    """
    surfaced = apply_surface(segments, dictionary, keep_pieces=True).withColumnRenamed("pieces", "__pieces")
    rows = surfaced.join(_arrays(tokens.filter("begin is not null and end is not null"), "begin", "end", "ord"), [PID, "segment_id"], "left")
    few = _few(readings)
    forms, listed = (_dictionary(readings, "correct", "reading"), _dictionary(readings, "reading", "correct")) if few else (None, None)
    if not few:
        rows = _tokens_of_edits(rows, readings)

    def moved(batch) -> list:
        maps = [forms.value] * batch.num_rows if few else _maps(batch, "__forms")
        texts = zip(_lists(batch.column("__tokens"), "begin", "end", "r"), _lists(batch.column("__pieces"), "was", "now"), maps, strict=True)
        return [moved_tokens(*t, list(zip(*p, strict=True)), m) for t, p, m in texts]

    def read(batch, places: list, maps: list, longest: list[int]) -> list:
        texts = zip(batch.column("new_text").to_pylist(), places, maps, longest, strict=True)
        found = [(None, []) if text is None else replaced(text, greedy_runs(*t, m, n)) for text, t, m, n in texts]
        return [{"text": text, "more": [{"matched": a, "correct": c, "applied": True} for a, c in hits]} for text, hits in found]

    kind, spent = "struct<text:string,more:array<struct<matched:string,correct:string,applied:boolean>>>", ("__tokens", "__pieces", "__forms", "__own")
    if few:
        done = _by_row(rows, lambda batch: read(batch, moved(batch), [listed.value] * batch.num_rows, [_longest(listed.value)] * batch.num_rows), "__read", kind, spent)
    else:
        flat = lambda batch: [[{"begin": b, "end": e, "r": r} for b, e, r in zip(*t, strict=True)] for t in moved(batch)]
        tokened = _by_row(rows, flat, "__moved", "array<struct<begin:int,end:int,r:string>>", spent).withColumnRenamed("__moved", "__tokens")
        maps = lambda batch: _maps(batch, "__own")
        done = _by_row(_own(tokened, readings), lambda batch: read(batch, _lists(batch.column("__tokens"), "begin", "end", "r"), maps(batch), list(map(_longest, maps(batch)))), "__read", kind, spent)
    out = done.withColumn("new_text", F.col("__read.text")).withColumn("hits", F.concat("hits", "__read.more"))
    return pending_hits(out.select(PID, "segment_id", *[c for c in segments.columns if c not in (PID, "segment_id")], "hits", "new_text"))


def correction_summary(corrected: DataFrame) -> DataFrame:
    n = lambda applied: F.sum(F.size(F.filter("hits", lambda h: h["applied"] == applied))).cast("bigint")
    return corrected.groupBy(PID).agg(F.count_if(F.col("new_text") != F.col("text")).alias("changed"), n(True).alias("applied"), n(False).alias("skipped"))


def check_patches(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """Problems of patches: ids that no segment has, ids edited twice."""
    unknown = edits.join(segments.select(PID, "segment_id"), [PID, "segment_id"], "left_anti").select(PID, "segment_id").distinct()
    twice = edits.groupBy(PID, "segment_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return unknown.select(PID, "segment_id", F.lit("unknown id").alias("problem")).unionByName(twice.select(PID, "segment_id", F.lit("repeated id").alias("problem")))


def apply_patches(segments: DataFrame, edits: DataFrame, at: str, tool: str = "llm") -> DataFrame:
    """Texts replaced where they differ, with what was before in `before`; a project with any problem is left as it is."""
    bad = check_patches(edits, segments).select(PID).distinct()
    good = edits.join(bad, PID, "left_anti").select(PID, "segment_id", F.col("text").alias("patch"))
    out = segments.join(good, [PID, "segment_id"], "left")
    changed = F.coalesce(F.col("patch") != F.col("text"), F.lit(False))
    edit = F.struct(F.lit(at).cast("timestamp").alias("at"), F.lit(tool).alias("tool"), F.col("text").alias("before"))
    none = F.expr("cast(array() as array<struct<at:timestamp,tool:string,before:string>>)")
    old = F.coalesce("edits", none) if "edits" in segments.columns else none
    out = out.withColumn("edits", F.when(changed, F.array_append(old, edit)).otherwise(old)).withColumn("changed", changed)
    return out.withColumn("text", F.when(changed, F.col("patch")).otherwise(F.col("text"))).drop("patch")


def shape_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Places where (segment_id, start_ms, end_ms) differ between two versions of a transcript."""
    side = lambda df, p: df.select(PID, "ord", F.struct("segment_id", "start_ms", "end_ms").alias(p))
    both = side(before, "b").join(side(after, "a"), [PID, "ord"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(PID, "ord", F.col("b.segment_id").alias("before_id"), F.col("a.segment_id").alias("after_id"))
