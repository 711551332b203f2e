"""Fillers: dictionaries, the scan of a segment's text, and the cuts that take them out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.functions.matching import match_words
from fleetcut.functions.text import filler_normalise
from fleetcut.operators.candidates import longest_piece
from fleetcut.operators.intervals import PID, subtract
from fleetcut.operators.speech import quiet, regions_in

# The packaged filler words, strong and weak.
STRONG = ("えー", "えーと", "えっと", "あのー", "そのー", "うーん")
WEAK = ("まあ", "なんか", "こう")
MIN_FILLER_MS, ADJACENT_MS, PAD_PRE_MS, PAD_POST_MS = 100, 200, 300, 300


def packaged_words(spark) -> DataFrame:
    return spark.createDataFrame([(w, "strong") for w in STRONG] + [(w, "weak") for w in WEAK], "word string, tier string")


def filler_words(projects: DataFrame, packaged: DataFrame, own: DataFrame, enable_weak: bool = False) -> DataFrame:
    """Words of each project: the packaged ones and its own; strong wins over weak; longest first, then by the alphabet."""
    shipped = F.array(*[F.struct(F.lit(r["word"]).alias("word"), F.lit(r["tier"]).alias("tier")) for r in packaged.collect()])  # a short, fixed list
    every = projects.select(PID, F.inline(shipped)).unionByName(own.select(PID, "word", "tier"))
    every = every.filter("word <> ''") if enable_weak else every.filter("word <> '' and tier = 'strong'")
    first = every.groupBy(PID, "word").agg(F.min("tier").alias("tier"))
    place = F.row_number().over(Window.partitionBy(PID).orderBy(F.length("word").desc(), "word"))
    return first.select(PID, "word", "tier", place.cast("bigint").alias("place"))


def _hits(df: DataFrame, alternation: Column) -> DataFrame:
    """Hits (word, start, end) in t from left to right, longest at each place, from the pieces of t."""
    pieces = F.regexp_extract_all("t", F.concat(F.lit("(?s)"), alternation, F.lit("|.")), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<word:string,start:int,end:int>>)").alias("h"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        hit = F.array_append(acc["h"], F.struct(p.alias("word"), acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.array_contains("known", p), hit).otherwise(acc["h"]).alias("h"))

    return df.withColumn("hits", F.aggregate(pieces, start, step, lambda acc: acc["h"]))


def _placed(df: DataFrame) -> DataFrame:
    """Where the hits are: the whole text, its opening, its end, or inside."""
    total = F.aggregate("hits", F.lit(0), lambda a, h: a + h["end"] - h["start"])
    whole = (F.length("t") > 0) & (total == F.length("t"))
    first, last = F.try_element_at("hits", F.lit(1)), F.try_element_at("hits", F.lit(-1))
    df = df.withColumn("is_whole", whole).withColumn("leading", F.when(~whole & (first["start"] == 0), first)).withColumn("trailing", F.when(~whole & (last["end"] == F.length("t")), last))
    inside = F.filter("hits", lambda h: (h["start"] > 0) & (h["end"] < F.length("t")))
    return df.withColumn("inside", inside)


def scan_fixed(segments: DataFrame, words: list[str], ascii_only: bool = False) -> DataFrame:
    """Scan with one word list for all projects."""
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    df = segments.withColumn("t", filler_normalise(F.col("text"), ascii_only)).withColumn("known", F.array(*map(F.lit, ordered)))
    out = _placed(_hits(df, F.lit("|".join(re.escape(w) for w in ordered))))
    return out.drop("known")


def scan(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Scan each segment with its project's words: t, hits, is_whole, leading, trailing, inside and the tier of the hits
    (strong if any hit is strong)."""
    listed = words.select(PID, "word", F.col("tier").alias("value"), F.when(F.col("tier") == "strong", 0).otherwise(1).alias("rank"))
    df = match_words(segments.withColumn("t", filler_normalise(F.col("text"))), listed, "t", "__pieces")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<word:string,start:int,end:int>>)").alias("h"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["was"])
        hit = F.array_append(acc["h"], F.struct(p["was"].alias("word"), acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["flag"], hit).otherwise(acc["h"]).alias("h"))

    any_strong = F.exists("__pieces", lambda p: p["value"] == "strong")
    df = _placed(df.withColumn("hits", F.aggregate("__pieces", start, step, lambda acc: acc["h"])))
    return df.withColumn("tier", F.when(any_strong, "strong").when(F.size("hits") > 0, "weak")).drop("__pieces")


def filler_confidence(placement: Column, tier: Column) -> Column:
    """0.8 for a whole segment of strong fillers, 0.2 less for an edge and 0.2 less for weak ones."""
    tenths = F.lit(8) - F.when(placement == "whole", 0).otherwise(2) - F.when(tier == "strong", 0).otherwise(2)
    return tenths / F.lit(10.0)


def filler_spans(segments: DataFrame, regions: DataFrame, projects: DataFrame, words: DataFrame, pad_pre: int = PAD_PRE_MS, pad_post: int = PAD_POST_MS, adjacent: int = ADJACENT_MS) -> DataFrame:
    """Candidates before trimming: whole segments, and fillers at an edge that the detector split off and silence adjoins.

    A whole cut extends left by the padding after speech and right by that before it, as silence cuts leave them.
    """
    s = scan(segments, words).filter(F.size("hits") > 0)
    s = _with_quiet(s, segments, regions, projects)
    s = s.join(regions_in(segments, regions), [PID, "segment_id"], "left").withColumn("n_regions", F.coalesce("n_regions", F.lit(0)))
    zero = F.lit(0).cast("bigint")
    left = F.col("start_ms") - F.least(F.lit(pad_post).cast("bigint"), F.col("quiet_before_ms"))
    right = F.col("end_ms") + F.least(F.lit(pad_pre).cast("bigint"), F.col("quiet_after_ms"))
    many = F.col("n_regions") >= 2
    lead_ok = ~F.col("is_whole") & F.col("leading").isNotNull() & (F.col("quiet_before_ms") >= adjacent) & many & (F.col("first_end_ms") < F.col("end_ms"))
    pause = F.greatest(zero, F.col("second_start_ms") - F.col("first_end_ms"))
    trail_ok = ~F.col("is_whole") & F.col("trailing").isNotNull() & (F.col("quiet_after_ms") >= adjacent) & many & (F.col("last_start_ms") > F.col("start_ms"))
    back = F.greatest(zero, F.col("last_start_ms") - F.col("before_last_end_ms"))

    def one(ok: Column, place: str, lo: Column, hi: Column, word: Column, rank: int) -> Column:
        return F.when(ok, F.struct(F.lit(rank).alias("rank"), F.lit(place).alias("placement"), lo.alias("lo"), hi.alias("hi"), word.alias("word")))

    found = F.array_compact(F.array(
        one(F.col("is_whole"), "whole", left, right, F.col("hits")[0]["word"], 0),
        one(lead_ok, "leading", left, F.col("first_end_ms") + F.least(F.lit(pad_pre).cast("bigint"), pause), F.col("leading.word"), 1),
        one(trail_ok, "trailing", F.col("last_start_ms") - F.least(F.lit(pad_post).cast("bigint"), back), right, F.col("trailing.word"), 2),
    ))
    out = s.select(PID, "segment_id", F.col("ord").alias("seg_ord"), "tier", F.explode(found).alias("c")).filter("c.hi > c.lo")
    # The notes that reviewers see.
    said = F.when(F.col("c.placement") == "whole", "segment is only the filler 「").when(F.col("c.placement") == "leading", "segment opens with the filler 「").otherwise("segment ends with the filler 「")
    note = F.concat(said, F.col("c.word"), F.lit("」, cut to the VAD boundary"))
    return out.select(PID, "segment_id", "seg_ord", F.col("c.rank").alias("rank"), F.col("c.placement").alias("placement"), F.col("c.lo").alias("start_ms"), F.col("c.hi").alias("end_ms"), filler_confidence(F.col("c.placement"), F.col("tier")).alias("confidence"), note.alias("note"))


def _with_quiet(scanned: DataFrame, segments: DataFrame, regions: DataFrame, projects: DataFrame) -> DataFrame:
    """Silences are measured among all segments, then joined to those with fillers."""
    q = quiet(segments.select(PID, "segment_id", "ord", "start_ms", "end_ms"), regions, projects).select(PID, "segment_id", "quiet_before_ms", "quiet_after_ms")
    return scanned.join(q, [PID, "segment_id"])


def trim_candidates(spans: DataFrame, silence: DataFrame) -> DataFrame:
    """Candidates without the silence cuts of the same run: their longest piece, if it lasts 0.1 s."""
    keys = (PID, "segment_id", "rank")
    piece = longest_piece(subtract(spans, silence, *keys), *keys).filter(F.col("end_ms") - F.col("start_ms") >= MIN_FILLER_MS)
    return spans.drop("start_ms", "end_ms").join(piece, list(keys))


def filler_candidates(segments: DataFrame, regions: DataFrame, projects: DataFrame, words: DataFrame, silence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates in order, count of fillers left inside sentences per project)."""
    trimmed = trim_candidates(filler_spans(segments, regions, projects, words), silence)
    n = F.row_number().over(Window.partitionBy(PID).orderBy("seg_ord", "rank")) - 1
    out = trimmed.select(PID, n.cast("bigint").alias("ord"), "start_ms", "end_ms", F.lit("filler").alias("reason"), "confidence", F.lit("proposed").alias("status"), "note")
    inside = scan(segments, words).groupBy(PID).agg(F.sum(F.size("inside")).cast("bigint").alias("in_sentence"))
    return out, inside
