"""Cut candidates: numbering, matching with reviewed cuts, upsert, overlap resolution and speech checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcut.functions.time import iou
from fleetcut.operators.intervals import PID, covered_ms, range_join, weight_touching

MERGE_IOU, MAX_CUTS, MAX_SPEECH_MS = 0.5, 9999, 200


def silence_candidates(spans: DataFrame) -> DataFrame:
    ordered = F.row_number().over(Window.partitionBy(PID).orderBy("start_ms", "end_ms")) - 1
    return spans.select(PID, ordered.cast("bigint").alias("ord"), "start_ms", "end_ms", F.lit("silence").alias("reason"), F.lit(0.95).alias("confidence"), F.lit("approved").alias("status"), F.lit(None).cast("string").alias("note"))


def four_digits(prefix: str, n: Column) -> Column:
    """The prefix and at least four digits; larger numbers keep all of theirs."""
    return F.format_string(f"{prefix}%04d", n.cast("bigint"))


def number_rows(df: DataFrame, prefix: str, order: list[str], start: int = 1) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(PID).orderBy(*order)) + (start - 1)
    return df.withColumn("row_id", four_digits(prefix, n))


def longest_piece(pieces: DataFrame, *keys: str) -> DataFrame:
    """The longest piece of each key, the first on ties."""
    best = F.max_by(F.struct("start_ms", "end_ms"), F.struct(F.col("end_ms") - F.col("start_ms"), -F.col("start_ms")))
    return pieces.groupBy(*keys).agg(best.alias("p")).select(*keys, "p.start_ms", "p.end_ms")


def all_candidates(silence: DataFrame, filler: DataFrame) -> DataFrame:
    """Silence candidates, then filler candidates, renumbered in that order."""
    cols = [PID, "ord", "start_ms", "end_ms", "reason", "confidence", "status", "note"]
    both = silence.select(*cols).withColumn("src", F.lit(0)).unionByName(filler.select(*cols).withColumn("src", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(PID).orderBy("src", "ord")) - 1
    return both.withColumn("ord", n.cast("bigint")).drop("src")


def _first_free(batches):
    """Pairs sorted by (project, reason, -iou, candidate, cut) to those whose candidate and cut no earlier pair has taken."""
    import pyarrow as pa

    now, used, taken = None, set(), set()
    for batch in batches:
        keep = []
        for i, (p, reason, ord_, cut) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if (p, reason) != now:
                now, used, taken = (p, reason), set(), set()
            if ord_ not in used and cut not in taken:
                used.add(ord_)
                taken.add(cut)
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 2, 3)], [PID, "ord", "cut_id"])


def pair_up(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """(project_id, ord, cut_id): candidates matched one to one with cuts of the same reason, best intersection over hull first, then by order and id.

    The pairs are sorted once and stream past two sets of what is taken, which hold a project's candidates and cuts at most.
    """
    pairs = range_join(candidates.select(PID, "ord", "reason", "start_ms", "end_ms"), existing.select(PID, "cut_id", "reason", "start_ms", "end_ms")).filter("reason = b_reason")
    scored = pairs.withColumn("iou", iou(*map(F.col, ("start_ms", "end_ms", "b_start_ms", "b_end_ms")))).filter(F.col("iou") >= MERGE_IOU)
    ordered = scored.repartition(PID, "reason").sortWithinPartitions(PID, "reason", F.desc("iou"), "ord", "b_cut_id").select(PID, "reason", "ord", "b_cut_id")
    kinds = dict(ordered.dtypes)
    return ordered.mapInArrow(_first_free, f"{PID} {kinds[PID]}, ord {kinds['ord']}, cut_id string")


def merge_cuts(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Upsert: a matched cut takes the candidate's interval and confidence and keeps its id, status and note; an unmatched
    one stays if it was judged or made by hand; new candidates get ids above every id in use. `origin` says which.

    Ids above 9,999 keep their digits; gate G21 refuses to publish a project that has one.
    """
    named = candidates.join(pair_up(existing, candidates), [PID, "ord"], "left")
    fresh = F.col("cut_id").isNull()
    top = existing.groupBy(PID).agg(F.max(F.substring("cut_id", 2, 9).cast("bigint")).alias("top"))
    rank = F.sum(fresh.cast("bigint")).over(Window.partitionBy(PID).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    named = named.withColumn("rank", rank).join(top, PID, "left")
    carried = ("start_ms", "end_ms", "reason", "confidence", "status", "note")
    e = existing.select(PID, "cut_id", F.struct(*carried).alias("e"))
    both = named.select(PID, "cut_id", (F.coalesce("top", F.lit(0)) + F.col("rank")).alias("number"), F.struct(*carried).alias("c")).join(e, [PID, "cut_id"], "full")
    origin = F.when(F.col("c").isNull(), "kept").when(F.col("e").isNull(), "added").otherwise("matched")
    both = both.withColumn("origin", origin).filter("origin <> 'kept' or e.status in ('approved', 'rejected') or e.reason = 'manual'")
    of = lambda name, first, then: F.when(F.col(first).isNull(), F.col(f"{then}.{name}")).otherwise(F.col(f"{first}.{name}")).alias(name)
    return both.select(
        PID, F.coalesce("cut_id", four_digits("c", F.col("number"))).alias("cut_id"), *[of(x, "c", "e") for x in carried[:4]], *[of(x, "e", "c") for x in carried[4:]], "origin",
    )


def merge_counts(existing: DataFrame, candidates: DataFrame, merged: DataFrame) -> DataFrame:
    kinds = merged.groupBy(PID).agg(*[F.count_if(F.col("origin") == k).alias(k) for k in ("matched", "kept", "added")])
    before = existing.groupBy(PID).agg(F.count(F.lit(1)).alias("existing"))
    out = kinds.join(before, PID, "full")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select(PID, z("matched").alias("matched"), z("kept").alias("kept"), z("added").alias("added"), (z("existing") - z("matched") - z("kept")).alias("dropped"))


def _clashes(batches):
    """Approved cuts sorted by (project, new, start, end, id) to those that overlap one accepted before. Accepted cuts are disjoint, so only neighbours are
    compared: for old cuts the last one, for new ones also the old cuts on both sides."""
    from bisect import bisect_right

    import pyarrow as pa

    now, starts, ends, last = None, [], [], 0
    for batch in batches:
        keep = []
        for i, (p, fresh, s, e) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
            if (p, fresh) != now:
                if now is None or p != now[0]:
                    starts, ends = [], []
                now, last = (p, fresh), None
            if s >= e:
                continue
            clash = last is not None and s < last
            if fresh and not clash:
                k = bisect_right(starts, s)
                clash = (k > 0 and ends[k - 1] > s) or (k < len(starts) and starts[k] < e)
            if clash:
                keep.append(i)
                continue
            last = e
            if not fresh:
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 4)], [PID, "cut_id"])


def resolve_overlaps(cuts: DataFrame) -> DataFrame:
    """Approved cuts in the order (new, start, end): one that overlaps an accepted one goes back to proposed (`demoted`)."""
    fresh = (F.col("origin") == "added") if "origin" in cuts.columns else F.lit(False)
    approved = cuts.filter("status = 'approved'").select(PID, fresh.alias("fresh"), "start_ms", "end_ms", "cut_id")
    ordered = approved.repartition(PID).sortWithinPartitions(PID, "fresh", "start_ms", "end_ms", "cut_id")
    down = ordered.mapInArrow(_clashes, f"{PID} {dict(cuts.dtypes)[PID]}, cut_id string").withColumn("down", F.lit(True))
    out = cuts.join(down, [PID, "cut_id"], "left").withColumn("demoted", F.coalesce("down", F.lit(False))).drop("down")
    return out.withColumn("status", F.when(F.col("demoted"), "proposed").otherwise(F.col("status")))


def speech_overlaps(cuts: DataFrame, spoken: DataFrame) -> DataFrame:
    """Speech that each silence cut would remove."""
    return covered_ms(cuts.filter("reason = 'silence'"), spoken, PID, "cut_id", out="speech_ms").select(PID, "cut_id", "speech_ms")


def segments_over_silence(segments: DataFrame, cuts: DataFrame, spoken: DataFrame) -> DataFrame:
    """Segments that claim over 0.2 s more of the silence cuts than the speech that touches them."""
    quiet = cuts.filter("reason = 'silence'").select(PID, "start_ms", "end_ms")
    claimed = covered_ms(segments.select(PID, "segment_id", "start_ms", "end_ms"), quiet, PID, "segment_id", out="claimed").filter("claimed > 0")
    real = covered_ms(spoken.select(PID, "start_ms", "end_ms"), quiet, PID, "start_ms", "end_ms", out="real_ms")
    both = weight_touching(claimed, real, "real_ms", PID, "segment_id", out="real_ms")
    return both.select(PID, "segment_id", (F.col("claimed") - F.col("real_ms")).alias("over_ms")).filter(F.col("over_ms") > MAX_SPEECH_MS)


def detect_summary(existing: DataFrame, candidates: DataFrame, merged: DataFrame, resolved: DataFrame, spoken: DataFrame) -> DataFrame:
    """Per project: what was found, in all and by reason, what became of it, the range of ids in use and the next one, and the most speech that a
    silence cut takes."""
    counts = merge_counts(existing, candidates, merged)
    found = candidates.groupBy(PID).agg(F.count(F.lit(1)).alias("detected"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("detected_ms"))
    number = F.substring("cut_id", 2, 9).cast("bigint")
    ids = merged.groupBy(PID).agg(
        F.min_by("cut_id", number).alias("first_id"), F.max_by("cut_id", number).alias("last_id"), (F.max(number) + 1).alias("next_id"), F.count(F.lit(1)).alias("cuts_total"),
    )
    by = candidates.groupBy(PID).agg(*[x for r in ("silence", "filler") for x in (
        F.count_if(F.col("reason") == r).alias(f"{r}_detected"), F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("end_ms") - F.col("start_ms"))), F.lit(0)).cast("bigint").alias(f"{r}_ms"))])
    down = resolved.groupBy(PID).agg(F.count_if("demoted").alias("demoted"))
    worst = speech_overlaps(resolved, spoken).groupBy(PID).agg(F.max("speech_ms").alias("max_speech_ms"))
    out = counts
    for x in (found, by, ids, down, worst):
        out = out.join(x, PID, "left")
    return out
