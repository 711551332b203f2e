"""Interval algebra over (project_id, start_ms, end_ms) tables; every range join carries the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PID = "project_id"


def merge_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """Union of the spans of a key as disjoint spans; touching spans merge."""
    keys = keys or (PID,)
    by = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    seen = F.max("end_ms").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_ms") <= seen, 0).otherwise(1)
    island = F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.select(*keys, "start_ms", "end_ms").withColumn("fresh", fresh).withColumn("island", island)
        .groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")
    )


def complement(spans: DataFrame, projects: DataFrame) -> DataFrame:
    """The gaps of each project's [0, duration_ms] that the spans leave; empty gaps are dropped."""
    end = projects.select(PID, F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    merged = merge_spans(spans)
    inside = merged.join(projects.select(PID, "duration_ms"), PID).filter("start_ms < duration_ms").select(PID, "start_ms", F.least("end_ms", "duration_ms").alias("end_ms"))
    rows = inside.unionByName(end)
    by = Window.partitionBy(PID).orderBy("start_ms", "end_ms")
    gap = rows.select(PID, F.lag("end_ms", 1, 0).over(by).alias("s"), F.col("start_ms").alias("e"))
    return gap.filter("s < e").select(PID, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def keeps(cuts: DataFrame, projects: DataFrame) -> DataFrame:
    """What is left of each project after its cuts."""
    return complement(cuts, projects)


#: Width of the time bins that spread a project's spans over tasks.
BIN_MS = 60_000


def range_join(a: DataFrame, b: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs of overlapping spans of a project; b's columns get the prefix b_.

    Both sides go to time bins, so a project is not one group and spans meet only near one another; a pair is kept in its first common bin. Sums over pairs
    need none of them: covered_ms and weight_touching.
    """
    def binned(df: DataFrame, start: str, end: str, out: str) -> DataFrame:
        first, last = F.floor(F.col(start) / bin_ms), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bin_ms)
        return df.withColumn(out, F.explode(F.sequence(first, last)))

    one = binned(a, "start_ms", "end_ms", "__bin")
    two = binned(b.select(F.col(PID).alias("__pid"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != PID]), "b_start_ms", "b_end_ms", "__b_bin")
    on = (F.col(PID) == F.col("__pid")) & (F.col("__bin") == F.col("__b_bin")) & (F.col("start_ms") < F.col("b_end_ms")) & (F.col("b_start_ms") < F.col("end_ms"))
    first = F.greatest(F.floor(F.col("start_ms") / bin_ms), F.floor(F.col("b_start_ms") / bin_ms))
    return one.join(two, on).filter(F.col("__bin") == first).drop("__bin", "__b_bin", "__pid")


def bin_join(a: DataFrame, b: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """range_join with bins of another width, for projects with very many spans a minute."""
    return range_join(a, b, bin_ms)


def inside(points: DataFrame, spans: DataFrame, at: str, out: str = "inside", bin_ms: int = BIN_MS) -> DataFrame:
    """Points with a boolean: whether a span of their project holds them, start included and end not.

    No pairs: the spans are merged and cut at the borders of time bins, points and spans of a bin are sorted once, and each point looks at the last span
    that has begun. A project of any length spreads over its bins. A point without a time is in no span.
    """
    whole = merge_spans(spans.filter("start_ms < end_ms"))
    first, last = F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") - 1) / bin_ms)
    cut = whole.withColumn("__bin", F.explode(F.sequence(first, last)))
    marks = cut.select(PID, "__bin", F.greatest(F.col("start_ms"), F.col("__bin") * bin_ms).alias("__t"), F.least(F.col("end_ms"), (F.col("__bin") + 1) * bin_ms).alias("__end"))
    names = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != PID else F.col(PID) for f in points.schema]
    rows = points.select("*", F.floor(F.col(at) / bin_ms).alias("__bin"), F.col(at).alias("__t"), F.lit(None).cast("bigint").alias("__end"), F.lit(True).alias("__point"))
    both = rows.unionByName(marks.select(*names, "__bin", "__t", "__end", F.lit(False).alias("__point")))
    by = Window.partitionBy(PID, "__bin").orderBy("__t", "__point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__end", F.last("__end", ignorenulls=True).over(by)).filter("__point")
    return found.select(*points.columns, F.coalesce(F.col("__t") < F.col("__end"), F.lit(False)).alias(out))


def _ends(a: DataFrame, keys: tuple[str, ...], events: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Both ends of each a (keys, __row, __t, __sign -1 or 1) with the running sums of the events' measures: one union, one sort. An event has __o: 0 if it
    counts for a point of the same time, 2 if only for later ones."""
    row = F.struct(*[F.col(c) for c in a.columns]).alias("__row")
    end = lambda c, sign: F.struct(F.col(c).alias("__t"), F.lit(sign).alias("__sign"))
    points = a.select(*keys, row, F.explode(F.array(end("start_ms", -1), end("end_ms", 1))).alias("__p")).select(*keys, "__row", "__p.*", F.lit(1).alias("__o"), *[F.lit(0).cast("bigint").alias(m) for m in measures])
    nulls = [F.lit(None).cast(a.schema[k].dataType).alias(k) if k != PID else F.col(PID) for k in keys]
    marks = events.select(*nulls, F.lit(None).cast(points.schema["__row"].dataType).alias("__row"), "__t", F.lit(0).alias("__sign"), "__o", *measures)
    by = Window.partitionBy(PID).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return points.unionByName(marks).select("*", *[F.sum(m).over(by).alias(f"__sum_{m}") for m in measures]).filter("__sign <> 0")


def subtract(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The pieces of each a that no b covers, with a's key columns (project_id and more that tell its rows apart)."""
    span = a.select(*keys, F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    inner = range_join(a.select(*keys, "start_ms", "end_ms"), b.select(PID, "start_ms", "end_ms"))
    clipped = inner.select(*keys, F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms"))
    holes = merge_spans(clipped, *keys).unionByName(span.select(*keys, F.col("hi").alias("start_ms"), F.col("hi").alias("end_ms")))
    by = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    gaps = holes.withColumn("before", F.lag("end_ms").over(by)).join(span, list(keys))
    out = gaps.select(*keys, F.coalesce("before", "lo").alias("s"), F.col("start_ms").alias("e")).filter("s < e")
    return out.select(*keys, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def removed_prefix(cuts: DataFrame) -> DataFrame:
    """Disjoint cuts with what is removed before each, and the place its start has afterwards."""
    by = Window.partitionBy(PID).orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(by), F.lit(0)).cast("bigint")
    return cuts.select(PID, "start_ms", "end_ms").withColumn("removed_before", before).withColumn("image_ms", F.col("start_ms") - F.col("removed_before"))


def asof(points: DataFrame, marks: DataFrame, at: str, mark_at: str, take: list[str], inclusive: bool = True) -> DataFrame:
    """The last mark of a project at or before each point (before it, if not inclusive), by one union and one window."""
    left = points.withColumn("__t", F.col(at)).withColumn("__side", F.lit(1 if inclusive else 0)).withColumn("__mark", F.lit(None).cast(marks.select(F.struct(*take)).schema[0].dataType))
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != PID else F.col(PID) for f in points.schema]
    right = marks.select(*cols, F.col(mark_at).alias("__t"), F.lit(0 if inclusive else 1).alias("__side"), F.struct(*take).alias("__mark"))
    both = left.withColumn("__point", F.lit(True)).unionByName(right.withColumn("__point", F.lit(False)))
    by = Window.partitionBy(PID).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__mark", F.last("__mark", ignorenulls=True).over(by)).filter("__point")
    return found.select(*points.columns, *[F.col(f"__mark.{c}").alias(f"mark_{c}") for c in take])


def asof_ends(a: DataFrame, marks: DataFrame, keys: tuple[str, ...], mark_at: str, take: list[str]) -> DataFrame:
    """a with the last marks at or before both ends of each of its rows, as structs at_start and at_end; the keys (project_id first) tell the rows apart.
    One union and one window serve both ends."""
    kind = marks.select(F.struct(*take)).schema[0].dataType
    row, end = F.struct(*a.columns).alias("__row"), lambda c, last: F.struct(F.col(c).alias("__t"), F.lit(last).alias("__last"))
    points = a.select(*keys, row, F.explode(F.array(end("start_ms", False), end("end_ms", True))).alias("__p")).select(*keys, "__row", "__p.*", F.lit(None).cast(kind).alias("__mark"))
    nulls = [F.lit(None).cast(a.schema[k].dataType).alias(k) if k != PID else F.col(PID) for k in keys]
    rows = marks.select(*nulls, F.lit(None).cast(points.schema["__row"].dataType).alias("__row"), F.col(mark_at).alias("__t"), F.lit(None).cast("boolean").alias("__last"), F.struct(*take).alias("__mark"))
    by = Window.partitionBy(PID).orderBy("__t", F.col("__last").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(rows).withColumn("__mark", F.last("__mark", ignorenulls=True).over(by)).filter("__last IS NOT NULL")
    both = found.groupBy(*keys).agg(F.first("__row").alias("__row"), F.max(F.when(~F.col("__last"), F.col("__mark"))).alias("at_start"), F.max(F.when(F.col("__last"), F.col("__mark"))).alias("at_end"))
    return both.select("__row.*", "at_start", "at_end")


def covered_ms(a: DataFrame, b: DataFrame, *keys: str, out: str = "covered_ms") -> DataFrame:
    """a with the summed overlap of all b with each of its rows, which the keys (project_id first) tell apart.

    What lies before a moment, of all b together, is a running sum over their starts and ends; a row's overlap is the difference between its ends.
    No pairs are made, however many spans overlap.
    """
    one = lambda t, n, m: F.struct(F.col(t).alias("__t"), F.lit(n).cast("bigint").alias("n"), m.alias("m"))
    events = b.filter("start_ms < end_ms").select(PID, F.explode(F.array(one("start_ms", 1, F.col("start_ms")), one("end_ms", -1, -F.col("end_ms")))).alias("e")).select(PID, "e.*", F.lit(0).alias("__o"))
    before = F.col("__t") * F.col("__sum_n") - F.col("__sum_m")
    sums = _ends(a, keys, events, ("n", "m")).groupBy(*keys).agg(F.greatest(F.sum(F.col("__sign") * before), F.lit(0)).cast("bigint").alias("__sum"), F.first("__row").alias("__row"))
    return sums.select("__row.*", F.col("__sum").alias(out))


def weight_touching(a: DataFrame, b: DataFrame, weight: str, *keys: str, out: str) -> DataFrame:
    """a with the summed weight of all b that overlap each of its rows: those that begin before its end, less those that are over at its start."""
    one = lambda t, o, x, y: F.struct(F.col(t).alias("__t"), F.lit(o).alias("__o"), x.cast("bigint").alias("begun"), y.cast("bigint").alias("over"))
    none, w = F.lit(0), F.col(weight)
    events = b.select(PID, F.explode(F.array(one("start_ms", 2, w, none), one("end_ms", 0, none, w))).alias("e")).select(PID, "e.*")
    part = F.when(F.col("__sign") > 0, F.col("__sum_begun")).otherwise(-F.col("__sum_over"))
    return _ends(a, keys, events, ("begun", "over")).groupBy(*keys).agg(F.sum(part).cast("bigint").alias("__sum"), F.first("__row").alias("__row")).select("__row.*", F.col("__sum").alias(out))


def intersect_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """What the spans of both sides cover, as disjoint spans (touching ones merged): one sweep over all ends."""
    one = lambda t, x, y: F.struct(F.col(t).alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    ends = lambda df, x, y: df.filter("start_ms < end_ms").select(PID, F.explode(F.array(one("start_ms", x, y), one("end_ms", -x, -y))).alias("e")).select(PID, "e.*")
    moments = ends(a, 1, 0).unionByName(ends(b, 0, 1)).repartition(PID).groupBy(PID, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    by = Window.partitionBy(PID).orderBy("t")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    on = moments.select(PID, "t", ((F.sum("x").over(so_far) > 0) & (F.sum("y").over(so_far) > 0)).alias("on"))
    turns = on.withColumn("was", F.lag("on", 1, False).over(by)).filter("on <> was").withColumn("end_ms", F.lead("t").over(by))
    return turns.filter("on").select(PID, F.col("t").alias("start_ms"), "end_ms")


def is_frame_rate(fps: Column) -> Column:
    return fps.rlike(r"^\d+/\d+$")
