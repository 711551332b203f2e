"""Strict JSON documents: values and keys are checked in the pass that reads them, and bad documents are named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.operators.intervals import PID


class SourceError(ValueError):
    """A document lacks what its schema requires."""


@dataclass(frozen=True)
class Shape:
    """What a kind of document may hold: `schema` is read, `also` may be there, `required` must be; below the paths in `free` any key may stand."""

    schema: str
    required: tuple[str, ...] = ()
    also: str = "version string"
    free: tuple[str, ...] = ()
    strict: bool = True
    exactly: tuple[tuple[str, str], ...] = ()

    @property
    def known(self) -> T.StructType:
        read = T.StructType.fromDDL(self.schema)
        return T.StructType([*read, *[f for f in T.StructType.fromDDL(self.also) if f.name not in read.fieldNames()]])


def project_of(path: Column) -> Column:
    """A project is the directory that holds the file (or its `dictionaries` folder); the name of a partition's directory is its value."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "dictionaries")
    return F.regexp_replace(F.element_at(parts, -2), "^project_id=", "")


def raw_documents(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(path, value, written_at): whole files that a pattern of paths names, or a pack as it is (sinks.pack_documents)."""
    if isinstance(source, DataFrame):
        return source.select("path", "value", "written_at")
    return spark.read.text(source, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_modification_time").alias("written_at"))


_NONE = "cast(array() as array<string>)"


def strange_keys(value: Column, kind: T.DataType, path: str = "", free: tuple[str, ...] = ()) -> Column:
    """Paths of keys of a VARIANT for which its type has no place; a map takes any key, and so does what is below a path in `free`."""
    if path.rstrip(".") in free and path:
        return F.expr(_NONE)
    if isinstance(kind, T.StructType):
        members = F.try_variant_get(value, "$", "map<string,variant>")
        here = F.array_except(F.map_keys(members), F.array(*[F.lit(n) for n in kind.fieldNames()]))
        found = [F.coalesce(F.transform(here, lambda k: F.concat(F.lit(path), k)), F.expr(_NONE))]
        for f in kind:
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                found.append(strange_keys(F.try_element_at(members, F.lit(f.name)), f.dataType, f"{path}{f.name}.", free))
        return F.concat(*found)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if not isinstance(inner, (T.StructType, T.ArrayType, T.MapType)):
            return F.expr(_NONE)
        items = F.try_variant_get(value, "$", "array<variant>") if isinstance(kind, T.ArrayType) else F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        return F.coalesce(F.array_distinct(F.flatten(F.transform(items, lambda x: strange_keys(x, inner, path, free)))), F.expr(_NONE))
    return F.expr(_NONE)


def checked_documents(spark: SparkSession, glob: str | DataFrame, shape: Shape) -> DataFrame:
    """One row per document: its project, path, the fields that are read, and `problem`, null if it is as its shape says. One scan; what a document holds
    never becomes part of the plan, so a fleet may have as many names of presets or stages as it likes. A file of no bytes is not there for Spark's file
    index and counts as missing."""
    fields = T.StructType.fromDDL(shape.schema).add("_corrupt_record", T.StringType())
    raw = raw_documents(spark, glob).select("path", "value")
    doc = raw.select(project_of(F.col("path")).alias(PID), "path", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"), F.try_parse_json("value").alias("v"))
    wrong = F.col("d").isNull() | F.col("d._corrupt_record").isNotNull() | F.col("v").isNull() | (F.col("v").isNotNull() & F.try_variant_get("v", "$", "map<string,variant>").isNull())
    problem = F.when(wrong, "document of the wrong shape")
    for c in shape.required:
        problem = problem.when(F.col("d").getField(c).isNull(), f"document of the wrong shape: no {c}")
    for c, value in shape.exactly:
        problem = problem.when(~F.col("d").getField(c).eqNullSafe(F.lit(value)), f"document is not of {c} {value}")
    if shape.strict:
        keys = strange_keys(F.col("v"), shape.known, "", shape.free)
        problem = problem.when(F.size(keys) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.slice(keys, 1, 20), ", ")))
    return doc.select(PID, "path", problem.alias("problem"), *[F.col("d").getField(f.name).alias(f.name) for f in fields if f.name != "_corrupt_record"])


def bad_documents(spark: SparkSession, glob: str | DataFrame, shape: Shape) -> DataFrame:
    """(project_id, path, problem) of the documents that a reader of this shape refuses: the fleet's quarantine."""
    return checked_documents(spark, glob, shape).filter("problem IS NOT NULL").select(PID, "path", "problem")


def read_json(spark: SparkSession, glob: str | DataFrame, shape: Shape, good_only: bool = False) -> DataFrame:
    """One row per document with its project. A document that is not as its shape says is an error when any of its fields is read, or is left out if only
    good ones are asked for (bad_documents names it)."""
    df = checked_documents(spark, glob, shape)
    if good_only:
        return df.filter("problem IS NULL").drop("path", "problem")
    fail = F.raise_error(F.concat("problem", F.lit(" in project "), F.col(PID), F.lit(" ("), F.col("path"), F.lit(")")))
    # the check is part of every column, so that no filter on one can pass a bad row by
    out = [F.when(F.col("problem").isNotNull(), fail.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in df.schema if f.name not in (PID, "path", "problem")]
    return df.select(PID, *out)
