"""Many words in many texts: leftmost, longest, without overlap; the words are a table, for all projects or for each its own."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PID = "project_id"
#: Words and characters of a list that is broadcast; a longer one meets the texts by a join.
MAX_WORDS, MAX_CHARS = 200_000, 8_000_000
#: Tasks over which the texts of a project with its own words spread.
SALTS = 8
_PIECES = "array<struct<was:string,value:string,flag:boolean>>"


class Matcher:
    """Words with a value and a flag each; the first of equal words counts. At a place only words with its first character are tried, longest first."""

    def __init__(self, words: Iterable[tuple[str, str | None, bool | None]]):
        self.words: dict[str, tuple[str | None, bool | None]] = {}
        lengths: dict[str, set[int]] = {}
        for word, value, flag in words:
            if word and word not in self.words:
                self.words[word] = (value, flag)
                lengths.setdefault(word[0], set()).add(len(word))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        self.opens = re.compile("[" + "".join(map(re.escape, self.lengths)) + "]") if self.lengths else None

    def pieces(self, text: str) -> list[tuple[str, str | None, bool | None]]:
        """The text in pieces: matches with value and flag, and what stands between them with null for both."""
        out, done, at = [], 0, 0
        while self.opens and (m := self.opens.search(text, at)):
            i = m.start()
            for n in self.lengths[text[i]]:
                found = self.words.get(text[i : i + n])
                if found is not None and i + n <= len(text):
                    if done < i:
                        out.append((text[done:i], None, None))
                    out.append((text[i : i + n], *found))
                    done = at = i + n
                    break
            else:
                at = i + 1
        if done < len(text):
            out.append((text[done:], None, None))
        return out


def _column(found: list):
    """Pieces of many texts as an Arrow column."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("was", pa.string()), ("value", pa.string()), ("flag", pa.bool_())]))
    return pa.array([None if pieces is None else [{"was": w, "value": v, "flag": f} for w, v, f in pieces] for pieces in found], kind)


def _schema(rows: DataFrame, out: str) -> T.StructType:
    return T.StructType([*rows.schema, T.StructField(out, T._parse_datatype_string(_PIECES))])


def _by_join(rows: DataFrame, words: DataFrame, text: str, out: str) -> DataFrame:
    """For lists too long to broadcast: every place of a text meets the words by a join on its substrings of the lengths that words have."""
    lengths = [r[0] for r in words.select(F.length("word").alias("n")).distinct().orderBy("n").collect()]  # as many as the longest word has characters
    keyed = rows.withColumn("__row", F.struct(*rows.columns)).select("__row", F.xxhash64("__row").alias("__h"), F.col(text).alias("__t"))
    place = F.explode(F.sequence(F.lit(1), F.length("__t"))).alias("i")
    subs = keyed.filter("__t <> ''").select("__h", "__t", place).select("__h", "__t", "i", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter("i + n <= length(__t) + 1")
    first = words.groupBy("word").agg(F.min(F.struct("rank", "value", "flag")).alias("w")).select("word", "w.value", "w.flag")
    hits = subs.withColumn("word", F.expr("substring(__t, i, n)")).join(first, "word").groupBy("__h", "__t", "i").agg(F.max(F.struct("n", "value", "flag")).alias("x"))
    best = F.array_sort(F.collect_list(F.struct("i", "x.n", "x.value", "x.flag")))
    lists = hits.groupBy("__h", "__t").agg(best.alias("hits"))
    none = F.expr(f"cast(array() as {_PIECES})")
    gap = lambda a, b: F.struct(F.substring(F.col("__t"), a, b - a).alias("was"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("boolean").alias("flag"))

    def step(acc, h):
        hit = F.struct(F.substring(F.col("__t"), h["i"], h["n"]).alias("was"), h["value"].alias("value"), h["flag"].alias("flag"))
        free, end = h["i"] >= acc["at"], h["i"] + h["n"]
        grown = F.concat(acc["out"], F.when(h["i"] > acc["at"], F.array(gap(acc["at"], h["i"]), hit)).otherwise(F.array(hit)))
        return F.struct(F.when(free, end).otherwise(acc["at"]).alias("at"), F.when(free, grown).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.when(acc["at"] <= F.length("__t"), F.array_append(acc["out"], gap(acc["at"], F.length("__t") + 1))).otherwise(acc["out"])
    joined = keyed.join(lists, ["__h", "__t"], "left")
    folded = F.aggregate(F.coalesce("hits", F.expr("cast(array() as array<struct<i:int,n:int,value:string,flag:boolean>>)")), F.struct(F.lit(1).alias("at"), none.alias("out")), step, rest)
    return joined.select("__row.*", F.when(F.col("__t").isNotNull(), folded).alias(out))


def match_words(rows: DataFrame, words: DataFrame, text: str = "text", out: str = "pieces") -> DataFrame:
    """rows with their text in pieces (was, value, flag): matches leftmost, longest, and what stands between them (value and flag null).

    words: word, and optionally value (default: the word), flag (true), rank (of equal words the lowest counts) and project_id. Words of all projects
    are broadcast, if they are few enough, and joined otherwise; with project_id each project's words travel to its texts, which spread over SALTS
    tasks a project. Null texts give null, empty words match nothing.
    """
    spark = rows.sparkSession
    known = words.columns
    value = F.col("value") if "value" in known else F.col("word")
    flag = F.col("flag") if "flag" in known else F.lit(True)
    rank = F.col("rank") if "rank" in known else F.lit(0)
    own = [PID] if PID in known else []
    table = words.filter("word <> ''").select(*own, "word", value.alias("value"), flag.alias("flag"), rank.alias("rank"))
    at = rows.columns.index(text)
    if not own:
        n, chars = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word") + F.length("value")), F.lit(0))).first()
        if n > MAX_WORDS or chars > MAX_CHARS:
            return _by_join(rows, table, text, out)
        listed = spark.sparkContext.broadcast([(r["word"], r["value"], r["flag"]) for r in table.orderBy("rank").collect()])

        def run(batches):
            import pyarrow as pa

            matcher = Matcher(listed.value)
            for batch in batches:
                found = [None if t is None else matcher.pieces(t) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, _column(found)], [*batch.schema.names, out])

        return rows.mapInArrow(run, _schema(rows, out))
    row = F.struct(*rows.columns)
    texts = rows.select(F.col(PID), F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int").alias("salt"), row.alias("r"))
    empty = texts.schema["r"].dataType
    lists = table.select(PID, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.struct("rank", "word", "value", "flag").alias("w"))
    both = texts.withColumn("w", F.lit(None).cast(lists.schema["w"].dataType)).unionByName(lists.withColumn("r", F.lit(None).cast(empty)))
    order = [PID, "salt", F.col("w").isNull(), "w"]

    def stream(batches):
        import pyarrow as pa

        # projects with the same short list share a matcher, and a batch gives one batch however many projects it holds
        shared = lru_cache(maxsize=64)(Matcher)
        now, held, matcher = None, [], None
        for batch in batches:
            project, salt, r, w = (batch.column(batch.schema.get_field_index(c)) for c in (PID, "salt", "r", "w"))
            entries = w.to_pylist()
            part = r.take(pa.array([i for i, entry in enumerate(entries) if entry is None], pa.int64()))
            columns, found = part.flatten(), []
            texts = iter(columns[at].to_pylist())
            for key, entry in zip(zip(project.to_pylist(), salt.to_pylist(), strict=True), entries, strict=True):
                if key != now:
                    now, held, matcher = key, [], None
                if entry is not None:
                    held.append((entry["word"], entry["value"], entry["flag"]))
                    continue
                if matcher is None:
                    matcher, held = (shared(tuple(held)) if len(held) <= 1000 else Matcher(held)), []
                t = next(texts)
                found.append(None if t is None else matcher.pieces(t))
            if found:
                yield pa.RecordBatch.from_arrays([*columns, _column(found)], [*(f.name for f in part.type), out])

    return both.select(PID, "salt", "r", "w").repartition(PID, "salt").sortWithinPartitions(*order).mapInArrow(stream, _schema(rows, out))


def has_match(rows: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds one of the words at least."""
    return match_words(rows, words, text, "__pieces").filter(F.exists("__pieces", lambda p: p["value"].isNotNull())).drop("__pieces")
