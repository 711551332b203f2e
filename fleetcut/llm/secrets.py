"""Secret scans: wide candidate patterns, then a random forest trained on labelled findings removes false positives."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.llm import _common as C

#: Labelled findings of each class that train the forest, at most; words of the dictionary.
TRAIN_FINDINGS, DICTIONARY_WORDS = 4000, 5000
#: Of the values of labelled findings, one in so many is held out by evaluate().
HOLDOUT = 5

# Published formats of issued credentials.
ISSUED = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"sk_live_[A-Za-z0-9]{16,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?>(?:[^-]|-(?!----))*)-----END [A-Z ]*PRIVATE KEY-----|(?>(?:\s*[A-Za-z0-9+/=]{16,})*))",
)
KEYWORDS = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "credential", "auth", "bearer")

_ISSUED = re.compile("|".join(ISSUED))
_LONG = re.compile(r"[A-Za-z0-9_+/=.\-]{16,}")
_NAMED = re.compile(r"(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)[\"']?\s?[=:](?=(\s?[\"']?))")
_VALUE = re.compile(r"[^\s\"'<>]*")
_NEXT = re.compile(r"[&;,?{][A-Za-z][A-Za-z0-9_.\-]*[=:]")
_KEYWORD = re.compile(r"(?i)" + "|".join(KEYWORDS))
_NAME_BEFORE = re.compile(r"([A-Za-z0-9_.\-]+)[\"']?\s?[=:]\s?[\"']?$")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[A-Za-z]{2,}")

#: What the seed labels look at; the forest does not see these features if it learns from seeds.
SEEN_BY_SEEDS = ("assigned", "keyword", "quoted", "digits", "uppers", "others")
NUMERIC = (*SEEN_BY_SEEDS, "length", "transitions", "entropy", "coverage", "path_depth")
#: Hashed one-hot features: of the path's parts and of the two neighbouring words (credential words apart, which NUMERIC has).
PATH_SLOTS, WORD_SLOTS = 8, 16


def _assigned(text: str) -> list[tuple[int, int]]:
    """Values of six or more characters assigned to a credential word, each up to the next assignment of its run."""
    found: list[tuple[int, int, int]] = []
    end = 0
    for m in _NAMED.finditer(text):
        if _KEYWORD.search(m.group(1)):
            lo = m.end(2)
            if lo >= end:
                end = _VALUE.match(text, lo).end()
            found.append((lo, end, m.end()))
    out = []
    for k, (lo, hi, _) in enumerate(found):
        # a nested credential begins behind its own sign; this value ends before the name that is assigned there, if a
        # delimiter tells where that name begins, else with the sign
        hi = min(hi, found[k + 1][0]) if k + 1 < len(found) else hi
        if cut := _NEXT.search(text, lo, hi):
            hi = cut.start()
        if hi - lo >= 6:
            out.append((lo, hi))
    return out


def _without(span: tuple[int, int], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted spans apart from each other leave of a span."""
    lo, hi = span
    out = []
    for a, b in taken[max(0, bisect_left(taken, span) - 1) :]:
        if a >= hi:
            break
        if b > lo:
            out.append((lo, a))
            lo = b
    return [(a, b) for a, b in [*out, (lo, hi)] if a < b]


def candidates(text: str) -> list[tuple[int, int]]:
    """Code-point spans that may hold a secret, apart from each other, in order: issued formats, values assigned to a
    credential word, and runs of 16 or more token characters with a letter and a digit. Where they overlap, the longer
    run is split around issued formats, then around assigned values; what is left must be long enough by itself."""
    spans = [m.span() for m in _ISSUED.finditer(text)]
    if "=" in text or ":" in text:
        spans = sorted(spans + [p for s in _assigned(text) for p in _without(s, spans) if p[1] - p[0] >= 6])
    rest = []
    for m in _LONG.finditer(text):
        run = m.group()
        cut = run.find("=") + 1 if "=" in run[:-2] else 0
        pieces = _without((m.start() + (cut if len(run) - cut >= 6 else 0), m.end()), spans)
        whole = len(pieces) == 1 and pieces[0][1] - pieces[0][0] >= len(run) - cut
        for lo, hi in pieces:
            value = run if whole else text[lo:hi]
            if (whole or hi - lo >= 16) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                rest.append((lo, hi))
    return sorted(spans + rest)


def _classes(s: str) -> list[int]:
    return [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]


def covered(s: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that lie in dictionary words, longest match first from the left."""
    low, n, i = s.lower(), 0, 0
    while i < len(low):
        for size in range(min(12, len(low) - i), 2, -1):
            if low[i : i + size] in dictionary:
                n, i = n + size, i + size
                break
        else:
            i += 1
    return n / max(1, len(s))


def _slot(word: str, slots: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "replace"), digest_size=4).digest(), "big") % slots


def _around(text: str, lo: int, hi: int) -> tuple[str, str]:
    """What stands before and behind a span: so much that three whole words are in it, or all."""
    left = right = 80
    while left < lo and len(_WORD.findall(text, lo - left, lo)) < 4:
        left *= 2
    while hi + right < len(text) and len(_WORD.findall(text, hi, hi + right)) < 2:
        right *= 2
    return text[max(0, lo - left) : lo], text[hi : hi + right]


def describe(text: str, lo: int, hi: int, path: str, dictionary: frozenset[str]) -> list[float]:
    value = text[lo:hi]
    kinds = _classes(value)
    share = np.unique(list(value), return_counts=True)[1] / len(value)
    before, after = _around(text, lo, hi)
    name = _NAME_BEFORE.search(before)
    numeric = [
        float(bool(name)), float(bool(name and _KEYWORD.search(name.group(1)))), float(before[-1:] in ("'", '"') and before != ""),
        kinds.count(2) / len(value), kinds.count(1) / len(value), kinds.count(3) / len(value),
        min(len(value), 200), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(kinds) - 1), float(-(share * np.log2(share)).sum()), covered(value, dictionary), path.count("/"),
    ]
    slots = np.zeros(PATH_SLOTS + 2 * WORD_SLOTS)
    for part in re.split(r"[/.]", path):
        slots[_slot(part, PATH_SLOTS)] = 1
    left, right = ([x for w in _WORD.findall(side) if (x := w.strip("\"'=:,.;")) and not _KEYWORD.search(x)] for side in (before, after))
    if left:
        slots[PATH_SLOTS + _slot(left[-1], WORD_SLOTS)] = 1
    if right:
        slots[PATH_SLOTS + WORD_SLOTS + _slot(right[0], WORD_SLOTS)] = 1
    return [*numeric, *slots.tolist()]


def seed_label(text: str, lo: int, hi: int) -> int | None:
    """A label where formats leave no doubt: 1 for an issued format, or a value of 16 or more hexadecimal or base64
    characters with digits that is assigned to a credential word; 0 for addresses, numbers and values in plain prose; else none."""
    value = text[lo:hi]
    if _ISSUED.fullmatch(value):
        return 1
    name = _NAME_BEFORE.search(_around(text, lo, hi)[0])
    if name and _KEYWORD.search(name.group(1)):
        random = re.fullmatch(r"[A-Fa-f0-9]{16,}|[A-Za-z0-9+/_-]{20,}={0,2}", value) and any(c.isdigit() for c in value)
        return 1 if random else None
    if re.fullmatch(r"(?:[a-z0-9-]+\.)+[a-z]{2,}[.,]?", value) or text[lo - 1 : lo] == "@" or re.fullmatch(r"[\d.+\-/]+", value):
        return 0
    return 0 if re.fullmatch(r"[A-Za-z]+\d{0,2}[.,]?", value) else None


def _dictionary(rows: DataFrame) -> frozenset[str]:
    """The words of 3 to 12 letters that most documents hold, counted over all documents; counts combine before they shuffle."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0))
    counts = rows.select(F.explode(words).alias("w")).filter(F.length("w") <= 12).groupBy("w").count()
    return frozenset(r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS).collect())


def find_candidates(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(doc_id, start, end, value_sha256, features, seed) of every candidate in columns (doc_id, text, path). words: the dictionary."""
    import pyarrow as pa

    schema = T.StructType([docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value_sha256", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("seed", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in C.slices(batch):
                src, lo_, hi_, sha, feats, seeds = [], [], [], [], [], []
                for row, (text, path) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                    text, path = text.as_py() or "", path.as_py()
                    for lo, hi in candidates(text):
                        src.append(row), lo_.append(lo), hi_.append(hi), seeds.append(seed_label(text, lo, hi))
                        sha.append(hashlib.sha256(text[lo:hi].encode("utf-8", "replace")).hexdigest())
                        feats.append(describe(text, lo, hi, path or "", words.value))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(src, pa.int32())), pa.array(lo_, pa.int64()), pa.array(hi_, pa.int64()), pa.array(sha, pa.string()), pa.array(feats, pa.list_(pa.float64())), pa.array(seeds, pa.int32())],
                    schema.fieldNames(),
                )
        C.trim()

    C.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", "path").mapInArrow(run, schema)


def fit_forest(findings: DataFrame, train_findings: int = TRAIN_FINDINGS, trees: int = 20, depth: int = 6, seed: int = 7):
    """A random forest on at most train_findings findings of each label; None if only one label occurs."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    counts = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("value_sha256", "start"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("label") == 1, min(1.0, train_findings / counts[1])).otherwise(min(1.0, train_findings / counts[0]))
    sample = findings.filter(draw < share).select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(sample)


def _found(docs: DataFrame, path: Column | None, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (path if path is not None else F.lit("")).cast("string").alias("path"))
    words = docs.sparkSession.sparkContext.broadcast(_dictionary(rows))
    found = C.stage(find_candidates(rows, words), "candidates")
    words.destroy()
    return found


def _known(found: DataFrame, labelled: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The candidates with the features that the forest may see, and those of them with a label."""
    if labelled is None:
        found = found.withColumn("features", F.slice("features", len(SEEN_BY_SEEDS) + 1, 1 << 20))
        return found, found.filter("seed is not null").withColumn("label", F.col("seed"))
    judged = labelled.select("value_sha256", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    judged = judged.groupBy("value_sha256").agg(F.max("label").alias("label"))
    return found, found.join(judged, "value_sha256")


def _predict(model, found: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return model.transform(found.withColumn("features", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")[1])


def scan_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, path: Column | None = None, cutoff: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", train_findings: int = TRAIN_FINDINGS,
) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), value_sha256, probability, is_secret. No secret is shown.

    labelled: findings (value_sha256, label 0/1) that people judged; of contrary labels of a value, 1 counts. Without them the forest
    learns from candidates whose format alone decides, without the features by which it does, and generalises to the rest by length,
    character transitions, dictionary coverage, path and neighbouring words. If all labels are the same, they decide
    alone. Candidates of a text never overlap: an issued format goes before an assigned value, that before a long run, and of equals
    the first. Null or empty text has no candidates, long texts are read whole; repeated rows repeat theirs; other columns
    are ignored; an empty table gives no rows. Training data are bounded, candidates are not.
    """
    found, known = _known(_found(docs, path, id_col, text_col), labelled)
    model = fit_forest(known.select("value_sha256", "start", "features", "label"), train_findings)
    if model is None:
        scored = found.withColumn("probability", F.coalesce(F.col("seed"), F.lit(0)).cast("double"))
    else:
        scored = _predict(model, found)
    return scored.select("doc_id", "start", "end", "value_sha256", "probability", (F.col("probability") >= cutoff).alias("is_secret"))


def evaluate(
    docs: DataFrame, labelled: DataFrame | None = None, path: Column | None = None, cutoff: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", train_findings: int = TRAIN_FINDINGS,
) -> DataFrame:
    """One row (n, precision, recall) on labelled findings whose values, one in HOLDOUT by their hash, the forest has not seen."""
    _, known = _known(_found(docs, path, id_col, text_col), labelled)
    held = F.pmod(F.xxhash64("value_sha256"), F.lit(HOLDOUT)) == 0
    model = fit_forest(known.filter(~held).select("value_sha256", "start", "features", "label"), train_findings)
    if model is None:
        return known.limit(0).select(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    said, true = (F.col("probability") >= cutoff).cast("int"), F.col("label")
    return _predict(model, known.filter(held)).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(said * true) / F.sum(said)).alias("precision"), (F.sum(said * true) / F.sum(true)).alias("recall"),
    )


def redact(docs: DataFrame, findings: DataFrame, marker: str = "<secret>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span that is_secret replaced by the marker; rows without one pass straight through."""
    spans = findings.filter("is_secret").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    spans = C.stage(spans.withColumnRenamed("doc_id", "__id"), "spans")
    words = C.filter_words(spans.count())
    bloom = C.stage(C.bloom_of(spans.select(F.xxhash64("__id").alias("h")), "h", words), "bloom")
    marked = C.probe(docs, F.xxhash64(F.col(id_col)), bloom, words, "__maybe")
    text, last = F.col(text_col), F.element_at("__spans", -1)["end"]
    pieces = F.transform("__spans", lambda s, i: F.concat(
        F.substring(text, F.when(i == 0, 1).otherwise(F.element_at("__spans", F.greatest(i, F.lit(1)))["end"] + 1).cast("int"),
                    (s["start"] - F.when(i == 0, 0).otherwise(F.element_at("__spans", F.greatest(i, F.lit(1)))["end"])).cast("int")), F.lit(marker)))
    masked = F.concat(F.array_join(pieces, ""), F.substring(text, (last + 1).cast("int"), F.lit((1 << 31) - 1)))
    some = marked.filter("__maybe").join(spans, F.col(id_col) == F.col("__id"), "left")
    some = some.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(masked))
    return marked.filter(~F.col("__maybe")).select(*C.columns_of(docs)).unionByName(some.select(*C.columns_of(docs)))
