"""Quality rules with risk-controlled thresholds: exact binomial bounds on labelled documents choose each stratum's cutoffs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.llm import _common as C
from fleetcut.llm.words import WordHashes, shingles

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject when the expression is above a cutoff; cutoffs run from the most lenient to the strictest."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (4.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    Rule("dup_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("repeat_words", "n_repeat_words / n_words", (0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    Rule("long_words", "word_chars / n_words", (40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    Rule("short_words", "-word_chars / n_words", (-1.0, -1.5, -2.0, -2.5, -3.0, -3.5)),
    Rule("capitals", "n_capitals / word_chars", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
)


def repeated_words(words: np.ndarray, size: int = 5) -> int:
    """Words that lie in a window of `size` words which the text holds at least twice."""
    if len(words) <= size:
        return 0
    windows = shingles(words, size)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(windows)] += twice
    edges[size : size + len(windows)] -= twice
    return int(np.count_nonzero(np.cumsum(edges)[: len(words)] > 0))


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns in keep, and the counts that the rules read. Whole texts; null has no words."""
    import pyarrow as pa

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
    schema = T.StructType([docs.schema["doc_id"], *[docs.schema[k] for k in keep], *[T.StructField(c, T.LongType()) for c in counts]])

    def measure(text: str, hashes: WordHashes) -> tuple[int, ...]:
        words = hashes.of(text, lower=False)
        lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return (
            len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), int(np.count_nonzero((raw - np.uint8(65)) < 26)),
        )

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in C.slices(batch):
                rows = [measure(t.as_py() or "", hashes) for t in part.column(1)]
                cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(2 + i) for i in range(len(keep))], *cols], schema.fieldNames())
        hashes.clear()
        C.trim()

    C.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exactly, by summing its terms from their logarithms."""
    if k >= n:
        return 1.0
    if p <= 0.0 or p >= 1.0:
        return float(p <= 0.0)
    i = np.arange(k + 1)
    logs = np.cumsum(np.r_[n * math.log1p(-p), np.log(n - i[:-1]) - np.log(i[:-1] + 1.0) + math.log(p) - math.log1p(-p)])
    return float(min(1.0, np.exp(logs).sum()))


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Clopper-Pearson: the largest rate with P(X <= k) > alpha; 1 without labels."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > alpha else (low, mid)
    return high


def select_cutoffs(good: DataFrame, stratum: str, max_false: float, alpha: float, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, one column for each rule): the strictest cutoff proven safe on labelled good documents, or null.

    A stratum's limit on false rejections is shared among the rules (union bound), alpha among all strata and rules
    (Bonferroni). Cutoffs of a rule are tested from lenient to strict and testing stops at the first whose bound is
    too high, so they need no further correction. With probability 1 - alpha every stratum keeps the limit.
    """
    hits = [F.sum((F.expr(r.value) > c).cast("bigint")).alias(f"{r.name}__{i}") for r in rules for i, c in enumerate(r.cutoffs)]
    table = good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *hits)
    table = C.stage(table, "strata")
    n_strata = table.count()
    names = [r.name for r in rules]
    schema = T.StructType([good.schema[stratum], *[T.StructField(x, T.DoubleType()) for x in names]])

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                level = alpha / (n_strata * len(rules))
                got = []
                for r in rules:
                    best = None
                    for i, c in enumerate(r.cutoffs):
                        if upper_bound(int(row[f"{r.name}__{i}"] or 0), int(row["n_good"]), level) > max_false / len(rules):
                            break
                        best = c
                    got.append(best)
                rows.append([row[stratum], *got])
            yield pd.DataFrame(rows, columns=schema.fieldNames()).astype(dict.fromkeys(names, "float64"))

    return table.mapInPandas(run, schema)


def quality_filter(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = 0.05, alpha: float = 0.05, rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and the rules that reject it.

    Base rules are fixed (under 10 words, or over 20 % of the words repeated in 5-word windows); the others take the cutoffs that
    select_cutoffs proves safe on labels with quality 1. Rules whose safety the labels cannot prove stay off; so with no
    labels only the base rules act. Null text has no words and fails; a null stratum is one of its own; labels
    with null or repeated ids count once per matching document. Repeated rows give a row each; an empty table none.
    """
    base = C.clean(docs, id_col, text_col, F.coalesce(F.col(stratum).cast("string"), F.lit("\u0000none")).alias("stratum"))
    known = C.stage(features(base, ("stratum",)), "features")
    good_ids = labels.filter("quality = 1").select("doc_id").distinct()
    good = known.filter("n_words > 0").join(good_ids, "doc_id", "left_semi")
    cutoffs = select_cutoffs(good, "stratum", max_false, alpha, rules)
    sizes = known.groupBy("stratum").agg(F.count(F.lit(1)).alias("members"))
    chosen = C.stage(sizes.join(cutoffs, "stratum", "left"), "cutoffs")
    rows = C.lookup(known, chosen, "stratum", "members", known.count())
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    broken = F.array_compact(F.array(*[F.when((F.col("n_words") > 0) & (F.expr(f"try_divide({r.value.replace(' / ', ', ')})") > F.col(r.name)), F.lit(r.name)) for r in rules]))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.size(broken) == 0)).alias("kept"), broken.alias("broken_rules"),
    )
