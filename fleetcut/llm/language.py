"""Language ID by Bayesian fusion of text likelihoods, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.llm import _common as C
from fleetcut.llm.exact_dedup import normalised
from fleetcut.llm.html_text import extract_main_text

#: Hashed byte trigrams; labelled documents of a language that train its likelihoods, at most.
GRAMS, TRAIN_DOCS = 1 << 16, 4000
#: Trigrams whose counts one row holds, between tasks.
CELL = 1 << 12
#: Languages whose counts a task or the driver holds at once; all languages are learned, in blocks.
BLOCK = 64
#: Text evidence counts as that of so many independent trigrams at most: neighbouring trigrams are not independent.
EVIDENCE = 40
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of letters (ASCII folded, all else a space) of all texts, and where each text's begin."""
    parts = [np.frombuffer(b" " + (t or "").encode("utf-8", "replace").translate(_FOLD) + b"  ", np.uint8) for t in texts]
    flat = np.concatenate(parts).astype(np.uint32) if parts else np.empty(0, np.uint32)
    a, b, c = flat[:-2], flat[1:-1], flat[2:]
    code = ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ends = np.cumsum([len(p) for p in parts])
    real = b != 32  # a space in the middle says nothing; texts end with two, so none spans two texts
    kept = np.cumsum(np.r_[0, real])
    starts = kept[np.r_[0, ends[:-1]].astype(np.int64)] if parts else np.empty(0, np.int64)
    return code[real], starts


def trigram_counts(texts: DataFrame) -> DataFrame:
    """Counts of trigrams (label, cell, grams, n) of texts (label, text): a task gives one row at most for each language and CELL trigrams that it holds at
    once, however many trigrams its texts have."""
    def run(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}

        def flush():
            for name, c in total.items():
                used = np.flatnonzero(c)
                for part in np.split(used, np.searchsorted(used, np.arange(CELL, GRAMS, CELL))):
                    if len(part):
                        row = [pa.array([x], kind) for x, kind in ((name, pa.string()), (int(part[0]) // CELL, pa.int32()), ((part % CELL).astype("<u2").tobytes(), pa.binary()), (c[part].astype("<i8").tobytes(), pa.binary()))]
                        yield pa.RecordBatch.from_arrays(row, ["label", "cell", "grams", "n"])
            total.clear()

        for batch in batches:
            for part in C.slices(batch):
                labels = np.array(part.column(0).to_pylist(), object)
                texts = part.column(1).to_pylist()
                for name in set(labels):
                    codes, _ = trigrams([texts[i] for i in np.flatnonzero(labels == name)])
                    total[name] = total.get(name, 0) + np.bincount(codes, minlength=GRAMS)
                    if len(total) > BLOCK:
                        yield from flush()
        yield from flush()
        C.trim()

    return texts.mapInArrow(run, "label string, cell int, grams binary, n binary")


def _train(rows: DataFrame, train_docs: int) -> tuple[list[str], list[np.ndarray]]:
    """All labelled languages by name, and log likelihoods of the trigrams in blocks of BLOCK languages, from whole texts of a bounded
    sample for each."""
    counts = C.stage(rows.filter("label is not null and text <> ''").groupBy("label").count(), "labels")
    names = [r["label"] for r in counts.orderBy("label").collect()]  # a row a language
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    share = F.broadcast(counts.select("label", F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("count")).alias("share")))
    sample = rows.select("label", "text").join(share, "label").filter(draw < F.col("share")).select("label", "text")

    def add(table):
        import pyarrow as pa

        dense = np.zeros(CELL, "<i8")
        for grams, n in zip(table.column("grams").to_pylist(), table.column("n").to_pylist(), strict=True):
            dense[np.frombuffer(grams, "<u2")] += np.frombuffer(n, "<i8")
        return pa.table({"label": table.column("label").slice(0, 1), "cell": table.column("cell").slice(0, 1), "counts": pa.array([dense.tobytes()], pa.binary())})

    cells = trigram_counts(sample).groupBy("label", "cell").applyInArrow(add, "label string, cell int, counts binary")
    packed = C.stage(cells, "grams")
    blocks = []
    for lo in range(0, len(names), BLOCK):
        block = names[lo : lo + BLOCK]
        table = np.full((len(block), GRAMS), 0.5)
        for r in packed.filter((F.col("label") >= block[0]) & (F.col("label") <= block[-1])).collect():  # BLOCK times 512 KiB at most
            table[block.index(r["label"]), r["cell"] * CELL : (r["cell"] + 1) * CELL] += np.frombuffer(r["counts"], "<i8")
        blocks.append(np.log(table / table.sum(1, keepdims=True)).astype(np.float32))
    C.unstage(packed)
    return names, blocks


def _base(tag: Column) -> Column:
    """The primary part of a language tag, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(tag), "^([A-Za-z]{2,8})", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(url: Column) -> Column:
    """What an address says of its language: a two-letter first path part, else the last part of the host."""
    path = F.nullif(F.lower(F.regexp_extract(url, "^[^/]*//[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1)), F.lit(""))
    return F.coalesce(F.concat(F.lit("/"), path), F.concat(F.lit("."), F.element_at(F.split(host_of(url), r"\."), -1)))


def markup_language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))


def _zip(*arrays: Column, f) -> Column:
    out = arrays[0]
    for x in arrays[1:]:
        out = F.zip_with(out, x, f)
    return out


def with_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The documents (doc_id, text, lang, source) with url and markup (language) of the page whose main text without headings is theirs,
    white space apart; of several pages the one of smallest address, null if there is none. Documents without a page do not shuffle."""
    sha = lambda text: F.sha2(F.trim(normalised(text)).cast("binary"), 256)
    found = extract_main_text(pages.select("page_id", "url", "html"), headings=False, keep={"markup": markup_language(F.col("html"))})
    facts = found.filter("n_chars > 0").groupBy(sha(F.col("text")).alias("key")).agg(F.min(F.struct("url", "markup")).alias("p"))
    facts = C.stage(facts.select("key", "p.url", "p.markup"), "facts")
    words = C.filter_words(facts.count())
    bloom = C.stage(C.bloom_of(facts.select(F.xxhash64("key").alias("h")), "h", words), "bloom")
    rows = C.stage(C.probe(docs.select("doc_id", "text", "lang", "source", sha(F.col("text")).alias("key")), F.xxhash64("key"), bloom, words, "maybe"), "keyed")
    some, none = rows.filter("maybe").drop("maybe"), F.lit(None).cast("string")
    sizes = some.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    known = C.stage(facts.join(sizes, "key"), "known")
    return (
        rows.filter("not maybe").select("doc_id", "text", "lang", "source", none.alias("url"), none.alias("markup"))
        .unionByName(C.lookup(some, known, "key", "m", some.count(), "left").drop("key", "m"))
    )


def _counts(table: DataFrame, k: int) -> Column:
    """Counts of each language from rows (guess, n) that a group collects; a group has a row a language at most."""
    seen = F.map_from_entries(F.collect_list(F.struct("guess", "n")))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at(seen, i), F.lit(0)))


def _attach(rows: DataFrame, table: DataFrame, key: str, total: int, out: str, default: Column) -> DataFrame:
    """Rows with column `out` of a table by key (and rows of the key, m); the default where the key is null or unknown."""
    none = rows.filter(F.col(key).isNull()).withColumn(out, default)
    some = C.lookup(rows.filter(F.col(key).isNotNull()), table, key, "m", total, "left").drop("m").withColumn(out, F.coalesce(out, default))
    return none.unionByName(some)


def _evidence(rows: DataFrame, key: str, k: int, total: int, out: str) -> DataFrame:
    """log P(value of key | language) for each language, from counts of the text's own verdicts, smoothed by one. Null: 0."""
    known = rows.filter(F.col(key).isNotNull() & (F.col("guess") >= 0))
    counts = C.stage(known.groupBy(key, "guess").agg(F.count(F.lit(1)).alias("n")), "counts")
    sums = C.stage(counts.groupBy(key).agg(_counts(counts, k).alias("c"), F.sum("n").alias("m")), "sums")
    kinds = sums.count() + 1
    every = {r["guess"]: r["n"] for r in counts.groupBy("guess").agg(F.sum("n").alias("n")).collect()}  # a row a language
    totals = F.array(*[F.lit(float(every.get(i, 0) + kinds)) for i in range(k)])
    logs = F.zip_with("c", totals, lambda c, t: F.log((c + 1.0) / t))
    return _attach(rows, C.stage(sums.select(key, "m", logs.alias(out)), "evidence"), key, total, out, F.array_repeat(F.lit(0.0), k))


def _host_prior(rows: DataFrame, k: int, total: int, kappa: float) -> DataFrame:
    """log prior of each language for a row's host: counts of the host, smoothed towards its domain, smoothed towards all."""
    known = rows.filter("guess >= 0")
    every = {r["guess"]: r["n"] for r in known.groupBy("guess").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    n = sum(every.values())
    base = [(every.get(i, 0) + 1.0) / (n + k) for i in range(k)]
    counts = C.stage(known.filter("host is not null").groupBy("host", "domain", "guess").agg(F.count(F.lit(1)).alias("n")), "counts")
    hosts = counts.groupBy("host", "domain").agg(_counts(counts, k).alias("c"), F.sum("n").alias("m"))
    of_domain = counts.groupBy("domain", "guess").agg(F.sum("n").alias("n"), F.countDistinct("host").alias("h"))
    domains = of_domain.groupBy("domain").agg(_counts(of_domain, k).alias("d"), F.sum("n").alias("above"), F.max("h").alias("hosts"))
    both = C.lookup(C.stage(hosts, "hosts"), C.stage(domains, "domains"), "domain", "hosts", counts.count())
    smooth = F.zip_with("d", F.array(*[F.lit(kappa * b) for b in base]), lambda d, b: (d + b) / (F.col("above") + kappa))
    prior = F.zip_with("c", smooth, lambda c, s: F.log((c + kappa * s) / (F.col("m") + kappa)))
    table = C.stage(both.select("host", "m", prior.alias("prior")), "priors")
    return _attach(rows, table, "host", total, "prior", F.array(*[F.lit(float(np.log(b))) for b in base]))


def identify_languages(
    docs: DataFrame, declared: Column | None = None, url: Column | None = None, host: Column | None = None, label: Column | None = None,
    min_posterior: float = 0.5, kappa: float = 20.0, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS,
) -> DataFrame:
    """One row per document: doc_id, language, posterior, kept, reason.

    log posterior = tempered text likelihood + log P(declared | language) + log P(suffix | language) + log host prior.
    Likelihoods are learned from at most train_docs whole texts of each label (the declared language if no label is given), of all
    labels that occur; the rest from grouped counts over all rows; hot hosts and tags come by a bounded broadcast.
    Evidence that is missing (null) counts for nothing. A document is rejected if it has no letters ("no text") or no language
    reaches min_posterior ("undetermined"); with no labels at all, every document is undetermined. Ties go to the first language
    by name. Null or empty texts have no text; long ones are read whole; repeated rows give a row each; an empty table none; other
    columns are ignored.
    """
    import pyarrow as pa

    C.small_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    tag = _base(declared if declared is not None else none)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), tag.alias("declared"),
        (suffix_of(url) if url is not None else none).alias("suffix"),
        F.coalesce(host_of(url) if url is not None else none, host if host is not None else none).alias("host"),
        (_base(label) if label is not None else tag).alias("label"),
    )
    names, logp = _train(rows, train_docs)
    if not names:
        some = F.regexp_like(F.col("text"), F.lit(r"\p{L}"))
        return rows.select("doc_id", none.alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"), F.when(some, "undetermined").otherwise("no text").alias("reason"))
    k, weights = len(names), [docs.sparkSession.sparkContext.broadcast(block) for block in logp]
    schema = T.StructType([*[rows.schema[c] for c in ("doc_id", "declared", "suffix", "host")], T.StructField("n", T.LongType()), T.StructField("fit", T.ArrayType(T.DoubleType()))])

    def run(batches):
        tables = [w.value for w in weights]
        for batch in batches:
            for part in C.slices(batch):
                codes, starts = trigrams(part.column(1).to_pylist())
                n = np.diff(np.r_[starts, len(codes)])
                fit = np.zeros((len(n), k))
                full = n > 0
                if full.any():
                    for i in range(k):
                        fit[full, i] = np.add.reduceat(tables[i // BLOCK][i % BLOCK][codes], starts[full], dtype=np.float64) / n[full]
                cols = [part.column(i) for i in (0, 2, 3, 4)] + [pa.array(n, pa.int64()), pa.array(list(fit), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())
        C.trim()

    fitted = rows.select("doc_id", "text", "declared", "suffix", "host").mapInArrow(run, schema)
    guess = F.when(F.col("n") > 0, F.array_position("fit", F.array_max("fit")).cast("int") - 1).otherwise(-1)
    scored = C.stage(fitted.withColumn("guess", guess).withColumn("domain", F.substring_index("host", ".", -2)), "scores")
    for w in weights:
        w.destroy()
    total = scored.count()
    out = _evidence(_evidence(_host_prior(scored, k, total, kappa), "declared", k, total, "tag"), "suffix", k, total, "end")
    add = lambda x, y: x + y
    text = F.transform("fit", lambda x: x * F.least("n", F.lit(EVIDENCE)))
    log_post = _zip(text, F.col("prior"), F.col("tag"), F.col("end"), f=add)
    out = out.withColumn("lp", log_post)
    best = F.array_max("lp")
    odds = F.aggregate("lp", F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    out = out.withColumn("posterior", 1.0 / odds).withColumn("at", F.array_position("lp", best).cast("int"))
    sure = (F.col("n") > 0) & (F.col("posterior") >= min_posterior)
    reason = F.when(F.col("n") == 0, "no text").when(~sure, "undetermined")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at"))
    return out.select("doc_id", F.when(F.col("n") > 0, name).alias("language"), F.when(F.col("n") > 0, F.col("posterior")).otherwise(0.0).alias("posterior"), sure.alias("kept"), reason.alias("reason"))
