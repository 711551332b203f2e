"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcut.llm.bpe import encode_documents
from fleetcut.llm.exact_dedup import exact_groups
from fleetcut.llm.html_text import extract_main_text
from fleetcut.llm.language import identify_languages, with_pages
from fleetcut.llm.minhash import near_groups
from fleetcut.llm.packing import pack_documents
from fleetcut.llm.passages import repeated_passages
from fleetcut.llm.quality import quality_filter
from fleetcut.llm.repair import repair_conversations
from fleetcut.llm.secrets import scan_secrets
from fleetcut.llm.sharding import assign_shards, grid, grown
from fleetcut.llm.suffixes import remove_repeats
from fleetcut.llm.trie import prefix_trie

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=2)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), path=F.col("source"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text stands on a page take the page's markup language and address as evidence. The label is never evidence too: others have their
    text and the host prior of their source alone."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return identify_languages(
        with_pages(docs, pages), declared=F.col("markup"), url=F.col("url"), host=F.col("source"), label=F.col("lang"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = grid(40)
    return assign_shards(table(spark, sf_dir, "documents"), tree, grown(tree, 40))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """A twentieth each of the messages is dropped, emptied, loses its sentence ends, stands twice, or is said by the user; nulls are one space."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    changed = F.when(fate == 1, "").when(fate == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"])
    times = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.filter(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(text["role"]).alias("role"), changed.alias("text"), times.alias("copy"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), ids=rows.select("conv_id"))


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation with some first turns of the first of its hundred in place of its own: (conv_id, place, role, text). Nulls count as empty; turns are
    in order of turn (null first), role and text."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    order = "row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)"
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", *text).withColumn("at", F.expr(order))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    own = turns.withColumn("heads", heads).filter("at > heads").select("conv_id", (F.col("at") + 6).alias("place"), "role", "text")
    ids = turns.select("conv_id").distinct().select("conv_id", F.expr("conv_id - conv_id % 100").alias("first"), heads.alias("heads"))
    first = turns.filter("at < 6 AND conv_id % 100 = 0").select(F.col("conv_id").alias("first"), F.col("at").alias("place"), "role", "text")
    return own.unionByName(ids.join(first, "first").filter("place <= heads").select("conv_id", "place", "role", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return prefix_trie(rebuilt(rows), rows.select("conv_id"))


def queries() -> dict[str, Query]:
    ops = (
        op1_exact_dedup, op2_minhash, op3_bpe, op4_secrets, op5_language, op6_quality, op7_packing, op8_html, op9_sharding, op10_substring,
        op11_repair, op12_suffix_array, op13_prefix_trie,
    )
    return {f.__name__: f for f in ops}


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit, in DuckDB."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, y: {bit})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS BIGINT), 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


def _repair_sql() -> str:
    """Dynamic programming over the messages, the states as texts of cost and audit, of which the least is the cheapest; then the audit is played back."""

    def more(state: str, cost: str, edit: str) -> str:
        return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{edit}'"

    ins = [  # insertions before a message or at the end, twice, so that both places profit
        f"q0, q1, least(q2, {more('q0', '2', 'I')}, {more('q1', '2', 'I')}, {more('q3', '2', 'I')}) AS q2, q3",
        f"q0, q1, q2, least(q3, {more('q2', '2', 'I')}) AS q3",
        f"q0, q1, least(q2, {more('q3', '2', 'I')}) AS q2, q3",
    ]

    def step(to: str, sources: list[str], initial: str, own: str) -> str:
        out = [more(own, "3", "D")]
        for q in sources:
            out.append(f"CASE WHEN fault NOT IN (1, 2) AND left(role, 1) = '{initial}' THEN {more(q, 'late', 'K')} END")
            if initial != "s":
                out.append(f"CASE WHEN fault NOT IN (1, 2) THEN {more(q, '2 + late', 'R')} END")
        return f"least({', '.join(out)}) AS {to}"

    moves = ", ".join([f"{more('q0', '3', 'D')} AS q0", step("q1", ["q0"], "s", "q1"), step("q2", ["q0", "q1", "q3"], "u", "q2"), step("q3", ["q2"], "a", "q3")])
    says = "CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END"
    return f"""
WITH RECURSIVE original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
),
fated AS (SELECT *, {_crc32("name")} % 20 AS fate FROM original),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) || left(role, 1) AS pair,
         right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM numbered
),
faults AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed
),
rows AS (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS late, count(*) OVER (PARTITION BY conv_id) AS n FROM faults),
states AS (
  SELECT conv_id, max(n) AS n, CAST(0 AS BIGINT) AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, CAST(NULL AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3
  FROM rows GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n, i + 1, {moves} FROM (
    SELECT a.conv_id, a.n, a.i, role, fault, late, q0, q1, q2, q3
    FROM (SELECT conv_id, n, i, {ins[2]} FROM (SELECT conv_id, n, i, {ins[1]} FROM (SELECT conv_id, n, i, {ins[0]} FROM states))) a
    JOIN rows b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = a.i + 1
  )
),
best AS (
  SELECT conv_id, least(q0, q3, {more("q2", "2", "I")}, {more("q1", "4", "II")}) AS b FROM states WHERE i = n
),
played AS (
  SELECT conv_id, substr(b, 10) AS audit, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, 0 AS q, CAST([] AS VARCHAR[]) AS said FROM best
  UNION ALL
  SELECT p.conv_id, audit, k + 1, CASE WHEN e = 'I' THEN p.i ELSE p.i + 1 END,
         CASE WHEN e = 'D' THEN q WHEN e = 'K' THEN CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN q = 2 THEN 3 ELSE 2 END,
         CASE e WHEN 'D' THEN said WHEN 'I' THEN list_append(said, {says} || ':') WHEN 'K' THEN list_append(said, role || ':' || text)
         ELSE list_append(said, {says} || ':' || text) END
  FROM (SELECT *, substr(audit, k + 1, 1) AS e FROM played WHERE k < length(audit)) p
  LEFT JOIN rows r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1
),
texts AS (SELECT conv_id, audit, array_to_string(said, chr(10)) AS repaired FROM played WHERE k = length(audit)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(left(b, 9) AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_repair": _repair_sql(),
        "op1_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
""",
        "op13_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS first, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS heads FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT i.conv_id, pos AS place, role, text FROM ids i JOIN turns t ON t.conv_id = i.first WHERE pos <= heads
  UNION ALL SELECT conv_id, pos + 6, role, text FROM ids JOIN turns USING (conv_id) WHERE pos > heads
),
paths AS (
  SELECT conv_id, coalesce(list(row(role, text) ORDER BY place) FILTER (place IS NOT NULL), []) AS path FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
),
prefixes AS (SELECT conv_id, path, len(path) AS n, unnest(range(len(path) + 1)) AS depth FROM paths),
members AS (SELECT conv_id, n, depth, path[1:depth] AS prefix FROM prefixes),
nodes AS (
  SELECT prefix, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256 FROM members GROUP BY prefix
),
family AS (
  SELECT a.prefix, a.depth, a.conv_id, b.conv_id AS parent_conv_id, a.n_convs, a.ends_sha256, len(a.prefix) = 0 AS top,
         coalesce((a.n_convs - 1) * length(a.prefix[-1][2]), 0) AS saved FROM nodes a LEFT JOIN nodes b ON a.depth > 0 AND b.prefix = a.prefix[1:a.depth - 1]
),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT DISTINCT a.prefix, b.prefix AS lower FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth
),
sums AS (
  SELECT x.prefix, count(*) FILTER (c.prefix IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM below x JOIN family f ON f.prefix = x.lower LEFT JOIN children c ON c.prefix = x.lower GROUP BY x.prefix
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM family JOIN sums USING (prefix) LEFT JOIN children USING (prefix)
""",
        "op12_suffix_array": """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, unnest(range((strlen(h) // 2 + 199) // 200)) AS c, h FROM bytes),
parts AS (SELECT doc_id, c, substr(h, CAST(400 * c + 1 AS BIGINT), 498) AS h FROM chunks),
places AS (SELECT doc_id, c, h, unnest(range(least(strlen(h) // 2 - 49, 200))) AS o FROM parts),
windows AS (SELECT doc_id, 200 * c + o AS p, min(doc_id) OVER (PARTITION BY md5_number(substr(h, CAST(2 * o + 1 AS BIGINT), 100))) < doc_id AS gone FROM places),
marks AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -51) > 50 AS fresh FROM windows WHERE gone),
runs AS (SELECT doc_id, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marks),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
),
texts AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (coalesce(hi, strlen(h) // 2) - lo) AS BIGINT)), '' ORDER BY lo) AS h
  FROM kept JOIN bytes USING (doc_id) GROUP BY doc_id
),
removed AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, CAST(strlen(b.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t.h, b.h))) AS kept_sha256
FROM bytes b LEFT JOIN texts t USING (doc_id) LEFT JOIN removed USING (doc_id)
""",
    }
