"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, found by iterative-deepening A*."""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcut.llm import _common as C

#: What each edit costs, and what a truncated message that stays adds.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
#: Places in `(s?(ua)+)?`: nothing yet, after s, after u, after a. By place: where an initial leads, and what an insertion or a new role says.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
SAYS = ("user", "user", "assistant", "user")
#: Cheapest ends after the last message, by place.
ENDS = ((0, "", None), (2 * INSERT, "II", None), (INSERT, "I", None), (0, "", None))
#: Messages that are searched at once; characters of a conversation that are held in memory; conversations whose result is remembered.
BLOCK, HELD, KNOWN = 64, 16 << 20, 50_000


def _search(codes: list[tuple[str, int]], place: int, ends) -> tuple[int, str, int]:
    """Cost, audit and last place of the cheapest edits of some messages (initial, fault: 0 none, 1 must go, 2 truncated) from a place on; ends: cost by
    last place. Depth first in ASCII order of the edits under rising bounds on cost so far plus least cost to come; of each state the largest budget with
    which it has failed is remembered. The bound never passes the least cost, so the first path that is accepted is the least of the cheapest."""
    n = len(codes)
    least = [min(e[0] for e in ends)] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (KEEP, DELETE, TRUNCATED)[codes[i][1]]
    failed: dict[tuple[int, int], int] = {}
    over = 0

    def go(i: int, q: int, budget: int) -> tuple[int, str, int] | None:
        nonlocal over
        if i == n:
            cost = ends[q][0]
            if cost <= budget:
                return cost, "", q
            over = min(over, cost - budget)
            return None
        if least[i] > budget:
            over = min(over, least[i] - budget)
            return None
        if failed.get((i, q), -1) >= budget:
            return None
        initial, fault = codes[i]
        steps = [("D", DELETE, i + 1, q), ("I", INSERT, i, LEADS[q][SAYS[q][0]])]
        if fault != 1:
            more = TRUNCATED if fault else 0
            if initial in LEADS[q]:
                steps.append(("K", KEEP + more, i + 1, LEADS[q][initial]))
            steps.append(("R", REROLE + more, i + 1, LEADS[q][SAYS[q][0]]))
        for name, cost, j, to in steps:
            if cost <= budget:
                found = go(j, to, budget - cost)
                if found:
                    return found[0] + cost, name + found[1], found[2]
            else:
                over = min(over, cost - budget)
        failed[i, q] = budget
        return None

    bound = least[0]
    while True:
        over = 1 << 60
        failed.clear()
        if found := go(0, place, bound):
            return found
        bound += over


def cheapest_edits(codes: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation. Long ones are searched in blocks from the end, from each place that a block may begin with."""
    if len(codes) <= BLOCK:
        cost, audit, last = _search(codes, START, ENDS)
        return cost, audit + ENDS[last][1]
    ends, blocks = ENDS, []
    for lo in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        ends = tuple(_search(codes[lo : lo + BLOCK], q, ends) for q in (range(4) if lo else (START,)))
        blocks.append(ends)
    q, parts = START, []
    for block in reversed(blocks):
        parts.append(block[q][1])
        q = block[q][2]
    return blocks[-1][START][0], "".join(parts) + ENDS[q][1]


class _Messages:
    """The messages of one conversation in order; beyond HELD characters they wait in an unnamed file."""

    def __init__(self):
        self.now, self.size, self.file = [], 0, None

    def add(self, role: str, text: str) -> None:
        self.now.append((role, text))
        self.size += len(text)
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.now, self.file)
            self.now, self.size = [], 0

    def __iter__(self):
        if self.file:
            self.file.seek(0)
            try:
                while True:
                    yield from pickle.load(self.file)
            except EOFError:
                self.file.close()
        yield from self.now


def repaired(messages, audit: str):
    """(edit, role, text) of each step of an audit: what stays is None for deleted messages."""
    rest, q = iter(messages), START
    for edit in audit:
        if edit == "I":
            role, text = SAYS[q], ""
        else:
            role, text = next(rest)
            role = None if edit == "D" else SAYS[q] if edit == "R" else role
        if role is not None:
            q = LEADS[q][role[:1]]
        yield edit, role, text


def _conversations(kind: str, steps: bool):
    """Messages sorted by conversation and place (conv, turn, role, text, fault) to a row per conversation, or per step of its audit."""
    known: dict[tuple, tuple[int, str]] = {}

    def summary(conv, turns: tuple, counts: list[int], illegal: int, codes: list[tuple[str, int]], messages: _Messages) -> list[tuple]:
        key = tuple(codes)
        if len(known) > KNOWN:
            known.clear()
        cost, audit = known[key] if key in known else known.setdefault(key, cheapest_edits(codes)) if len(key) <= BLOCK else cheapest_edits(codes)
        if steps:
            return [(conv, i, *step) for i, step in enumerate(repaired(messages, audit))]
        digest, before = hashlib.sha256(), b""
        for _, role, text in repaired(messages, audit):
            if role is not None:
                digest.update(before + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                before = b"\n"
        low, high, distinct = turns
        return [(conv, high - low + 1 - distinct if distinct else 0, counts[1], counts[2], counts[3], illegal, cost, audit, digest.hexdigest())]

    types = [pa.int64(), pa.string(), pa.string(), pa.string()] if steps else [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches):
        out, held, begun, now, conv_type = [], 0, False, None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [conv_type, *types], strict=True)], names=[str(i) for i in range(len(columns))])

        def fresh():
            return (0, 0, 0), [0] * 4, 0, [], _Messages()

        state, last = fresh(), None
        for rows in batches:
            conv_type = rows.column(0).type
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if begun and conv != now:
                    out += summary(now, *state)
                    held += sum(len(x[-1]) for x in out[-1:])
                    state, last = fresh(), None
                    if len(out) >= 2000 or held > 4 << 20:
                        yield batch()
                        out, held = [], 0
                begun, now = True, conv
                (low, high, distinct), counts, illegal, codes, messages = state
                if turn is not None and (not distinct or turn != high):
                    low, high, distinct = low if distinct else turn, turn, distinct + 1
                counts[fault] += 1
                illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
                last = role[:1]
                codes.append((last if last in ("s", "u", "a") else "", (0, 1, 1, 2)[fault]))
                messages.add(role, text)
                state = (low, high, distinct), counts, illegal, codes, messages
        if begun:
            out += summary(now, *state)
            yield batch()
        C.trim()

    return run


def with_faults(rows: DataFrame) -> DataFrame:
    """Messages (conv, turn, role, text) of whole conversations in order, each with its first fault: 1 blank, 2 duplicate, 3 truncated, 0 none. A duplicate is
    found by a window over its own copies, so no conversation is held for it; the one shuffle is by conversation."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    nth = "row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST)"
    fault = F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    numbered = rows.repartition("conv").withColumn("nth", F.expr(nth)).sortWithinPartitions(*order)
    return numbered.select("conv", "turn", "role", "text", fault.alias("fault"))


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ids: DataFrame | None = None, steps: bool = False,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; or with `steps` one row per step of its
    audit: conv_id, step, edit (D, I, K or R), role (of the repaired message, null if deleted), text.

    Order is by turn, null first; messages of one turn by role and text. Null role or text is one space; the messages without conversation id are one
    conversation. `ids`, conversations that must have a row, get zeros, an empty audit and the hash of nothing where they have no messages. An empty table
    gives no rows; other columns are ignored. A digest of a conversation needs its bytes one after the other, so a conversation is one task's work;
    its texts stream and wait in a file when they are long, and only a code of each message is held.
    """
    spark = rows.sparkSession
    C.small_batches(spark)
    clean = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    kind = dict(clean.dtypes)["conv"]
    names = "step bigint, edit string, role string, text string" if steps else (
        "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    )
    out = with_faults(clean).mapInArrow(_conversations(kind, steps), f"conv_id {kind}, {names}")
    if ids is None or steps:
        return out
    every = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    zero = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    found = out.withColumnRenamed("conv_id", "__conv")
    return every.join(found, F.col("__id").eqNullSafe(F.col("__conv")), "left").select(
        F.col("__id").alias("conv_id"), *[F.coalesce(c, F.lit(zero.get(c, 0))).alias(c) for c in out.columns[1:]]
    )
