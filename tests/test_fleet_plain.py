"""Queries of the fleet that SQL does not say, against plain Python over the rows that they start from."""

import difflib
import json
from collections import defaultdict

import pytest

from fleetcut.plans import gate_queries, registry, report_queries, speech_queries, text_queries
from fleetcut.plans.fixtures import Fleet

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fleet(spark):
    return Fleet(spark, SF)


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def overlap(a, b):
    return max(0, min(a[1], b[1]) - max(a[0], b[0]))


def test_j22_and_a04(spark, fleet):
    merged, spoken = rows(spark, "j21_merge_cuts"), defaultdict(list)
    for r in speech_queries.spoken(fleet).collect():
        spoken[r.project_id].append((r.start_ms, r.end_ms))
    taken, demoted = defaultdict(list), set()
    for r in sorted((r for r in merged if r.status == "approved"), key=lambda r: (r.project_id, r.origin == "added", r.start_ms, r.end_ms, r.cut_id)):
        span = (r.start_ms, r.end_ms)
        if any(overlap(span, x) for x in taken[r.project_id]):
            demoted.add((r.project_id, r.cut_id))
        else:
            taken[r.project_id].append(span)
    got = rows(spark, "j22_resolve_overlaps")
    assert {(r.project_id, r.cut_id) for r in got if r.demoted} == demoted and demoted
    assert {(r.project_id, r.cut_id): r.status for r in got} == {(r.project_id, r.cut_id): "proposed" if (r.project_id, r.cut_id) in demoted else r.status for r in merged}

    candidates = fleet.candidates.collect()
    before = fleet.cuts.groupBy("project_id").count().collect()
    summary = {r.project_id: r for r in rows(spark, "a04_detect_summary")}
    for p, n in ((r.project_id, r["count"]) for r in before):
        mine, s = [r for r in merged if r.project_id == p], summary[p]
        kinds = {k: sum(r.origin == k for r in mine) for k in ("matched", "kept", "added")}
        assert (s.matched, s.kept, s.added, s.dropped) == (kinds["matched"], kinds["kept"], kinds["added"], n - kinds["matched"] - kinds["kept"])
        found = [c for c in candidates if c.project_id == p]
        if found:
            assert (s.detected, s.detected_ms) == (s.silence_detected, s.silence_ms) == (len(found), sum(c.end_ms - c.start_ms for c in found)) and s.filler_detected == 0
        ids = sorted(int(r.cut_id[1:]) for r in mine)
        assert (int(s.first_id[1:]), int(s.last_id[1:]), s.next_id, s.cuts_total) == (ids[0], ids[-1], ids[-1] + 1, len(ids))
        assert s.demoted == sum(d[0] == p for d in demoted)
        speech = [sum(overlap((r.start_ms, r.end_ms), x) for x in spoken[p]) for r in mine if r.reason == "silence"]
        assert s.max_speech_ms == (max(speech) if speech else None)


def test_g26_is_every_schema_gate(spark, fleet):
    length = {r.project_id: r.duration_ms for r in fleet.projects.collect()}
    cuts, want = gate_queries.faulty(fleet).collect(), []
    for items, key in ((fleet.segments.collect(), "segment_id"), (cuts, "cut_id")):
        seen = defaultdict(int)
        for r in items:
            seen[r.project_id, r[key]] += 1
            if not (0 <= r.start_ms < r.end_ms <= length[r.project_id]):
                want.append((r.project_id, "G01", r[key]))
        want += [(p, "G03", i) for (p, i), n in seen.items() if n > 1]
    for r in cuts:
        want += [(r.project_id, "G02", r.cut_id)] * ((r.status == "maybe") + (r.confidence > 1) + (r.cut_id == "x1"))
    end = {}
    for r in sorted((r for r in cuts if r.status == "approved"), key=lambda r: (r.project_id, r.start_ms, r.end_ms, r.cut_id)):
        if r.start_ms < end.get(r.project_id, -(10**9)):
            want.append((r.project_id, "G04", r.cut_id))
        end[r.project_id] = max(end.get(r.project_id, -(10**9)), r.end_ms)
    for r in fleet.telops.collect():
        if not (r.segment_id or (r.start_ms is not None and r.duration_ms is not None)) or (r.start_ms or 0) > length[r.project_id]:
            want.append((r.project_id, "G13", str(r.idx)))
    got = [(r.project_id, r.gate, r.item_id) for r in rows(spark, "g26_artifacts")]
    assert sorted(x for x in got if x[1] != "G05") == sorted(want) and want


def test_documents_hold_the_tables_rows(spark):
    shown = defaultdict(list)
    for r in rows(spark, "j35_resolve_telops"):
        if r.problem is None:
            shown[r.project_id].append(r.idx)
    styles = defaultdict(set)
    for r in rows(spark, "j36_merge_styles"):
        styles[r.project_id].add((r.preset, r.font, r.size))
    for r in rows(spark, "k03_ass_documents"):
        lines = r.document.split("\n")
        assert [int(x.split(",")[0].split()[1]) for x in lines if x.startswith("Dialogue: ")] == sorted(shown[r.project_id])
        assert {tuple(x.removeprefix("Style: ").split(",")[:3]) for x in lines if x.startswith("Style: ")} == styles[r.project_id]
    facts = {r.project_id: r for r in rows(spark, "a16_project_report")}
    for r in rows(spark, "k04_statistics_documents"):
        doc, a = json.loads(r.document), facts[r.project_id]
        assert doc["version"] == "2" and {"duration", "cuts", "noise_floor", "subtitles", "render"} <= set(doc)
        assert round(doc["duration"]["source_sec"], 3) == a.source_sec and doc["duration"]["rendered_sec"] == a.rendered_sec
        assert doc["subtitles"]["entries"] == a.entries and sum(x["n"] for x in doc["cuts"]) == a.cuts


def test_wrapped_texts(spark, fleet):
    text = {(r.project_id, r.segment_id): r.text for r in fleet.segments.collect()}
    for r in rows(spark, "h10_wrap"):
        whole = text[r.project_id, r.segment_id]
        lines = r.wrapped.split("\\N")
        assert "".join("".join(lines).split()) == "".join(whole.split()) and len(lines) <= 2


def test_alignment_and_flags(spark, fleet):
    heard = {r.project_id: (r.expected, r.actual) for r in text_queries.heard(fleet).collect()}
    want, rate = set(), {}
    for p, (a, b) in heard.items():
        errors = 0
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            errors += max(j - i, m - k) if tag != "equal" else 0
            if tag == "delete" and j - i >= 2:
                want.add((p, i, a[i:j]))
        rate[p] = errors / len(a) if a else None
    assert {(r.project_id, r["index"], r.text) for r in rows(spark, "h13_missing_hunks")} == want
    assert {r.project_id: r.cer for r in rows(spark, "h14_alignment_cer")} == rate
    flags = defaultdict(int)
    for r in rows(spark, "j32_flag_boundaries"):
        assert (r.project_id, r["index"], r.hunk) in want
        flags[r.project_id] += 1
    assert {r.project_id: r.flags for r in rows(spark, "a20_verify_summary")} == {r.project_id: flags[r.project_id] for r in fleet.projects.collect()}
    assert {(r.project_id, r.value) for r in rows(spark, "g22_flags")} == {(p, float(n)) for p, n in flags.items() if n and p % 3}


def test_readings_and_corrections(spark, fleet):
    dictionary = {r.reading: r.correct for r in sorted(text_queries.readings(fleet).collect(), key=lambda r: -r["rank"])}
    tokens = defaultdict(list)
    for r in text_queries.tokens(fleet).orderBy("ord").collect():
        tokens[r.project_id, r.segment_id].append(r)
    want = set()
    for key, mine in tokens.items():
        i = 0
        while i < len(mine):
            for n in range(min(8, len(mine) - i), 0, -1):
                part = mine[i : i + n]
                if part[0].reading and part[-1].reading and "".join(t.reading or "" for t in part) in dictionary:
                    want.add((*key, i + 1, i + n, dictionary["".join(t.reading or "" for t in part)]))
                    i += n
                    break
            else:
                i += 1
    assert {(r.project_id, r.segment_id, r.first, r.last, r.correct) for r in rows(spark, "h06_readings")} == want and want
    corrected = {(r.project_id, r.segment_id): r for r in rows(spark, "h07_correct")}
    text = {(r.project_id, r.segment_id): r.text for r in fleet.segments.collect()}
    assert set(corrected) == set(text)
    for r in rows(spark, "a15_correction_summary"):
        mine = [k for k in text if k[0] == r.project_id]
        assert r.changed == sum(corrected[k].new_text != text[k] for k in mine) and r.applied + r.skipped == sum(corrected[k].hits for k in mine)


def test_every_query_is_compared():
    here = {
        "j22_resolve_overlaps", "a04_detect_summary", "g26_artifacts", "k04_statistics_documents", "h10_wrap", "h13_missing_hunks", "h14_alignment_cer",
        "j32_flag_boundaries", "a20_verify_summary", "g22_flags", "h06_readings", "h07_correct", "a15_correction_summary",
    }
    elsewhere = {"h12_edit_counts", "h16_without_fillers", "j27_filler_spans", "j28_trim_candidates", "j29_filler_candidates"}  # tests/test_text.py
    assert here | elsewhere == set(registry.queries()) - set(registry.oracle_sql())
    assert report_queries
