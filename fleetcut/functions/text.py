"""Column functions for Japanese and plain text: normalisation, width, edit distance."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.functions.batches import small_batches


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark lacks; it runs in Python only where a row is not ASCII."""
    small_batches(SparkSession.active())
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text))


def normalise(text: Column, ascii_only: bool = False) -> Column:
    """For comparing: compatibility form, without white space and sentence marks, lower case."""
    base = text if ascii_only else nfkc(text)
    return F.lower(F.regexp_replace(base, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}、。!?.,]", ""))


def filler_normalise(text: Column, ascii_only: bool = False) -> Column:
    """For finding fillers: compatibility form, without punctuation, separators, symbols and controls; long marks collapse."""
    base = text if ascii_only else nfkc(text)
    return F.regexp_replace(F.regexp_replace(base, r"[\p{P}\p{Z}\p{S}\p{C}]", ""), "ー+", "ー")


def normalise_reading(text: Column) -> Column:
    """Readings: hiragana to katakana, only katakana and its marks stay."""
    hira = "".join(chr(c) for c in range(0x3041, 0x3097))
    kata = "".join(chr(ord(c) + 0x60) for c in hira)
    return F.regexp_replace(F.translate(nfkc(text), hira, kata), r"[^\x{30A1}-\x{30FA}ーヽヾ]", "")


@cache
def _wide_ranges() -> list[tuple[int, int]]:
    """The characters that are two cells wide, as ranges computed from the Unicode tables."""
    ranges, start = [], None
    for c in range(0x20, 0x110000):
        wide = not 0xD800 <= c <= 0xDFFF and unicodedata.east_asian_width(chr(c)) in "WF"
        if wide and start is None:
            start = c
        if not wide and start is not None:
            ranges.append((start, c - 1))
            start = None
    return ranges


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def text_width(text: Column) -> Column:
    """Wide and full-width characters count 1, others 0.5.

    A class of all wide ranges costs each character as many steps as there are ranges, so runs below the first and of the few long ranges (kana,
    ideographs, syllables) go first, and only what is left meets the rest.
    """
    long = [r for r in _wide_ranges() if r[1] - r[0] >= 80]
    high = F.regexp_replace(text, r"[\x{0}-\x{10FF}]++", "")
    rest = F.regexp_replace(high, _class(long) + "++", "")
    wide = F.length(high) - F.length(rest) + F.when(rest == "", 0).otherwise(F.regexp_count(rest, F.lit(_class([r for r in _wide_ranges() if r not in long]))))
    return (F.length(text) + wide) * 0.5


def cps(units: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.try_divide(units, (end_ms - start_ms) / F.lit(1000.0))


def cer_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; null for an empty reference."""
    return F.when(F.length(reference) > 0, F.levenshtein(reference, hypothesis) / F.length(reference))


EDITS = T.StructType([T.StructField(c, T.LongType()) for c in ("substitutions", "deletions", "insertions")])


def edit_script(a: str, b: str) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of one minimal edit script (substitutions first on ties, then deletions).

    Rows of the distance table are kept as the bits of their steps, one number each for up and down, and made a row at a time by
    bit-parallel arithmetic; the script is read off backwards from the steps alone.
    """
    m, full = len(b), (1 << len(b)) - 1
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    up, down = full, 0  # steps along b in the current row
    along, across = [(up, down)], [(0, 0)]
    for x in a:
        eq = places.get(x, 0)
        same = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = (down | ~(same | up)) & full, same & up
        across.append((rise, fall))
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = (fall | ~(same | rise)) & full, rise & same
        along.append((up, down))
    i, j, subs, dels, ins = len(a), m, 0, 0, 0
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            continue
        bit = 1 << (j - 1)
        v = bool(across[i][0] & bit) - bool(across[i][1] & bit)
        h = bool(along[i - 1][0] & bit) - bool(along[i - 1][1] & bit)
        if v + h == 1:
            subs, i, j = subs + 1, i - 1, j - 1
        elif v == 1:
            dels, i = dels + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return subs, dels + i, ins + j


#: Pairs whose scripts are made together, and characters of their longer text at most: the bits of a machine word.
_TOGETHER, _WORD = 4096, 63


def edit_scripts(pairs: list[tuple[str, str]]) -> np.ndarray:
    """edit_script of many pairs of at most 63 characters each side, a row at a time for all of them: (substitutions, deletions, insertions) per pair."""
    u = lambda x: np.asarray(x, np.uint64)
    one, count = np.uint64(1), len(pairs)
    la, lb = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    codes = []
    for i, n, gap in ((0, la, -1), (1, lb, -2)):
        at = np.full((count, max(1, int(n.max()))), gap, np.int64)
        at[np.arange(at.shape[1]) < n[:, None]] = np.frombuffer("".join(p[i] for p in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes.append(at)
    a, b = codes
    weights, full = one << u(np.arange(b.shape[1])), (one << u(lb)) - one
    up, down = full.copy(), np.zeros(count, np.uint64)
    along, across = [(up, down)], [(up, down)]
    for i in range(int(la.max())):
        eq = ((a[:, i, None] == b) * weights).sum(1, dtype=np.uint64)
        same = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = (down | ~(same | up)) & full, same & up
        across.append((rise, fall))
        rise, fall = (rise << one | one) & full, (fall << one) & full
        up, down = (fall | ~(same | rise)) & full, rise & same
        along.append((up, down))
    ups, downs, rises, falls = (np.stack(x) for x in (*zip(*along, strict=True), *zip(*across, strict=True)))
    i, j, out = la.copy(), lb.copy(), np.zeros((count, 3), np.int64)
    k = np.flatnonzero((i > 0) & (j > 0))
    while len(k):
        x, y = i[k], j[k]
        bit = u(y - 1)
        has = lambda m, r: (m[r, k] >> bit & one).astype(np.int64)  # noqa: B023, E731
        v, h = has(rises, x) - has(falls, x), has(ups, x - 1) - has(downs, x - 1)
        equal, sub, gone = a[k, x - 1] == b[k, y - 1], v + h == 1, v == 1
        out[k, 0] += ~equal & sub
        out[k, 1] += ~equal & ~sub & gone
        out[k, 2] += ~equal & ~sub & ~gone
        i[k] -= equal | sub | gone
        j[k] -= equal | sub | ~gone
        k = k[(i[k] > 0) & (j[k] > 0)]
    out[:, 1] += i
    out[:, 2] += j
    return out


@F.pandas_udf(EDITS)
def edit_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """edit_script of each pair; null counts as empty. Short texts go together, thousands at once, long ones each by itself."""
    pairs = [(a or "", b or "") for a, b in zip(reference, hypothesis, strict=True)]
    out = np.zeros((len(pairs), 3), np.int64)
    short = [n for n, (a, b) in enumerate(pairs) if len(a) <= _WORD and len(b) <= _WORD]
    for lo in range(0, len(short), _TOGETHER):
        part = short[lo : lo + _TOGETHER]
        out[part] = edit_scripts([pairs[n] for n in part])
    for n, (a, b) in enumerate(pairs):
        if len(a) > _WORD or len(b) > _WORD:
            out[n] = edit_script(a, b)
    return pd.DataFrame(out, columns=[f.name for f in EDITS])
