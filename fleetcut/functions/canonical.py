"""JSON with sorted keys, no spaces, ASCII only and the shortest text of each number, as hashes of parameters need it; SQL expressions only."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A number as %.<n>e writes it: sign, first digit, further digits without closing zeros, power of ten.
_FORM = r"r'^(-?)(\d)\.(\d*?)0*e([+-]\d+)$'"
#: Characters that JSON has a short escape for.
_SHORT = {8: r"r'\b'", 9: r"r'\t'", 10: r"r'\n'", 12: r"r'\f'", 13: r"r'\r'", 34: r"""r'\"'""", 92: r"r'\\'"}


def _let(value: str, name: str, body: str) -> str:
    """body of a value that has a name and is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def double_sql(x: str) -> str:
    """The shortest decimal text that gives the same double: plain from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    tries = [f"format_string('%.{n}e', dv)" for n in (14, 15, 16)]
    text = f"CASE WHEN try_cast({tries[0]} AS DOUBLE) = dv THEN {tries[0]} WHEN try_cast({tries[1]} AS DOUBLE) = dv THEN {tries[1]} ELSE {tries[2]} END"
    part = lambda i: f"regexp_extract(dt, {_FORM}, {i})"
    parts = f"named_struct('s', {part(1)}, 'd', {part(2)} || {part(3)}, 'p', try_cast({part(4)} AS INT))"
    decimals = "substring(dp.d, dp.p + 2)"
    laid_out = (
        f"CASE WHEN dp.p BETWEEN 0 AND 15 THEN dp.s || substring(rpad(dp.d, dp.p + 1, '0'), 1, dp.p + 1) || '.' || CASE WHEN {decimals} = '' THEN '0' ELSE {decimals} END"
        " WHEN dp.p BETWEEN -4 AND -1 THEN dp.s || '0.' || repeat('0', -dp.p - 1) || dp.d"
        " ELSE dp.s || left(dp.d, 1) || CASE WHEN length(dp.d) > 1 THEN '.' || substring(dp.d, 2) ELSE '' END || 'e'"
        " || CASE WHEN dp.p < 0 THEN '-' ELSE '+' END || CASE WHEN abs(dp.p) < 10 THEN '0' ELSE '' END || abs(dp.p) END"
    )
    written = _let(_let(text, "dt", parts), "dp", laid_out)
    return _let(f"CAST({x} AS DOUBLE)", "dv", f"CASE WHEN dv IS NULL OR isnan(dv) OR dv = 0 THEN CAST(dv AS STRING) ELSE {written} END")


def string_sql(s: str) -> str:
    """A quoted string: control and non-ASCII characters as \\uXXXX, those beyond U+FFFF as two of them."""
    unit = lambda n: rf"r'\u' || lpad(lower(hex({n})), 4, '0')"
    short = " ".join(f"WHEN sn = {code} THEN {text}" for code, text in _SHORT.items())
    one = f"CASE {short} WHEN sn BETWEEN 32 AND 126 THEN sc WHEN sn < 65536 THEN {unit('sn')} ELSE {unit('55296 + (sn - 65536) DIV 1024')} || {unit('56320 + (sn - 65536) % 1024')} END"
    escaped = f"array_join(transform(regexp_extract_all(sv, r'[\\s\\S]', 0), sc -> {_let('ascii(sc)', 'sn', one)}), '')"
    plain = r"""sv RLIKE r'^[ !#-\[\]-~]*\z'"""
    return "'\"' || " + _let(s, "sv", f"CASE WHEN {plain} THEN sv ELSE {escaped} END") + " || '\"'"


def canonical_sql(path: str, kind: T.DataType, depth: int = 0) -> str:
    """Canonical JSON of what stands at a path: structs and maps as objects with sorted keys, arrays, strings, numbers, truth values, null."""
    x = f"x{depth}"
    if isinstance(kind, T.StructType):
        parts = [f"'{json.dumps(f.name)}:' || {canonical_sql(f'{path}.`{f.name}`' if path else f'`{f.name}`', f.dataType, depth)}" for f in sorted(kind, key=lambda f: f.name)]
        text = "'{' || " + (" || ',' || ".join(parts) + " || " if parts else "") + "'}'"
        return f"CASE WHEN {path} IS NULL THEN 'null' ELSE {text} END" if path else text
    if isinstance(kind, T.MapType):
        entries = f"array_sort(map_entries({path}), (l, r) -> CASE WHEN l.key < r.key THEN -1 ELSE 1 END)"
        text = f"'{{' || array_join(transform({entries}, {x} -> {string_sql(f'{x}.key')} || ':' || {canonical_sql(f'{x}.value', kind.valueType, depth + 1)}), ',') || '}}'"
    elif isinstance(kind, T.ArrayType):
        text = f"'[' || array_join(transform({path}, {x} -> {canonical_sql(x, kind.elementType, depth + 1)}), ',') || ']'"
    elif isinstance(kind, T.StringType):
        text = string_sql(path)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = double_sql(path)
    else:
        text = f"CAST({path} AS STRING)"
    return f"coalesce({text}, 'null')"


def canonical_json(kind: T.StructType) -> Column:
    """Canonical JSON of a row's columns of these names and types, as one object."""
    return F.expr(canonical_sql("", kind))


def double_text(column: str) -> Column:
    return F.expr(double_sql(f"`{column}`"))
