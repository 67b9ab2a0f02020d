"""DuckDB text for the same rules, used as the independent oracle."""

from __future__ import annotations

from quire.functions.types import STATA_TO_SQL, UNMAPPED


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def py_ts(c: str) -> str:
    return (f"strftime({c}, '%Y-%m-%d %H:%M:%S') || "
            f"CASE WHEN strftime({c}, '%f') <> '000000' THEN '.' || strftime({c}, '%f') ELSE '' END")


def py_str(c: str, kind: str) -> str:
    """DuckDB's double text already equals Python's ``str(float)``."""
    if kind == "ts":
        return py_ts(c)
    return f"CAST({c} AS VARCHAR)"


def stringify(c: str, kind: str) -> str:
    return f"coalesce({py_str(c, kind)}, '')"


def sanitize(c: str, kind: str) -> str:
    return (f"coalesce(replace(replace(replace({py_str(c, kind)}, ',', ' '), chr(10), ' '), "
            f"'\"', ''''), '')")


def numeric_or_text(c: str) -> str:
    whole = f"regexp_full_match({c}, '\\s*[+-]?[0-9]+\\s*') AND try_cast({c} AS BIGINT) IS NOT NULL"
    return (f"CASE WHEN {whole} THEN CAST(try_cast({c} AS BIGINT) AS VARCHAR) "
            f"WHEN try_cast({c} AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast({c} AS DOUBLE)) "
            f"THEN CAST(try_cast({c} AS DOUBLE) AS VARCHAR) "
            f"ELSE {c} END")


def type_case(c: str) -> str:
    arms = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in STATA_TO_SQL.items())
    return f"CASE {c} {arms} ELSE {s(UNMAPPED)} END"
