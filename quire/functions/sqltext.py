"""Helpers that turn names and literals into Spark SQL text.

Wide operators build one list of SQL strings and call ``selectExpr`` once:
building thousands of ``Column`` objects from Python is far slower than
parsing the same expressions from text.
"""

from __future__ import annotations


def ident(name: str) -> str:
    """Backtick-quote a column name so any character is accepted."""
    return "`" + name.replace("`", "``") + "`"


def lit(text: str | None) -> str:
    """A Spark SQL string literal for ``text`` (``NULL`` for ``None``)."""
    if text is None:
        return "NULL"
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + escaped + "'"


def alias(expr: str, name: str) -> str:
    return f"{expr} AS {ident(name)}"


def value(v: object) -> str:
    """A SQL literal for a Python scalar (str, int, float, bool, None)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return lit(str(v))


def literal_frame(spark, rows, schema: str):
    """A small DataFrame from literal rows, planned as SQL ``VALUES``.

    For short literal tables (dictionaries, rule lists, one row per input
    table) this avoids serialising Python objects to the JVM; the columns
    are cast to ``schema`` ("name type, ...").
    """
    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(value(v) for v in row) + ")" for row in rows)
    names = ", ".join(ident(n) for n, _ in fields)
    cols = ", ".join(f"CAST({ident(n)} AS {t}) AS {ident(n)}" for n, t in fields)
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({names})")
