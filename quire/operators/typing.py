"""Declared types: dictionary lookup, typed load and DDL text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.sqltext import alias, ident, lit
from quire.functions.text import NUMBER_TEXT
from quire.functions.types import UNMAPPED, sql_to_spark, type_map_column

def map_types(variables: DataFrame, type_col: str = "type", out_col: str = "sql_type", *,
              on_unmapped: str = "none", dictionary: DataFrame | None = None) -> DataFrame:
    """Add the SQL type of each Stata storage code.

    By default the 33-entry dictionary is a literal map (no join). A user
    dictionary table ``(code, sql_type)`` is joined instead. Unknown codes give the text ``None``, or an
    error with ``on_unmapped="error"``.
    """
    if dictionary is None:
        looked = F.try_element_at(type_map_column(), F.col(type_col))
        out = variables.withColumn(out_col, looked)
    else:
        d = dictionary.select(F.col("code").alias("_code"), F.col("sql_type").alias("_sql"))
        out = (variables.join(d, F.col(type_col) == F.col("_code"), "left")
               .withColumn(out_col, F.col("_sql")).drop("_code", "_sql"))
    if on_unmapped == "error":
        fail = F.raise_error(F.concat(F.lit("unmapped type code: "), F.coalesce(F.col(type_col), F.lit("NULL"))))
        return out.withColumn(out_col, F.when(F.col(out_col).isNull(), fail).otherwise(F.col(out_col)))
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(UNMAPPED)))


def _typed_expr(col: str, target: T.DataType, empty_as_null: bool) -> str:
    c = ident(col)
    src = f"nullif({c}, '')" if empty_as_null else c
    t = target.simpleString()
    if isinstance(target, T.StringType):
        return src
    if isinstance(target, T.NumericType):
        src = f"CASE WHEN {src} RLIKE {lit(NUMBER_TEXT)} THEN {src} END"
    if isinstance(target, (T.ShortType, T.IntegerType, T.LongType, T.ByteType)):
        # Integer codes sometimes arrive float-formatted ("3.0", "1e2"):
        # accept any whole number; "3.5" stays unparseable.
        d = f"try_cast({src} AS DOUBLE)"
        return f"coalesce(try_cast({src} AS {t}), CASE WHEN {d} % 1 = 0 THEN try_cast({d} AS {t}) END)"
    return f"try_cast({src} AS {t})"


def _parsed(df: DataFrame, types: Mapping[str, str], empty_as_null: bool) -> tuple[DataFrame, dict[str, tuple[str, str, str]]]:
    """``df`` with each typed value as a column of its own, so that a cell is
    parsed once, and per column SQL text of its typed value, of whether there was
    a value, and of whether it is refused."""
    prefix = "_typed"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    parsed, out = [], {}
    for i, f in enumerate(df.schema.fields):
        if f.name not in types:
            continue
        target, c = sql_to_spark(types[f.name]), ident(f.name)
        typed = f"{prefix}{i}"
        parsed.append(alias(_typed_expr(f.name, target, empty_as_null), typed))
        given = f"({c} IS NOT NULL" + (f" AND CAST({c} AS STRING) <> '')" if empty_as_null else ")")
        size = re.fullmatch(r"VARCHAR\((\d+)\)", types[f.name].strip().upper())
        if isinstance(target, T.StringType):
            bad = f"({given} AND length(CAST({c} AS STRING)) > {size[1]})" if size else "false"
        else:
            bad = f"({given} AND {typed} IS NULL)"
        out[f.name] = typed, given, bad
    return (df.selectExpr("*", *parsed) if parsed else df), out


def _rejects(parsed: Mapping[str, tuple[str, str, str]], types: Mapping[str, str]) -> str:
    rows = [f"CASE WHEN {bad} THEN named_struct('variable', {lit(c)}, 'value', CAST({ident(c)} AS STRING), 'sql_type', {lit(types[c])}) END"
            for c, (_, _, bad) in parsed.items()]
    return f"array_compact(array({', '.join(rows)}))"


def rejected_values(df: DataFrame, types: Mapping[str, str], keys: Sequence[str], *, empty_as_null: bool = True) -> DataFrame:
    """Values that ``apply_types`` refuses: the keys, ``variable``, ``value`` and ``sql_type``."""
    work, parsed = _parsed(df, types, empty_as_null)
    out = work.selectExpr(*map(ident, keys), f"inline({_rejects(parsed, types)})")
    return out.select(*map(ident, keys), "variable", "value", "sql_type")


def apply_types(df: DataFrame, types: Mapping[str, str], *, empty_as_null: bool = True,
                on_error: str = "null") -> DataFrame:
    """Cast text columns to declared SQL types, each cell parsed once.

    ``types`` maps column -> SQL type (``SMALLINT``, ``VARCHAR(20)``, ...);
    columns not named keep their type. ``''`` becomes null first, and
    values that do not parse or are longer than their VARCHAR become null, or
    fail the query with ``on_error="raise"``; ``load_typed`` keeps them.
    """
    if on_error not in ("null", "raise"):
        raise ValueError("on_error must be 'null' or 'raise'")
    work, parsed = _parsed(df, types, empty_as_null)
    return work.selectExpr(*_typed_columns(df, types, parsed, on_error))


def _typed_columns(df: DataFrame, types: Mapping[str, str], parsed: Mapping, on_error: str = "null") -> list[str]:
    exprs = []
    for c in df.columns:
        if c in parsed:
            typed, _, bad = parsed[c]
            miss = "NULL" if on_error == "null" else f"raise_error(concat('not a {types[c]}: ', CAST({ident(c)} AS STRING)))"
            exprs.append(alias(f"CASE WHEN {bad} THEN {miss} ELSE {typed} END", c))
        else:
            exprs.append(ident(c))
    return exprs


class TypedLoad(NamedTuple):
    """What ``load_typed`` wrote: the typed rows, the refused values (keys,
    variable, value, sql_type), and the cells that held a value: ``given`` =
    ``typed`` + ``rejected``, of ``rows`` rows."""

    data: DataFrame
    rejects: DataFrame
    rows: int
    given: int
    typed: int
    rejected: int


def load_typed(df: DataFrame, types: Mapping[str, str], keys: Sequence[str], path: str, *, empty_as_null: bool = True) -> TypedLoad:
    """Write ``df`` with its declared types as Parquet under ``path`` (replacing
    it), the refused values of a row beside it, in one pass; the write itself
    counts (an observation), so no row is read twice."""
    work, parsed = _parsed(df, types, empty_as_null)
    given = " + ".join([f"CAST({g} AS INT)" for _, g, _ in parsed.values()] or ["0"])
    out = work.selectExpr(*_typed_columns(df, types, parsed), f"{_rejects(parsed, types)} AS _rejects", f"{given} AS _given")
    seen = Observation()
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum("_given").alias("given"), F.sum(F.size("_rejects")).alias("rejected"))
    out.drop("_given").write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    rejects = back.select(*map(ident, keys), F.inline("_rejects"))
    n = {k: seen.get.get(k) or 0 for k in ("rows", "given", "rejected")}
    return TypedLoad(back.drop("_rejects"), rejects, n["rows"], n["given"], n["given"] - n["rejected"], n["rejected"])


def declared_types(variables: DataFrame, name_col: str = "name", sql_type_col: str = "sql_type") -> dict[str, str]:
    """Column -> SQL type from a variables table. This is schema metadata,
    one row per column, so it is read to the driver to build the plan."""
    rows = variables.select(name_col, sql_type_col).collect()
    return {r[0]: r[1] for r in rows}


def generate_ddl(variables: DataFrame, *, table: str | None = None, sections: DataFrame | None = None,
                 keys: Sequence[str] = (), dataset_col: str = "dataset", name_col: str = "name",
                 sql_type_col: str = "sql_type", ordinal_col: str = "ordinal") -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS`` text, columns in declared order: one
    statement per dataset, whatever its width. With ``sections`` (section,
    name), one per dataset and section, named ``dataset_section``, that holds
    the dataset's ``keys`` first. Output: dataset, table_name, n_columns, ddl.
    """
    v = variables if table is None else variables.withColumn(dataset_col, F.lit(table))
    v = v.select(F.col(dataset_col).alias("dataset"), F.col(name_col).alias("name"), F.col(ordinal_col).alias("_ord"),
                 F.concat_ws(" ", F.col(name_col), F.col(sql_type_col)).alias("_def"))
    if sections is None:
        v = v.withColumn("table_name", F.col("dataset")).withColumn("_key", F.lit(0))
    else:
        key = F.col("name").isin(*keys)
        of = v.where(~key).join(sections.select("section", "name"), "name")
        heads = of.select("dataset", "section").distinct().join(v.where(key), "dataset")
        v = heads.withColumn("_key", F.lit(0)).unionByName(of.withColumn("_key", F.lit(1)))
        v = v.withColumn("table_name", F.concat_ws("_", "dataset", "section"))
    # A statement is one value, so its columns meet in one row: as many as a table is wide.
    defs = v.groupBy("dataset", "table_name").agg(
        F.count("*").alias("n_columns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_key", "_ord", "_def"))), lambda x: x["_def"]), ",").alias("_defs"))
    return defs.select("dataset", "table_name", "n_columns",
                       F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), F.col("table_name"), F.lit(" ("), F.col("_defs"), F.lit(");")).alias("ddl"))
