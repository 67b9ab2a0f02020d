"""Value-label codebooks: ``title:`` headings followed by ``code value``
lines become ``(vallab, code, value)`` rows; labels decode coded columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.functions.sqltext import alias, ident, lit
from quire.functions.text import py_strip
from quire.sources.files import read_lines

# Fixed value: a code and its value are separated by the first "-" or space.
CODE_SEPARATOR = "[- ]"
# With signed codes a separator at the very start is part of the code ("-1 Refused").
SIGNED_CODE_SEPARATOR = "(?<=.)[- ]"

def parse_value_labels(lines: DataFrame, mode: str = "strict", keep_position: bool = False,
                       signed_codes: bool = False) -> DataFrame:
    """Parse ordered codebook lines (``sources.read_lines`` layout).

    Per line: delete ``"``, strip, a line ending in ``:`` is a heading (minus
    the colon), any other line splits once into code and value and takes
    the latest heading above it (null before the first heading).

    The heading is carried forward inside each file split (a window per
    split), then splits that start without a heading inherit the last
    heading of the earlier splits of the same file, from a one-row-per-split
    table. No window covers a whole file, so one huge codebook is not one task.

    ``mode="strict"`` fails on a line with no separator (blank lines too);
    ``"permissive"`` drops them; ``"keep"`` keeps them, the line in ``rejected``,
    under the heading above it. ``signed_codes`` keeps a leading ``-`` in
    the code instead of treating it as the separator.
    """
    cleaned = lines.withColumn("_t", F.expr(py_strip("replace(line, '\"', '')")))
    is_head = F.col("_t").endswith(":")
    rows = cleaned.select(
        "file", "block", "seq", "sub", "line", "_t",
        F.when(is_head, F.expr("substr(_t, 1, length(_t) - 1)")).alias("_head"),
    )
    in_split = Window.partitionBy("file", "block").orderBy("seq", "sub").rowsBetween(
        Window.unboundedPreceding, 0)
    carried = rows.withColumn("_carry", F.last("_head", ignorenulls=True).over(in_split))

    # Last heading of every split, then the heading each split inherits.
    order_key = F.when(F.col("_head").isNotNull(), F.struct("seq", "sub"))
    per_split = rows.groupBy("file", "block").agg(F.max_by("_head", order_key).alias("_last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inherit = per_split.select("file", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_inh"))

    joined = carried.join(inherit, ["file", "block"], "left")
    values = joined.where(F.col("_head").isNull())
    parts = F.split(F.col("_t"), SIGNED_CODE_SEPARATOR if signed_codes else CODE_SEPARATOR, 2)
    bad = F.get(parts, 1).isNull()
    if mode == "strict":
        # In a filter, so that a count or any projection fails as well.
        values = values.where(F.when(bad, F.raise_error(F.concat(
            F.lit("codebook line has no code separator: '"), F.col("_t"), F.lit("'"))).cast("boolean")).otherwise(F.lit(True)))
        code = F.get(parts, 0)
    elif mode == "permissive":
        values = values.where(~bad)
        code = F.get(parts, 0)
    elif mode == "keep":
        code = F.when(~bad, F.get(parts, 0))
    else:
        raise ValueError("mode must be 'strict', 'permissive' or 'keep'")
    out = [F.coalesce("_carry", "_inh").alias("vallab"), code.alias("code"), F.get(parts, 1).alias("value")]
    if mode == "keep":
        out.append(F.when(bad, F.col("line")).alias("rejected"))
    if keep_position:
        out += ["file", "block", "seq", "sub"]
    return values.select(*out)


def read_value_labels(spark, path, mode: str = "strict", signed_codes: bool = False) -> DataFrame:
    return parse_value_labels(read_lines(spark, path), mode, signed_codes=signed_codes)


class LabelLoad(NamedTuple):
    """What ``load_value_labels`` wrote: the labels, the lines that are neither
    heading nor ``code value`` (vallab, line), and the count of each."""

    labels: DataFrame
    rejects: DataFrame
    n_labels: int
    n_rejected: int


def load_value_labels(lines: DataFrame, path: str, signed_codes: bool = False) -> LabelLoad:
    """Parse a codebook and write labels and rejected lines as one Parquet table
    under ``path`` (replacing it), counted by the write itself."""
    seen = Observation()
    rows = parse_value_labels(lines, "keep", signed_codes=signed_codes).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count("rejected").alias("rejected"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = lines.sparkSession.read.parquet(path)
    n = {k: seen.get.get(k) or 0 for k in ("rows", "rejected")}
    return LabelLoad(back.where("rejected is null").drop("rejected"), back.where("rejected is not null").select("vallab", F.col("rejected").alias("line")),
                     n["rows"] - n["rejected"], n["rejected"])


def rejected_label_lines(lines: DataFrame, signed_codes: bool = False) -> DataFrame:
    """Lines that are neither headings nor splittable, with their position."""
    separator = SIGNED_CODE_SEPARATOR if signed_codes else CODE_SEPARATOR
    t = F.expr(py_strip("replace(line, '\"', '')"))
    return (lines.withColumn("_t", t)
            .where(~F.col("_t").endswith(":") & F.get(F.split("_t", separator, 2), 1).isNull())
            .select("file", "block", "seq", "sub", "line"))


def _one_label(labels: DataFrame, keys: list[str]) -> DataFrame:
    """``labels`` with one row per code: its label, and whether there is another."""
    return labels.groupBy(*keys).agg(F.min("value").alias("_label"), (~F.min("value").eqNullSafe(F.max("value"))).alias("_clash"))


def _no_clash(vallab: F.Column, code: F.Column) -> F.Column:
    """A filter, so that a count or any projection fails as well."""
    fail = F.raise_error(F.concat(F.lit("two labels for a code of "), vallab, F.lit(": "), code)).cast("boolean")
    return F.when(F.col("_clash"), fail).otherwise(F.lit(True))


def decode_labels(df: DataFrame, column: str, labels: DataFrame, vallab: str,
                  out_col: str | None = None) -> DataFrame:
    """Add the label text of a coded column (left join on code, whose strategy
    the planner chooses). A code in use with two different labels is an error."""
    out_col = out_col or f"{column}_label"
    lab = _one_label(labels.where(F.col("vallab") == F.lit(vallab)), ["code"]).withColumnRenamed("code", "_code")
    joined = df.join(lab, F.col(ident(column)).cast("string") == F.col("_code"), "left")
    return joined.where(_no_clash(F.lit(vallab), F.col("_code"))).withColumnRenamed("_label", out_col).drop("_code", "_clash")


def decode_columns(df: DataFrame, columns: Mapping[str, str], labels: DataFrame, *,
                   suffix: str = "_label") -> DataFrame:
    """Add a label column for each coded column (``{column: vallab}``), all by one
    join, however many there are.

    A row becomes one entry per code it has, and one entry that carries the row
    itself; the entries meet the codebook on (vallab, code) and are put together
    again by row number. The codebook side has one row per code, so the join is
    broadcast or, with a codebook too large for that, splits codes in frequent
    use. A code in use with two different labels is an error.
    """
    if not columns:
        return df
    kept = [ident(c) for c in df.columns]
    row = f"named_struct({', '.join(f'{lit(f'c{i}')}, {c}' for i, c in enumerate(kept))})"
    code = [f"CAST({ident(c)} AS STRING)" for c in columns]
    entries = [f"named_struct('at', {i}, 'vallab', {lit(v)}, 'code', {c}, 'row', CAST(NULL AS {_struct_type(df)}))"
               for i, (c, v) in enumerate(zip(code, columns.values()))]
    carrier = f"named_struct('at', -1, 'vallab', CAST(NULL AS STRING), 'code', CAST(NULL AS STRING), 'row', {row})"
    entries = f"filter(array({', '.join([carrier, *entries])}), x -> x.at < 0 OR x.code IS NOT NULL)"
    # Numbered before the entries are taken apart.
    long = df.selectExpr("monotonically_increasing_id() AS _id", f"{entries} AS _e").select("_id", F.inline("_e"))
    book = _one_label(labels.where(F.col("vallab").isin(sorted(set(columns.values())))), ["vallab", "code"])
    met = long.join(book, ["vallab", "code"], "left").where(_no_clash(F.col("vallab"), F.col("code")))
    found = F.struct("at", F.col("_label").alias("label"))
    rows = met.groupBy("_id").agg(F.first("row", ignorenulls=True).alias("row"),
                                  F.collect_list(F.when(F.col("_label").isNotNull(), found)).alias("found"))
    rows = rows.select("row", F.map_from_entries("found").alias("found"))
    out = [f"row.c{i} AS {c}" for i, c in enumerate(kept)]
    out += [alias(f"try_element_at(found, {i})", f"{c}{suffix}") for i, c in enumerate(columns)]
    return rows.selectExpr(*out)


def _struct_type(df: DataFrame) -> str:
    return "STRUCT<" + ", ".join(f"c{i}: {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields)) + ">"
