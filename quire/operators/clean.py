"""Header and cell cleaning. Each operator is one ``toDF`` or one
``selectExpr`` however wide the table is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quire.functions import text
from quire.functions.names import clean_names, duplicates
from quire.functions.program import apply_rule


def clean_header(df: DataFrame, rules: str = "csv", raw_names: Sequence[object | None] | None = None,
                 allow_duplicates: bool | None = None) -> DataFrame:
    """Rename columns by the ``csv`` or ``parquet`` header rules.

    ``raw_names`` is the raw header row when it holds empty (``None``) cells
    or was read separately (``sources.read_raw_header``). Duplicate names are
    kept for CSV and refused for Parquet (a Parquet file cannot hold them).
    """
    raw = list(df.columns) if raw_names is None else list(raw_names)
    if len(raw) != len(df.columns):
        raise ValueError(f"header has {len(raw)} cells, table has {len(df.columns)} columns")
    names = clean_names(raw, rules)
    if allow_duplicates is None:
        allow_duplicates = rules == "csv"
    dup = duplicates(names)
    if dup and not allow_duplicates:
        raise ValueError(f"duplicate column names after cleaning: {dup[:10]}")
    return df.toDF(*names)


def clean_header_csv(df: DataFrame, raw_names: Sequence[object | None] | None = None) -> DataFrame:
    return clean_header(df, "csv", raw_names)


def clean_header_parquet(df: DataFrame, raw_names: Sequence[object | None] | None = None) -> DataFrame:
    return clean_header(df, "parquet", raw_names)


def _cellwise(df: DataFrame, rule, columns: Sequence[str] | None) -> DataFrame:
    return apply_rule(df, rule, columns)


def sanitize_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV cell rule on every (or the chosen) column; results are text."""
    return _cellwise(df, text.sanitize, columns)


def stringify_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet cell rule: null -> '', else the Python text of the value."""
    return _cellwise(df, text.stringify, columns)


def fill_empty(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Remaining nulls in text columns become ''. Other types are untouched."""
    return df.na.fill("", subset=list(columns) if columns is not None else None)


def numeric_or_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text cell: a number is rewritten in its numeric text form, anything
    else keeps its original text. Other column types are untouched."""
    return _cellwise(df, text.numeric_or_text, columns)


def clean_csv_table(df: DataFrame, raw_names: Sequence[object | None] | None = None) -> DataFrame:
    """The CSV conversion: header by CSV rules, every cell sanitised text."""
    return sanitize_cells(clean_header_csv(df, raw_names))


def clean_parquet_table(df: DataFrame, raw_names: Sequence[object | None] | None = None) -> DataFrame:
    """The Parquet conversion: header by Parquet rules, every cell text, null as ''."""
    return stringify_cells(clean_header_parquet(df, raw_names))
