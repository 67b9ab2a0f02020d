"""End-to-end conversions built from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from quire.operators.clean import clean_csv_table, clean_parquet_table
from quire.sinks.writers import write_csv, write_parquet
from quire.sources.files import NULL_TOKEN, read_raw_header
from quire.sources.records import read_csv_records


def table_to_csv(df: DataFrame, path: str, raw_names: Sequence[object | None] | None = None,
                 max_records_per_file: int | None = None) -> str:
    """Header by CSV rules, sanitised text cells, minimal-quoting CSV."""
    return write_csv(clean_csv_table(df, raw_names), path, max_records_per_file=max_records_per_file)


def table_to_parquet(df: DataFrame, path: str, raw_names: Sequence[object | None] | None = None,
                     row_group_rows: int | None = None, compression: str = "zstd") -> str:
    """Header by Parquet rules, every cell text (null as ''), zstd Parquet."""
    return write_parquet(clean_parquet_table(df, raw_names), path, compression=compression,
                         row_group_rows=row_group_rows)


def csv_to_parquet(spark: SparkSession, csv_path: str, out_path: str, *,
                   null_tokens: Sequence[str] = (NULL_TOKEN,), row_group_rows: int | None = None) -> str:
    """A raw CSV export to all-text Parquet, header cleaned from the raw row.

    Cells may hold quoted line breaks; files are read in splits all the same
    (``read_csv_records``), rows keep their order, and all headers must agree.
    """
    raw = read_raw_header(spark, csv_path)
    df = read_csv_records(spark, csv_path, null_tokens=null_tokens,
                          schema=",".join(f"`c{i}` string" for i in range(len(raw))))
    return table_to_parquet(df, out_path, raw_names=raw, row_group_rows=row_group_rows)


def show_section_heads(df: DataFrame, keys: Sequence[str], sections: Mapping[str, Sequence[str]],
                       n: int = 5) -> None:
    """Print the first ``n`` rows of every section for a person to read.

    The heads come from one scan (``section_heads``); only ``n`` rows per
    section reach the driver.
    """
    from pyspark.sql import functions as F

    from quire.operators.sections import section_heads

    heads = section_heads(df, keys, sections, n).cache()
    try:
        for name, cols in sections.items():
            part = (heads.where(F.col("section") == name)
                    .groupBy(*keys).pivot("variable", list(cols)).agg(F.first("value")))
            print(f"-- section {name} ({len(cols)} columns)")
            part.orderBy(*keys).show(n, truncate=False)
    finally:
        heads.unpersist()
