"""The survey preparation steps as whole-dataset Spark jobs.

Each function reads its input with the library's sources, applies the
operators and writes with the library's sinks; paths may be local or on a
shared filesystem.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from quire.operators import chunks, labels, sections, typing
from quire.plans.convert import csv_to_parquet
from quire.sinks import writers
from quire.sources.files import NULL_TOKEN, read_csv, read_variables


def convert_survey(spark: SparkSession, csv_path: str, parquet_path: str, *,
                   null_tokens: Sequence[str] = (NULL_TOKEN,), row_group_rows: int | None = 50_000) -> str:
    """Raw survey CSV -> all-text zstd Parquet with cleaned column names."""
    return csv_to_parquet(spark, csv_path, parquet_path, null_tokens=null_tokens,
                          row_group_rows=row_group_rows)


def preview_batches(spark: SparkSession, csv_path: str, *, batch_size: int = 50_000,
                    max_batches: int = 50, row_cap: int | None = 1_000_000,
                    null_tokens: Sequence[str] = (NULL_TOKEN,)) -> DataFrame:
    """The first ``max_batches`` batches of a CSV in file order, numbered
    from 1, types inferred, null tokens as null; rows past ``row_cap`` are
    not read into any batch."""
    return chunks.batch_preview_file_order(read_csv(spark, csv_path, null_tokens=null_tokens), batch_size=batch_size,
                                           max_batches=max_batches, row_cap=row_cap)


def labels_to_csv(spark: SparkSession, codebook_path: str, out_path: str, *,
                  mode: str = "strict", signed_codes: bool = False) -> DataFrame:
    """Codebook text -> ``(vallab, code, value)`` CSV; returns the label table."""
    table = labels.read_value_labels(spark, codebook_path, mode, signed_codes=signed_codes)
    writers.write_csv(table, out_path)
    return table


def variables_to_ddl(spark: SparkSession, variables_path: str, out_path: str, table: str) -> DataFrame:
    """Variable dictionary CSV -> ``CREATE TABLE`` text file; returns the statement."""
    declared = typing.map_types(read_variables(spark, variables_path))
    ddl = typing.generate_ddl(declared, table=table)
    writers.write_text(ddl, out_path, "ddl")
    return ddl


def section_tables(spark: SparkSession, parquet_path: str, out_dir: str, keys: Sequence[str],
                   section_map: Mapping[str, Sequence[str]], *, compression: str = "zstd") -> dict[str, str]:
    """Write every section as its own Parquet table (keys + section columns).

    Each write is a column-pruned scan of the source, so the source is read
    once per section but only for that section's columns.
    """
    src = spark.read.parquet(parquet_path)
    out = {}
    for name, frame in sections.split_sections(src, keys, section_map).items():
        out[name] = writers.write_parquet(frame, f"{out_dir.rstrip('/')}/{name}", compression=compression)
    return out
