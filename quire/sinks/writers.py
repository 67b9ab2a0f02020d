"""Sinks. Every write replaces its target atomically through Spark's commit
protocol (``mode="overwrite"``) unless appending is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.sources.profile import bytes_on_disk

# CSV with minimal quoting that round-trips any text: quotes are doubled,
# "" and null are both written as nothing, outer spaces are kept.
CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite", null_token: str | None = None,
              max_records_per_file: int | None = None, options: dict[str, str] | None = None) -> str:
    w = df.write.mode(mode).options(**CSV_WRITE_OPTIONS)
    if null_token is not None:
        w = w.option("nullValue", null_token)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.options(**(options or {})).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite", compression: str = "zstd",
                  row_group_rows: int | None = None, max_records_per_file: int | None = None) -> str:
    """Parquet with dictionary encoding and statistics (writer defaults).
    ``row_group_rows`` caps rows per row group, like a chunk size."""
    w = df.write.mode(mode).option("compression", compression)
    if row_group_rows:
        w = w.option("parquet.block.row.count.limit", str(row_group_rows))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] | str, *, fmt: str = "csv",
                      mode: str = "overwrite", files_per_value: int | None = None) -> str:
    """One folder per value of ``by`` (one file set per sheet).

    By default there is no shuffle by the partition value: every task writes
    its own rows, so a value holding a third of the table is spread over all
    tasks instead of landing in one (at the price of one file per value per
    task). ``files_per_value`` clusters rows by (value, salt) first: each
    value gets at most that many files, and a hot value is still written by
    that many tasks. The salt is a hash of the input row id, stable on retry.
    """
    cols = [by] if isinstance(by, str) else list(by)
    if files_per_value:
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(int(files_per_value)))
        df = df.repartition(*[F.col(c) for c in cols], salt)
    w = df.write.mode(mode).partitionBy(*cols)
    if fmt == "csv":
        w = w.options(**CSV_WRITE_OPTIONS)
    w.format(fmt).save(path)
    return path


def write_text(df: DataFrame, path: str, column: str, *, mode: str = "overwrite") -> str:
    df.select(column).write.mode(mode).text(path)
    return path


def write_with_report(df: DataFrame, path: str, *, fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` (replacing ``path``) and report what the write did, as one
    row: rows (counted by the tasks that wrote them, an observation), files,
    bytes and gb (of the files listed afterwards)."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").options(**(options or {})).format(fmt).save(path)
    rows = F.lit(seen.get.get("rows") or 0).cast("long").alias("rows")
    return bytes_on_disk(df.sparkSession, path).select(rows, "files", "bytes", "gb")
