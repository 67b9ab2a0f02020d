"""Dataset facts: rows, width, leading column names, rows per file, bytes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.sqltext import literal_frame


def dataset_profile(spark: SparkSession, tables: Mapping[str, DataFrame], preview: int = 5) -> DataFrame:
    """One row per table: name, rows, columns and the first ``preview`` names.

    All tables are counted in one job: each scan is reduced to its name
    (no column is read), the scans are unioned and counted in one grouped
    aggregate. Width and names come from the schemas; a table with no rows
    still gets its row (count 0) from the metadata side.
    """
    names = list(tables)
    scans = [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()]
    counts = reduce(lambda a, b: a.unionAll(b), scans).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_rows"))
    meta = literal_frame(
        spark, [(n, len(tables[n].columns), ",".join(tables[n].columns[:preview])) for n in names],
        "table_name string, n_columns int, first_columns string")
    # Both sides have one row per table; the planner picks the join.
    return (meta.join(counts, "table_name", "left")
            .select("table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_columns",
                    "first_columns"))


def rows_per_file(df: DataFrame) -> DataFrame:
    """Row count of every file behind a file-based DataFrame."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("n_rows"))


#: One GB in reports, and the digits shown.
GB, GB_DIGITS = 1e9, 2


def bytes_per_file(spark: SparkSession, path: str) -> DataFrame:
    """file_path and bytes of every data file under ``path``, at any depth (a
    listing; contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("bytes"))


def bytes_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, files and gb of the data files under ``path``."""
    return (bytes_per_file(spark, path).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))
            .withColumn("gb", F.round(F.col("bytes") / F.lit(GB), GB_DIGITS)))
