"""File sources: CSV with null tokens, raw header rows, tagged multi-file
scans, ordered text lines and variable dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.names import clean_names
from quire.functions.sqltext import alias, ident, lit
from quire.functions.text import EXTRA_LINE_BREAK_CLASS
from quire.sources.inference import infer_types

NULL_TOKEN = "#NULL!"

# Reader options that keep text exactly as written (no trimming, "" stays "").
CSV_READ_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def null_cells(df: DataFrame, null_tokens: Sequence[str]) -> DataFrame:
    """Text cells that are a null token become null."""
    if not null_tokens:
        return df
    tokens = ", ".join(lit(t) for t in null_tokens)
    return df.selectExpr(*(alias(f"CASE WHEN {ident(c)} IN ({tokens}) THEN NULL ELSE {ident(c)} END", c) for c in df.columns))


def cast_cells(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns, by position, as the types of ``schema``; null where they are not."""
    if all(isinstance(f.dataType, T.StringType) for f in schema):
        return df
    return df.selectExpr(*(ident(c) if isinstance(f.dataType, T.StringType) else alias(f"try_cast({ident(c)} AS {f.dataType.simpleString()})", c)
                           for c, f in zip(df.columns, schema)))


def read_csv(spark: SparkSession, path: str | Sequence[str], *,
             schema: T.StructType | str | None = None,
             null_tokens: Sequence[str] = (NULL_TOKEN,),
             header: bool = True, multiline: bool = False,
             header_rules: str | None = None, sampling_ratio: float | None = None) -> DataFrame:
    """CSV scan with a header row and null tokens.

    Cells are read as text; empty cells and those equal to a null token, of
    however many, are null, and the rest is cast to ``schema`` (a cell that is
    not of its type is null). Without ``schema`` the types are those that hold
    every value (``inference``), found by one aggregate over all rows or, with
    ``sampling_ratio``, a fraction of them; give a schema at scale to spare it.
    ``header_rules`` ("csv" / "parquet") cleans the raw header row.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.options(header=str(header).lower(),
                                multiLine=str(multiline).lower(), **CSV_READ_OPTIONS)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    df = null_cells(reader.csv(paths), null_tokens)
    df = cast_cells(df, infer_types(df, sampling_ratio) if schema is None else schema)
    if header_rules and header:
        raw = read_raw_header(spark, paths[0], multiline=True)
        df = df.toDF(*clean_names(raw, header_rules))
    return df


def read_raw_header(spark: SparkSession, path: str, multiline: bool = True) -> list[str | None]:
    """First record of the first file, empty cells as ``None``.

    Parsed by Spark's CSV parser so quoted header cells may hold newlines;
    the scan stops after one record.
    """
    first = spark.read.text(path).inputFiles()
    target = sorted(first)[0] if first else path
    row = (spark.read.options(header="false", multiLine=str(multiline).lower(), **CSV_READ_OPTIONS)
           .csv(target).limit(1).collect())
    return list(row[0]) if row else []


def _uri_decode(c: F.Column) -> F.Column:
    # A URI path keeps "+" literally; protect it from form decoding.
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def tagged_scan(spark: SparkSession, paths: Sequence[str], *, fmt: str = "parquet",
                schema: T.StructType | str | None = None, tag: str = "source",
                pattern: str | None = None, partition_value: bool = False,
                options: dict[str, str] | None = None) -> DataFrame:
    """Scan several sources as one table, each row tagged with where it came from.

    The tag is the decoded file path of each row (``_metadata.file_path``),
    optionally narrowed to a regex group (``pattern``); with
    ``partition_value`` the group is also unescaped the way Spark escapes
    ``key=value`` folder names. ``file_name`` is not used: part files of
    one partitioned write share names across folders.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(list(paths))
    src = _uri_decode(F.col("_metadata.file_path"))
    tag_col = F.regexp_extract(src, pattern, 1) if pattern else src
    if partition_value:
        tag_col = _uri_decode(tag_col)
    return df.withColumn(tag, tag_col)


FILE_POSITION = ["_file", "_block", "_row"]


def with_file_position(df: DataFrame) -> DataFrame:
    """Add the position of each row in its source files: file path, split
    offset and a row id increasing through the split. Ordering by
    ``FILE_POSITION`` is file order (files by path, then line order), so
    ``batch_preview(df, FILE_POSITION)`` numbers batches as a sequential
    reader would. Call it directly on a file scan, before any filter."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with a position key that keeps file order without one task.

    Columns: ``file``, ``block`` (byte offset of the split), ``seq`` (row
    id, increasing within a split), ``sub`` (piece of a line split on the
    rarer Python line breaks) and ``line``. Ordering by
    (file, block, seq, sub) is the file order; no window spans a whole file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value"),
    )
    return raw.select(
        "file", "block", "seq",
        F.posexplode(F.split("value", EXTRA_LINE_BREAK_CLASS, -1)).alias("sub", "line"),
    )


def read_variables(spark: SparkSession, path: str | Sequence[str], *,
                   dataset: str | None = None) -> DataFrame:
    """Variable dictionary CSV (at least ``name`` and ``type``), all rows,
    with its declared order as ``ordinal`` (0-based position over the files
    in path order, then line order)."""
    from quire.operators.chunks import with_file_index  # local: avoids a cycle

    out = with_file_index(read_csv(spark, path, null_tokens=(), multiline=False), index_col="ordinal")
    if dataset is not None:
        out = out.withColumn("dataset", F.lit(dataset))
    return out
