"""Positional numbering, row caps, batch previews and chunk manifests.

A global row number is built without an unpartitioned window: range
partition + sort within partitions, then each row's local position
(low 33 bits of ``monotonically_increasing_id``) plus the row count of all
earlier partitions. The per-partition counts table has one row per
partition, so broadcasting it has a proven size bound. The sorted frame,
with its row ids, is written once as a table in the shared checkpoint
space (``session.materialize``), so both reads see the same rows, an
executor loss does not recompute a different order, and the count pass
reads a single column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialize
from quire.sources.files import with_file_position

_LOCAL_BITS = 33


def range_sorted(df: DataFrame, order_by: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by ``order_by``; partition i holds the i-th range.

    The input row id breaks ties: a key value (or a block of identical rows)
    holding a third of the table is cut across range partitions instead of
    landing in one task. File scans give the same ids on retry.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c) for c in order_by] + [F.col("_tie")]
    ranged = (tied.repartitionByRange(num_partitions, *keys) if num_partitions
              else tied.repartitionByRange(*keys))
    return ranged.sortWithinPartitions(*keys).drop("_tie")


def with_row_index(df: DataFrame, order_by: Sequence[str], *, index_col: str = "row_index",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based global position in ``order_by`` order.

    Ties in ``order_by`` are ordered by input position, fixed once the ids
    are written; partitions stay balanced however skewed the key is.
    """
    ordered = materialize(range_sorted(df, order_by, num_partitions)
                          .withColumn("_mid", F.monotonically_increasing_id()), "row-index")
    pid = F.shiftrightunsigned("_mid", _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ordered.withColumn("_pid", pid)
            .join(F.broadcast(offsets), "_pid")
            .withColumn(index_col, (F.col("_off") + local).cast("bigint"))
            .drop("_pid", "_off", "_mid"))


def with_file_index(df: DataFrame, *, index_col: str = "row_index") -> DataFrame:
    """A file scan (not filtered yet) with each row's 0-based position in file
    order: files by path, then their lines or rows.

    A split's rows are numbered by their row ids already; one pass that reads no
    column counts them, and the counts of the splits before are added. No sort
    and no written copy; the window is over one row per split.
    """
    rows = with_file_position(df)
    splits = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    return (rows.join(splits.select("_file", "_block", offset.alias("_off")), ["_file", "_block"])
            .withColumn(index_col, F.col("_off") + F.col("_row")).select(*df.columns, index_col))


#: Rows that a head may bring to the driver.
HEAD_ROWS = 10_000


def _in_files(df: DataFrame, files: Sequence[str]) -> DataFrame:
    """A file scan of only these of its files (the others are not opened). A path
    without a host is listed as ``file:///x`` and scanned as ``file:/x``."""
    spelt = {*files, *(re.sub(r"^([A-Za-z0-9+.-]+):///", r"\1:/", f) for f in files)}
    return df.where(F.col("_metadata.file_path").isin(sorted(spelt)))


def _head(df: DataFrame, n: int) -> list:
    if n > HEAD_ROWS:
        raise ValueError(f"a head of {n} rows; at most {HEAD_ROWS}, use batch_preview_file_order for more")
    rows: list = []
    for path in sorted(df.inputFiles()):
        if len(rows) >= n:
            break
        rows += _in_files(df, [path]).take(n - len(rows))
    return rows


def head_of_files(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a file scan in file order, ``n`` at most HEAD_ROWS.

    Files are opened by path, one after the other, until there are enough rows;
    ``take`` starts with the first split of a file and goes on to later ones
    only as far as it must. The rows come back as a local table.
    """
    return df.sparkSession.createDataFrame(_head(df, n), df.schema)


def _leading_files(df: DataFrame, cap: int) -> tuple[DataFrame, list[tuple]]:
    """``df`` cut to its leading files that hold ``cap`` rows, with positions,
    and the offset of each split: (file, block, offset).

    Prefixes of 1, 2, 4, ... files are counted, without reading a column, until
    one holds enough; the splits of that same scan are then numbered."""
    files, k = sorted(df.inputFiles()), 1
    while True:
        rows = with_file_position(_in_files(df, files[:k]) if k < len(files) else df)
        splits = sorted(rows.groupBy("_file", "_block").agg(F.count(F.lit(1)), F.min("_row")).collect())
        if sum(r[2] for r in splits) >= cap or k >= len(files):
            break
        k *= 2
    before, offsets = 0, []
    for file, block, n, first in splits:
        offsets.append((file, block, before - first))
        before += n
    return rows, offsets


def batch_preview_file_order(df: DataFrame, *, batch_size: int = 50_000, max_batches: int = 50,
                             row_cap: int | None = None, batch_col: str = "batch",
                             index_col: str = "row_index") -> DataFrame:
    """Rows of the first ``max_batches`` batches of a file scan in file order
    (and before ``row_cap``), numbered from 1, with their 0-based position.

    Only leading files are read: up to HEAD_ROWS rows come from the first splits
    alone (``head_of_files``), more from the leading files that hold them."""
    cap = batch_size * max_batches if row_cap is None else min(batch_size * max_batches, row_cap)
    if cap <= HEAD_ROWS:
        head = [(*r, i) for i, r in enumerate(_head(df, cap))]
        schema = T.StructType([*df.schema.fields, T.StructField(index_col, T.LongType())])
        numbered = df.sparkSession.createDataFrame(head, schema)
    else:
        rows, offsets = _leading_files(df, cap)
        # One row per split of the leading files.
        splits = df.sparkSession.createDataFrame(offsets, "_file string, _block long, _off long")
        numbered = rows.join(F.broadcast(splits), ["_file", "_block"]).withColumn(index_col, F.col("_off") + F.col("_row"))
        numbered = numbered.where(F.col(index_col) < F.lit(cap)).select(*df.columns, index_col)
    return numbered.withColumn(batch_col, F.expr(f"`{index_col}` div {int(batch_size)}") + 1)


#: Keys drawn per round of a rank selection; as many are sorted in the end.
SELECT_SAMPLE = 4096


def _at(keys: Sequence[str], row: Sequence, types: dict[str, T.DataType]) -> F.Column:
    return F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, row)])


def _between(df: DataFrame, keys: Sequence[str], low: tuple | None, high: tuple | None) -> DataFrame:
    """Rows with key above ``low`` and below ``high``. The test of the leading
    key alone is implied, but reaches the scan (row groups are pruned)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    key, lead = F.struct(*[F.col(k) for k in keys]), F.col(keys[0])
    if low is not None:
        df = df.where(key > _at(keys, low, types))
        df = df.where(lead >= F.lit(low[0]).cast(types[keys[0]])) if low[0] is not None else df
    if high is not None:
        df = df.where(key < _at(keys, high, types))
        df = df.where(lead.isNull() | (lead <= F.lit(high[0]).cast(types[keys[0]]))) if high[0] is not None else df.where(lead.isNull())
    return df


def nth_key(df: DataFrame, n: int, order_by: Sequence[str], sample: int = SELECT_SAMPLE) -> tuple[tuple, int, int] | None:
    """The ``n``-th key (from 1) in ``order_by`` order, nulls first, the rows below
    it and the rows up to it; None if there are fewer rows than ``n``.

    Rank selection: a sample of the keys still in question gives three candidates
    about position ``n``, one aggregate counts the rows below and up to each, and
    only the keys between two of them stay in question, until one candidate is the
    key or few enough are left to be sorted. Rows are neither sorted, exchanged nor
    written; each round reads the key columns of the range twice.
    """
    keys = list(order_by)
    rows = df.select(*[F.col(k) for k in keys])
    types = {f.name: f.dataType for f in rows.schema.fields}
    low = high = None
    below, left, seed = 0, rows.count(), 0
    if n > left or n < 1:
        return None
    while True:
        part = _between(rows, keys, low, high)
        if left <= sample:
            got = [tuple(r) for r in part.orderBy(*keys).collect()]
            at = n - below - 1
            first = next(i for i in range(at + 1) if same_key(got[i], got[at]))
            last = next((i for i in range(at, len(got)) if not same_key(got[i], got[at])), len(got))
            return got[at], below + first, below + last
        seed += 1
        drawn = [tuple(r) for r in part.sample(sample / left, seed=seed).orderBy(*keys).collect()]
        if not drawn:
            continue
        middle, spread = (n - below) / left * len(drawn), 2 * math.sqrt(len(drawn)) + 1
        tries = [drawn[min(max(int(i), 0), len(drawn) - 1)] for i in (middle - spread, middle, middle + spread)]
        key = F.struct(*[F.col(k) for k in keys])
        counts = part.agg(*(F.count(F.when(t, 1)) for x in tries for t in (key < _at(keys, x, types), key <= _at(keys, x, types)))).head()
        most = left
        start = below
        for x, less, upto in zip(tries, counts[::2], counts[1::2]):
            if start + less < n <= start + upto:
                return x, start + less, start + upto
            if start + upto < n:
                low, below = x, start + upto
            elif less < most:
                high, most = x, less
        left = start + most - below


def same_key(a: tuple, b: tuple) -> bool:
    return all(x == y or x != x and y != y for x, y in zip(a, b))


def _first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows surely among the first ``n``, the rows of the ``n``-th key if not all
    of them are, and how many of those are."""
    keys = list(order_by)
    found = nth_key(df, n, keys)
    if found is None:
        return (df if n > 0 else df.limit(0)), None, 0
    last, below, upto = found
    types = {f.name: f.dataType for f in df.schema.fields}
    lead, key = F.col(keys[0]), F.struct(*[F.col(k) for k in keys])
    # The test of the leading key alone is implied by the bound but reaches the scan.
    near = lead.isNull() if last[0] is None else lead.isNull() | (lead <= F.lit(last[0]).cast(types[keys[0]]))
    edge = _at(keys, last, types)
    if upto == n:
        return df.where(near & (key <= edge)), None, 0
    return df.where(near & (key < edge)), df.where(near & key.eqNullSafe(edge)), n - below


def first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The rows whose key is at or below the ``n``-th key in ``order_by``
    order (the first ``n`` rows plus any ties with the ``n``-th).

    The key is found by ``nth_key``; the full rows are then filtered to keys at
    or below it (the leading key also as a plain comparison, which reaches the
    Parquet scan as a pushed filter). The table is never sorted or written.
    """
    rows, ties, _ = _first_rows(df, n, order_by)
    return rows if ties is None else rows.unionByName(ties)


def scan_row_cap(df: DataFrame, n: int = 1_000_000, order_by: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows. Unordered: any ``n`` (a plain limit). Ordered: the
    first ``n`` in key order, by a filter at the ``n``-th key (``nth_key``); only
    where ties straddle position ``n``, the tied rows are numbered and cut."""
    if not order_by:
        return df.limit(n)
    rows, ties, more = _first_rows(df, n, order_by)
    if ties is None:
        return rows
    cut = with_row_index(ties, order_by, index_col="_pos").where(F.col("_pos") < more)
    return rows.unionByName(cut.select(*df.columns))


def batch_preview(df: DataFrame, order_by: Sequence[str], *, batch_size: int = 50_000,
                  max_batches: int = 50, batch_col: str = "batch",
                  index_col: str = "row_index") -> DataFrame:
    """Rows of the first ``max_batches`` batches, numbered from 1, with their
    0-based global position."""
    cap = batch_size * max_batches
    indexed = with_row_index(first_rows(df, cap, order_by), order_by, index_col=index_col)
    return (indexed.where(F.col(index_col) < F.lit(cap))
            .withColumn(batch_col, F.expr(f"`{index_col}` div {int(batch_size)}") + 1))


def chunk_manifest(df: DataFrame, chunk_size: int = 50_000) -> DataFrame:
    """One row per chunk of ``chunk_size`` consecutive rows: chunk number
    (from 1), its rows, the running total after it, and the width.

    Chunks are consecutive and full except the last, so the table follows
    from the row count alone: one count (answered from Parquet footers when
    possible) and a distributed ``range``; no sort, no shuffle.
    """
    spark = df.sparkSession
    n = df.count()
    width = len(df.columns)
    n_chunks = max(0, math.ceil(n / chunk_size))
    size = F.lit(chunk_size).cast("bigint")
    total = F.lit(n).cast("bigint")
    return spark.range(1, n_chunks + 1).select(
        F.col("id").alias("chunk"),
        F.least(size, total - (F.col("id") - 1) * size).alias("rows"),
        F.least(F.col("id") * size, total).alias("rows_total"),
        F.lit(width).alias("n_columns"),
    )
