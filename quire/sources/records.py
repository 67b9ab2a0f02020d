"""CSV records with quoted line breaks, read in splits.

Files are cut into physical lines at ``\n`` only. A quote opens a cell only at
its start; a line begins a record when no cell is open before it. What a split
does to that state is known without the splits before it: one pass gives, for
either state at its start, the state at its end and the text up to the end of
the record that was open. From that table, one row per split, follow the state
at the start of every split and the rest of the records that run over its end.
A second pass then puts the lines of each record together as they come: no line
is moved between tasks, and a task holds one open record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialize
from quire.sources.files import CSV_READ_OPTIONS, NULL_TOKEN, cast_cells, null_cells, read_raw_header

_BOM = "\ufeff"
_RECORD_OPTIONS = {**CSV_READ_OPTIONS, "multiLine": "true", "lineSep": "\n"}

#: Pieces of a line from the start of a cell, each closed: a quoted piece before
#: a doubled quote, the rest of a cell with its comma, or an empty cell.
_PIECES = re.compile(r'(?:"[^"]*+"(?:(?=")|[^,"][^,]*+(?:,|\Z)|,|\Z)|[^",][^,]*+(?:,|\Z)|,)*+')
#: Longest header and record, in characters.
MAX_HEADER = MAX_RECORD = 1 << 26
#: Longest rest of an open record that the first pass keeps; of a longer one,
#: which few splits start with, the lines are read again.
MAX_REST = 1 << 16


def _opens(text: str) -> bool:
    """Whether a quoted cell is open after ``text``, which starts at a cell."""
    return _PIECES.match(text).end() < len(text)


def _closes(line: str) -> bool:
    """Whether the cell that is open before ``line`` (and any later one) is closed after it."""
    return '"' in line and not _opens('"' + line)


def _too_long(limit: int) -> ValueError:
    return ValueError(f"a record of more than {limit} characters; is a quote left open?")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Runs of lines of one split: the other columns of the first, and the lines."""
    for b in batches:
        if b.num_rows:
            values = b.column("value").to_pylist()
            ids = b.column("sid")
            cut = [0, *pc.indices_nonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1))).to_numpy() + 1, b.num_rows] if b.num_rows > 1 else [0, 1]
            for lo, hi in zip(cut[:-1], cut[1:]):
                yield {c: b.column(c)[int(lo)].as_py() for c in b.schema.names if c != "value"}, values[int(lo):int(hi)]


_STATES = "sid long, file string, block long, end0 boolean, end1 boolean, closes boolean, rest string"
_STATES_ARROW = pa.schema([("sid", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()),
                           ("closes", pa.bool_()), ("rest", pa.string())])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: the state at its end if no cell (end0) or one (end1) is
    open at its start, and for the latter whether and with which text it closes."""
    sid, now = None, None

    def row() -> pa.RecordBatch:
        rest = None if now["long"] else "\n".join(now["rest"])
        return pa.RecordBatch.from_pylist([{**now["at"], "end0": now["end0"], "end1": now["end1"], "closes": now["closes"], "rest": rest}], _STATES_ARROW)

    for at, lines in _lines(batches):
        if at["sid"] != sid:
            if now:
                yield row()
            sid, now = at["sid"], {"at": at, "end0": False, "end1": True, "closes": False, "rest": [], "size": 0, "long": False}
        for line in lines:
            quoted = '"' in line
            if quoted:
                after = _opens(line), not _closes(line)
                now["end0"] = after[now["end0"]]
            if not now["closes"]:
                now["size"] += len(line) + 1
                now["long"] |= now["size"] > MAX_REST
                if now["long"]:
                    now["rest"] = []
                else:
                    now["rest"].append(line)
                if quoted and not after[1]:
                    now["closes"], now["end1"] = True, False
            elif quoted:
                now["end1"] = after[now["end1"]]
    if now:
        yield row()


def _rests(limit: int):
    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text up to the end of the record that is open at the start of each split."""
        sid, closed, rest = None, True, []
        make = lambda: pa.RecordBatch.from_pylist([{"sid": sid, "rest": "\n".join(rest)}], pa.schema([("sid", pa.int64()), ("rest", pa.string())]))
        for at, lines in _lines(batches):
            if at["sid"] != sid:
                if sid is not None:
                    yield make()
                sid, closed, rest, size = at["sid"], False, [], 0
            for line in lines if not closed else ():
                rest.append(line)
                size += len(line) + 1
                if size > limit:
                    raise _too_long(limit)
                if _closes(line):
                    closed = True
                    break
        if sid is not None:
            yield make()
    return rests


_RECORDS = "sid long, seq long, record string, first boolean, cut boolean"
_RECORDS_ARROW = pa.schema([("sid", pa.int64()), ("seq", pa.int64()), ("record", pa.string()), ("first", pa.bool_()), ("cut", pa.bool_())])


def _assembled(limit: int):
    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records that begin in each split, in order; ``first``: of its file,
        ``cut``: the split ends within it."""
        sid, buffer, opened, size, skip, first = None, [], 0, 0, False, False

        def batch(seqs: list, records: list, firsts: list, cut: bool = False) -> pa.RecordBatch:
            n = len(seqs)
            return pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.int64()), pa.array(seqs, pa.int64()), pa.array(records, pa.string()),
                                               pa.array(firsts, pa.bool_()), pa.array([cut] * n, pa.bool_())], schema=_RECORDS_ARROW)

        for at, lines in _lines(batches):
            if at["sid"] != sid:
                if buffer:
                    yield batch([opened], ["\n".join(buffer)], [first], True)
                sid, buffer, skip, first = at["sid"], [], at["before"], at["leads"]
            seqs, records, firsts = [], [], []
            for seq, line in enumerate(lines, at["seq"]):
                if skip:
                    skip = not _closes(line)
                    continue
                if buffer:
                    buffer.append(line)
                    size += len(line) + 1
                    if not _closes(line):
                        if size > limit:
                            raise _too_long(limit)
                        continue
                    line, seq, buffer = "\n".join(buffer), opened, []
                elif '"' in line and _opens(line):
                    buffer, opened, size = [line], seq, len(line)
                    continue
                if len(line) > limit:
                    raise _too_long(limit)
                seqs.append(seq)
                records.append(line)
                firsts.append(first)
                first = False
            yield batch(seqs, records, firsts)
        if buffer:
            yield batch([opened], ["\n".join(buffer)], [first], True)
    return assembled


def _split_table(lines: DataFrame, limit: int) -> DataFrame:
    """Written table, one row per split: sid, file, block, before (a cell is open
    at its start), more (the rest of the record that is open at its end)."""
    splits = materialize(lines.drop("seq").mapInArrow(_states, _STATES), "splits")
    # Each split sets the state, flips it or leaves it. The windows see one row per split.
    files = Window.partitionBy("file").orderBy("block")
    earlier, here = files.rowsBetween(Window.unboundedPreceding, -1), files.rowsBetween(Window.unboundedPreceding, 0)
    flip = (F.col("end0") & ~F.col("end1")).cast("int")
    splits = splits.withColumn("flips", F.sum(flip).over(here))
    fixed = F.when(F.col("end0") == F.col("end1"), F.col("end0").cast("int") + F.col("flips"))
    splits = splits.withColumn("fixed", fixed)
    state = (F.coalesce(F.last("fixed", ignorenulls=True).over(earlier), F.lit(0)) + F.col("flips") - flip) % 2 == 1
    splits = splits.withColumn("before", state)
    # The split in which the record open at the start of this one begins.
    begins = F.when(~F.col("before") | F.col("closes"), F.col("block"))
    splits = materialize(splits.withColumn("owner", F.last(begins, ignorenulls=True).over(earlier)), "splits")
    open_ = splits.where("before")
    again = open_.where("rest is null").select("sid")
    rest = open_.select("sid", "file", "owner", "block", "rest").where("rest is not null")
    if not again.isEmpty():
        found = lines.drop("seq", "file", "block").join(F.broadcast(again), "sid", "left_semi").mapInArrow(_rests(limit), "sid long, rest string")
        rest = rest.unionByName(found.join(open_.drop("rest"), "sid").select("sid", "file", "owner", "block", "rest"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "rest"))), lambda x: x["rest"]), "\n")
    more = rest.groupBy("file", F.col("owner").alias("block")).agg(text.alias("more"))
    return materialize(splits.select("sid", "file", "block", "before").join(more, ["file", "block"], "left"), "splits")


def _records(spark: SparkSession, path: str | Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(sid, seq, record, first) of all records, and the table of splits."""
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text([path] if isinstance(path, str) else list(path)).select(
        F.xxhash64(file, block).alias("sid"), file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    splits = _split_table(lines, limit)
    # Lines stay in place and order: what is broadcast is one number per split.
    opened = splits.where("before").select("sid", F.lit(True).alias("before"))
    rows = lines.select("sid", "seq", "value", (F.col("block") == 0).alias("leads")).join(F.broadcast(opened), "sid", "left")
    rows = rows.withColumn("before", F.coalesce("before", F.lit(False))).mapInArrow(_assembled(limit), _RECORDS)
    more = splits.where("more is not null").select(F.col("sid").alias("s"), F.lit(True).alias("c"), "more")
    rows = rows.join(more, (F.col("sid") == F.col("s")) & (F.col("cut") == F.col("c")), "left")
    text = F.when(F.col("more").isNull(), F.col("record")).otherwise(F.concat("record", F.lit("\n"), "more"))
    text = F.when(F.length(text) <= limit, F.regexp_replace(text, r"\r\z", "")).otherwise(
        F.raise_error(F.lit(str(_too_long(limit)))).cast("string"))
    return rows.select("sid", "seq", "first", F.when(F.col("first"), F.ltrim(text, F.lit(_BOM))).otherwise(text).alias("record")), splits


def read_records(spark: SparkSession, path: str | Sequence[str], max_record: int = MAX_RECORD) -> DataFrame:
    """(file, block, seq, record): every record's text.

    ``block`` and ``seq`` are the split and row id of its first line; ordering by
    (file, block, seq) is the order of the files, which the rows of a split keep.
    The byte order mark of a file and the ``\r`` of a ``\r\n`` line end are not
    part of a record. A record of more than ``max_record`` characters, as a quote
    that is never closed makes one, is an error.
    """
    records, splits = _records(spark, path, max_record)
    return records.join(splits.select("sid", "file", "block"), "sid", "left").select("file", "block", "seq", "record")


def _header_text(spark: SparkSession, path: str | Sequence[str]) -> tuple[str, str | None]:
    """First file and its first record; only the lines of that record are read."""
    files = spark.read.text([path] if isinstance(path, str) else list(path)).inputFiles()
    if not files:
        return "", None
    target, n = min(files), 1
    while True:
        got = [r["value"] for r in spark.read.option("lineSep", "\n").text(target).take(n)]
        for k in range(len(got)):
            text = "\n".join(got[:k + 1])
            if len(text) > MAX_HEADER:
                raise ValueError(f"the header of {target} has more than {MAX_HEADER} characters; is a quote left open?")
            if not _opens(text):
                return target, text.removesuffix("\r").lstrip(_BOM)
        if len(got) < n:
            return target, "\n".join(got).removesuffix("\r").lstrip(_BOM) if got else None
        n *= 4


def read_csv_records(spark: SparkSession, path: str | Sequence[str], *, schema: T.StructType | str | None = None,
                     null_tokens: Sequence[str] = (NULL_TOKEN,), max_record: int = MAX_RECORD) -> DataFrame:
    """CSV with a header row whose cells may hold line breaks, splits in file order.

    All files must have the header of the first one; another header is an error
    when the rows are read. Without ``schema`` every column is text; with it,
    columns go by position, and a cell that is not of its type is null. An empty
    cell, quoted or not, is null, as in ``read_csv``. Null tokens are treated
    alike however many there are. Empty lines are skipped. A record of more than
    ``max_record`` characters is an error.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    target, header = _header_text(spark, path)
    raw = read_raw_header(spark, target) if header is not None else []
    names = schema.names if schema is not None else [n if n is not None else f"_c{i}" for i, n in enumerate(raw)]
    cols = [f"c{i}" for i in range(len(names))]
    if not cols:
        return spark.createDataFrame([], T.StructType([]))
    records, _ = _records(spark, path, max_record)
    other = F.raise_error(F.concat(F.lit("another header than the first file's: "), F.substring("record", 1, 200))).cast("boolean")
    is_row = F.when(~F.col("first"), F.lit(True)).when(F.col("record") == header, F.lit(False)).otherwise(other)
    rows = records.where(is_row).where("record != ''")
    cells = rows.select(F.from_csv("record", ", ".join(f"{c} string" for c in cols), _RECORD_OPTIONS).alias("r")).select("r.*")
    types = T.StructType([T.StructField(c, f.dataType) for c, f in zip(cols, schema)]) if schema is not None else None
    cells = null_cells(cells, null_tokens)
    return (cast_cells(cells, types) if types else cells).toDF(*names)
