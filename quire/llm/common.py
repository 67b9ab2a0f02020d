"""Helpers shared by the training-data operators: batches, word hashes, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialize, read_table

__all__ = ["WordHash", "batched", "crc_remainder", "documents", "few_rows", "id_text", "joined_back", "kept_by_ids",
           "materialize", "materialize_few", "mix", "ngram_hashes", "on_workers", "read_table", "text_slices", "worker_cache"]

#: Words a task remembers the hash of before it starts afresh (a cache, never a filter).
MEMO_WORDS = 200_000
#: Text bytes a task turns into arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Allocator settings of Python workers: freed blocks of a megabyte or more go
#: back to the system at once instead of staying with an idle worker.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576",
                 "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: A key with more than this share of the counted rows is hot; there are fewer than HOT_SHARE.
HOT_SHARE = 1000
#: Rows of doc ids that may be broadcast (16 bytes each in the hash relation's keys).
BROADCAST_IDS = 2_000_000
#: Rows of a few numbers in a file of a written table.
FILE_ROWS = 1 << 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def on_workers(spark: SparkSession) -> None:
    """Python workers of this session can import the package from where the
    driver did (on a cluster without a shared source tree, install it), and
    give the memory of freed arrays and batches back."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)


def release() -> None:
    """Give freed memory of this process back to the system, where it can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_CACHES: dict = {}


def worker_cache(key, make):
    """This worker's cache ``key``. Only the latest is held, so that a worker
    that goes on to another operator gives up what it remembered for the last."""
    if key not in _CACHES:
        if _CACHES:
            _CACHES.clear()
            release()
        _CACHES[key] = make()
    return _CACHES[key]


def id_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, whatever other columns there are."""
    on_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


class WordHash(dict):
    """Word bytes -> 64-bit hash, remembered for repeated words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 bytes (null: empty) in runs of about ``most`` bytes, with
    the index of the first row of each run."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or b"")
        size += len(run[-1])
        if size >= most:
            yield first, run
            first, size, run = i + 1, 0, []
    if run:
        yield first, run


def batched(rows: Iterator[list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples -> record batches."""
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, in place."""
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def ngram_hashes(words: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc *= _U(seed | 1)
        acc += words[j:j + m]
    return mix(acc)


def crc_remainder(doc_id: int | None, mod: int) -> int:
    """crc32 of the decimal text of ``doc_id`` modulo ``mod`` (null: of the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def few_rows(df: DataFrame, most: int = BROADCAST_IDS) -> bool:
    """Whether ``df`` (cheap to count: a written table) has at most ``most`` rows."""
    return df.count() <= most


def materialize_few(df: DataFrame, name: str, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``materialize`` of at most ``rows`` rows, in no more files than they fill
    with ``each``, one for each core at least, however many partitions the last
    shuffle has: a file costs a task, and on a local disk two short processes
    (chmod), each of which shares all memory of its executor while it starts."""
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))
    return materialize(df.coalesce(files), name)


def kept_by_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``docs`` whose doc_id is (``left_semi``) or isn't (``left_anti``) in ``ids``.
    The ids are broadcast only when a count proves them few; beyond that the
    planner shuffles both sides."""
    return docs.join(F.broadcast(ids) if few_rows(ids) else ids, "doc_id", how)


def joined_back(rows: DataFrame, distinct: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with what ``distinct`` (a written table with one row for each
    ``key`` of ``rows``, never null, and its count of rows) says of their key.
    Hot keys, of which there are fewer than HOT_SHARE, are broadcast, so their
    rows stay where they are; the others meet in a shuffle without large keys."""
    total = distinct.agg(F.sum(count)).head()[0] or 0
    hot, cool = F.col(count) * HOT_SHARE > total, F.col(count) * HOT_SHARE <= total
    few = F.broadcast(distinct.where(hot).drop(count))
    rest = rows.join(F.broadcast(distinct.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(distinct.where(cool).drop(count), key))
