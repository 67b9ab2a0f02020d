"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. A matcher looks at a block of
two words at the end of a window of the text: its shift table says how far the
search can jump when no pattern has that block near its end; where the shift is
zero, the patterns that end their first part there are picked by the block and
by their own first block, and compared word by word.

The items are dealt into sets of bounded size; each set is broadcast on its own
and run against all documents, so memory does not grow with the benchmark.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; items whose id is null are left out; repeated items count
once by id; rows with equal doc_id are judged one by one; an empty benchmark
hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, materialize, on_workers, read_table, worker_cache

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Text bytes of benchmark items in one set of patterns.
SET_BYTES = 16 << 20
#: Patterns are searched by length classes, so short ones do not spoil the shifts of long ones.
CLASSES = ((10, None), (5, 9), (2, 4), (1, 1))


def words(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())  # bytes.lower() changes A-Z only


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(item) <= size:
        return [tuple(item)] if item else []
    return [tuple(item[i:i + size]) for i in range(len(item) - size + 1)]


class WuManber:
    """All occurrences of word patterns that are at least ``m`` words long."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = min(map(len, patterns))
        self.b = min(2, self.m)
        self.most = self.m - self.b + 1
        self.shift: dict = {}
        self.found: dict = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for j in range(self.b, self.m + 1):
                block = p[j - self.b:j]
                if self.shift.get(block, self.most) > self.m - j:
                    self.shift[block] = self.m - j
            self.found[p[self.m - self.b:self.m]][p[:self.b]].append(p)
        self.found = {k: dict(v) for k, v in self.found.items()}

    def search(self, text: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(place of the first word, pattern) of every occurrence."""
        m, b, most, shift, n = self.m, self.b, self.most, self.shift.get, len(text)
        i = m  # the end of the window's first m words
        while i <= n:
            block = (text[i - 2], text[i - 1]) if b == 2 else (text[i - 1],)
            s = shift(block, most)
            if s:
                i += s
                continue
            at = i - m
            for p in self.found[block].get(tuple(text[at:at + b]), ()):
                if tuple(text[at:at + len(p)]) == p:
                    yield at, p
            i += 1


class Matcher:
    """Hits of a set of (item_id, text) in documents."""

    def __init__(self, items: list[tuple[int, bytes]], size: int = WINDOW):
        self.items: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, text in items:
            for w in windows(words(text), size):
                self.items[w].add(item)
        classes = [[p for p in self.items if low <= len(p) <= (high or len(p))] for low, high in CLASSES]
        self.parts = [WuManber(c) for c in classes if c]

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges covered by occurrences, and the items that occur."""
        ranges, items = [], set()
        for part in self.parts:
            for at, p in part.search(text):
                ranges.append((at, at + len(p)))
                items |= self.items[p]
        ranges.sort()
        merged: list[tuple[int, int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def item_sets(benchmark: DataFrame, set_bytes: int = SET_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items in sets of about ``set_bytes``, one at a time on the driver."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text") + 32).alias("n")).first()["n"] or 0
    n = total // set_bytes + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], bytes(r["text"])) for r in part.collect()]


def _matcher(items) -> Matcher:
    """Built once per worker for a broadcast set."""
    return worker_cache(("matcher", items.bid), lambda: Matcher(items.value))


class _Set:
    """A broadcast set with an id that survives the trip to the workers."""

    def __init__(self, spark: SparkSession, items: list):
        self._b = spark.sparkContext.broadcast(items)
        self.bid = self._b._jbroadcast.id() if hasattr(self._b, "_jbroadcast") else id(items)

    def __getstate__(self):
        return {"_b": self._b, "bid": self.bid}

    @property
    def value(self):
        return self._b.value


_FOUND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()),
                    ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
_FOUND_DDL = "doc_id long, row long, n_words long, starts array<long>, stops array<long>, items array<long>"


def _found_in(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(items)
        for batch in batches:
            n, starts, stops, got = [], [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                text = words(t or b"")
                ranges, hit = m.hits(text)
                n.append(len(text))
                starts.append([a for a, _ in ranges])
                stops.append([b for _, b in ranges])
                got.append(sorted(hit))
            cols = [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64())]
            cols += [pa.array(x, pa.list_(pa.int64())) for x in (starts, stops, got)]
            yield pa.RecordBatch.from_arrays(cols, schema=_FOUND)
    return run


def find(docs: DataFrame, benchmark: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """Per document: ``n_words``, merged hit ranges ``hits`` (start, stop in
    words) and ``items`` (ids of the items that occur, ascending)."""
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    # Without a benchmark there is still one (empty) set, so every document is counted.
    sets = [rows.mapInArrow(_found_in(_Set(spark, s)), _FOUND_DDL) for s in item_sets(benchmark, set_bytes)]
    if len(sets) == 1:
        return sets[0].select("doc_id", "n_words", F.arrays_zip("starts", "stops").alias("hits"), "items")
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    one = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                   F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("hits"),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return one.select("doc_id", "n_words", _merged("hits").alias("hits"), "items")


def _merged(ranges: str) -> F.Column:
    """Overlapping ranges of a document joined, in order."""
    kind = "array<struct<starts:bigint,stops:bigint>>"
    last = lambda acc: F.element_at(acc, -1)
    one = lambda a, b: F.array(F.struct(a.alias("starts"), b.alias("stops")))
    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["starts"] <= last(acc)["stops"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), one(last(acc)["starts"], F.greatest(last(acc)["stops"], x["stops"]))),
    ).otherwise(F.concat(acc, one(x["starts"], x["stops"]))))


def report(found: DataFrame) -> DataFrame:
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["stops"] - x["starts"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    out = found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")))


def _clean_rows(items_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [_matcher(i) for i in items_of]
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            keep = [not any(next(p.search(w), None) for m in matchers for p in m.parts) for w in (words(t or b"") for t in texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window occurs. With
    several sets of items, what each leaves is written before the next, so a
    worker holds one set however large the benchmark is."""
    on_workers(docs.sparkSession)
    waiting = False
    for s in item_sets(benchmark, set_bytes):
        if waiting:
            docs = materialize(docs, "decontaminated")
        docs, waiting = docs.mapInArrow(_clean_rows([_Set(docs.sparkSession, s)]), docs.schema), True
    return docs
