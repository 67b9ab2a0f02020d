"""Token-id output compressed by Re-Pair grammars, with random access.

Documents are range-partitioned by id; each partition is a shard and is written
in blocks of whole documents. A block repeatedly replaces frequent adjacent
pairs of symbols by a nonterminal, never across a document's end, and stores
the rules, the expansion length of every nonterminal and where each document
starts in the compressed sequence, so one document is decoded without the rest.

Defined results: a null text is an empty one; an empty text holds the end id
only; rows with equal doc_id are separate documents in order of the hash of
their texts; a null doc_id sorts first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_text, materialize, text_slices
from .tokens import ENCODE_BYTES, encoder, tokenizer_path

END_ID = 1
#: Tokens after which a block is closed (a longer document is a block of its own).
BLOCK_TOKENS = 1 << 18
#: Least count of a pair worth a rule.
LEAST = 4

SLOT_BITS = 18

BLOCK_SCHEMA = ("shard int, block int, n_tokens long, doc_ids array<long>, doc_tokens binary, "
                "doc_places binary, alphabet binary, rules binary, lengths binary, sequence binary")
_BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()),
                          ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.binary()), ("doc_places", pa.binary()),
                          ("alphabet", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary())])


class Grammar(NamedTuple):
    """One compressed block. Symbols below len(alphabet) are ids in rank order,
    the others nonterminals; ``rules`` holds each one's pair of earlier symbols
    and ``lengths`` the ids it stands for."""

    alphabet: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.concatenate([np.ones(len(self.alphabet), np.int64), self.lengths.astype(np.int64)])

    def spelt(self, symbols: np.ndarray) -> np.ndarray:
        """The terminals of a stretch of symbols; only rules below it are opened,
        one level of them at a time."""
        d = len(self.alphabet)
        while (nt := symbols >= d).any():
            to = np.cumsum(nt + 1)
            out = np.empty(int(to[-1]), np.int64)
            pair = self.rules[symbols[nt] - d]
            out[to[~nt] - 1] = symbols[~nt]
            out[to[nt] - 2], out[to[nt] - 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a stretch of symbols."""
        return self.alphabet[self.spelt(symbols)]

    def ids(self) -> np.ndarray:
        """Ids of the whole block: every nonterminal is spelt out once, in their
        order, then the sequence is gathered from the spellings."""
        d, symbols = len(self.alphabet), self.sequence
        if not len(self.rules):
            return self.alphabet[symbols]
        spelt = self.spelt(np.arange(d, d + len(self.rules)))
        pool = np.concatenate([self.alphabet, self.alphabet[spelt]])
        size = self.sizes()
        at = np.cumsum(size) - size
        n = size[symbols]
        after = np.cumsum(n)
        total = int(after[-1]) if len(after) else 0
        return pool[np.repeat(at[symbols] - (after - n), n) + np.arange(total)]

    def token_range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of the block; only the symbols that cover them are expanded."""
        size = self.sizes()[self.sequence]
        after = np.cumsum(size)
        start, stop = max(start, 0), min(stop, int(after[-1]) if len(after) else 0)
        if start >= stop:
            return np.empty(0, "<u4")
        a, b = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left") + 1
        before = int(after[a] - size[a])
        return self.expand(self.sequence[a:b])[start - before:stop - before]


def _slots(pairs: np.ndarray) -> np.ndarray:
    """Slot of each pair in a table of 2 ** SLOT_BITS: the high bits of a product."""
    bits = 8 * pairs.dtype.itemsize
    odd = pairs.dtype.type(0x9E3779B97F4A7C15 >> (64 - bits) | 1)
    return (pairs * odd) >> pairs.dtype.type(bits - SLOT_BITS)


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[Grammar, np.ndarray]:
    """Re-Pair over one block. ``ends`` marks the last id of each document.

    A round counts all adjacent pairs, gives a rule to those whose count is
    within a factor of the most frequent one's, and replaces their occurrences
    from left to right without overlaps. Rounds go on until no pair occurs
    ``least`` times. Also returns the end marks of the sequence.
    """
    there = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there).astype("<u4")
    d = len(alphabet)
    seq, ends = (np.cumsum(there) - 1).astype(np.uint32)[ids], ends.copy()
    rules, lengths = np.empty((0, 2), np.uint32), np.empty(0, np.int64)
    while len(seq) > 1:
        base = d + len(rules)
        # A pair is one number, in the narrower type while all of them fit it.
        number = np.uint32 if base * base < np.iinfo(np.uint32).max else np.uint64
        none = number(np.iinfo(number).max)
        pairs = seq[:-1].astype(number) * number(base) + seq[1:]
        pairs[ends[:-1]] = none  # none crosses a document's end
        s = np.sort(pairs)
        s = s[:np.searchsorted(s, none)]
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
        count = np.diff(np.append(at, len(s)))
        if not len(count) or count.max() < least:
            break
        often = count >= max(least, int(count.max()) >> 5)
        # A table of hashed pairs finds them; of two in one slot the more
        # frequent stays, and the other waits for a later round.
        chosen = s[at[often]][np.argsort(count[often], kind="stable")]
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        table[_slots(chosen)] = np.arange(len(chosen))
        place = table[_slots(pairs)]
        hit = (place >= 0) & (chosen[place] == pairs)
        # In a run of overlapping occurrences take the first, third, ...
        i = np.flatnonzero(hit)
        began = np.maximum.accumulate(np.where(np.concatenate([[True], i[1:] != i[:-1] + 1]), i, 0))
        take = i[((i - began) & 1) == 0]
        uses = np.bincount(place[take], minlength=len(chosen))
        named = np.cumsum(uses > 0) - 1
        new = chosen[uses > 0]
        new = np.stack([new // number(base), new % number(base)], 1).astype(np.uint32)
        size = np.concatenate([np.ones(d, np.int64), lengths])
        seq[take] = named[place[take]] + base
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size[new].sum(1)])
        ends[take] = ends[take + 1]
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq, ends = seq[keep], ends[keep]
    return Grammar(alphabet, rules.astype("<u4"), lengths.astype("<u4"), seq.astype("<u4")), ends


def _block(shard: int, block: int, doc_ids: list, encoded: list) -> list:
    ids = np.frombuffer(b"".join(encoded), "<u4")
    n = np.array([len(e) // 4 for e in encoded], np.int64)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(n) - 1] = True
    g, ends = compress(ids, ends)
    places = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    return [shard, block, len(ids), doc_ids, n.astype("<u8").tobytes(), places.astype("<u8").tobytes(),
            g.alphabet.tobytes(), g.rules.tobytes(), g.lengths.tobytes(), g.sequence.tobytes()]


def grammar(row) -> Grammar:
    """The grammar of one written block."""
    a, r, n, s = (np.frombuffer(row[k], "<u4") for k in ("alphabet", "rules", "lengths", "sequence"))
    return Grammar(a, r.reshape(-1, 2), n, s)


def document(row, k: int) -> np.ndarray:
    """Ids of the ``k``-th document of a block, decoded on their own."""
    places = np.frombuffer(row["doc_places"], "<u8")
    g = grammar(row)
    return g.expand(g.sequence[int(places[k]):int(places[k + 1]) if k + 1 < len(places) else None])


def _shards(path: str, end_id: int, block_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block = encoder(path, "words"), TaskContext.get().partitionId(), 0
        ids: list = []
        got: list[memoryview] = []
        size = 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, texts in text_slices(batch, most=ENCODE_BYTES):
                flat, ends = enc.encode_all(texts, end_id)
                flat, at = memoryview(flat).cast("B"), 0
                for k, stop in enumerate(ends.tolist()):
                    ids.append(names[first + k])
                    got.append(flat[4 * at:4 * stop])
                    size += stop - at
                    at = stop
                    if size >= block_tokens:
                        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_ARROW.names, _block(shard, block, ids, got)))], _BLOCK_ARROW)
                        ids, got, size, block = [], [], 0, block + 1
        if got:
            yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_ARROW.names, _block(shard, block, ids, got)))], _BLOCK_ARROW)
    return write


def encode_shards(docs: DataFrame, path: str, end_id: int = END_ID, shards: int | None = None,
                  block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (BLOCK_SCHEMA) of all documents, in ascending doc_id by (shard, block)."""
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64("text")
    ordered = id_text(docs).repartitionByRange(n, F.col("doc_id"), key).sortWithinPartitions(F.col("doc_id"), key)
    return ordered.mapInArrow(_shards(path, end_id, block_tokens), BLOCK_SCHEMA)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = np.frombuffer(row["doc_tokens"], "<u8").astype(np.int64)
            ids = grammar(row).ids()
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            whole = memoryview(ids.tobytes())
            crc = [zlib.crc32(whole[4 * a:4 * (a + m)]) for a, m in zip(start.tolist(), n.tolist())]
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * size, pa.int32()), pa.array([row["block"]] * size, pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())],
                names=["shard", "block", "doc_id", "place", "n_tokens", "ids_crc32"])


def read_digests(blocks: DataFrame) -> DataFrame:
    """Per document: its place in the whole id stream, length and crc32, from the decoded blocks."""
    decoded = blocks.select("shard", "block", "doc_ids", "doc_tokens", "alphabet", "rules", "lengths", "sequence").mapInArrow(
        _decoded, "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("shard", "block", "n_tokens")
    # Ids before a shard: one row per shard, so this window is as small as the shard count.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("block_start"))
    base = base.join(shard, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))
    return decoded.join(base, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = encode_shards(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return read_digests(materialize(blocks, "repair"))
