"""Best-fit packing of documents into token sequences, improved by local search.

A document longer than a sequence is cut so that only its first piece is
shorter; full pieces fill sequences of their own. The one remaining piece of
each document is packed: documents are dealt at random into groups of bounded
size, each group is packed best-fit in decreasing order, and a local search
moves one document, exchanges one for one, or two for one, between underfull
sequences as long as that increases the sum of squared fills, until sequences
empty. Sequences that are then full, and the fuller half of the others, are
settled; the documents of the rest are dealt into groups again, until one group
is left, so each round is at most half the last and no group grows with the data.

Defined results: a null text is an empty one; an empty text holds the end id
only; rows with equal (or null) doc_id are separate documents; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, materialize, text_slices
from .tokens import ENCODE_BYTES, encoder, tokenizer_path

END_ID = 2
SEQUENCE = 1024
#: Documents packed together in one group.
GROUP = 8192

SIZED_DDL = "row long, doc_id long, n_tokens long, crcs array<long>"
_SIZED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def piece_lengths(n: int, size: int = SEQUENCE) -> list[int]:
    first = n % size
    return [first] * (first > 0) + [size] * (n // size)


def _sized(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "spaced")
        for batch in batches:
            n, crcs = [], []
            for _, texts in text_slices(batch, most=ENCODE_BYTES):
                ids, ends = enc.encode_all(texts, end_id)
                ids, at = memoryview(ids).cast("B"), 0
                for stop in ends.tolist():
                    n.append(stop - at)
                    mine = []
                    for m in piece_lengths(n[-1], size):
                        mine.append(zlib.crc32(ids[4 * at:4 * (at + m)]))
                        at += m
                    crcs.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()),
                                              pa.array(crcs, pa.list_(pa.int64()))], schema=_SIZED)
    return run


def token_sizes(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """Per document: token count and the crc32 of each piece's ids."""
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(_sized(path, end_id, size), SIZED_DDL)


def best_fit(sizes: np.ndarray, size: int) -> list[list[int]]:
    """Items (indices) of each bin: largest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: there is a bin with room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        if room > n:
            rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, size: int) -> list[list[int]]:
    """Local search between underfull bins. From the emptiest bin upwards, a
    bin gives away one document, or exchanges one or two of its documents for
    a smaller one, where that increases the sum of squared fills most; passes go
    on until one moves nothing (each move adds to that sum, so they end)."""
    sizes = sizes.tolist()
    fill = [sum(sizes[i] for i in b) for b in bins]
    live = {b for b, f in enumerate(fill) if 0 < f < size}
    holders: list[dict[int, int]] = [{} for _ in range(size + 1)]  # size -> bin -> how many it has
    for b in live:
        for i in bins[b]:
            holders[sizes[i]][b] = holders[sizes[i]].get(b, 0) + 1
    holders[0] = {b: 1 for b in live}  # giving away is an exchange for nothing
    # Most room of a bin that has this size, and that bin; then the second most.
    room, where = np.full((2, size + 1), -1), np.full((2, size + 1), -1)

    def refresh(n: int) -> None:
        best = nlargest(2, holders[n], key=lambda x: (size - fill[x], -x))
        for k in range(2):
            where[k, n], room[k, n] = (best[k], size - fill[best[k]]) if k < len(best) else (-1, -1)

    for n in range(size + 1):
        if holders[n]:
            refresh(n)

    def change(b: int, out: list[int], into: list[int]) -> set[int]:
        for i in out:
            bins[b].remove(i)
        bins[b].extend(into)
        fill[b] += sum(sizes[i] for i in into) - sum(sizes[i] for i in out)
        for i in out:
            h = holders[sizes[i]]
            h[b] -= 1
            if not h[b]:
                del h[b]
        if 0 < fill[b] < size:
            for i in into:
                holders[sizes[i]][b] = holders[sizes[i]].get(b, 0) + 1
        else:  # full or empty: out of the search
            live.discard(b)
            holders[0].pop(b, None)
            for i in bins[b]:
                holders[sizes[i]].pop(b, None)
        return {0, *(sizes[i] for i in bins[b]), *(sizes[i] for i in out)}

    moved = True
    while moved:
        moved = False
        for v in sorted(live, key=lambda b: fill[b]):
            while v in live:
                mine = bins[v]
                offers = {sizes[i]: [i] for i in mine}
                for x in range(len(mine)):
                    for y in range(x):
                        offers.setdefault(sizes[mine[x]] + sizes[mine[y]], [mine[x], mine[y]])
                best, own = None, where[0] == v
                others = np.where(own, room[1], room[0])  # the roomiest bin but this one
                for s, out in offers.items():
                    if s > size:
                        continue
                    gain = s - np.arange(s)  # what the other bin would grow by
                    fits = np.flatnonzero(others[:s] >= gain)
                    if not len(fits):
                        continue
                    other = size - others[fits]
                    value = 2 * gain[fits] * (other - fill[v] + gain[fits])
                    k = int(np.argmax(value))
                    if value[k] > 0 and (best is None or value[k] > best[0]):
                        best = (int(value[k]), out, int(fits[k]))
                if best is None:
                    break
                _, out, n = best
                b = int(where[1, n] if own[n] else where[0, n])
                back = [next(i for i in bins[b] if sizes[i] == n)] if n else []
                touched = change(b, back, out) | change(v, out, back)
                for n in touched:
                    refresh(n)
                moved = True
    return [b for b in bins if b]


def _packed(size: int, level: int):
    """One group: settled sequences get an id made of level, group and number."""
    def run(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        base = (level << 56) | (int(key[0]) << 24)
        n = rows["n_tokens"].to_numpy()
        rest = n % size
        out_seq, out_at = np.full(len(rows), -1), np.full(len(rows), -1)
        items = np.flatnonzero(rest)
        bins = improve(best_fit(rest[items], size), rest[items], size)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                out_seq[items[i]], out_at[items[i]] = base | k, at
                at += int(rest[items[i]])
        fill = np.zeros(len(bins), np.int64)
        for k, b in enumerate(bins):
            fill[k] = rest[items[b]].sum()
        done = fill == size
        done[np.argsort(-fill, kind="stable")[:-(-len(bins) // 2)]] = True
        settled = np.ones(len(rows), bool)  # a document of full pieces only has nothing to place
        settled[items] = done[out_seq[items] - base]
        # Sequences of the full pieces are numbered after the packed ones, once, at the first level.
        pieces = n // size
        first_full = (base | len(bins)) + np.cumsum(pieces) - pieces if level == 0 else rows["full_id"].to_numpy()
        return rows.assign(sequence_id=out_seq, offset=out_at, full_id=first_full, settled=settled)[_PACKED]
    return run


_PACKED = ["row", "doc_id", "n_tokens", "crcs", "full_id", "sequence_id", "offset", "settled"]
_PACKED_DDL = SIZED_DDL + ", full_id long, sequence_id long, offset long, settled boolean"


def pack(sized: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Per document (of ``sized``, a written table): the sequence and offset of
    its shorter piece (-1 if it has none) and the first id of its full pieces."""
    settled, level = None, 0
    while True:
        n = max(1, -(-sized.count() // group))
        dealt = sized.withColumn("g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(n)))
        out = materialize(dealt.groupBy("g").applyInPandas(_packed(size, level), _PACKED_DDL), f"packed{level}")
        done = out if n == 1 else out.where("settled")
        settled = done if settled is None else settled.unionByName(done)
        if n == 1:
            return settled
        sized, level = out.where("not settled").select("row", "doc_id", "n_tokens", "crcs", "full_id"), level + 1


def _piece_rows(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            crcs = rows["crcs"].to_numpy()
            count = np.array([len(c) for c in crcs])
            if not len(rows):
                continue
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            many = rows[["doc_id", "n_tokens", "full_id", "sequence_id", "offset"]].loc[rows.index.repeat(count)]
            rest = many["n_tokens"].to_numpy() % size
            short = (rest > 0) & (piece == 0)
            nth = piece - (rest > 0)  # number among the full pieces
            yield pd.DataFrame({
                "doc_id": many["doc_id"].to_numpy(), "piece": piece.astype("int32"),
                "start": np.where(short, 0, rest + nth * size), "length": np.where(short, rest, size),
                "ids_crc32": np.concatenate(crcs).astype("int64"),
                "sequence_id": np.where(short, many["sequence_id"], many["full_id"] + nth),
                "offset": np.where(short, many["offset"], 0)})
    return run


def pieces(packed: DataFrame, size: int = SEQUENCE) -> DataFrame:
    return packed.mapInPandas(_piece_rows(size), PIECE_DDL)


def _ids_of_pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "spaced")
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for first, texts in text_slices(batch):
                ids, ends = enc.encode_all(texts, end_id)
                for k, mine in enumerate(np.split(ids.astype(np.int32), ends[:-1])):
                    cut = np.split(mine, np.cumsum(piece_lengths(len(mine), size))[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([docs[first + k]] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()),
                         pa.array([c.tolist() for c in cut], pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])
    return run


def sequences(docs: DataFrame, placed: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids). Needs unique doc_id.
    Groups hold at most ``size`` ids, whatever the data."""
    ids = id_text(docs).mapInArrow(_ids_of_pieces(path, end_id, size),
                                   "doc_id long, piece int, ids array<int>")
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: where its ids lie in the document and in a sequence."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    return pieces(pack(materialize(token_sizes(docs, path, end_id, size), "sizes"), size), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
