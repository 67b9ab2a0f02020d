"""Removal of word passages that an earlier document holds, by seed and extend.

Seeds are winnowed: of every window of ``window`` words the least hash among its
``SEED``-word runs is its anchor, so two equal windows have the same anchor at
the same place. Documents are joined on anchors; an anchor that only one
document has seeds nothing. A seed is extended to both sides, one window at a
time, as long as the windows it is the anchor of are there in an earlier
document: all earlier documents at once, by the smallest doc_id of each window,
so a passage shared by many documents costs a row per occurrence and no pairs.
Overlapping extensions join into the maximal repeats, which are cut out.

Documents with equal words are one document up to here: every copy but the
first is a repeat as a whole.

Defined results: a null or empty text has no words; a text shorter than a
window is kept whole; rows with equal doc_id are never earlier than each other;
a row with a null doc_id is kept whole and is no source; windows are compared
by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, documents, few_rows, id_text, materialize, ngram_hashes, text_slices

WINDOW = 13
#: Words of an anchor; a window then has WINDOW - SEED + 1 to choose from.
SEED = 6

_HASHES = WordHash()


def window_anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all SEED-word runs, and for every window the place of its anchor."""
    runs = ngram_hashes(words, min(SEED, window))
    wide = window - min(SEED, window) + 1
    if len(runs) < wide:
        return runs, np.empty(0, np.int64)
    return runs, sliding_window_view(runs, wide).argmin(1) + np.arange(len(runs) - wide + 1)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_ANCHORED = pa.schema([("doc_id", pa.int64()), ("tx", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))])


def _anchored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, anchors = [], [], []
            for _, texts in text_slices(batch):
                for t in texts:
                    words = t.split()
                    n.append(len(words))
                    sha.append(digest(words))
                    runs, at = window_anchors(_HASHES.array(words), window)
                    anchors.append(np.unique(runs[at]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tx"), pa.array(n, pa.int64()), pa.array(sha),
                                              pa.array(anchors, pa.list_(pa.int64()))], schema=_ANCHORED)
    return run


_EXTENDED_DDL = "doc_id long, tx long, places array<int>, w1 array<long>, w2 array<long>"


def _extended(window: int):
    """Windows that a shared anchor is the anchor of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column("seeds").to_pylist()
            places, w1, w2 = [], [], []
            for first, texts in text_slices(batch):
                for k, t in enumerate(texts):
                    words = _HASHES.array(t.split())
                    runs, at = window_anchors(words, window)
                    hit = np.flatnonzero(np.isin(runs[at], np.array(seeds[first + k], np.int64).view(np.uint64)))
                    places.append(hit.astype(np.int32))
                    w1.append(ngram_hashes(words, window)[hit].view(np.int64))
                    w2.append(ngram_hashes(words, window, seed=0xD6E8FEB86659FD93)[hit].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tx"), pa.array(places, pa.list_(pa.int32())),
                 pa.array(w1, pa.list_(pa.int64())), pa.array(w2, pa.list_(pa.int64()))], names=["doc_id", "tx", "places", "w1", "w2"])
    return run


def repeats(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by the windows at ``starts``."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts").to_pylist()
            removed, kept = [], []
            for first, texts in text_slices(batch):
                for k, t in enumerate(texts):
                    words, at, stay = t.split(), 0, []
                    for a, b in repeats(starts[first + k], window):
                        stay += words[at:a]
                        at = b
                    stay += words[at:]
                    removed.append(len(words) - len(stay))
                    kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tx"), pa.array(removed, pa.int64()), pa.array(kept)],
                                             names=["doc_id", "tx", "n_removed", "kept_text"])
    return run


def _with_texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """``keys`` (doc_id, tx and more; a written table) with their texts. A small
    set of keys is broadcast first to thin out the texts before they are shuffled."""
    if few_rows(keys):
        docs = docs.join(F.broadcast(keys.select("doc_id", "tx").distinct()), ["doc_id", "tx"], "left_semi")
    return docs.join(keys, ["doc_id", "tx"])


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(``rows``, ``cut``): per row doc_id, tx (its text's hash), n_words, sha of
    all words and ``copy`` (whether an earlier document has the same words); and
    for the documents with repeats, without copies, n_removed and kept_text."""
    docs = id_text(docs).withColumn("tx", F.xxhash64("text"))
    rows = materialize(docs.mapInArrow(_anchored(window), "doc_id long, tx long, n_words long, sha string, anchors array<long>"), "anchored")
    # Copies: the first document of equal words stands for all.
    first = rows.where("n_words > 0 and doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("rep"))
    marked = materialize(rows.select("doc_id", "tx", "n_words", "sha").join(first, "sha", "left").select(
        "doc_id", "tx", "n_words", "sha", F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)).alias("copy")), "marked")
    copies = materialize(marked.where("copy").select("doc_id", "tx").distinct(), "copies")
    copies = F.broadcast(copies) if few_rows(copies) else copies
    posts = rows.where("doc_id is not null").join(copies, ["doc_id", "tx"], "left_anti").select("doc_id", "tx", F.explode("anchors").alias("anchor"))
    shared = posts.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    seeds = materialize(posts.join(shared, "anchor", "left_semi").groupBy("doc_id", "tx").agg(F.collect_list("anchor").alias("seeds")), "seeds")
    extended = materialize(_with_texts(seeds, docs).mapInArrow(_extended(window), _EXTENDED_DDL), "extended")
    windows = extended.select("doc_id", "tx", F.explode(F.arrays_zip("places", "w1", "w2")).alias("w")).select("doc_id", "tx", "w.places", "w.w1", "w.w2")
    source = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    covered = windows.join(source, ["w1", "w2"]).where("lo < doc_id").groupBy("doc_id", "tx").agg(F.collect_list("places").alias("starts"))
    covered = materialize(covered, "covered")
    cut = _with_texts(covered, docs).mapInArrow(_cut(window), "doc_id long, tx long, n_removed long, kept_text string")
    return marked, cut


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = cut_repeats(documents(spark, sf_dir))
    cut = cut.select("doc_id", "tx", "n_removed", F.sha2("kept_text", 256).alias("cut_sha")).dropDuplicates(["doc_id", "tx"])
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    return rows.join(cut, ["doc_id", "tx"], "left").select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))
