"""Bigram language model as a weighted backoff automaton, and text scores.

Word and pair counts come from all training documents. The automaton has a
state for every word and one root; a state has an arc for each pair of count
LEAST or more (interpolated absolute discounting) and a failure arc to the root
with the mass left over, where a word costs its add-one unigram probability.

Words and arcs are written tables of any size. Workers hold the frequent part of
them as a cache of bounded size: the words of some relative frequency, with
their failure weights, and the most frequent arcs. One left-to-right traversal
runs over all texts of a batch at once and adds up what the cache has; words
and pairs it lacks are counted per text and joined with the tables. What is
cached changes the work, never the result.

Defined results: a null or empty text is the end token alone; a null doc_id
counts as crc32 of the empty text; rows with equal doc_id are scored one by one
and all train; without training documents every token costs 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, documents, id_text, materialize, mix, text_slices

FOLDS, HELD_OUT = 7, 2
#: Least count of a pair that is an arc, whatever the corpus.
LEAST = 2
#: Least share of the training tokens for a cached word; 1 / PAIR_RATE arcs at most are cached.
WORD_RATE, PAIR_RATE = 2e-7, 1e-6
#: Bits of the filter that spares pairs without an arc the join. Fuller on larger
#: corpora, it lets more of them through; it never holds back an arc.
FILTER_BITS = 1 << 26
DISCOUNT = 0.75
#: Hash of the end token: of a blank, which no word is.
END = xxhash.xxh3_64_intdigest(b" ")
ROOT = -1  # place of a word that is not cached
#: Key of a word in the tables: its place if cached, else its hash with this bit (so negative).
RARE = np.uint64(1 << 63)

#: Text bytes of which pairs are counted, and that are scored, at a time.
PAIR_BYTES, SCORE_BYTES = 32 << 20, 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def _tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of ``n`` of each."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens of ``texts`` (ascending), the number among
    them of each token (words of a text, then its end), and where texts end."""
    whole = (b"\n".join(texts) + b"\n").lower()
    space = _SPACE[np.frombuffer(whole, np.uint8)]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, last)  # words up to the text's end
    # A word with the white space after it is one stretch of the bytes.
    at = np.append(starts, len(whole))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(whole)]).dictionary_encode()
    words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    spelt = np.fromiter((xxhash.xxh3_64_intdigest(w.rstrip()) for w in words), np.uint64, len(words))
    hashes, number = np.unique(np.append(spelt, np.uint64(END)), return_inverse=True)
    which = np.insert(number[found.indices.to_numpy()], upto, number[-1])
    return hashes, which, upto + np.arange(1, len(texts) + 1)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (by hash) in the training texts of each batch."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        keys, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, texts in text_slices(batch, most=PAIR_BYTES):
            train = [t for k, t in enumerate(texts) if crc_remainder(ids[first + k], FOLDS) != HELD_OUT]
            if train:
                hashes, which, _ = _split(train)
                keys.append(hashes)
                n.append(np.bincount(which, minlength=len(hashes)))
        keys, n = _tally(np.concatenate(keys), np.concatenate(n))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])


class Automaton:
    """The cache: ``hashes`` (ascending) and ``counts`` of its words, ``left`` as
    mass of their failure arcs (``fail``, log10); ``pairs`` (state and word in one
    key, ascending) with their log10 weights. ``rare`` and ``arcs`` are the
    tables of the other words and of all arcs, on the driver only."""

    def __init__(self, hashes, counts, total: int, distinct: int, left=None, pairs=None, pair_counts=None):
        self.hashes, self.counts, self.total, self.distinct = hashes, counts, total, distinct
        self.unigram = np.log10((counts + 1) / (total + distinct + 1))
        self.left = np.ones(len(counts)) if left is None else left
        self.fail = np.log10(self.left)
        self.pairs = np.empty(0, np.uint64) if pairs is None else pairs
        n = np.empty(0) if pair_counts is None else pair_counts
        state, word = (self.pairs >> np.uint64(32)).astype(np.int64), (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.weight = (np.log10((n - DISCOUNT) / counts[state] + self.left[state] * 10 ** self.unigram[word])
                       if len(self.pairs) else np.empty(0))
        self.filter = np.zeros(FILTER_BITS // 8, np.uint8)
        self.rare = self.arcs = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rare", "arcs")}

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word hash, ROOT for those that have none."""
        if not len(self.hashes):
            return np.full(len(hashes), ROOT, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, ROOT)

    def traverse(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Weight of reading ``word`` in ``state``, as far as it is cached."""
        return self.read(state, word)[0]

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights as of ``traverse``, and where no arc is cached: there the
        failure arc and the unigram cost of cached words are what it adds up."""
        cost = np.where(state == ROOT, 0.0, self.fail[state] if len(self.fail) else 0.0)
        cost += np.where(word == ROOT, 0.0, self.unigram[word] if len(self.unigram) else 0.0)
        missed = np.ones(len(cost), bool)
        if len(self.pairs):
            both = np.flatnonzero((state != ROOT) & (word != ROOT))
            key = (state[both].astype(np.uint64) << np.uint64(32)) | word[both].astype(np.uint64)
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            hit = self.pairs[at] == key
            cost[both[hit]] = self.weight[at[hit]]
            missed[both[hit]] = False
        return cost, missed


def _keyed(automaton: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and key (ascending) of the distinct tokens of ``texts``, the number
    among them of each token, and where texts end."""
    hashes, which, ends = _split(texts)
    place = automaton.places(hashes)
    key = np.where(place == ROOT, (hashes | RARE).view(np.int64), place)
    order = np.argsort(key)
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    return place[order], key[order], number[which], ends


def _before(which: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each one; a text starts in the state of the end."""
    out = np.empty_like(which)
    out[1:] = which[:-1]
    out[0] = which[ends[0] - 1]
    return out


def _runs(bounds: list[int], *keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``keys`` (from 0 to below their bounds), in their order, and how often each occurs."""
    if math.prod(map(int, bounds)) >= 1 << 63:  # too many for one number
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        at = np.flatnonzero(new)
        return [k[at] for k in keys], np.diff(np.append(at, len(order)))
    code = np.zeros(len(keys[0]), np.int64)
    for bound, k in zip(bounds, keys):
        code *= bound
        code += k
    code.sort()
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(new)
    n, code = np.diff(np.append(at, len(code))), code[at]
    out = []
    for bound in bounds[:0:-1]:
        code, k = np.divmod(code, bound)
        out.append(k)
    return [code, *out[::-1]], n


def _slots(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bit of each pair of keys in the filter, from 0."""
    h = mix(s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    return (mix(h) % np.uint64(FILTER_BITS)).astype(np.int64)


def _pairs(model):
    """Counts of pairs (by key) in the training texts of each slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in text_slices(batch, most=PAIR_BYTES):
                train = [t for k, t in enumerate(texts) if crc_remainder(ids[first + k], FOLDS) != HELD_OUT]
                if train:
                    _, key, which, ends = _keyed(model.value, train)
                    (s, w), n = _runs([len(key)] * 2, _before(which, ends), which)
                    yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(key[w]), pa.array(n.astype(np.int64))], names=["s", "w", "c"])
    return run


def _odds(model):
    """Arcs with what cached words add to their odds against the failure arc (null: not cached)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.value
        of_state, of_word = 1 / (a.counts * a.left), 10 ** -a.unigram
        for batch in batches:
            got = []
            for name, factor in (("s", of_state), ("w", of_word)):
                k = batch.column(name).to_numpy()
                x = factor[np.maximum(k, 0)] if len(factor) else np.ones(len(k))
                got.append(pa.array(x, pa.float64(), mask=k < 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("s", "w", "c")), *got], names=["s", "w", "c", "fs", "fw"])
    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit of each arc in the filter, from 1."""
    for batch in batches:
        slot = _slots(batch.column("s").to_numpy(), batch.column("w").to_numpy()) + 1
        yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])


_SCORED_DDL = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, path double, "
               "rare array<struct<h:long,m:long>>, missed array<struct<s:long,w:long,m:long>>")
_SCORED = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "path", "rare", "missed"]


def _lists(text: np.ndarray, size: int, **columns: np.ndarray) -> pa.Array:
    """Rows of ``columns``, in the order of ``text``, as a list for each text."""
    offsets = np.searchsorted(text, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], list(columns)))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in text_slices(batch, most=SCORE_BYTES):
                m, (place, key, which, ends) = len(texts), _keyed(a, texts)
                before, text = _before(which, ends), np.repeat(np.arange(m), np.diff(ends, prepend=0))
                word = place[which]
                placed = word != ROOT
                cost, missed = a.read(place[before], word)
                base = np.bincount(text[placed], a.unigram[word[placed]] if len(a.unigram) else None, minlength=m)
                missed = np.flatnonzero(missed)
                slot = _slots(key[before[missed]], key[which[missed]])
                missed = missed[(a.filter[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                (rt, rw), rn = _runs([m, len(key)], text[~placed], which[~placed])
                (mt, ms, mw), mn = _runs([m, len(key), len(key)], text[missed], before[missed], which[missed])
                cols = [batch.column("row").slice(first, m), batch.column("doc_id").slice(first, m),
                        pa.array([crc_remainder(i, FOLDS) == HELD_OUT for i in ids[first:first + m]], pa.bool_()),
                        pa.array(np.bincount(text, minlength=m), pa.int64()), pa.array(np.bincount(text[placed], minlength=m), pa.int64()),
                        pa.array(base, pa.float64()), pa.array(np.bincount(text, cost, minlength=m), pa.float64()),
                        _lists(rt, m, h=key[rw], m=rn), _lists(mt, m, s=key[ms], w=key[mw], m=mn)]
                yield pa.RecordBatch.from_arrays(cols, names=_SCORED)
    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): exact counts of all training tokens, by hash; a written table."""
    parts = docs.mapInArrow(_words, "h long, c long")
    return materialize(parts.groupBy("h").agg(F.sum("c").alias("c")), "words")


def _collected(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns as arrays, by Arrow: rows as Python objects would take many times the memory."""
    got = df.select(*columns).toArrow()
    return [got.column(c).to_numpy() for c in columns]


def train(docs: DataFrame, counts: DataFrame, word_rate: float = WORD_RATE, pair_rate: float = PAIR_RATE) -> Automaton:
    sc = docs.sparkSession.sparkContext
    t = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = t["n"] or 0, t["v"]
    # At most 1 / word_rate rows have that share of the tokens.
    hashes, n = _collected(counts.where(F.col("c") >= word_rate * total), "h", "c")
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    words = Automaton(hashes, n, total, distinct)
    pairs = docs.mapInArrow(_pairs(sc.broadcast(words)), "s long, w long, c long").groupBy("s", "w").agg(F.sum("c").alias("c"))
    pairs = materialize(pairs.where(F.col("c") >= LEAST), "pairs")

    # What the arcs of a state leave of its mass.
    taken = materialize(pairs.groupBy("s").agg(F.sum(F.col("c") - DISCOUNT).alias("taken")), "taken")
    left, (state, mass) = np.ones(len(n)), _collected(taken.where("s >= 0"), "s", "taken")
    left[state] -= mass / n[state]
    key = F.col("h").bitwiseOR(F.lit(-1 << 63)).alias("s")
    rare = counts.where(F.col("c") < word_rate * total).select(key, F.col("c").alias("n")).join(taken.where("s < 0"), "s", "left")
    rare = materialize(rare.select("s", "n", (1 - F.coalesce("taken", F.lit(0.0)) / F.col("n")).alias("left")), "rare")

    # The most frequent arcs, as whole classes of a count.
    placed = pairs.where("s >= 0 and w >= 0")
    size, many = _collected(placed.groupBy("c").agg(F.count("*").alias("many")), "c", "many")
    order = np.argsort(-size)
    fit = size[order][np.cumsum(many[order]) <= 1 / pair_rate]
    often = placed.where(F.col("c") >= (int(fit.min()) if len(fit) else 1 << 62))
    state, word, often = _collected(often, "s", "w", "c")
    keys = (state << 32 | word).view(np.uint64)
    order = np.argsort(keys)
    model = Automaton(hashes, n, total, distinct, left, keys[order], often[order])

    # Odds of an arc against the failure arc; the factors of rare words are joined.
    known, odds_ddl = sc.broadcast(model), "s long, w long, c long, fs double, fw double"
    plain = pairs.where("s >= 0 and w >= 0").mapInArrow(_odds(known), odds_ddl)
    odds = materialize(pairs.where("s < 0 or w < 0").mapInArrow(_odds(known), odds_ddl), "odds")
    slots = pairs.select("s", "w").mapInArrow(_filled, "slot long")
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
    if blocks.num_rows:  # a block has 2^15 bits; blocks count from 1
        held = np.frombuffer(b"".join(blocks.column("bits").to_pylist()), np.uint8).reshape(blocks.num_rows, -1)
        model.filter.reshape(-1, held.shape[1])[blocks.column("b").to_numpy() - 1] = held
    joined = odds.where("fs is null").drop("fs").join(rare, "s").withColumn("fs", 1 / (F.col("n") * F.col("left"))).select(odds.columns)
    odds = odds.where("fs is not null").unionByName(joined)
    floor = F.lit(float(total + distinct + 1))
    joined = odds.where("fw is null").drop("fw").join(rare.select(F.col("s").alias("w"), "n"), "w").withColumn("fw", floor / (F.col("n") + 1))
    odds = odds.where("fw is not null").unionByName(joined.select(odds.columns)).unionByName(plain)
    gain = F.log10(1 + (F.col("c") - DISCOUNT) * F.col("fs") * F.col("fw"))
    model.rare, model.arcs = rare, materialize(odds.select("s", "w", gain.alias("gain")), "arcs")
    return model


def score(docs: DataFrame, counts: DataFrame, automaton: Automaton, word_rate: float = WORD_RATE) -> DataFrame:
    """Per row: n_tokens, n_known, train_tokens, base_score and score (log10)."""
    model = docs.sparkSession.sparkContext.broadcast(automaton)
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.mapInArrow(_scored(model), _SCORED_DDL), "scored")
    total, floor = automaton.total, F.lit(float(automaton.total + automaton.distinct + 1))
    # Every word of a text is the state before one token of it: it costs its failure arc as often as itself.
    words = rows.select("row", F.explode("rare").alias("x")).select("row", F.col("x.h").alias("s"), "x.m").join(automaton.rare, "s", "left")
    cost = words.select("row", (F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 1) / floor)).alias("extra"),
                        F.when(F.col("n") > 0, F.col("m")).otherwise(0).alias("more"),
                        (F.col("m") * F.log10(F.coalesce("left", F.lit(1.0)))).alias("gain"))
    pairs = rows.select("row", F.explode("missed").alias("x")).select("row", "x.s", "x.w", "x.m").join(automaton.arcs, ["s", "w"])
    gain = pairs.select("row", F.lit(0.0).alias("extra"), F.lit(0).cast("long").alias("more"), (F.col("m") * F.col("gain")).alias("gain"))
    cost = cost.unionByName(gain).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("extra", "more", "gain")))
    extra, gain = F.coalesce("extra", F.lit(0.0)), F.coalesce("gain", F.lit(0.0))
    return rows.drop("rare", "missed").join(cost, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("path") + extra + gain).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(documents(spark, sf_dir))
    counts = word_counts(docs)
    return score(docs, counts, train(docs, counts))
