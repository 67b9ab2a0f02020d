"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the average of the vectors of its character n-grams (hashed into
buckets), a text the average of its distinct words (and of a few empty ones, so
that short texts do not hang on one word), and a softmax sits on top;
vectors and weights are trained jointly in numpy, so an unseen misspelling gets
most of its vector from n-grams it shares with known words. The model has a
fixed size; it is fitted in one task on a bounded sample of labelled rows
(POSITIVES and NEGATIVES, those of least hash) and every text is scored whole.

Defined results: a null or empty text gets the score of no evidence (the bias);
without labels of both kinds every score is the share of toxic labels (0 when
there is none); rows with equal doc_id are scored one by one; a null doc_id is
never a training row and counts as crc32 of the empty text.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, documents, id_text, on_workers, read_table, worker_cache

BUCKETS, DIM = 1 << 16, 8
GRAMS = (3, 4, 5)
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Most labelled rows of each kind that the model is fitted on.
POSITIVES, NEGATIVES = 2000, 4000
#: Training texts a word must be in to be trained on; any word is scored.
LEAST_TEXTS = 5
STEPS, RATE, DECAY, SEED = 60, 0.03, 0.1, 7
#: The text average is scaled by GAIN before the softmax (the words that matter
#: are a few hundredths of a text) and taken over PAD empty words more.
GAIN, PAD = 100.0, 20
FOLDS, HELD_OUT = 5, 0
MEMO_WORDS = 150_000


def word_grams(word: str) -> np.ndarray:
    """Buckets of the n-grams of ``<word>`` and of the word itself."""
    w = f"<{word}>"
    got = [w] + [w[i:i + n] for n in GRAMS for i in range(len(w) - n + 1)]
    return np.array([zlib.crc32(g.encode()) % BUCKETS for g in got], np.int64)


def text_words(text: bytes) -> list[bytes]:
    """Distinct words, letters and digits only, in a fixed order."""
    return sorted(set(WORDS.findall(text.lower())))


class Model:
    """``vectors`` [BUCKETS, DIM], ``weights`` [DIM, 2] and ``bias`` [2]."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias
        # With the softmax linear in the average, a bucket matters by one number.
        self.pull = vectors.astype(np.float64) @ (weights[:, 1] - weights[:, 0]) * GAIN
        self.lean = float(bias[1] - bias[0])
        self.words: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= MEMO_WORDS:
                self.words.clear()
            got = self.words[word] = float(self.pull[word_grams(word.decode(errors="replace"))].mean())
        return got

    def score(self, text: bytes) -> float:
        words = text_words(text)
        z = self.lean + sum(map(self.word, words)) / (len(words) + PAD)
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, v=self.vectors, w=self.weights, b=self.bias)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Model":
        got = np.load(io.BytesIO(data))
        return cls(got["v"], got["w"], got["b"])


def constant(share: float) -> Model:
    p = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2)), np.array([0.0, np.log(p / (1 - p))]))


class _Sum:
    """Weighted sums of rows that share a target, by one sort made beforehand:
    out[target[i]] += weight[i] * rows[source[i]]."""

    def __init__(self, source: np.ndarray, target: np.ndarray, weight: np.ndarray, size: int):
        order = np.argsort(target, kind="stable")
        to = target[order]
        self.at = np.flatnonzero(np.concatenate([np.ones(min(1, len(to)), bool), to[1:] != to[:-1]]))
        self.source, self.weight, self.to, self.size = source[order], weight[order, None], to[self.at], size

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, rows.shape[1]), np.float32)
        if len(self.at):
            parts = rows[self.source]
            parts *= self.weight
            out[self.to] = np.add.reduceat(parts, self.at, axis=0)
        return out


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, least: int = LEAST_TEXTS) -> Model:
    """Joint training of vectors, weights and bias: full-batch Adam steps on the
    cross-entropy, with the vectors decayed towards zero."""
    if len(set(labels.tolist())) < 2:
        return constant(float(labels.mean()) if len(labels) else 0.0)
    # Words are hashes here; only those trained on are kept as text.
    rows = [np.array([xxhash.xxh3_64_intdigest(w) for w in text_words(t)], np.uint64) for t in texts]
    n = np.array([len(r) for r in rows])
    names, word, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    kept, doc = count >= least, np.repeat(np.arange(len(rows)), n)
    if not kept.any():
        return constant(float(labels.mean()))
    sel = kept[word]
    weight = (GAIN / (n + PAD)[doc[sel]]).astype(np.float32)
    word, doc = (np.cumsum(kept) - 1)[word[sel]], doc[sel]
    known: dict[int, bytes] = {}
    wanted = set(names[kept].tolist())
    for t in texts:
        known |= {h: w for w in text_words(t) if (h := xxhash.xxh3_64_intdigest(w)) in wanted}
    grams = [word_grams(known[h].decode(errors="replace")) for h in names[kept].tolist()]
    size = np.array([len(g) for g in grams])
    of = np.repeat(np.arange(len(grams)), size)
    used, gram = np.unique(np.concatenate(grams), return_inverse=True)
    share = (1 / size[of]).astype(np.float32)
    to_word, to_doc = _Sum(gram, of, share, len(grams)), _Sum(word, doc, weight, len(rows))
    from_doc, from_word = _Sum(doc, word, weight, len(grams)), _Sum(of, gram, share, len(used))
    rng = np.random.default_rng(SEED)
    values = [rng.uniform(-0.5 / DIM, 0.5 / DIM, (len(used), DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)),
              np.array([0.0, np.log(labels.mean() / (1 - labels.mean()))])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        E, W, b = values
        H = to_doc(to_word(E))
        z = H @ W + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), labels] -= 1
        p /= len(rows)
        dE = from_word(from_doc((p @ W.T).astype(np.float32))) + DECAY / len(rows) * E
        for v, m, s, d in zip(values, first, second, (dE, H.T @ p, p.sum(0))):
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            v -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(v.dtype)
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    vectors[used] = values[0]
    return Model(vectors, values[1], values[2])


def _fit_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [b for b in batches if len(b)]
    rows = pd.concat(got) if got else pd.DataFrame({"doc_id": [], "text": [], "toxic": []})
    rows = rows.sort_values(["doc_id", "text"])  # the same model whatever order the rows came in
    model = fit([t.encode() for t in rows["text"]], rows["toxic"].to_numpy(np.int64))
    yield pd.DataFrame({"model": [model.dump()]})


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Fitted on labelled documents outside the held-out fold. The sample's ids
    are at most ``positives + negatives``, so they can be broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where((F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT) & F.col("toxic").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id")
    sample = [rows.where(F.col("toxic") == t).orderBy(key, "doc_id").limit(n) for t, n in ((1, positives), (0, negatives))]
    chosen = id_text(docs).where("text is not null").join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id")
    got = chosen.repartition(1).mapInPandas(_fit_task, "model binary").first()
    return Model.load(bytes(got["model"])) if got else constant(0.0)


def _loaded(model) -> Model:
    data = model.value
    return worker_cache(zlib.crc32(data), lambda: Model.load(data))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            score = [m.score(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([crc_remainder(i, FOLDS) == HELD_OUT for i in ids], pa.bool_()),
                 pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())
    return id_text(docs).mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")


def _clean_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in batches:
            keep = [m.score(t or b"") < 0.5 for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't call toxic."""
    on_workers(docs.sparkSession)
    return docs.mapInArrow(_clean_rows(docs.sparkSession.sparkContext.broadcast(model.dump())), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
