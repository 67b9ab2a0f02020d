"""Counting and scoring of texts in slices, by distinct word."""

import numpy as np
import pyarrow as pa
import xxhash

from quire.llm import lm_scoring
from quire.llm.common import crc_remainder

TEXTS = ["The cat\tsat", None, "", " \n the CAT  \x0b", "x", "the cat sat\non the mat ", "Élan É b", "the cat\x1csat"]


def tokens(text):
    return [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()] + [lm_scoring.END]


def test_split_gives_every_token_and_hashes_each_distinct_word_once(monkeypatch):
    asked = []
    monkeypatch.setattr(lm_scoring.xxhash, "xxh3_64_intdigest", lambda w, f=xxhash.xxh3_64_intdigest: asked.append(w) or f(w))
    many = TEXTS + ["the cat sat on the mat " * 50] * 40
    hashes, which, ends = lm_scoring._split([(t or "").encode() for t in many])
    assert len(asked) < 40  # of over 12000 tokens
    monkeypatch.undo()
    starts = [0, *ends.tolist()]
    assert [hashes[which[a:b]].tolist() for a, b in zip(starts, starts[1:])] == [tokens(t) for t in many]


def test_words_of_a_batch_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(lm_scoring, "PAIR_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], names=["doc_id", "text"])
    (got,) = lm_scoring._words(iter([batch]))
    want = {}
    for i, t in enumerate(TEXTS):
        if crc_remainder(i, lm_scoring.FOLDS) != lm_scoring.HELD_OUT:
            for h in tokens(t):
                want[h] = want.get(h, 0) + 1
    found = dict(zip(got.column(0).to_numpy().view(np.uint64).tolist(), got.column(1).to_pylist()))
    assert found == want


def test_runs_count_rows_whatever_the_bounds():
    draw = np.random.default_rng(3)
    a, b, c = (draw.integers(0, n, 500) for n in (3, 4, 5))
    for bounds in ([3, 4, 5], [1 << 40, 1 << 40, 5]):
        keys, n = lm_scoring._runs(bounds, a, b, c)
        rows, times = np.unique(np.stack([a, b, c]), axis=1, return_counts=True)
        assert (np.stack(keys) == rows).all() and (n == times).all()


def test_only_odds_of_rare_words_are_written(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(lm_scoring, "materialize", lambda df, name, f=lm_scoring.materialize: kept.setdefault(name, f(df, name)))
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b d e", "d e a b"] * 8)]
    docs = lm_scoring.id_text(spark.createDataFrame(rows, "doc_id long, text string"))
    lm_scoring.train(docs, lm_scoring.word_counts(docs), word_rate=0.2)
    key = {(r["s"], r["w"]) for r in kept["arcs"].collect()}
    assert key == {(r["s"], r["w"]) for r in kept["pairs"].collect()}
    assert {(r["s"], r["w"]) for r in kept["odds"].collect()} == {(s, w) for s, w in key if s < 0 or w < 0} != key
