"""Digest columns of the registered queries against plain recomputation."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from conftest import SF001
from quire.llm import host_rules, packing, toxicity
from quire.llm.common import read_table
from quire.llm.tokens import tokenizer_path

DDL = "doc_id long, text string, source string, row long"
TEXTS = [(1, "a short text"), (2, "word " * 700), (3, ""), (4, None), (5, "naïve café don't " * 300), (6, "a short text"), (None, "x y")]


def test_pieces_start_length_and_crc(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in TEXTS], DDL)
    got = {}
    for r in packing.pack_documents(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i, t in TEXTS:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        assert sorted(got[i]) == want


def test_toxic_scores_are_a_softmax_of_averages(rng=np.random.default_rng(0)):
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32) / 10, rng.normal(size=(toxicity.DIM, 2)), rng.normal(size=2))
    for text in (b"some words here", b"", b"one", b"same same same other"):
        words = toxicity.text_words(text)
        h = np.zeros(toxicity.DIM)
        for w in words:
            h += model.vectors[toxicity.word_grams(w.decode())].astype(np.float64).mean(0)
        z = h * toxicity.GAIN / (len(words) + toxicity.PAD) @ model.weights + model.bias
        p = np.exp(z - z.max())
        assert model.score(text) == pytest.approx(p[1] / p.sum(), rel=1e-5)


def test_toxicity_of_held_out_labels(spark):
    got = {r["doc_id"]: r for r in toxicity.query(spark, SF001).collect()}
    labels = pq.read_table(f"{SF001}/labels.parquet").to_pylist()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels if r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and all(r["held_out"] for _, r in held)
    assert np.mean([t == r["predicted"] for t, r in held]) >= 0.9


def test_host_verdicts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        host = [None, "good", "bad", f"h{i % 30}"][i % 4]
        text = " ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 30))
        if host == "bad" and rng.random() < 0.9 or rng.random() < 0.1:
            text += " #### $$$$ ****" * 30
        if rng.random() < 0.1:
            text = "too short"
        rows.append((i, text, host, 1))
    docs = spark.createDataFrame(rows, DDL)
    got = {r["doc_id"]: r for r in host_rules.judge(docs).collect()}
    strict = {i: r["base_failed"] or 100 * r["n_symbols"] > 20 * r["word_chars"] or 100 * r["n_dup_lines"] > 10 * r["n_words"] for i, r in got.items()}
    hosts = {}
    for i, _, h, _ in rows:
        hosts.setdefault(h, []).append(strict[i])
    n, x = np.array([len(v) for v in hosts.values()]), np.array([sum(v) for v in hosts.values()])
    mean = x.sum() / n.sum()
    between = max((x / n).var() - mean * (1 - mean) * (1 / n).mean(), 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    rate = {h: (sum(v) + mean * strength) / (len(v) + strength) for h, v in hosts.items()}
    assert rate["bad"] > 0.5 > rate["good"]
    for i, _, h, _ in rows:
        assert got[i]["host_rate"] == pytest.approx(rate[h], abs=1e-8)
        assert got[i]["kept"] == (not got[i]["base_failed"] and not (rate[h] > 0.5 and strict[i]))
