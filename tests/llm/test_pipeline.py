"""The pipeline, stage by stage, against plain Python on the small tables."""

import zlib

import corpus_pipeline
import numpy as np
from quire.llm import common, decontaminate, pii, toxicity
from quire.llm.common import materialize, read_table

from .test_operators import jaccard_components, near_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, read_table(spark, SF, "labels"))
    assert zlib.crc32(model.dump())
    bench = decontaminate.Matcher([(r["item_id"], r["text"].encode()) for r in read_table(spark, SF, "benchmark").collect()])
    keep = [
        lambda w: {i: t for i, t in w.items() if model.score(t.encode()) < 0.5},
        lambda w: {i: w[i] for i, c in jaccard_components(w.items()).items() if i == c},
        lambda w: {i: t for i, t in w.items() if not bench.hits(decontaminate.words(t.encode()))[1]},
        lambda w: {i: pii.redact(t, pii.find(t)) for i, t in w.items()},
    ]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, keep):
        docs = materialize(stage(spark, docs, SF), name)
        want = plain(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == set(want)


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Of each group one row stays, and a text is sent for about each row, not for each pair."""
    rows = near_copies(4, 12, np.random.default_rng(9), changed=2)
    written = []
    monkeypatch.setattr(common, "materialize", lambda df, name, f=common.materialize: written.append((name, f(df, name))) or written[-1][1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(jaccard_components(rows).values()))
    assert sum(t.count() for name, t in written if name in ("first", "pairs")) < 2 * len(rows)
