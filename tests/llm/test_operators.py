"""Operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import (common, decontaminate, host_rules, jaccard_join, lm_scoring, packing, pii, repair_output, substrings, token_counts,
                       toxicity)
from quire.llm.components import components
from quire.llm.tokens import Encoder, tokenizer_path

DDL = "doc_id long, text string, lang string, source string, n_chars long, row long, n_words long, kept boolean"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree near the quiet river bank"
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("owls", "hens") + " today"), (4, ""), (5, None), (6, "short one"), (7, "short one"),
    (8, "x" * 30000 + " " + "word " * 3000), (None, BASE), (9, "mail a.b@c.de or +49 30 123456789 now\nsame line here\nsame line here\n"),
    (10, "lead in words " + BASE + " then a tail of other words"), (11, "  \t\n "), (12, "naïve café <|endoftext|> ünïcode's don't")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), 1, 2, True) for i, t in TEXTS], DDL)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DDL)


def words(t):
    return (t or "").encode().split()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_encoder_equals_whole_text_encoding(name, kind):
    path = tokenizer_path(name)
    whole, parts = Tokenizer.from_file(path), Encoder(path, kind)
    for _, t in TEXTS + [(0, "  a  b\n\nc\t d "), (0, "a b　c it's 12,5 $$$ AB!!")]:
        t = (t or "")[:5000]
        assert np.frombuffer(parts.encode(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_repair_round_trip_and_random_access(rng=np.random.default_rng(0)):
    for n, top in ((0, 5), (1, 5), (5000, 3), (5000, 40000), (70000, 1 << 17)):
        ids = rng.integers(0, top, n).astype("<u4")
        ends = rng.random(n) < 0.01
        g, marks = repair_output.compress(ids, ends)
        assert (g.ids() == ids).all() and marks.sum() == ends.sum()
        assert (g.token_range(10, 99) == ids[10:99]).all()


def test_repair_goes_on_until_no_pair_repeats(rng=np.random.default_rng(8)):
    phrase = rng.integers(0, 50, 300)
    ids = np.concatenate([phrase if rng.random() < 0.7 else rng.integers(0, 50, 40) for _ in range(60)]).astype("<u4")
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    g, marks = repair_output.compress(ids, ends)
    assert (g.ids() == ids).all() and (g.expand(g.sequence) == ids).all()
    _, count = np.unique(np.stack([g.sequence[:-1], g.sequence[1:]]), axis=1, return_counts=True)
    assert count.max() < repair_output.LEAST and g.lengths.max() >= 256 and len(g.sequence) < len(ids) / 8


def test_repair_digests(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    got = repair_output.read_digests(repair_output.encode_shards(docs, path, shards=3, block_tokens=50).cache())
    whole, start = Tokenizer.from_file(path), 0
    rows = sorted(got.collect(), key=lambda r: r["start"])
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    texts = {i: t or "" for i, t in TEXTS}
    for r in rows:
        ids = np.array(whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert repair_output.read_digests(repair_output.encode_shards(empty, path)).count() == 0


def test_one_document_of_a_block():
    ids = [np.array([1, 2, 1, 2, 1, 2, 9], "<u4"), np.array([2, 1, 2, 9], "<u4"), np.array([9], "<u4")]
    row = dict(zip(repair_output._BLOCK_ARROW.names, repair_output._block(0, 0, [1, 2, 3], [i.tobytes() for i in ids])))
    for k, i in enumerate(ids):
        assert repair_output.document(row, k).tolist() == i.tolist()


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while seven wise owls"), (2, "Short ONE!"), (3, None), (None, "tail"),
                                   (10, "short one"), (4, "...")], "item_id long, text string")
    got = by_id(decontaminate.report(decontaminate.find(docs, bench)))
    sets = by_id(decontaminate.report(decontaminate.find(docs, bench, set_bytes=40)))
    assert {k: sorted(map(tuple, v)) for k, v in got.items()} == {k: sorted(map(tuple, v)) for k, v in sets.items()}
    assert [r["n_hit"] for r in got[1]] == [12] and len(got[2]) == 2 and got[5][0]["n_words"] == 0
    assert got[6][0]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and got[6][0]["n_items"] == 2
    assert [r["contaminated"] for r in got[9]] == [False]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 8, 9, 11, 12}  # 3 still has one window
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_wu_manber_against_every_place(rng=np.random.default_rng(1)):
    for _ in range(200):
        text = [bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(0, 40))]
        patterns = list({tuple(bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(1, 7))) for _ in range(4)})
        got = sorted(decontaminate.WuManber(patterns).search(text))
        assert got == sorted((i, p) for p in patterns for i in range(len(text) - len(p) + 1) if tuple(text[i:i + len(p)]) == p)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, size=64).toPandas()
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert rows["length"].sum() == sum(want) and (rows["piece"] == 0).sum() == len(TEXTS)
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by["length"].sum().max() <= 64 and all((g["offset"] == g["length"].cumsum() - g["length"]).all() for _, g in by)
    assert packing.pack_documents(empty).count() == 0


def test_packing_rounds_end_when_nothing_fits(spark):
    sized = spark.range(300).selectExpr("id AS row", "id AS doc_id", "600L AS n_tokens", "array(1L) AS crcs")
    got = packing.pieces(packing.pack(sized, group=16)).toPandas()
    assert got["sequence_id"].nunique() == 300


def test_local_search_moves_and_exchanges():
    sizes = np.array([6, 5, 5, 4, 4])
    bins = packing.improve([[0], [1, 3], [2, 4]], sizes, 10)
    assert sorted(sum(bins, [])) == [0, 1, 2, 3, 4] and sorted(sizes[b].sum() for b in bins) == [4, 10, 10]


def test_sequences_hold_the_ids(docs, spark):
    some = docs.where("doc_id in (1, 3, 4, 12)")
    path = tokenizer_path("byte_bpe_50k.json")
    got = packing.sequences(some, packing.pack_documents(some, size=16), path, size=16).collect()
    whole = Tokenizer.from_file(path)
    want = Counter(x for i, t in TEXTS if i in (1, 3, 4, 12) for x in whole.encode(t, add_special_tokens=False).ids + [2])
    assert Counter(x for r in got for x in r["ids"]) == want and max(len(r["ids"]) for r in got) <= 16


def test_toxicity(spark, docs, empty):
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        rows.append((i, " ".join(["plain", "words", f"w{i % 7}", "stupid" if bad else "gentle", f"v{i % 5}"] * 3)))
        labels.append((i, bad))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(train, labels)
    assert model.score(b"you are stupidd indeed") > 0.5 > model.score(b"you are gentlee indeed")
    got = by_id(toxicity.score(docs, model))
    assert sum(map(len, got.values())) == len(TEXTS) and all(0 <= r["score"] <= 1 for v in got.values() for r in v)
    assert got[3][0]["held_out"] == (zlib.crc32(b"3") % 5 == 0)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(empty, labels).score(b"x") < 1e-6
    assert toxicity.train(train, labels.limit(0)).score(b"x") < 1e-6


def test_substrings(docs, empty):
    rows, cut = substrings.cut_repeats(docs)
    got = by_id(rows.join(cut, ["doc_id", "tx"], "left"))
    seen = {}
    for i, t in sorted((x for x in TEXTS if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        covered = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k:k + 13]), i) < i:
                covered[k:k + 13] = [True] * 13
        for r in got[i]:
            assert (len(w) if r["copy"] and len(w) >= 13 else r["n_removed"] or 0) == sum(covered)
            if r["kept_text"] is not None:
                assert r["kept_text"].encode() == b" ".join(x for x, c in zip(w, covered) if not c)
    assert len(got[None]) == 1 and not got[None][0]["copy"]
    assert substrings.cut_repeats(empty)[0].count() == 0


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_jaccard_edges(docs, empty):
    got = by_id(jaccard_join.join(docs))
    want = jaccard_components([x for x in TEXTS if x[0] is not None])
    assert {i: {r["component_id"] for r in v} for i, v in got.items() if i is not None} == {i: {c} for i, c in want.items()}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, 8, 9, 10, 11, 12, None] + ([3] if want[3] == 3 else []))
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_of_repeated_and_null_ids(spark):
    """Rows are judged by their own text: no text is lost because its doc_id is
    that of a copy, and a null doc_id is linked with nothing."""
    a, b = "alpha beta gamma delta epsilon zeta", BASE
    rows = [(1, b), (None, b), (2, b), (2, a), (3, a), (None, a), (4, "x y"), (4, "x y"), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _row int")
    got = sorted(tuple(r) for r in jaccard_join.join(df.where("doc_id is not null")).select("doc_id", "component_id").collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4), (5, 5), (5, 5)]
    nulls = jaccard_join.join(df).where("doc_id is null").collect()
    assert len(nulls) == 2 and all(r["component_id"] is None and r["n_shingles"] > 0 for r in nulls)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, b), (None, b), (2, a), (None, a), (4, "x y"), (5, None), (5, "")])


def test_jaccard_crowded_columns(spark, monkeypatch, rng=np.random.default_rng(5)):
    monkeypatch.setattr(jaccard_join, "DIRECT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 6), replace=False):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w)))
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    want = jaccard_components(rows)
    assert {i: v[0]["component_id"] for i, v in got.items()} == want and 1 < len(set(want.values())) < 60


def test_jaccard_writes_few_files(spark, monkeypatch, rng=np.random.default_rng(6)):
    """Small tables have few files, however many partitions a shuffle has."""
    monkeypatch.setattr(jaccard_join, "DIRECT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = []
    for i in range(160):
        w = [f"g{i % 20}_{x}" for x in range(40)]
        for at in rng.choice(40, rng.integers(0, 3), replace=False):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w)))
    many = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    written = []
    for module in (jaccard_join, common):
        monkeypatch.setattr(module, "materialize", lambda df, name, f=module.materialize: written.append((name, f(df, name))) or written[-1][1])
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {i: v[0]["component_id"] for i, v in got.items()} == jaccard_components(rows)
    assert {"classes", "shared", "pairs", "linked", "labels"} <= {name for name, _ in written}
    assert {name: n for name, t in written if (n := len(t.inputFiles())) > spark.sparkContext.defaultParallelism} == {}


def near_copies(groups, size, rng, changed):
    rows = []
    for g in range(groups):
        for k in range(size):
            w = [f"g{g}_{x}" for x in range(120)]
            for at in rng.choice(120, rng.integers(0, changed), replace=False):
                w[at] = f"e{k}_{at}"
            rows.append((g * size + k, " ".join(w)))
    return rows


def test_jaccard_compares_a_group_by_its_size(spark, monkeypatch, rng=np.random.default_rng(7)):
    """A text is sent for about each row of a group, not for each pair."""
    rows = near_copies(10, 12, rng, changed=2)
    written = []
    monkeypatch.setattr(common, "materialize", lambda df, name, f=common.materialize: written.append((name, f(df, name))) or written[-1][1])
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: v[0]["component_id"] for i, v in got.items()} == jaccard_components(rows)
    assert sum(t.count() for name, t in written if name in ("first", "pairs")) < 2 * len(rows)


def test_jaccard_in_shares(spark, monkeypatch, rng=np.random.default_rng(8)):
    """Pairs, sums and blocks in shares, and groups dealt out, give the same links."""
    monkeypatch.setattr(jaccard_join, "SENT", (40, 40))
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    monkeypatch.setattr(jaccard_join, "DIRECT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = near_copies(6, 10, rng, changed=6)
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    want = jaccard_components(rows)
    assert {i: v[0]["component_id"] for i, v in got.items()} == want and 6 < len(set(want.values())) < 60


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = spark.range(2000).selectExpr("id", "xxhash64(id) AS h")

    def shuffles():
        return {m for m in re.findall(r"shuffle_(\d+)_", blocks.getAllBlocks().mkString(" "))}

    before = shuffles()
    written = common.materialize(rows.repartition("h").join(rows.groupBy("h").count(), "h"), "few")
    for _ in range(20):  # files go in the background
        if not shuffles() - before:
            break
        time.sleep(0.25)
    assert not shuffles() - before and written.count() == 2000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_components_of_a_path(spark):
    order = np.random.default_rng(2).permutation(50).tolist()
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(49)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(50), 0), 100: 100, 101: 100}


def test_token_counts(docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    c = token_counts.Counter(token_counts.piece_scores(path))

    def brute(word):
        best = [(0, 0)] + [(-10 ** 18, 0)] * len(word)
        for d in range(1, len(word) + 1):
            size = len(word[d - 1].encode())
            options = [(best[d - 1][0] + size * c.byte, -best[d - 1][1] - size)]
            for at in range(d):
                s = token_counts.piece_scores_cache.get(word[at:d])
                if s is not None:
                    options.append((best[at][0] + s, -best[at][1] - 1))
            top = max(options)
            best[d] = (top[0], -top[1])
        return best[-1][1]

    token_counts.piece_scores_cache = token_counts.piece_scores(path)
    got = by_id(token_counts.token_counts(docs, path))
    for i, t in TEXTS:
        if len(t or "") < 5000:
            w = [x.decode() for x in words(t)]
            for r in got[i]:
                assert (r["n_pretokens"], r["n_tokens"]) == (len(w), sum(brute("▁" + x) for x in w))
    assert token_counts.token_counts(empty, path).count() == 0


def test_lm_scores(docs, empty):
    ids = lm_scoring.id_text(docs)
    counts = lm_scoring.word_counts(ids)
    model = lm_scoring.train(ids, counts)
    got = by_id(lm_scoring.score(ids, counts, model))
    c = Counter()
    for i, t in TEXTS:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            c.update([*words((t or "").lower()), b" "])
    n, v = sum(c.values()), len(c)
    for i, t in TEXTS:
        w = [*words((t or "").lower()), b" "]
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            assert r["score"] < 0
    # In every state the weights over all words and the unknown one add up to 1.
    size = len(model.counts)
    for state in range(0, size, 5):
        total = sum(10 ** model.traverse(np.full(size, state), np.arange(size))) + 10 ** model.fail[state] / (n + v + 1)
        assert total == pytest.approx(1)
    e = lm_scoring.id_text(empty)
    ec = lm_scoring.word_counts(e)
    assert lm_scoring.score(e, ec, lm_scoring.train(e, ec)).count() == 0
    assert all(r["base_score"] == 0 for r in lm_scoring.score(ids, ec, lm_scoring.train(e, ec)).collect())


@pytest.mark.parametrize("word_rate,pair_rate", [(1e-3, 1e-3), (0.02, 0.1), (2.0, 2.0)])
def test_lm_scores_do_not_depend_on_the_cache(spark, word_rate, pair_rate, rng=np.random.default_rng(4)):
    top = np.minimum(rng.zipf(1.3, 6000), 400)
    rows = [(i, " ".join(f"w{x}" for x in top[20 * i:20 * i + 20])) for i in range(300)]
    words_, pairs = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [*t.split(), " "]
            words_.update(w)
            pairs.update(zip([" ", *w], w))
    arcs = {k: c for k, c in pairs.items() if c >= 2}
    n, v, left = sum(words_.values()), len(words_), {}
    for (s, _), c in arcs.items():
        left[s] = left.get(s, 1) - (c - 0.75) / words_[s]
    cost = lambda s, w: (arcs.get((s, w), 0.75) - 0.75) / max(1, words_[s]) + left.get(s, 1) * (words_[w] + 1) / (n + v + 1)
    ids = lm_scoring.id_text(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = lm_scoring.word_counts(ids)
    got = by_id(lm_scoring.score(ids, counts, lm_scoring.train(ids, counts, word_rate, pair_rate), word_rate))
    for i, t in rows:
        w = [*t.split(), " "]
        assert got[i][0]["score"] == pytest.approx(sum(math.log10(cost(*x)) for x in zip([" ", *w], w)))
        assert got[i][0]["base_score"] == pytest.approx(sum(math.log10((words_[x] + 1) / (n + v + 1)) for x in w))


def test_host_rules(docs, empty):
    got = by_id(host_rules.judge(docs))
    for i, t in TEXTS:
        w = words(t)
        c = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        for r in got[i]:
            assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
            assert r["word_chars"] == sum(len(x.decode()) for x in w)
            assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert host_rules.judge(empty).count() == 0


def test_pii_spans_and_redaction(docs, empty):
    text = "IBAN: DE89 3704 0044 0532 0130 00, see ftp://me:pw@host 10.0.0.255 card 4111-1111-1111-1111 x@y.z."
    found = pii.find(text)
    assert [text[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[a:b] for a, b in found["login"]] == ["me:pw"]
    assert [text[a:b] for k in ("ip", "card", "email") for a, b in found[k]] == ["10.0.0.255", "4111-1111-1111-1111", "x@y.z"]
    assert pii.redact(text, found).endswith("<IP> card <CARD> <EMAIL>.")
    got = by_id(pii.spans(docs))
    assert got[9][0]["spans"] == "email:5:13,phone:17:33" and got[5][0]["spans"] == ""
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and by_id(clean)[9][0]["text"].startswith("mail <EMAIL> or <PHONE> now")
    assert by_id(clean)[5][0]["text"] is None
    assert pii.spans(empty).count() == 0


def test_pii_base_kinds_against_the_patterns(rng=np.random.default_rng(11)):
    """Base spans against the contract's patterns, on texts drawn from what matters to them."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    parts = ["a", "b.c", "@", "@@", ".", "-", " ", "+", "+4", "9", "192", "256.", "4111 1111 1111 1111", "4111111111111111", "(030)", "12-34",
             "1.2.3.4", "\n", "é", "İ", "_%", "x@y.de", "0.0.0.0.0.0.0.0", "token"]

    def brute(t):
        digits = lambda x: re.sub("[^0-9]", "", x)
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]

    for _ in range(3000):
        t = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 14)))
        got = pii.find(t)
        assert [(k, a, b) for k in pii.BASE for a, b in got[k]] == brute(t), t


def test_pii_accounts_and_secrets():
    def found(t, kind):
        return [t[a:b] for a, b in pii.find(t)[kind]]
    assert found("İ IBAN ES91 2100 0418 4502 0005 1332 BIC", "account") == ["ES91 2100 0418 4502 0005 1332"]
    assert found("IBAN AT61 1904 3002 3457 3201 BAWAATWW", "account") == ["AT61 1904 3002 3457 3201"]
    assert found("IBAN ES92 2100 0418 4502 0005 1332", "account") == [] and found("Acct 12345678.", "account") == ["12345678"]
    assert found('x TOKEN = "04dbebab91ab85687d33" y', "secret") == ["04dbebab91ab85687d33"]
    assert found("password: hunter2hunter, api_key='a1b2c3d4'", "secret") == ["hunter2hunter", "a1b2c3d4"]
    assert found("ghp_0123456789abcdefghijABCDEFGHIJ012345 tail", "secret") == ["ghp_0123456789abcdefghijABCDEFGHIJ012345"]
    for clean in ("the token: a small thing", "secret = plain words", "password is needed", "desk-research-and-development-plan", "token = \"only words here\""):
        assert found(clean, "secret") == [], clean
    t = 'a token = "04dbebab91ab85687d33" b'
    assert pii.redact(t, pii.find(t)) == 'a token = "<SECRET>" b'
