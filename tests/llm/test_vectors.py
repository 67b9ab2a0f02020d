"""Vantage-point search and whitening against brute force, and on edge cases."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from conftest import SF001
from quire.llm import vantage, whitening

DDL = "vec_id long, embedding array<float>, label int, x long, dim int, shard int, count long, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], DDL)


def edge_rows(rng):
    rows = [(i, rng.normal(size=6).astype("f4").tolist()) for i in range(0, 400, 5)]
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(30)] + [(15, same), (15, same), (50, same), (1000, rows[7][1])]
    rows += [(2000, None), (2050, [0.0] * 6), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2150, [math.nan] * 6), (2200, [math.inf] * 6), (None, same), (2250, [])]
    return rows


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


def brute_nearest(rows, every, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if q % every == 0:
            near = sorted((-cosine(v, w), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8, 1000])
def test_exact_search_equals_brute_force(spark, shard_rows):
    rows = edge_rows(np.random.default_rng(0)) + [(3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    df = frame(spark, rows)
    trees = vantage.index(df, 5, shard_rows)
    got = sorted(tuple(r) for r in vantage.nearest(trees, df.where("vec_id % 50 = 0"), 5, factor=1.0, block_rows=7).collect())
    want = brute_nearest(rows, 50, 5)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-14)
    assert [r[:2] for r in got if r[0] == 3000] == [(3000, 1)]


def test_search_of_nothing(spark):
    empty = frame(spark, [])
    some = frame(spark, edge_rows(np.random.default_rng(1)))
    assert vantage.nearest(vantage.index(empty, 5), some, 5).count() == 0
    assert vantage.nearest(vantage.index(some, 5), empty, 5).count() == 0
    with pytest.raises(ValueError):
        vantage.nearest(vantage.index(some, 5), some, 5, factor=0.5)


def test_tree_holds_every_vector_and_its_bounds(rng=np.random.default_rng(2)):
    for n in (1, 64, 65, 700):
        unit = rng.normal(size=(n, 4)).round(1)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        order, nodes = vantage.build_tree(unit, leaf=8)
        assert sorted(order) == list(range(n))
        for node in nodes:
            for child in (node.near, node.far):
                if child:
                    below = nodes[child[0]]
                    d = vantage.chords(unit[order[below.start:below.stop]], unit[order[node.start]][None])
                    assert d.min() >= child[1] - 1e-9 and d.max() <= child[2] + 1e-9


def test_recall_of_the_production_query(spark):
    got = vantage.query(spark, SF001).collect()
    table = pq.read_table(f"{SF001}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    want = brute_nearest(rows, 50, 5)
    assert len({r[:3] for r in want} & {tuple(r)[:3] for r in got}) >= 0.9 * len(want) and len(got) == len(want)


def test_relaxed_search_compares_less(rng=np.random.default_rng(3)):
    centres = rng.normal(size=(40, 8)) * 3
    v = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.1
    order, nodes = vantage.build_tree(v / np.linalg.norm(v, axis=1, keepdims=True))
    ids = np.arange(4000)
    exact = vantage.Search(v[order], nodes, v[:100], 6, 1.0).run(ids)
    loose = vantage.Search(v[order], nodes, v[:100], 6, 2.5).run(ids)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = -np.sort(-(unit[:100] @ unit.T), axis=1)[:, :6]
    assert np.allclose(exact.score, best) and exact.compared < 0.5 * 100 * 4000
    assert loose.compared < exact.compared and (loose.score[:, 4] > best[:, 4] - 1e-12).mean() > 0.9


def brute_whiten(rows, k):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int) + 100000) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v in good])
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    gap = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in x]
    return [i for i, _ in good], n, gap, c @ u[:, :k] / np.sqrt(e[:k]), e / e.sum()


def test_whitening_equals_brute_force(spark):
    rows = edge_rows(np.random.default_rng(4))
    got = sorted(whitening.whiten(frame(spark, rows), components=4).collect(), key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["component"], abs(r["whitened"])))
    ids, n, gap, z, share = brute_whiten(rows, 4)
    want = sorted(((i is not None, i or 0, c + 1, abs(z[r, c]), gap[r], share[c]) for r, i in enumerate(ids) for c in range(4)))
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (r["vec_id"] is not None, r["vec_id"] or 0, r["component"], r["n"], r["deviation"]) == (*w[:3], n, w[4])
        assert abs(r["whitened"]) == pytest.approx(w[3], abs=1e-9) and r["explained"] == pytest.approx(w[5], rel=1e-9) and r["identity_error"] < 1e-9


def test_signs_are_the_same_for_all_rows(spark):
    got = whitening.query(spark, SF001).where("component <= 8").collect()
    table = pq.read_table(f"{SF001}/embeddings.parquet")
    ids, n, gap, z, share = brute_whiten(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist())), 8)
    row = {i: k for k, i in enumerate(ids)}
    for c in range(8):
        mine = np.array([[r["whitened"], z[row[r["vec_id"]], c]] for r in got if r["component"] == c + 1])
        assert len(mine) == n and min(np.abs(mine[:, 0] - mine[:, 1]).max(), np.abs(mine[:, 0] + mine[:, 1]).max()) < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(zip(ids, gap))


def test_whitening_edges(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    flat = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["deviation"] == 0 for r in flat)
    line = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [2.0, 2.0])])).collect()
    assert sum(r["whitened"] is None for r in line) == 3 and line[0]["identity_error"] < 1e-9
    with pytest.raises(Exception, match="one length"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])).count()


def test_weights_of_one(spark):
    rows = [(1, [1.0, 0.0])] * 5 + [(2, [0.0, 1.0]), (3, [3.0, 1.5])]
    got = whitening.whiten(frame(spark, rows), weights="one").collect()
    once = whitening.whiten(frame(spark, [(1, [1.0, 0.0]), *rows[5:]])).collect()
    assert {r["n"] for r in got} == {3} and len(got) == 14
    assert {(r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in got} == {(r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in once}


def test_large_sums_stay_exact(rng=np.random.default_rng(5)):
    x = rng.integers(-2 ** 60, 2 ** 60, (9, 3))
    n, s = 10 ** 6, [int(c) for c in x.astype(object).sum(0)]
    assert (whitening._centred(x, n, s) == n * x.astype(object) - np.array(s, object)).all()
