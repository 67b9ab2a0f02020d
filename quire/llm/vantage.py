"""Nearest neighbours by vantage-point trees, one per shard.

Rows are dealt to shards by position, so copies of a vector or an id never make
a large shard. A shard holds each distinct vector once, on the unit sphere,
where the chord is a metric and falls as the cosine rises; its tree splits the
vectors of a node at their median distance from a vantage point. A block of
queries walks a shard's tree together: first every query goes down to its own
leaf, which gives it a bound, then each node is visited once with the queries
that the triangle inequality leaves. A query skips a node when ``factor`` times
the least distance possible there is beyond its bound; factor 1 is exact search,
larger ones skip more. Shards and query blocks meet in a grid of cells of
bounded size; each cell returns the nearest of its shard, and a window per query
keeps the nearest of all shards.

Defined results: vectors that are null, empty, zero or hold null, NaN or
infinite entries take no part, nor do rows with a null id; a vector is compared
with those of its own length only; each row with a query id is a query, and no
row with its id is its candidate; repeated rows are candidates each; ties go to
the smaller id; with fewer candidates all are returned; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .whitening import usable

#: Rows of a shard and of a query block.
SHARD_ROWS, BLOCK_ROWS = 8192, 8192
LEAF = 64
#: Relaxation of the production query; README holds the recall measured.
FACTOR = 2.5
#: What rounding may add to a distance near zero.
SLACK = 1e-6
_TREE = "dim int, shard long, k int, ids binary, owners binary, vectors binary, tree binary"
_FOUND = "query_row long, query_id long, vec_id long, score double"


class Node(NamedTuple):
    """Vectors ``start:stop``; the first is the vantage point of an inner node.
    ``near`` and ``far`` are (child, least, largest distance) or None in a leaf."""

    start: int
    stop: int
    near: tuple | None
    far: tuple | None


def build_tree(unit: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[Node]]:
    """Order of the vectors and the nodes, parents first (the root is node 0).
    The vantage point is the vector farthest from the node's first."""
    order = np.arange(len(unit))
    nodes: list = [None]
    todo = [(0, 0, len(unit))]
    while todo:
        at, a, b = todo.pop()
        if b - a <= leaf:
            nodes[at] = Node(a, b, None, None)
            continue
        own = order[a:b]
        far = a + int(np.argmin(unit[own] @ unit[own[0]]))
        order[[a, far]] = order[[far, a]]
        rest = order[a + 1:b].copy()
        d = chords(unit[rest], unit[order[a]][None])[:, 0]
        by = np.argsort(d, kind="stable")
        order[a + 1:b], d = rest[by], d[by]
        half = len(d) // 2
        children = []
        for lo, hi in ((0, half), (half, len(d))):
            children.append((len(nodes), float(d[lo]), float(d[hi - 1])))
            todo.append((len(nodes), a + 1 + lo, a + 1 + hi))
            nodes.append(None)
        nodes[at] = Node(a, b, *children)
    return order, nodes


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that row of ``b``; equal rows give equal results."""
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


class Search:
    """The ``keep`` nearest distinct vectors of each query in one shard."""

    def __init__(self, vectors: np.ndarray, nodes: list[Node], queries: np.ndarray, keep: int, factor: float):
        self.vectors, self.nodes, self.queries, self.keep, self.factor = vectors, nodes, queries, keep, factor
        norm = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
        self.unit, self.to = norm(vectors), norm(queries)
        self.score = np.full((len(queries), keep), -np.inf)
        self.found = np.full((len(queries), keep), -1)
        self.compared = 0

    def bound(self, who: np.ndarray) -> np.ndarray:
        """Chord of the worst vector kept (infinite while fewer are)."""
        return np.where(np.isinf(s := self.score[who, -1]), np.inf, np.sqrt(np.maximum(2 - 2 * s, 0)))

    def offer(self, who: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Compare queries with vectors ``start:stop``; their cosines, roughly."""
        rough = self.to[who] @ self.unit[start:stop].T
        self.compared += rough.size
        good = rough >= self.score[who, -1][:, None] - 1e-9
        rows = np.flatnonzero(good.any(1))
        for lo in range(0, len(rows), 4096):
            some = rows[lo:lo + 4096]
            i, j = np.nonzero(good[some])
            exact = cosines(self.queries[who[some[i]]], self.vectors[start + j])
            new = np.full((len(some), stop - start), -np.inf)
            new[i, j] = exact
            score = np.concatenate([self.score[who[some]], new], 1)
            found = np.concatenate([self.found[who[some]], np.broadcast_to(np.arange(start, stop), new.shape)], 1)
            found[:, self.keep:][np.isinf(new)] = -1
            # By score, then by the vector's smallest id (its rank here).
            best = np.lexsort((self.rank(found), -score), axis=1)[:, :self.keep]
            self.score[who[some]] = np.take_along_axis(score, best, 1)
            self.found[who[some]] = np.take_along_axis(found, best, 1)
        return rough

    def rank(self, found: np.ndarray) -> np.ndarray:
        return self.ranks[found]

    def run(self, smallest: np.ndarray) -> Search:
        """``smallest``: the smallest id of each distinct vector."""
        self.ranks = np.append(np.argsort(np.argsort(smallest, kind="stable"), kind="stable"), len(smallest))
        everyone = np.arange(len(self.queries))
        done: dict[int, np.ndarray] = {}
        todo = [(0, everyone)] if len(self.vectors) else []
        while todo:  # down to the own leaf
            at, who = todo.pop()
            node = self.nodes[at]
            if node.near is None:
                done[at] = who
                self.offer(who, node.start, node.stop)
                continue
            d = chords(self.to[who], self.unit[node.start][None])[:, 0]
            inside = d <= (node.near[2] + node.far[1]) / 2
            todo += [(child[0], who[side]) for child, side in ((node.near, inside), (node.far, ~inside)) if side.any()]
        todo = [(0, everyone, np.zeros(len(everyone)))] if len(self.vectors) else []
        while todo:
            at, who, least = todo.pop()
            open_ = self.factor * least <= self.bound(who) + SLACK
            who, least = who[open_], least[open_]
            if at in done:
                left = ~np.isin(who, done[at])
                who, least = who[left], least[left]
            if not len(who):
                continue
            node = self.nodes[at]
            if node.near is None:
                self.offer(who, node.start, node.stop)
                continue
            rough = self.offer(who, node.start, node.start + 1)[:, 0]
            d = np.sqrt(np.maximum(2 - 2 * rough, 0))
            for child, lo, hi in (node.far, node.near):
                todo.append((child, who, np.maximum(least, np.maximum(lo - d, d - hi))))
        return self


def _smallest_ids(ids: np.ndarray, most: int) -> np.ndarray:
    """Sorted ids, each at most ``most`` times, as far as ``most`` are left
    whichever one id is taken away."""
    ids, n = np.unique(ids, return_counts=True)
    return np.repeat(ids, np.minimum(n, most))[:2 * most]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _build(k: int):
    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
        v, which = np.unique(v, axis=0, return_inverse=True)
        which = which.ravel()
        unit = v / np.sqrt((v * v).sum(1, keepdims=True))
        order, nodes = build_tree(unit)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[which], kind="stable")
        cut = np.flatnonzero(np.diff(place[which][by])) + 1
        groups = [_smallest_ids(g, k) for g in np.split(ids[by], cut)]
        owners = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        row = {"dim": dim, "shard": shard, "k": k, "ids": np.concatenate(groups).astype("<i8").tobytes(), "owners": owners.astype("<i8").tobytes(),
               "vectors": v[order].astype("<f8").tobytes(), "tree": pickle.dumps([tuple(n) for n in nodes])}
        return pa.Table.from_pylist([row], pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("k", pa.int32()), *((c, pa.binary()) for c in ("ids", "owners", "vectors", "tree"))]))
    return build


def _search(k: int, factor: float):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key: tuple, trees: pa.Table, queries: pa.Table) -> pa.Table:
        if not trees.num_rows or not queries.num_rows:
            return schema.empty_table()
        row, dim = trees.to_pylist()[0], key[0].as_py()
        if k > row["k"]:
            raise ValueError(f"the index holds enough copies for {row['k']} neighbours, not {k}")
        ids, owners = (np.frombuffer(row[c], "<i8") for c in ("ids", "owners"))
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
        first = np.searchsorted(owners, np.arange(len(vectors) + 1))
        # One vector more than asked for: the query's own may have no other row.
        got = Search(vectors, [Node(*n) for n in pickle.loads(row["tree"])], _matrix(queries.column("v"), dim), k + 1, factor).run(ids[first[:-1]])
        names, rows = queries.column("vec_id").to_numpy(), queries.column("query_row").to_numpy()
        # All rows of the vectors kept, without those of the query's id, then the k nearest.
        q, slot = np.nonzero(got.found >= 0)
        vector = got.found[q, slot]
        n = first[vector + 1] - first[vector]
        q, slot = np.repeat(q, n), np.repeat(slot, n)
        at = np.repeat(first[vector] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        other = ids[at] != names[q]
        q, slot, at = q[other], slot[other], at[other]
        score = got.score[q, slot]
        by = np.lexsort((ids[at], -score, q))
        q, at, score = q[by], at[by], score[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, at, score = q[nth < k], at[nth < k], score[nth < k]
        return pa.Table.from_arrays([pa.array(rows[q]), pa.array(names[q]), pa.array(ids[at]), pa.array(score)], schema=schema)
    return search


def _dealt(df: DataFrame, size: int, name: str, number: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``name``, the row's group of about ``size`` of its ``dim``, and how many groups each dim has."""
    groups = df.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("long").alias(number))
    return df.join(F.broadcast(groups), "dim").withColumn(name, F.pmod(F.xxhash64("at"), F.col(number))).drop(number), groups


def index(embeddings: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Written table of one tree per shard, over every row that takes part."""
    rows = _vectors(embeddings).withColumn("at", F.monotonically_increasing_id())
    dealt, _ = _dealt(rows, shard_rows, "shard", "shards")
    return materialize(dealt.drop("at").groupBy("dim", "shard").applyInArrow(_build(k), _TREE), "trees")


def _vectors(embeddings: DataFrame) -> DataFrame:
    v = usable(embeddings).where(F.col("vec_id").isNotNull() & F.exists("v", lambda c: c != 0))
    return v.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("v").alias("dim"), "v")


def nearest(trees: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows to each row of
    ``queries`` (vec_id, embedding) in an ``index`` built for at least ``k``."""
    if factor < 1:
        raise ValueError("factor must be 1 (exact) or more")
    asked = materialize(_vectors(queries).withColumn("query_row", F.monotonically_increasing_id()), "queries")
    dealt, blocks = _dealt(asked.withColumn("at", F.col("query_row")), block_rows, "block", "blocks")
    shards = trees.groupBy("dim").agg(F.count("*").alias("shards"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # Both tables have one row per vector length.
    left = trees.join(F.broadcast(blocks), "dim").withColumn("block", span("blocks")).drop("blocks")
    right = dealt.drop("at").join(F.broadcast(shards), "dim").withColumn("shard", span("shards")).drop("shards")
    cell = ("dim", "shard", "block")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_search(k, factor), _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read_table(spark, sf_dir, "embeddings")
    return nearest(index(embeddings, 5), embeddings.where("vec_id % 50 = 0"), 5)
