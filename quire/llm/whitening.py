"""Whitening of embeddings by a covariance weighted with multiplicities.

A vector becomes integers, x = floor(1024 * c) + 100000 per entry. Equal x
vectors are one row with a count; the counts (or one each) are the weights of
the fit. Per-dimension sums are exact integers; centred vectors are n * x - S,
exact before they are scaled, so a weighted GEMM of them is the covariance. Each
distinct vector is projected once and joined back to its rows.

Hot vectors: those with more than a ``HOT_SHARE``-th of all rows are fewer than
HOT_SHARE, so they are broadcast; the others are joined by a shuffle in which no
key holds more than that share.

Defined results: rows whose vector is null or empty or holds null, NaN or
infinite entries take no part; repeated rows and null ids give rows like any
other; vectors of different lengths are an error, as is an entry whose x is no
64-bit integer; a component without variance has a null ``whitened``; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_back, materialize, on_workers, read_table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Variance below this share of the largest is none.
FLAT = 1e-12
_WIDE = pa.decimal128(38, 0)


class Fit(NamedTuple):
    """Vectors in the fit list, sums per dimension, eigenvalues (falling), unit
    eigenvectors as columns, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    on_workers(embeddings.sparkSession)
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    return embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", v.alias("v"))


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    return usable(embeddings).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * d or (len(column) and pa.compute.min_max(pa.compute.list_value_length(column)).as_py() != {"min": d, "max": d}):
        raise ValueError(f"a vector has not {d} entries; all must have one length")
    return flat.reshape(-1, d)


def _weights(batch: pa.RecordBatch, weights: str) -> np.ndarray:
    return batch.column("count").to_numpy(zero_copy_only=False) if weights == "counts" else np.ones(batch.num_rows, np.int64)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as Python integers where ``bound`` is beyond 64 bits."""
    return x if bound < 2 ** 62 else x.astype(object)


def _sums(d: int, weights: str):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x, w = _matrix(b.column("x"), d), _weights(b, weights)
            if len(w):
                n += int(w.sum())
                x = _exact(x, int(np.abs(x).max()) * int(w.sum()))
                total = [t + int(s) for t, s in zip(total, w @ x)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array(map(Decimal, [n, *total]), _WIDE)], names=["at", "s"])
    return sums


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    x = _exact(x, 2 * n * max(int(np.abs(x).max()), 1)) if len(x) else x
    return n * x - np.array(sums, x.dtype)


def _products(n: int, sums: list[int], weights: str):
    d = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros((d, d))
        for b in batches:
            c = _centred(_matrix(b.column("x"), d), n, sums).astype(np.float64) / n
            v += (c * _weights(b, weights)[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d), pa.int32()), pa.array(v.ravel())], names=["at", "s"])
    return products


def distinct_vectors(x: DataFrame) -> DataFrame:
    """Written table of the distinct x vectors and their counts."""
    return materialize(x.groupBy("x").agg(F.count("*").alias("count")), "vectors")


def fit(vectors: DataFrame, weights: str = "counts") -> Fit | None:
    """Fitted on ``vectors`` (x, count), each with its count, or with "one" once.
    What reaches the driver is as large as a vector is long, squared."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    first = vectors.select(F.size("x")).head()
    if first is None:
        return None
    parts = vectors.mapInArrow(_sums(first[0], weights), "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s"))
    n, *sums = (int(r["s"]) for r in parts.orderBy("at").collect())
    parts = vectors.mapInArrow(_products(n, sums, weights), "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    d = len(sums)
    v = np.array([r["s"] for r in parts.orderBy("at").collect()]).reshape(d, d) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    return Fit(n, sums, values[::-1], axes[:, ::-1], float(np.trace(v)))


def _projected(model: Fit, components: int):
    d, k = len(model.sums), min(components, len(model.sums))
    flat = model.values[:k] <= FLAT * max(model.values[0], 0)
    to = model.axes[:, :k] / np.sqrt(np.where(flat, 1, model.values[:k]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _centred(_matrix(b.column("x"), d), model.n, model.sums)
            z = (y.astype(np.float64) / model.n) @ to
            y = _exact(y, d * int(np.abs(y).max()) ** 2) if len(y) else y
            gap = pa.array(map(Decimal, map(int, (y * y).sum(1))), _WIDE)
            z = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel(), mask=np.tile(flat, len(z))))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("count"), gap, z], names=["x", "count", "deviation", "z"])
    return project


def _identity_error(projected: DataFrame, model: Fit, components: int, weights: str) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less
    the identity, over the components with variance."""
    k = [i for i in range(min(components, len(model.sums))) if model.values[i] > FLAT * max(model.values[0], 0)]
    if not k:
        return 0.0
    w = F.col("count") if weights == "counts" else F.lit(1)
    mean = projected.agg(*((F.sum(w * F.col("z")[i]) / model.n).alias(f"m{i}") for i in k)).head()
    c = {i: F.col("z")[i] - F.lit(mean[f"m{i}"]) for i in k}
    got = projected.agg(*((F.sum(w * c[i] * c[j]) / model.n).alias(f"v{i}_{j}") for i in k for j in k if i <= j)).head()
    return max(abs(got[f"v{i}_{j}"] - (i == j)) for i in k for j in k if i <= j)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """Per row that takes part and component: vec_id, component, n, deviation
    (decimal, exact at any size), whitened, explained, identity_error."""
    x = integers(embeddings)
    vectors = distinct_vectors(x)
    model = fit(vectors, weights)
    if model is None:
        return x.selectExpr("vec_id", "1 AS component", "0L AS n", "CAST(0 AS DECIMAL(38,0)) AS deviation",
                            "0D AS whitened", "0D AS explained", "0D AS identity_error").limit(0)
    done = materialize(vectors.mapInArrow(_projected(model, components),
                                          "x array<long>, count long, deviation decimal(38,0), z array<double>"), "whitened")
    error = _identity_error(done, model, components, weights)
    explained = F.array(*(F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values[:components]))
    rows = joined_back(x, done, "x", "count").select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it is beyond a long (from a few million rows
    on); ``deviation_exact`` holds it at any size."""
    got = whiten(read_table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained",
                      "identity_error", F.col("deviation").alias("deviation_exact"))
