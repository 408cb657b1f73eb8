"""Centroid clustering of integer vectors, exact: blocks of vectors against all centroids by one matrix product.

Vectors are written once as blocks of rows.  A block's squared distances are |x|^2 - 2 x.c + |c|^2 in float64, whose products and sums
are exact while ``dims * (max |x| + max |c|)^2`` is below 2^53; a block beyond that bound is computed with Python's integers.  The sums of each cluster's
vectors are added by ``treeAggregate`` as integers without bound, so the order in which executors answer, or answer again, changes nothing.
What tasks, closures and the driver hold besides a block is ``k`` centroids.

Defined cases: vectors that are null, hold null or non-finite components or have another number of components take no part; a row
whose id is null is clustered too, but no start; rows that repeat an id are vectors each, and as starts those of equal hash go by their components;
fewer vectors than ``k`` give as many centroids as there are; of equally near centroids the first is taken; a centroid that no vector is nearest to stays;
components beyond 64 bits saturate, and so do distances and sums of them when returned; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.files import written

#: Vectors of a block.
BLOCK_ROWS = 2048
EXACT, MOST = 2**53, 2**63 - 1
ROWS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
Centroids = list[list[int]]


def usable(vectors: DataFrame, dims: int, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v array<long>)``: floor(scale * component) of vectors of ``dims`` finite components, taken as doubles."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter((F.size(embedding) == dims) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def blocks(vectors: DataFrame) -> DataFrame:
    """``(ids array<long>, x binary)``: up to ``BLOCK_ROWS`` ``usable`` rows each, their components as 64-bit integers; written."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()])], ["ids", "x"])

    return written(vectors.mapInArrow(put, "ids array<long>, x binary"), "vectors")


def starts(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The ``k`` vectors of smallest SHA-256 of ``seed:id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(order.alias("hash"), "v").orderBy("hash", "v").limit(k).collect()  # k rows
    return [list(r["v"]) for r in rows]


def _most(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance; int64 where the bound holds, else Python's integers."""
    most = max(abs(v) for c in centroids for v in c)
    if x.shape[1] * (_most(x) + most) ** 2 < EXACT:
        rows, c = x.astype(float), np.array(centroids, float)
        distances = (rows * rows).sum(axis=1)[:, None] - 2.0 * (rows @ c.T) + (c * c).sum(axis=1)
        cluster = distances.argmin(axis=1)
        return cluster, distances[np.arange(len(x)), cluster].astype(np.int64)
    rows = x.astype(object)
    distances = np.stack([((rows - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)
    cluster = np.array([min(range(len(d)), key=d.__getitem__) for d in distances.tolist()])
    return cluster, distances[np.arange(len(x)), cluster]


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Python's integers: each cluster's sum of the rows, and in the last column their number."""
    if len(x) * _most(x) < EXACT:
        member = (cluster[:, None] == np.arange(k)).astype(float)
        total = (member.T @ x.astype(float)).astype(np.int64).astype(object)
    else:
        total = np.array([[sum(column) for column in zip(*own)] if (own := x[cluster == i].tolist()) else [0] * x.shape[1] for i in range(k)], object)
    return np.concatenate([total, np.bincount(cluster, minlength=k).astype(object)[:, None]], axis=1)


def _aggregated(made: DataFrame, of_block) -> np.ndarray | None:
    """The sum of ``of_block(x bytes)``, arrays of Python's integers, over all blocks; None where there are none."""

    def with_block(total, row):
        own = of_block(row[0])
        return own if total is None else total + own

    def together(a, b):
        return b if a is None else a if b is None else a + b

    return made.select("x").rdd.treeAggregate(None, with_block, together)


def _rows(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dims)


def fit(made: DataFrame, first: Centroids, rounds: int) -> Centroids:
    """The centroids after ``rounds`` of assigning all blocks' vectors and taking each cluster's floored mean."""
    now = first
    for _ in range(rounds if first else 0):

        def of_block(data: bytes, now=now) -> np.ndarray:
            x = _rows(data, len(now[0]))
            return sums(x, nearest(x, now)[0], len(now))

        total = _aggregated(made, of_block)
        now = [[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(total.tolist(), now, strict=True)]
    return now


def assign(made: DataFrame, centroids: Centroids) -> DataFrame:
    """``ROWS``: each vector's nearest centroid and squared distance, and the distances' sums over its cluster and over all."""
    if not centroids:
        return made.sparkSession.createDataFrame([], ROWS)
    dims, k = len(centroids[0]), len(centroids)

    def of_block(data: bytes) -> np.ndarray:
        cluster, distance = nearest(_rows(data, dims), centroids)
        total = np.array([0] * k, object)
        np.add.at(total, cluster, distance.astype(object))
        return total

    exact = _aggregated(made, of_block).tolist()
    inertia = [min(MOST, t) for t in exact]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("x").to_pylist(), strict=True):
                cluster, distance = nearest(_rows(data, dims), centroids)
                columns = [
                    ids.values,
                    pa.array(cluster.astype(np.int32)),
                    pa.array([min(MOST, d) for d in distance.tolist()], pa.int64()),
                    pa.array(inertia, pa.int64()).take(pa.array(cluster)),
                    pa.array([min(MOST, sum(exact))] * len(cluster), pa.int64()),
                    pa.array(digests).take(pa.array(cluster)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return made.mapInArrow(run, ROWS)


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int = 1) -> DataFrame:
    """``ROWS`` of ``usable`` vectors after ``rounds`` of ``fit`` from ``starts``."""
    made = blocks(vectors)
    return assign(made, fit(made, starts(vectors, k, seed), rounds))
