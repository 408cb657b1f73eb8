"""A written index of vectors, and exact searches of the cells that can hold a neighbour.

Every vector belongs to the nearest of some centres, its cell, which is a folder of files sorted by the distance to the centre.  By the triangle inequality a
vector at ``r`` from its centre is at least ``|r - |q - centre||`` from a query ``q``; so a cell's least and greatest ``r`` bound all its vectors.  A search reads
each query's most promising cells, and then of the others those whose bound, and in them the vectors whose ``r``, is within the k-th distance found.

The index of cosine distances holds unit vectors, for which the distance grows with the cosine distance; a vector without length has the distance 1 to all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.plans.lineage import cut

#: Centres at most, queries of a pass, vectors of the first pass for each neighbour asked for, ranges that the reader of the files is told.
CENTRES, QUERIES, FIRST, RANGES = 4096, 256, 8, 64
#: Vectors for which one more task writes a cell.
SPREAD = 1_000_000
#: What sums of floats may be off.
SLACK = 1e-9


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.sqrt((d * d).sum(axis=-1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centre; which of nearly equal ones doesn't matter."""
    cell = np.empty(len(x), np.int64)
    sizes = (centres * centres).sum(axis=1)
    for a in range(0, len(x), 1024):
        cell[a : a + 1024] = (sizes - 2 * (x[a : a + 1024] @ centres.T)).argmin(axis=1)
    return cell, _distances(x, centres[cell])


@dataclass(frozen=True)
class Found:
    """Neighbours, and what was read for them."""

    rows: DataFrame
    cells_read: int
    cells: int
    vectors_read: int
    vectors: int


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    @cached_property
    def settings(self) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.folder}/settings").head()["settings"])

    @cached_property
    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()  # CENTRES at most
        return np.array([r["centre"] for r in rows], float).reshape(len(rows), self.settings["dims"])

    def vectors(self) -> DataFrame:
        """``(key, kept columns, v, r, cell)``."""
        schema = f"{self.settings['columns']}, v array<double>, r double, cell int, part string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/vectors").drop("part")

    def add(self, vectors: DataFrame, part: str) -> VectorIndex:
        """Append rows, whose keys the index doesn't hold, under the batch's name ``part``; a batch of the same name is replaced."""
        s = self.settings
        dims, cosine, centres = s["dims"], s["metric"] == "cosine", self.centres
        own = usable(vectors, s["key"], s["embedding"], dims, s["keep"])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("v"), dims)
                    x = _units(x) if cosine else x
                    cell, r = _nearest(x, centres)
                    ends = pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32))
                    made = [*[batch.column(c) for c in ("key", *s["keep"])], pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(r), pa.array(cell.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(made, ["key", *s["keep"], "v", "r", "cell"])

        rows = own.mapInArrow(place, f"{s['columns']}, v array<double>, r double, cell int")
        tasks = F.pmod(F.xxhash64("key"), F.lit(1 + s["n"] // SPREAD))  # copies of one vector may fill a cell
        placed = rows.repartition("cell", tasks).sortWithinPartitions("cell", "r")
        folder = f"{self.folder}/vectors/part={part}"
        placed.write.partitionBy("cell").mode("overwrite").option("parquet.page.row.count.limit", 1000).parquet(folder)
        written = self.vectors_of(part)
        written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells/part={part}")
        return self

    def vectors_of(self, part: str) -> DataFrame:
        return self.spark.read.schema(f"{self.settings['columns']}, v array<double>, r double, cell int").parquet(f"{self.folder}/vectors/part={part}")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, others: bool = False) -> Found:
        """``(query_id, rank, key, distance)`` of the k nearest to each of ``queries(query_id, embedding)``; filtered first, ties by key.

        ``where`` speaks of the key and the kept columns; with ``others`` a query isn't its own neighbour.  Queries with null, non-finite or differently many components find nothing.
        """
        s = self.settings
        asked = usable(queries, "query_id", "embedding", s["dims"], ()).withColumnRenamed("key", "query_id")
        numbered = cut(asked.withColumn("place", F.monotonically_increasing_id()))
        n = numbered.count()
        blocks = max(1, -(-n // QUERIES))
        cells = {r["cell"]: r for r in self.spark.read.parquet(f"{self.folder}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()}  # CENTRES at most
        out, read, seen = None, set(), 0
        for b in range(blocks):
            rows = numbered.filter(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).collect()  # about QUERIES rows
            if rows and cells:
                found, cells_read, vectors = self._block(rows, k, where, others, cells)
                out = found if out is None else out.unionByName(found)
                read, seen = read | cells_read, seen + vectors
        kind = numbered.schema["query_id"].dataType.simpleString()
        if out is None:
            out = self.spark.createDataFrame([], f"query_id {kind}, rank int, key {s['columns'].split(', ')[0].split(' ', 1)[1]}, distance double")
        return Found(out, len(read), len(cells), seen, sum(c["n"] for c in cells.values()) * blocks)

    def _block(self, rows: list, k: int, where: Column | None, others: bool, cells: dict) -> tuple[DataFrame, set, int]:
        s = self.settings
        q = np.array([r["v"] for r in rows], float)
        q = _units(q) if s["metric"] == "cosine" else q
        ids, numbers = [r["query_id"] for r in rows], np.array(sorted(cells))
        n, least, most = (np.array([cells[c][name] for c in numbers]) for name in ("n", "least", "most"))
        apart = np.stack([_distances(self.centres[numbers], v) for v in q])
        bound = np.maximum(np.maximum(apart - most, least - apart), 0)
        first = np.zeros(bound.shape, bool)
        for i in range(len(q)):
            order = np.lexsort([apart[i], bound[i]])
            first[i, order[: 1 + int(np.searchsorted(np.cumsum(n[order]), FIRST * k))]] = True
        found = cut(self._scan(q, ids, numbers, apart, first, np.full(len(q), np.inf), k, where, others))
        reached = {r["query"]: r["reach"] for r in found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.sort_array(F.collect_list("distance"))[k - 1]).alias("reach")).collect()}  # a row a query
        reach = np.array([np.inf if reached.get(i) is None else reached[i] for i in range(len(q))]) * (1 + SLACK) + SLACK
        then = (bound <= reach[:, None]) & ~first
        if then.any():
            found = found.unionByName(self._scan(q, ids, numbers, apart, then, reach, k, where, others))
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        kind = type(rows[0]["query_id"])
        names = self.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"query int, query_id {'string' if kind is str else 'long'}")
        distance = F.col("distance") * F.col("distance") / 2 if s["metric"] == "cosine" else F.col("distance")
        either = first | then
        return best.join(F.broadcast(names), "query").select("query_id", "rank", "key", distance.alias("distance")), set(numbers[either.any(axis=0)].tolist()), int(n[either.any(axis=0)].sum())  # QUERIES rows

    def _scan(self, q: np.ndarray, ids: list, numbers: np.ndarray, apart: np.ndarray, wanted: np.ndarray, reach: np.ndarray, k: int, where: Column | None, others: bool) -> DataFrame:
        """``(query, key, distance)``: of each batch and query the k nearest within its reach, in the cells wanted."""
        s = self.settings
        dims, cosine = s["dims"], s["metric"] == "cosine"
        used = np.flatnonzero(wanted.any(axis=0))
        rows = self.vectors().filter(F.col("cell").isin(numbers[used].tolist()))
        if len(used) <= RANGES and np.isfinite(reach).all():
            within = F.lit(False)
            for c in used:
                own = wanted[:, c]
                within = within | ((F.col("cell") == int(numbers[c])) & F.col("r").between(float((apart[own, c] - reach[own]).min()), float((apart[own, c] + reach[own]).max())))
            rows = rows.filter(within)
        if where is not None:
            rows = rows.filter(where)
        at = {int(numbers[c]): (c, np.flatnonzero(wanted[:, c])) for c in used}

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, r, cell, keys = _matrix(batch.column("v"), dims), batch.column("r").to_numpy(), batch.column("cell").to_numpy(), batch.column("key")
                for number in np.unique(cell).tolist():
                    c, queries = at[number]
                    mine = np.flatnonzero(cell == number)
                    for i in queries.tolist():
                        near = mine[np.abs(r[mine] - apart[i, c]) <= reach[i]]
                        if others and len(near):
                            near = near[~pc.equal(keys.take(pa.array(near)), pa.scalar(ids[i], keys.type)).to_numpy(zero_copy_only=False)]
                        d = _distances(x[near], q[i])
                        if cosine:  # without a length there is no direction: the cosine is 0
                            d = np.where(x[near].any(axis=1) & q[i].any(), d, np.sqrt(2.0))
                        if len(d) > k:
                            kept = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                            near, d = near[kept], d[kept]
                        made = pa.table({"key": keys.take(pa.array(near)), "distance": pa.array(d)})
                        made = made.take(pc.sort_indices(made, sort_keys=[("distance", "ascending"), ("key", "ascending")])[:k])
                        if made.num_rows:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(made.num_rows, i, np.int32)), *[made.column(c).combine_chunks() for c in ("key", "distance")]], ["query", "key", "distance"])

        return rows.select("key", "v", "r", "cell").mapInArrow(nearest, f"query int, {s['columns'].split(', ')[0]}, distance double")


def usable(vectors: DataFrame, key: str, embedding: str, dims: int, keep: Sequence[str]) -> DataFrame:
    """``(key, kept columns, v)`` of the vectors of ``dims`` finite components that have a key."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(key).isNotNull() & (F.size(embedding) == dims) & ~bad).select(F.col(key).alias("key"), *keep, v.alias("v"))


def build(vectors: DataFrame, key: str, embedding: str, folder: str, dims: int, metric: str = "l2", keep: Sequence[str] = (), centres: int | None = None) -> VectorIndex:
    """Write the index of ``vectors(key, embedding, kept columns)`` into a new folder: about as many cells as a cell has vectors, ``CENTRES`` at most.

    The centres are vectors drawn by their keys' hash, moved once to the means of their cells.
    """
    spark, cosine = vectors.sparkSession, metric == "cosine"
    own = usable(vectors, key, embedding, dims, keep)
    n = own.count()
    most = min(CENTRES, centres or max(1, int(n**0.5)))
    drawn = np.array([r["v"] for r in own.orderBy(F.xxhash64("key"), "key").limit(most).collect()], float).reshape(-1, dims)
    drawn = np.unique(_units(drawn) if cosine else drawn, axis=0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(drawn), dims + 1))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), dims)
                x = _units(x) if cosine else x
                np.add.at(total, _nearest(x, drawn)[0], np.concatenate([x, np.ones((len(x), 1))], axis=1))
        cell = np.flatnonzero(total[:, -1])
        ends = pa.array(np.arange(0, len(cell) * (dims + 1) + 1, dims + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(total[cell].ravel()))], ["cell", "total"])

    def mean(table: pa.Table) -> pa.Table:
        total = table.column("total").combine_chunks().flatten().to_numpy().reshape(-1, dims + 1).sum(axis=0)
        return pa.table({"cell": table.column("cell")[:1], "centre": pa.array([total[:-1] / total[-1]])})

    parts = own.select("v").mapInArrow(sums, "cell int, total array<double>") if len(drawn) else spark.createDataFrame([], "cell int, total array<double>")
    means = parts.groupBy("cell").applyInArrow(mean, "cell int, centre array<double>").orderBy("cell").collect()  # CENTRES at most
    rows = [(i, r["centre"]) for i, r in enumerate(means)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
    columns = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("key", *keep))
    settings = {"dims": dims, "metric": metric, "key": key, "embedding": embedding, "keep": list(keep), "columns": columns, "n": n}
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.parquet(f"{folder}/settings")
    index = VectorIndex(spark, folder)
    return index.add(vectors, "0") if rows else index.add(vectors.limit(0), "0")
