"""Exact top-k search by inner product over vector-approximation files.

``build`` writes file sets of up to ``FILE_ROWS`` vectors: a quantised cell of ``CELL_BITS`` bits for every component
and, apart from it, the exact integer vectors.  A search scans the cells of a set for lower and upper
bounds of every score, then reads exact vectors in order of falling upper bound until the k-th best score
found passes every bound that is left.

The sets of the queries and ranges of the vectors' sets are paired on the executors; a pair is a task's unit of work, which goes
through its range set by set and carries each query's best k from one to the next, so later sets are mostly told by their bounds.
There are about ``UNITS`` pairs for each shuffle partition: with many queries a range is all vectors, with few it is
a part.  Memory holds one set of either side.  The best k of each pair are merged per query.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; ties go to the smaller id; repeated ids are candidates each, but none for a
query of that id, and one query together (the smallest vector of them); fewer than k candidates give all; components beyond 64 bits saturate, and so
do scores; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.files import opened, unique_name
from loomdex.plans.lineage import cut

CELL_BITS = 4
#: Vectors of one file set, and queries looked at together.
FILE_ROWS, QUERY_ROWS = 16_384, 256
#: Pairs of a query set and a range for each shuffle partition.
UNITS = 2
HITS = "query_id long, vec_id long, score long"
SETS = "name string, rows long, dims int"
MOST = 2**63 - 1


def usable(vectors: DataFrame, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v array<long>)``: floor(scale * component), the component taken as double."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each component, and the components' least values and cell widths as two rows of edges."""
    lo, hi = [int(v) for v in x.min(axis=0, initial=0)], [int(v) for v in x.max(axis=0, initial=0)]
    width = [max(1, -(-(b - a + 1) // (1 << CELL_BITS))) for a, b in zip(lo, hi, strict=True)]
    wide = any(b - a > MOST for a, b in zip(lo, hi, strict=True))
    kind = object if wide else np.int64
    cells = (x.astype(kind) - np.array(lo, kind)) // np.array(width, kind)
    return cells.astype(np.uint8), np.array([lo, width], np.int64).reshape(2, -1)


def build(vectors: DataFrame, folder: str) -> DataFrame:
    """Write the file sets of ``usable`` rows; ``SETS``, one row each."""
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    schema = pa.schema([("name", pa.string()), ("rows", pa.int64()), ("dims", pa.int32())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = opened(folder)
        ids, rows = [], []

        def done() -> pa.RecordBatch:
            dims = max(len(r) for r in rows)
            x = np.zeros((len(rows), dims), np.int64)
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            cells, edges = quantised(x)
            name = unique_name("va", "")
            for ending, data in ((".ids", np.array(ids, "<i8")), (".cells", cells), (".edges", edges.astype("<i8")), (".exact", x.astype("<i8"))):
                with files.open_output_stream(f"{top}/{name}{ending}") as f:
                    f.write(data.tobytes())
            return pa.RecordBatch.from_pylist([{"name": name, "rows": len(ids), "dims": dims}], schema)

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) >= FILE_ROWS:
                    yield done()
                    ids, rows = [], []
        if ids:
            yield done()

    return cut(vectors.mapInArrow(put, SETS))


def _load(folder: str, entry: dict, ending: str, kind: str, rows: int) -> np.ndarray:
    files, top = opened(folder)
    with files.open_input_file(f"{top}/{entry['name']}{ending}") as f:
        return np.frombuffer(f.read(), kind).reshape(rows, -1)


def _read_rows(source, rows: np.ndarray, dims: int) -> np.ndarray:
    """Exact vectors of ascending ``rows``: near ones in one range read."""
    out, i = np.empty((len(rows), dims), np.int64), 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j] - rows[j - 1] <= 16:
            j += 1
        source.seek(int(rows[i]) * dims * 8)
        block = np.frombuffer(source.read(int(rows[j - 1] - rows[i] + 1) * dims * 8), "<i8").reshape(-1, dims)
        out[i:j] = block[rows[i:j] - rows[i]]
        i = j
    return out


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of float queries and cells, widened by what float sums may be off."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).max(axis=0, initial=0)[:, None]) * 2.0**-44
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def search(folder: str, queries: dict, vectors: list[dict], k: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's best k in some file sets."""
    files, top = opened(folder)
    q_ids, q_all = _load(folder, queries, ".ids", "<i8", queries["rows"])[:, 0], _load(folder, queries, ".exact", "<i8", queries["rows"])
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]  # (-score, id), best first
    for entry in vectors:
        ids, cells = _load(folder, entry, ".ids", "<i8", entry["rows"])[:, 0], _load(folder, entry, ".cells", "u1", entry["rows"])
        lo, width = _load(folder, entry, ".edges", "<i8", 2).astype(float)
        dims = min(q_all.shape[1], cells.shape[1])  # components beyond meet zeros
        low = (lo + cells * width)[:, :dims]
        high = low + (width - 1)[:dims]
        exact: dict[int, np.ndarray] = {}
        with files.open_input_file(f"{top}/{entry['name']}.exact") as source:
            for a in range(0, len(q_ids), QUERY_ROWS):
                q = q_all[a : a + QUERY_ROWS, :dims].astype(float)
                lower, upper = bounds(q, low, high)
                large = np.abs(upper).max(initial=0) + np.abs(lower).max(initial=0) >= 2.0**62
                own = q_ids[a : a + QUERY_ROWS, None] == ids[None, :]
                upper[own] = lower[own] = -np.inf
                sure = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(q), -np.inf)
                for i in range(len(q)):
                    mine = best[a + i]
                    least = max(sure[i], -mine[k - 1][0] if len(mine) >= k else -np.inf)
                    near = np.flatnonzero((upper[i] >= least) & ~own[i])
                    near = near[np.argsort(-upper[i, near], kind="stable")]
                    at = 0
                    while at < len(near) and not (len(mine) >= k and upper[i, near[at]] < -mine[k - 1][0]):
                        step = near[at : at + 4 * k]
                        at += len(step)
                        new = np.sort(np.array([r for r in step.tolist() if r not in exact], np.int64))
                        if len(exact) + len(new) > FILE_ROWS:
                            exact.clear()
                            new = np.sort(step)
                        exact.update(zip(new.tolist(), _read_rows(source, new, cells.shape[1]), strict=True))
                        kind = object if large else np.int64
                        scores = np.array([exact[r] for r in step.tolist()])[:, :dims].astype(kind) @ q_all[a + i, :dims].astype(kind)
                        mine = sorted([*mine, *zip((-scores).tolist(), ids[step].tolist(), strict=True)])[:k]
                    best[a + i] = mine
    for q, mine in zip(q_ids.tolist(), best, strict=True):
        for s, v in mine:
            yield q, v, max(-MOST - 1, min(MOST, -s))


def top_k(vectors: DataFrame, queries: DataFrame, folder: str, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of ``usable`` rows; the file sets stay in ``folder`` and are read by the result."""
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    theirs, own = build(vectors, folder), build(one.coalesce(max(1, partitions // 4)), folder)
    n, m = theirs.count(), own.count()
    ranges = max(1, min(n, -(-UNITS * partitions // max(1, m))))
    part = F.pmod(F.xxhash64("name"), F.lit(ranges)).cast("int")
    # a set is a row of some 40 bytes; one range's meet in a row, and each is paired with every set of queries by its number
    parts = theirs.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("name", "rows", "dims"))).alias("sets"))
    numbered = own.select((F.row_number().over(Window.orderBy("name")) - 1).alias("number"), F.struct("name", "rows", "dims").alias("asked"))  # a row a set
    pairs = parts.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(max(0, m - 1))))).join(numbered, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hits = list(search(folder, row["asked"], row["sets"], k))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*hits, strict=True) if hits else ([], [], []))], names=["query_id", "vec_id", "score"])

    units = pairs.repartitionById(max(1, ranges * m), F.col("part") * F.lit(m) + F.col("number")).select("asked", "sets")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return units.mapInArrow(run, HITS).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
