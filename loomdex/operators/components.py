"""Connected components by repeated contraction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.plans.lineage import cut, settle, shared_dir
from loomdex.plans.versions import remove

#: Once so small a part of the edges is left, and no more than so many, a single task joins them.
LAST_SHARE, LAST_MOST = 500, 50_000


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, root)`` of the vertices of at most ``LAST_MOST`` edges; ``root`` is the smallest id joined."""
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    for batch in batches:
        for u, v in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([top(v) for v in list(root)], pa.int64())], names=["id", "root"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, root)`` for every vertex of an undirected graph; ``root`` is the smallest id of its component.

    Each round points every vertex at the lowest of its neighbours and itself, and contracts the edges
    along those pointers.  By id, stars go within two rounds, whatever their centre; sorted paths would
    not, so every other round ranks by a hash of that round instead, which shrinks any graph by a constant
    factor.  All steps are partial aggregates and equi-joins on the remaining edges: a hub vertex is
    combined before its shuffle and its join partition can be split.

    Contracted edges are read back from files, whose size is known.  A checkpoint keeps its plan's estimate of
    size, in which a join is the product of its sides; from round to round that number would have three times
    as many digits, and a dozen rounds would fill the driver with it.

    A round costs the driver the same however few edges are left.  So when a small part of them is, of a bounded
    number, one task joins them for good; and after each round the driver lets go of what the round left there.

    Null endpoints and self-loops are ignored; vertices without edges don't appear; an empty edge
    table gives an empty result.
    """
    e = cut(edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src <> dst").distinct())
    steps: list[DataFrame] = []
    spark, folder = e.sparkSession, f"{shared_dir(e.sparkSession)}/loomdex-components-{uuid.uuid4().hex}"
    try:
        n = most = e.count()
        while n:
            if n <= min(most // LAST_SHARE, LAST_MOST):
                steps.append(cut(e.coalesce(1).mapInArrow(_last, "id long, root long")))
                by_id = len(steps) <= 3
                break
            both = e.union(e.select(F.col("dst"), F.col("src")))
            if len(steps) < 2 or len(steps) % 2:
                low = both.groupBy("src").agg(F.min(F.least("src", "dst")).alias("root"))
                step = cut(low.select(F.col("src").alias("id"), "root"))
            else:

                def rank(c: str) -> Column:
                    return F.xxhash64(c, F.lit(len(steps)))

                low = both.groupBy("src").agg(F.min(F.struct(rank("dst").alias("h"), F.col("dst").alias("to"))).alias("low"))
                step = cut(low.select(F.col("src").alias("id"), F.when(F.col("low.h") < rank("src"), F.col("low.to")).otherwise(F.col("src")).alias("root")))
            joined = (
                e.join(step.select(F.col("id").alias("src"), F.col("root").alias("a")), "src")
                .join(step.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst")
                .filter("a <> b")
                .select(F.col("a").alias("src"), F.col("b").alias("dst"))
                .distinct()
            )
            place = f"{folder}/{len(steps)}"
            joined.write.parquet(place)
            e = spark.read.schema(joined.schema).parquet(place)
            steps.append(step)
            by_id = len(steps) <= 2
            n = e.count()
            settle(spark)
    finally:
        remove(spark, folder)
    if not steps:
        return e.select(F.col("src").alias("id"), F.col("dst").alias("root"))

    def follow(known: DataFrame, step: DataFrame) -> DataFrame:
        nxt = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        return known.join(nxt, "root", "left").select("id", F.coalesce("next", "root").alias("root"))

    found = reduce(follow, steps[1:], steps[0])
    if by_id:
        return found  # so the root is the least
    found = cut(found)
    least = found.groupBy("root").agg(F.min("id").alias("least"))
    return cut(found.join(least, "root").select("id", F.col("least").alias("root")))
