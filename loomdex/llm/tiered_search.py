"""Ranked lexical search over a tiered index: postings of high impact first, and proofs that the lower ones can't change a result.

``build`` reads the texts twice: for the number and mean length of documents, on which every posting's impact depends, and to invert them.  A task
inverts some megabytes of text at a time, a shard, so no token is shuffled.  A shard's postings are dealt into tiers by impact, one folder
a tier; a row holds a shard's terms in a tier, with the greatest impact of each, and their documents and frequencies.

``search`` takes the queries in blocks of bounded size.  It first gathers each query term's document frequency, and its residual bound at every tier: its greatest impact
in the tiers below.  Then all queries of the block are scored on the first tier.  A document's score so far is its lower bound, and adding the
residual bounds of the terms not met in it gives its upper bound; a document not met at all is bounded by the sum of all residual bounds.  A query is done when
its k best by lower bound are fully known and no other document's upper bound reaches them.  The others fall through to the next tier with the
ones above it; below the last tier nothing is left, so there every query is done.

Defined cases: a null or empty text, or one without terms, is no document of the statistics and is not found; a query without terms, or
whose terms are unknown or weigh nothing, has no rows; equal scores go by doc_id, nulls last, then by place; rows that repeat a doc_id are documents each,
and rows that repeat an item_id queries each; fewer than k documents above 0 give all; texts of any length are taken whole; columns not named are
not read; an empty table, of documents or queries, gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.files import written
from loomdex.llm.text import sliced, text_bytes, trimmed

#: Least impacts, of a million, of all tiers but the last.  A term used once in a document of mean length has 454,545.
EDGES = (400_000, 250_000, 150_000)
#: Bytes of text in a shard; only a single longer text goes over it.
SHARD_BYTES = 8 << 20
#: Terms of all queries that are looked up together; only a single longer query goes over it.
BLOCK_TERMS = 1 << 17
SHARD = "tier int, shard string, ids array<long>, lengths array<long>, terms array<string>, tops array<int>, ends array<int>, docs array<int>, uses array<int>"
FOUND = "shard string, ids array<long>, lengths array<long>, terms array<int>, ends array<int>, docs array<int>, uses array<int>"
SCORED = "item int, doc_id long, lower long, upper long, shard string, doc int"

#: What terms are made of: letters and digits of ASCII, and all else beyond it.
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all rows in order, and how many each row has."""
    data, bounds = text_bytes(column)
    inside = _IN_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    # without what lies between them terms stand one behind the other
    ahead = np.concatenate([np.cumsum(inside) - inside, [inside.sum()]])
    offsets = np.concatenate([ahead[starts], ahead[-1:]])
    own = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(_LOWER[data[inside]].tobytes()))
    return own.dictionary_encode(), np.diff(np.searchsorted(starts, bounds))


def impact(uses: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of postings in documents of normalised ``lengths``, in millionths."""
    return (1_000_000_000 * uses) // (1000 * uses + 12 * lengths)


@dataclass(frozen=True)
class Index:
    """An index in a folder, and the statistics of its documents."""

    spark: SparkSession
    folder: str
    documents: int
    terms: int
    tiers: int

    def rows(self, tiers: Sequence[int]) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(self.folder).filter(F.col("tier").isin(list(tiers)))

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut and joined to ``SHARD_BYTES`` of text each."""
    held, size = [], 0
    for batch in batches:
        for part in sliced(batch, text, SHARD_BYTES):
            own = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + own > SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _inverted(ids: pa.Array, column: pa.Array, documents: int, terms: int, edges: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The ``SHARD`` rows of some documents: of tier 0 the ids and normalised lengths, and one row a tier of postings."""
    schema = pa.schema([("tier", pa.int32()), ("shard", pa.string()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))] + [(c, pa.list_(pa.int32())) for c in ("tops", "ends", "docs", "uses")])
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end")
    ids, column = ids.take(order), column.take(order)  # so a document's number in the shard follows its id
    own, counts = terms_of(column)
    shard = uuid.uuid4().hex
    lengths = np.array([75 + (25 * n * documents) // max(1, terms) for n in counts.tolist()], np.int64)
    none = pa.array([None], pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([shard]), _lists(ids, pa.int64()), _lists(lengths, pa.int64()), pa.array([None], pa.list_(pa.string())), *[none] * 4], schema=schema)
    doc = np.repeat(np.arange(len(counts)), counts)
    key, uses = np.unique(own.indices.to_numpy().astype(np.int64) * len(counts) + doc, return_counts=True)
    if not len(key):
        return
    term, doc = np.divmod(key, len(counts))
    value = impact(uses, lengths[doc])
    tier = (value[:, None] < np.array(edges)).sum(axis=1)
    words = own.dictionary.cast(pa.string())
    for t in range(len(edges) + 1):
        at = np.flatnonzero(tier == t)
        if len(at):
            heads = np.flatnonzero(np.concatenate([[True], term[at][1:] != term[at][:-1]]))
            columns = (_lists(words.take(pa.array(term[at][heads])), pa.string()), _lists(np.maximum.reduceat(value[at], heads), pa.int32()), _lists(np.append(heads[1:], len(at)), pa.int32()), _lists(doc[at], pa.int32()), _lists(uses[at], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([t + 1], pa.int32()), pa.array([shard]), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int64())), *columns], schema=schema)


def build(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", edges: Sequence[int] = EDGES) -> Index:
    """Write the index of ``docs`` into a new folder."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                data, bounds = text_bytes(part.column("text"))
                inside = _IN_TERM[data]
                ends = np.append(inside[1:] < inside[:-1], inside[-1:]) if len(data) else inside
                ends[bounds[1:][bounds[1:] > 0] - 1] = inside[bounds[1:][bounds[1:] > 0] - 1]
                n = np.diff(np.concatenate([[0], np.cumsum(ends)])[bounds])
                yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "terms"])

    sums = own.select("text").mapInArrow(count, "documents long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "terms")]).head()  # one row
    documents, terms = sums["documents"], sums["terms"]

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, "text"):
            yield from _inverted(shard.column("id"), shard.column("text"), documents, terms, edges)

    rows = own.mapInArrow(lambda b: trimmed(invert(b)), SHARD)
    rows.write.partitionBy("tier").option("compression", "zstd").parquet(folder)
    return Index(docs.sparkSession, folder, documents, terms, len(edges) + 1)


def _known(batch: pa.RecordBatch, asked: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: its number, which of its terms are asked for, and those's numbers, and where their postings begin and end."""
    for i, terms in enumerate(batch.column("terms")):
        if terms.values is None:
            yield i, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        number = pc.index_in(terms.values, value_set=asked)
        at = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
        yield i, at, number.take(pa.array(at)).to_numpy(), batch.column("ends")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)


def statistics(index: Index, terms: list[str]) -> tuple[list[int], np.ndarray]:
    """Document frequency of each term, and its residual bound at each tier: the greatest impact below it."""
    tops = np.zeros((index.tiers + 2, len(terms)), np.int64)
    frequency = [0] * len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms, pa.string())
        for batch in batches:
            for i, at, number, ends in _known(batch, asked):
                n = np.diff(ends, prepend=0)[at]
                top = batch.column("tops")[i].values.to_numpy(zero_copy_only=False)[at]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.repeat(batch.column("tier")[i].as_py(), len(at)), pa.int32()), pa.array(n, pa.int64()), pa.array(top, pa.int32())], ["term", "tier", "n", "top"])

    rows = index.rows(range(1, index.tiers + 1)).select("tier", "terms", "tops", "ends").mapInArrow(run, "term int, tier int, n long, top int")
    for r in rows.groupBy("term", "tier").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect():  # a row an asked term and tier
        frequency[r["term"]] += r["n"]
        tops[r["tier"], r["term"]] = r["top"]
    below = np.maximum.accumulate(tops[::-1], axis=0)[::-1]  # the greatest in a tier or below
    return frequency, np.concatenate([below[1:], below[:1] * 0])


def _best(lower: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k greatest values above 0, best first, the first of equal ones."""
    found = np.flatnonzero(lower > 0)
    if len(found) > k:
        found = found[lower[found] >= np.partition(lower[found], -k)[-k]]
    return found[np.lexsort([found, -lower[found]])][:k]


def _scored(index: Index, tier: int, asked: list[str], items: dict[int, tuple[np.ndarray, np.ndarray]], residual: np.ndarray, k: int) -> DataFrame:
    """``SCORED``: each item's best k documents of every shard by the postings down to ``tier``; and without a document the greatest upper bound of the shard's others that aren't fully known."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(asked, pa.string())
        for batch in batches:
            for i, at, number, ends in _known(batch, value_set):
                if batch.column("terms")[i].values is None:
                    none = pa.array([None], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in ("shard", "ids", "lengths")], none, none, none, none], ["shard", "ids", "lengths", "terms", "ends", "docs", "uses"])
                elif len(at):
                    n = np.diff(ends, prepend=0)[at]
                    stop = np.cumsum(n)
                    own = np.arange(stop[-1]) + np.repeat(ends[at] - stop, n)
                    none = pa.array([None], pa.list_(pa.int64()))
                    postings = [_lists(batch.column(c)[i].values.to_numpy(zero_copy_only=False)[own], pa.int32()) for c in ("docs", "uses")]
                    yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), none, none, _lists(number, pa.int32()), _lists(stop, pa.int32()), *postings], ["shard", "ids", "lengths", "terms", "ends", "docs", "uses"])

    def score(table: pa.Table) -> pa.Table:
        head = next(i for i, v in enumerate(table.column("ids")) if v.values is not None)
        ids, lengths = table.column("ids")[head].values, table.column("lengths")[head].values.to_numpy(zero_copy_only=False)
        postings: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i in range(table.num_rows):
            if i != head:
                ends = table.column("ends")[i].values.to_pylist()
                docs, uses = (table.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("docs", "uses"))
                value = impact(uses, lengths[docs])
                for t, a, b in zip(table.column("terms")[i].values.to_pylist(), [0, *ends[:-1]], ends, strict=True):
                    postings.setdefault(t, []).append((docs[a:b], value[a:b]))
        shard, out = table.column("shard")[0].as_py(), []
        for item, (terms, weights) in items.items():
            lower, met = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for t, w, r in zip(terms.tolist(), weights.tolist(), residual[terms].tolist(), strict=True):
                for docs, value in postings.get(t, ()):
                    lower[docs] += w * value
                    met[docs] += w * r
            missing = int(weights @ residual[terms]) - met
            best = _best(lower, k)
            open_ = (lower > 0) & (missing > 0)
            open_[best] = False
            n = len(best)
            columns = [[item] * n, ids.take(pa.array(best)), lower[best], (lower + missing)[best], [shard] * n, best]
            out.append(pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _KINDS, strict=True)], _NAMES))
            if open_.any():
                rest = [[item], [None], [-1], [int((lower + missing)[open_].max())], [shard], [None]]
                out.append(pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rest, _KINDS, strict=True)], _NAMES))
        return pa.Table.from_batches(out)

    rows = index.rows(range(tier + 1)).drop("tops").mapInArrow(find, FOUND)
    return rows.groupBy("shard").applyInArrow(score, SCORED)


_NAMES = ["item", "doc_id", "lower", "upper", "shard", "doc"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]


def _searched(index: Index, queries: list[tuple[object, dict[str, int]]], k: int) -> Iterator[tuple[DataFrame, int]]:
    """For each tier that proves some queries, ``(item, rank, doc_id, score)`` of these, by their number in the block."""
    asked = sorted({t for _, uses in queries for t in uses})
    frequency, residual = statistics(index, asked)
    number = {t: i for i, t in enumerate(asked) if frequency[i]}
    pending = {}
    for item, (_, uses) in enumerate(queries):
        terms = np.array([number[t] for t in uses if t in number], np.int64)
        weights = np.array([n * index.weight(frequency[number[t]]) for t, n in uses.items() if t in number], np.int64)
        if weights.any():
            pending[item] = terms, weights
    order = Window.partitionBy("item").orderBy(F.col("lower").desc(), F.col("doc_id").asc_nulls_last(), "shard", "doc")
    for tier in range(1, index.tiers + 1):
        if not pending:
            return
        scored = written(_scored(index, tier, asked, pending, residual[tier], k), "scored").withColumn("rank", F.row_number().over(order))
        top = F.col("rank") <= k
        known = F.col("upper") == F.col("lower")
        state = scored.groupBy("item").agg(
            F.count_if(top & F.col("doc").isNotNull()).alias("n"),
            F.min(F.when(top, F.col("lower"))).alias("least"),
            F.count_if(top & ~known).alias("unsure"),
            F.coalesce(F.max(F.when(~top & ~known, F.col("upper"))), F.lit(-1)).alias("rest"),
        )
        proven = []
        for r in state.collect():  # a row a query of the block
            terms, weights = pending[r["item"]]
            unmet = int(weights @ residual[tier][terms])
            if r["unsure"] == 0 and (max(unmet, r["rest"]) < r["least"] if r["n"] == k else unmet == 0):
                proven.append(r["item"])
        if tier == index.tiers:
            proven = list(pending)
        if proven:
            yield scored.filter(top & F.col("doc").isNotNull() & F.col("item").isin(proven)).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("lower").alias("score")), tier
        pending = {i: v for i, v in pending.items() if i not in set(proven)}


def search(index: Index, queries: DataFrame, k: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score, tier)``: each query's k best documents, and the tier at which they were proven."""
    spark = index.spark
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kind = queries.schema[item_id].dataType.simpleString()
    rows = queries.select(F.col(item_id).alias("item_id"), F.regexp_extract_all(lower, F.lit(pattern), F.lit(0)).alias("terms")).filter(F.size("terms") > 0)
    rows = written(rows.withColumn("part", F.rand(7)), "queries")  # any fixed deal will do
    blocks = max(1, -(-(rows.agg(F.sum(F.size("terms"))).head()[0] or 0) // BLOCK_TERMS))
    schema = f"item_id {kind}, rank int, doc_id long, score long, tier int"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = []
        for r in rows.filter(F.floor(F.col("part") * blocks) == b).collect():  # about BLOCK_TERMS terms
            uses: dict[str, int] = {}
            for t in r["terms"]:
                uses[t] = uses.get(t, 0) + 1
            own.append((r["item_id"], uses))
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(own)], f"item int, item_id {kind}")
        for found, tier in _searched(index, own, k):
            out = out.unionByName(found.join(names, "item").withColumn("tier", F.lit(tier)).select("item_id", "rank", "doc_id", "score", "tier"))
    return out
