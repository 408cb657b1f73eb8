"""Rank of documents for all words of a query by where the words stand, over written positional postings.

The rank is the one that PostgreSQL's ``ts_rank`` defines.  Each field has a label from A to D and the labels have weights; of two words that are both asked for, every pair of places
counts by the root of their weights and of a factor that falls with their distance.  A single word, or words of which any will do, count by the weights
of their places, each next place less.  Flags divide the rank by the document's length or number of words.

A document's words are counted and placed in its own row, so only posting rows are shuffled, to the folder of their word's bucket; a search reads its words' folders.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.stemming import fold, stem
from loomdex.operators.retrieval import query_terms, tokens

#: The weights of labels, the last place that is told from others, places kept of a word.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
LAST, PLACES = 16_383, 256
#: Divide by 1 + ln(length), length, number of distinct words, 1 + ln of it, rank + 1.
LOG_LENGTH, LENGTH, UNIQUE, LOG_UNIQUE, SELF = 1, 2, 8, 16, 32
BUCKETS = 16


def _factor(distance: np.ndarray) -> np.ndarray:
    return np.where(distance > 100, 1e-30, 1.0 / (1.005 + 0.05 * np.exp(np.minimum(distance, 101) / 1.5 - 2)))


def together(places: list[np.ndarray], weights: list[np.ndarray]) -> float:
    """Rank of words that are all there, two or more, by their places and the weights of these."""
    missed = 1.0
    for i in range(len(places)):
        for k in range(i):
            distance = np.abs(places[i][:, None] - places[k][None, :])
            apart = distance > 0
            missed *= float(np.prod(1.0 - np.sqrt(weights[i][:, None] * weights[k][None, :] * _factor(distance))[apart]))
    return 1.0 - missed if missed < 1.0 else 1e-20


def each(weights: list[np.ndarray], asked: int) -> float:
    """Rank of the words that are there of ``asked`` ones, by their places' weights in order."""
    total = 0.0
    for w in weights:
        squares = np.arange(1, len(w) + 1) ** 2
        best = int(w.argmax())
        total += (w[best] + float((w / squares).sum()) - w[best] / squares[best]) / 1.64493406685
    return total / asked


def normalised(rank: float, length: int, words: int, flags: int) -> float:
    """The rank divided as the flags say."""
    if flags & LOG_LENGTH and words:
        rank /= math.log2(length + 1)
    if flags & LENGTH and length:
        rank /= length
    if flags & UNIQUE and words:
        rank /= words
    if flags & LOG_UNIQUE and words:
        rank /= math.log2(words + 1)
    return rank / (rank + 1) if flags & SELF else rank


@dataclass(frozen=True)
class PositionalIndex:
    """Positional postings in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def settings(self) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.folder}/settings").head()["settings"])

    def search(self, query: str, all_terms: bool = True, weights: dict[str, float] = WEIGHTS, flags: int = 0, among: DataFrame | None = None) -> DataFrame:
        """``(key, rank)``, best first, ties by key: documents with all words of the query, or with any; kept for keys in ``among(key, ...)``, whose other columns stay."""
        s = self.settings()
        terms = query_terms(query)
        if s["stem"]:
            terms = sorted({stem(fold(t)) for t in terms})
        rows = self.spark.read.schema(f"{_schema(s['key'])}, bucket int").parquet(f"{self.folder}/postings")
        here = F.lit(False)
        for t in terms:
            here = here | ((F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(s["buckets"])).cast("int")) & (F.col("term") == t))
        hits = rows.filter(here)
        if among is not None:
            hits = hits.join(among.select("key").distinct(), "key", "left_semi")
        # a row a word that was asked for
        found = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "places", "labels"))).alias("words"), F.first("length").alias("length"), F.first("distinct").alias("distinct"))
        if all_terms:
            found = found.filter(F.size("words") == len(terms))
        of = {label: weights.get(name, 0.0) for label, name in enumerate("DCBA")}

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for words, length, distinct in zip(*(batch.column(c).to_pylist() for c in ("words", "length", "distinct")), strict=True):
                    w = [np.array([of[x] for x in word["labels"]]) for word in words]
                    value = together([np.array(word["places"]) for word in words], w) if all_terms and len(words) > 1 else each(w, len(terms))
                    out.append(normalised(value, length, distinct, flags))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.float64())], ["key", "rank"])

        ranked = found.mapInArrow(rank, f"key {s['key']}, rank double")
        if among is not None:
            ranked = ranked.join(among, "key")
        return ranked.orderBy(F.desc("rank"), "key")


def _schema(key: str) -> str:
    return f"key {key}, term string, places array<int>, labels array<int>, length int, distinct int"


def build(docs: DataFrame, key: str, fields: dict[str, str], folder: str, buckets: int = BUCKETS, stem_words: bool = False) -> PositionalIndex:
    """Write the postings of ``docs(key, fields...)``, whose keys are distinct, into a new folder; ``fields`` have a label from A to D each, and stand one behind the other.  Nulls are empty.

    Places beyond ``LAST`` are one place, and of a word the first ``PLACES`` count, as the rank's definition has it; a document's length is how many places its words keep.
    """
    kind, names = docs.schema[key].dataType.simpleString(), list(fields)
    labels = ["DCBA".index(fields[f]) for f in names]
    made = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[tokens(F.col(f).cast("string")).alias(f"w{i}") for i, f in enumerate(names)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                lists = [batch.column(f"w{i}")[row].values for i in range(len(names))]
                own = pa.concat_arrays(lists).dictionary_encode()
                if not len(own):
                    continue
                code, words = own.indices.to_numpy(), own.dictionary
                if stem_words:
                    known = pa.array([stem(fold(w)) for w in words.to_pylist()], pa.string()).dictionary_encode()
                    code, words = known.indices.to_numpy()[code], known.dictionary
                label = np.repeat(labels, [len(x) for x in lists])
                at = np.minimum(np.arange(1, len(code) + 1), LAST)
                # of a word's uses at one place, which only the last place has, the best label counts
                order = np.lexsort([-label, at, code])
                code, at, label = code[order], at[order], label[order]
                first = np.concatenate([[True], (code[1:] != code[:-1]) | (at[1:] != at[:-1])])
                code, at, label = code[first], at[first], label[first]
                heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                sizes = np.diff(np.append(heads, len(code)))
                kept = np.arange(len(code)) - np.repeat(heads, sizes) < PLACES
                sizes = np.minimum(sizes, PLACES)
                ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                n = len(heads)
                columns = [
                    pa.array([batch.column("key")[row].as_py()] * n, batch.column("key").type),
                    words.take(pa.array(code[heads])),
                    pa.ListArray.from_arrays(ends, pa.array(at[kept].astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(label[kept].astype(np.int32))),
                    pa.array(np.full(n, kept.sum(), np.int32)),
                    pa.array(np.full(n, n, np.int32)),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, ["key", "term", "places", "labels", "length", "distinct"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rows = made.mapInArrow(place, _schema(kind)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    spread = F.pmod(F.xxhash64("key"), F.lit(8))  # a frequent word's postings are several files
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")
    settings = {"key": kind, "buckets": buckets, "stem": stem_words}
    docs.sparkSession.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.parquet(f"{folder}/settings")
    return PositionalIndex(docs.sparkSession, folder)
