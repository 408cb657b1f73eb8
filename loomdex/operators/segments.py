"""A text index that is kept up to date by segments, and top-k searches that read the postings that can matter.

A segment is written once: its documents, and their postings.  Documents are dealt into stripes of similar length; a posting row is a term in a stripe, with the
greatest frequency of each field and the least length there, apart from the arrays of keys, lengths and frequencies.  Nothing but these rows is shuffled.

``add`` writes a segment, and the keys that it replaces go on a deletion list, as those of ``delete`` do, together with how much the counts of each of their terms fall.
``maintain`` writes segments of like size together.  What counts is one row a version, the last of which names the live segments and lists; its
file appears under its name in one move, so a search sees a version whole, and two writers can't publish the same one.  Statistics are sums over the live segments, less
the lists', so a search finds what it would in an index made anew.

``search`` bounds each stripe's best score by its rows without arrays, scores the most promising stripes, and then only those others whose bound reaches the
score of the k-th found so far.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.stemming import fold, stem, stemmed
from loomdex.operators.retrieval import K1, B, query_terms, tokens
from loomdex.plans.lineage import cut
from loomdex.plans.versions import publish, state_of

#: Documents of a stripe, folders of postings, segments of like size that are merged.
STRIPE, BUCKETS, FANOUT = 256, 16, 4
#: Stripes that are scored first, and stripes named one by one in a plan; more are joined.
FIRST, MOST = 64, 4096
#: Bytes a core of an input that is dealt to all cores; larger ones are taken as they are partitioned.
SMALL = 32 << 20
#: Ranges of stripes that the reader of the files is told, and rows of a page, of which it passes over those beside the ranges.
RANGES, PAGE_ROWS = 32, 256


def _inverted(fields: int, stems: bool):
    """Rows of ``(key, stripe, w0.. array<string>)`` to posting rows, a stripe at a time."""

    def of_stripe(part: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = part.num_rows
        counts = np.stack([pc.list_value_length(part.column(f"w{f}")).to_numpy() for f in range(fields)])
        own = pa.concat_arrays([part.column(f"w{f}").flatten() for f in range(fields)]).dictionary_encode()
        if not len(own):
            return None
        code, words = own.indices.to_numpy().astype(np.int64), own.dictionary
        if stems:
            known = pa.array([stem(fold(w)) for w in words.to_pylist()], pa.string()).dictionary_encode()
            code, words = known.indices.to_numpy().astype(np.int64)[code], known.dictionary
        doc = np.concatenate([np.repeat(np.arange(rows), c) for c in counts])
        field = np.repeat(np.arange(fields), counts.sum(axis=1))
        each, uses = np.unique((code * rows + doc) * fields + field, return_counts=True)
        posting, at = np.unique(each // fields, return_inverse=True)
        tfs = np.zeros((len(posting), fields), np.int32)
        tfs[at, each % fields] = uses
        code, doc = np.divmod(posting, rows)
        heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(heads, len(posting)).astype(np.int32)
        lengths = counts.sum(axis=0).astype(np.int32)[doc]
        listed = [part.column("key").take(pa.array(doc)), lengths, *[tfs[:, f] for f in range(fields)]]
        columns = {
            "stripe": pa.array(np.repeat(part.column("stripe")[0].as_py(), len(heads)), pa.int64()),
            "term": words.take(pa.array(code[heads])).cast(pa.string()),
            "n": pa.array(np.diff(ends)),
            "least": pa.array(np.minimum.reduceat(lengths, heads)),
            **{f"m{f}": pa.array(np.maximum.reduceat(tfs[:, f], heads)) for f in range(fields)},
            **{f"s{f}": pa.array(np.add.reduceat(tfs[:, f].astype(np.int64), heads)) for f in range(fields)},
            **{name: pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for name, v in zip(("keys", "lengths", *[f"t{f}" for f in range(fields)]), listed, strict=True)},
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stripe = batch.column("stripe").to_numpy()
            edges = [0, *(np.flatnonzero(stripe[1:] != stripe[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and (made := of_stripe(batch.slice(a, b - a))) is not None:
                    yield made

    return run


def in_ranges(column: str, numbers: Sequence[int]) -> Column:
    """Whether a column is in the ``RANGES`` closest ranges around some numbers, as a filter that file readers understand."""
    numbers = sorted(set(numbers))
    gaps = sorted(range(1, len(numbers)), key=lambda i: numbers[i - 1] - numbers[i])[: RANGES - 1]
    edges = [0, *sorted(gaps), len(numbers)]
    within = F.lit(False)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            within = within | F.col(column).between(numbers[a], numbers[b - 1])
    return within


def _posting_rows(state: dict) -> str:
    """Columns of the posting rows: greatest frequencies and their sums a field, and the postings."""
    n = range(len(state["fields"]))
    numbers = [*[f"m{i} int" for i in n], *[f"s{i} long" for i in n]]
    return ", ".join(["stripe long", "term string", "n int", "least int", *numbers, f"keys array<{state['key']}>", "lengths array<int>", *[f"t{i} array<int>" for i in n]])


@dataclass(frozen=True)
class Segments:
    """An index in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    # versions

    def state(self) -> dict:
        return state_of(self.spark, self.folder)

    def _publish(self, state: dict) -> dict:
        return publish(self.spark, self.folder, state)

    # tables

    def _docs(self, state: dict, names: Sequence[str]) -> DataFrame:
        schema = f"key {state['key']}, stripe long, {', '.join(f'f{i} string' for i in range(len(state['fields'])))}, segment string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/docs").filter(F.col("segment").isin(list(names)))

    def _postings(self, state: dict, names: Sequence[str]) -> DataFrame:
        schema = f"{_posting_rows(state)}, segment string, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/postings").filter(F.col("segment").isin(list(names)))

    def _deleted(self, state: dict) -> DataFrame | None:
        """``(segment, key)`` of rows that live segments hold no more."""
        lists = [d["name"] for d in state["deletes"]]
        if not lists:
            return None
        rows = self.spark.read.schema(f"segment string, key {state['key']}, name string").parquet(f"{self.folder}/deleted")
        return rows.filter(F.col("name").isin(lists) & F.col("segment").isin(list(state["segments"]))).select("segment", "key")

    def live(self, state: dict | None = None, names: Sequence[str] | None = None) -> DataFrame:
        """``(segment, key, f0..)`` of the documents that a search can find."""
        state = state or self.state()
        rows = self._docs(state, names if names is not None else list(state["segments"])).drop("stripe")
        gone = self._deleted(state)
        return rows if gone is None else rows.join(gone, ["segment", "key"], "left_anti")

    # changes

    def _write(self, state: dict, docs: DataFrame) -> tuple[str, dict]:
        """Write ``docs(key, f0..)`` as a segment; its name and statistics."""
        name, n = uuid.uuid4().hex, len(state["fields"])
        fields = [f"f{i}" for i in range(n)]
        rows = docs.select("key", *fields)
        cores = self.spark.sparkContext.defaultParallelism
        if rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * SMALL:
            rows = rows.repartition(cores, "key")  # few files would be few tasks
        short_first = rows.sortWithinPartitions(sum((F.length(f) for f in fields), F.lit(0)), "key")
        place = f"{self.folder}/docs/segment={name}"
        short_first.withColumn("stripe", F.floor(F.monotonically_increasing_id() / state["stripe"])).write.option("compression", "zstd").parquet(place)
        words = self._docs(state, [name]).select("key", "stripe", *[tokens(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)])
        rows = words.mapInArrow(_inverted(n, state["stem"]), _posting_rows(state)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(state["buckets"])).cast("int"))
        out = rows.repartition("bucket", F.pmod("stripe", F.lit(4))).sortWithinPartitions("bucket", "term", "stripe").write.partitionBy("bucket").option("compression", "zstd")
        out.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.folder}/postings/segment={name}")
        sums = self._postings(state, [name]).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)) for i in range(n)]).head()  # one row
        return name, {"n": self._docs(state, [name]).count(), "tokens": list(sums)}

    def _delete(self, state: dict, keys: DataFrame) -> dict:
        """``state`` with a list of the live rows of ``keys(key)``."""
        if not state["segments"]:
            return state
        n = len(state["fields"])
        hit = cut(self.live(state).join(keys.select("key").distinct(), "key", "left_semi").select("segment", "key", *[tokens(F.col(f"f{i}")).alias(f"w{i}") for i in range(n)]))
        sums = hit.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.size(f"w{i}")).alias(f"l{i}") for i in range(n)]).collect()  # a row a segment
        if not sums:
            return state
        name = uuid.uuid4().hex
        hit.select("segment", "key").write.parquet(f"{self.folder}/deleted/name={name}")
        each = hit.select("segment", "key", F.explode(F.array_distinct(F.concat(*[f"w{i}" for i in range(n)]))).alias("term"))
        if state["stem"]:
            each = each.withColumn("term", stemmed("term")).distinct()
        each.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("term").write.parquet(f"{self.folder}/fallen/name={name}")
        lost = {r["segment"]: {"n": r["n"], "tokens": [r[f"l{i}"] for i in range(n)]} for r in sums}
        return {**state, "deletes": [*state["deletes"], {"name": name, "segments": lost}]}

    def add(self, docs: DataFrame, key: str) -> Segments:
        """Insert ``docs(key, fields...)``, whose keys are distinct, or replace what has their keys; null texts are empty, null keys are left out."""
        state = self.state()
        own = docs.select(F.col(key).cast(state["key"]).alias("key"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(state["fields"])]).filter("key IS NOT NULL")
        name, counts = self._write(state, own)
        if counts["n"]:
            state = self._delete(state, self._docs(state, [name]))
            self._publish({**state, "segments": {**state["segments"], name: counts}})
        return self

    def delete(self, keys: DataFrame, key: str = "key") -> Segments:
        """Remove documents by their keys."""
        before = self.state()
        state = self._delete(before, keys.select(F.col(key).cast(before["key"]).alias("key")))
        if state is not before:
            self._publish(state)
        return self

    def maintain(self, fanout: int = FANOUT) -> Segments:
        """Write ``fanout`` or more segments of like size as one, and any whose rows are mostly deleted anew; once, so call it after every change."""
        state = self.state()
        lost = {s: sum(d["segments"].get(s, {"n": 0})["n"] for d in state["deletes"]) for s in state["segments"]}
        by_size: dict[int, list[str]] = {}
        for s, c in state["segments"].items():
            by_size.setdefault(int(math.log(max(1, c["n"] - lost[s]), fanout) + 1e-9), []).append(s)
        groups = [g for g in by_size.values() if len(g) >= fanout]
        groups += [[s] for s, c in state["segments"].items() if 2 * lost[s] > c["n"] and not any(s in g for g in groups)]
        for names in groups:
            segments = {s: c for s, c in state["segments"].items() if s not in names}
            if any(state["segments"][s]["n"] > lost[s] for s in names):
                name, counts = self._write(state, self.live(state, names))
                segments[name] = counts
            deletes = [{**d, "segments": {s: c for s, c in d["segments"].items() if s not in names}} for d in state["deletes"]]
            state = self._publish({**state, "segments": segments, "deletes": [d for d in deletes if d["segments"]]})
        return self

    # searches

    def _asked(self, state: dict, terms: Sequence[str]) -> DataFrame:
        """The posting rows of the terms; their buckets are constants, so other folders aren't listed in the plan."""
        in_bucket = [(F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(state["buckets"])).cast("int")) & (F.col("term") == t) for t in terms]
        wanted = in_bucket[0]
        for c in in_bucket[1:]:
            wanted = wanted | c
        return self._postings(state, list(state["segments"])).filter(wanted)

    def search(self, query: str, weights: dict[str, float] | None = None, among: DataFrame | None = None, limit: int | None = None, all_terms: bool = False) -> DataFrame:
        """``(key, score)``, best first, ties by key: BM25 as ``retrieval.bm25`` over the live documents, then kept for keys in ``among(key, ...)``, whose other columns stay.

        Without a limit all hits are scored.  ``all_terms`` asks for documents that have every term.
        """
        state = self.state()
        terms = query_terms(query)
        if state["stem"]:
            terms = sorted({stem(fold(t)) for t in terms})
        empty = self.spark.createDataFrame([], f"key {state['key']}, score double")
        if not terms or not state["segments"]:
            return empty if among is None else empty.join(among, "key")
        scorer = _Scorer(self, state, terms, weights, among, all_terms)
        return scorer.all() if limit is None else scorer.best(limit)


class _Scorer:
    """One search over one version."""

    def __init__(self, index: Segments, state: dict, terms: list[str], weights: dict[str, float] | None, among: DataFrame | None, all_terms: bool):
        self.spark, self.terms, self.among, self.all_terms, self.fields = index.spark, terms, among, all_terms, range(len(state["fields"]))
        self.w = [float((weights or {}).get(f, 1.0 if weights is None else 0.0)) for f in state["fields"]]
        self.rows, self.deleted = index._asked(state, terms), index._deleted(state)
        df = {r["term"]: r["n"] for r in self.rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a query term
        n, tokens_ = sum(c["n"] for c in state["segments"].values()), sum(sum(c["tokens"]) for c in state["segments"].values())
        for lost in (c for d in state["deletes"] for c in d["segments"].values()):
            n, tokens_ = n - lost["n"], tokens_ - sum(lost["tokens"])
        if self.deleted is not None:
            fallen = index.spark.read.schema("segment string, term string, n long, name string").parquet(f"{index.folder}/fallen")
            fallen = fallen.filter(F.col("name").isin([d["name"] for d in state["deletes"]]) & F.col("term").isin(terms) & F.col("segment").isin(list(state["segments"])))
            for r in fallen.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a query term
                df[r["term"]] -= r["n"]
        self.mean = tokens_ / max(1, n) or 1.0
        self.idf = F.lit(0.0)
        for t, k in sorted(df.items()):
            self.idf = F.when(F.col("term") == t, F.lit(max(1e-6, math.log((n - k + 0.5) / (k + 0.5))))).otherwise(self.idf)

    def _part(self, tf: str, length: str) -> Column:
        wtf = sum((F.col(f"{tf}{i}") * F.lit(x) for i, x in zip(self.fields, self.w, strict=True)), F.lit(0.0))
        return self.idf * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * F.col(length) / self.mean))

    def scored(self, rows: DataFrame) -> DataFrame:
        """``(key, score)`` by the postings in ``rows``."""
        each = rows.select("segment", "term", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("lengths").alias("length"), *[F.col(f"t{i}") for i in self.fields])))
        if self.deleted is not None:
            each = each.join(self.deleted, ["segment", "key"], "left_anti")
        out = each.groupBy("key").agg((-F.sum(self._part("t", "length"))).alias("score"), F.count(F.lit(1)).alias("_terms"))
        if self.all_terms:
            out = out.filter(F.col("_terms") == len(self.terms))
        out = out.drop("_terms")
        return out if self.among is None else out.join(self.among, "key")

    def all(self) -> DataFrame:
        return self.scored(self.rows).orderBy("score", "key")

    def stripes(self) -> DataFrame:
        """``(segment, stripe, bound)``: no document of the stripe scores more."""
        heads = self.rows.groupBy("segment", "stripe").agg((F.sum(self._part("m", "least")) * (1 + 1e-9)).alias("bound"), F.count_distinct("term").alias("_terms"))
        return heads.filter(F.col("_terms") == len(self.terms)).drop("_terms") if self.all_terms else heads.drop("_terms")

    def within(self, chosen: Sequence) -> DataFrame:
        """The posting rows of at most ``MOST`` stripes, of which the reader is told ranges."""
        exact = F.lit(False)
        for s in sorted({r["segment"] for r in chosen}):
            exact = exact | ((F.col("segment") == s) & F.col("stripe").isin([r["stripe"] for r in chosen if r["segment"] == s]))
        return self.rows.filter(in_ranges("stripe", [r["stripe"] for r in chosen]) & exact)

    def best(self, k: int) -> DataFrame:
        if k <= 0:
            return self.all().limit(0)
        # the stripes that can be named in a plan; with one more, which tells that there are others, and how good those can be
        known = self.stripes().orderBy(F.desc("bound"), "segment", "stripe").limit(MOST + 1).collect()
        many, all_known = FIRST, len(known) <= MOST
        while True:
            found = self.scored(self.within(known[:many])).orderBy("score", "key").limit(k)
            rows = found.collect()  # k rows
            full = len(rows) == k
            reach = [r for r in known if not full or r["bound"] >= -rows[-1]["score"]]  # best bounds first
            if len(reach) <= many and (all_known or full and len(reach) < len(known)):
                return self.spark.createDataFrame(rows, found.schema)
            if not all_known and len(reach) == len(known):
                if full:
                    least = -rows[-1]["score"]
                    return self.scored(self.rows.join(self.stripes().filter(F.col("bound") >= least).drop("bound"), ["segment", "stripe"], "left_semi")).orderBy("score", "key").limit(k)
                if many >= MOST:
                    return self.all().limit(k)
            many = len(reach) if full else min(MOST, many * 4)


def create(spark: SparkSession, folder: str, fields: Sequence[str], key: str = "long", stripe: int = STRIPE, buckets: int = BUCKETS, stem_words: bool = False) -> Segments:
    """An index without documents in a new folder; ``key`` is the keys' type."""
    index = Segments(spark, folder)
    index._publish({"version": 0, "key": key, "fields": list(fields), "stripe": stripe, "buckets": buckets, "stem": stem_words, "segments": {}, "deletes": []})
    return index


def build(docs: DataFrame, key: str, fields: Sequence[str], folder: str, **options) -> Segments:
    """The index of ``docs(key, fields...)`` in a new folder."""
    return create(docs.sparkSession, folder, fields, docs.schema[key].dataType.simpleString(), **options).add(docs, key)
