"""A written inverted index, and searches that read their own terms alone.

``build`` writes postings dealt into buckets by a hash of the term and sorted by it, one folder a bucket, and each document's field
lengths.  A search reads the buckets of its terms (a partition filter) and, by the statistics of the sorted files, little else
of them; corpus statistics are a row written at build time.  So a search's cost follows the postings of its terms, not the corpus.

Frequencies are kept by field, so weights are chosen by each search.  With ``stem`` terms are folded and stemmed when the
index is made and when it is asked; only distinct words pass through Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.stemming import fold, stem, stemmed
from loomdex.operators.retrieval import K1, B, query_terms, ranked, rerank, token_budget, tokens

BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """An index in a folder."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def settings(self) -> dict:
        return json.loads(self._table("settings").head()["settings"])


def build(docs: DataFrame, key: str, fields: Sequence[str], folder: str, buckets: int = BUCKETS, stem_words: bool = False) -> Index:
    """Write the index of ``docs(key, fields...)``; nulls are empty, keys are distinct."""
    numbers = range(len(fields))
    made = docs.select(F.col(key).alias("key"), *[tokens(F.col(f).cast("string")).alias(f"_{i}") for i, f in enumerate(fields)])
    # a term's postings carry their documents' lengths, which a document's tokens say, so neither build nor search joins them
    sizes = [f"_l{i}" for i in numbers]
    words = made.select("key", *[F.size(f"_{i}").alias(c) for i, c in enumerate(sizes)], F.posexplode(F.concat(*[f"_{i}" for i in numbers])).alias("pos", "term"))
    ends = [sum((F.col(c) for c in sizes[: i + 1]), F.lit(0)) for i in numbers]  # the fields' tokens stand one behind the other
    tfs = [F.count_if((F.col("pos") < ends[i]) & (F.col("pos") >= ends[i] - F.col(sizes[i]))).cast("int") for i in numbers]
    counted = words.groupBy("key", *sizes, "term").agg(*[t.alias(f"_n{i}") for i, t in enumerate(tfs)])
    postings = counted.select("key", F.array(*sizes).alias("lengths"), "term", F.array(*[f"_n{i}" for i in numbers]).alias("tfs"))
    if stem_words:
        stems = postings.select("term").distinct().withColumn("stem", stemmed("term"))
        tfs = F.array(*[F.sum(F.col("tfs")[i]).cast("int") for i in numbers])
        postings = postings.join(stems, "term").groupBy("key", "lengths", F.col("stem").alias("term")).agg(tfs.alias("tfs"))
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    spread = F.pmod(F.xxhash64("key"), F.lit(8))  # a frequent term's postings are several files
    postings.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings")
    spark = docs.sparkSession
    # the sums are those of the written postings, and documents without any token are counted too
    written = spark.read.parquet(f"{folder}/postings")
    sums = written.agg(*[F.coalesce(F.sum(F.col("tfs")[i]), F.lit(0)).alias(f"l{i}") for i in numbers]).head()  # one row
    settings = {"fields": list(fields), "buckets": buckets, "stem": stem_words, "n": docs.count(), "tokens": [sums[f"l{i}"] for i in numbers]}
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")
    return Index(spark, folder)


def search(index: Index, query: str, weights: dict[str, float] | None = None, among: DataFrame | None = None, limit: int | None = None, order: Sequence[Column | str] | None = None, all_terms: bool = False) -> DataFrame:
    """``(key, score)``, best first: BM25 as ``retrieval.bm25`` over the whole index, then kept for keys in ``among(key, ...)``.

    ``among`` is any filtered or joined frame of documents (a repository, a kind, a workspace's repositories); its other
    columns stay.  ``order`` replaces the order by score.  ``all_terms`` asks for documents that have every term.
    """
    s = index.settings()
    terms = query_terms(query)
    if s["stem"]:
        terms = sorted({stem(fold(t)) for t in terms})
    postings = index._table("postings")
    hits = postings.filter(F.col("bucket").isin([b for b in _buckets(index.spark, terms, s["buckets"])]) & F.col("term").isin(terms)) if terms else postings.limit(0)
    w = [float((weights or {}).get(f, 1.0 if weights is None else 0.0)) for f in s["fields"]]
    wtf = sum((F.col("tfs")[i] * F.lit(x) for i, x in enumerate(w)), F.lit(0.0))
    length = F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a query term
    idf = F.lit(0.0)
    for t, n in sorted(df.items()):
        idf = F.when(F.col("term") == t, F.lit(max(1e-6, math.log((s["n"] - n + 0.5) / (n + 0.5))))).otherwise(idf)
    mean = sum(s["tokens"]) / max(1, s["n"]) or 1.0
    part = idf * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * length / mean))
    scored = hits.groupBy("key").agg((-F.sum(part)).alias("score"), F.count(F.lit(1)).alias("_terms"))
    if all_terms:
        scored = scored.filter(F.col("_terms") == len(terms))
    scored = scored.drop("_terms")
    if among is not None:
        scored = scored.join(among, "key")
    out = scored.orderBy(*(order or ("score", "key")))
    return out if limit is None else out.limit(limit)


def _buckets(spark: SparkSession, terms: Sequence[str], buckets: int) -> list[int]:
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()  # a row a query term
    return sorted(r[0] for r in rows)


def search_service(index: Index, query: str, rows: DataFrame, weights: dict[str, float], limit: int = 20, seen: DataFrame | None = None, boosts: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Best ``limit`` of ``rows(key, ...)`` for a query, as a session sees them: unseen ones first, by their boost, then the rank; cut at a budget of tokens.

    ``seen(key)`` and ``boosts(key, boost)`` are the session's.  A blank query raises ValueError.
    """
    if not query_terms(query):
        raise ValueError("blank query")
    best = ranked(search(index, query, weights, rows, limit), "score", "key")  # limit rows
    known = best.join((seen if seen is not None else best.select("key").limit(0)).select("key").distinct().withColumn("_seen", F.lit(True)), "key", "left")
    if boosts is not None:
        known = known.join(boosts.select("key", "boost"), "key", "left")
    else:
        known = known.withColumn("boost", F.lit(0.0))
    known = known.withColumns({"seen": F.coalesce("_seen", F.lit(False)), "boost": F.coalesce("boost", F.lit(0.0))}).drop("_seen")
    in_order = rerank(known, F.col("seen"), F.col("boost"))
    if budget is None:
        return in_order
    order = [F.col("seen").asc(), F.when(~F.col("seen"), F.col("boost")).desc_nulls_last(), F.col("rank")]
    return token_budget(in_order, order, None, budget).orderBy(*order)
