"""From documents to packed training sequences: five stages, each written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.names import fresh
from loomdex.llm import mixing, ngram_join, packing, quality, toxicity
from loomdex.llm.files import passing
from loomdex.llm.text import vocabulary
from loomdex.plans.lineage import cut
from loomdex.plans.shipping import shipped

TOXIC_FROM, GOOD_FROM = 0.7, 0.5


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("y"))


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity is under ``TOXIC_FROM``.

    Rows are judged by their text alone: null and empty texts, and repeated rows, like others; a score on the bound goes; without
    labels nothing goes.  Extra columns pass through; an empty table stays empty.
    """
    labels = _labels(spark, sf_dir, "toxic").filter(toxicity.fold(F.col("doc_id")) != 1)
    scored = toxicity.score(docs, toxicity.train(docs, labels), tuple(docs.columns))
    score = scored.columns[len(docs.columns)]
    return scored.filter(F.col(score) < TOXIC_FROM).select(*_own(docs))


@shipped
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior chance of being good reaches ``GOOD_FROM``; ``source`` stands for the host, ``lang`` for the path.

    Null texts are empty ones, null sources and languages groups of their own; equal texts of one site are judged alike, a chance on the
    bound stays; without labels, or with good ones alone, nothing goes.  Extra columns pass through; an empty table stays empty.
    """
    # the classifier has names of its own, so further columns go by under others
    further = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source")]
    names = fresh(docs.columns, *[f"further_{i}" for i in range(len(further))])
    carried = {c: names[f"further_{i}"] for i, c in enumerate(further)}
    own = docs.select(*[F.col(f"`{c}`").alias(carried.get(c, c)) for c in docs.columns], F.col("source").alias("host"), F.col("lang").alias("path"))
    judged = quality.classify(own, _labels(spark, sf_dir, "quality"), tuple(carried.get(c, c) for c in docs.columns), at_least=GOOD_FROM)
    return judged.filter(F.col(judged.columns[-1])).select(*[F.col(carried.get(c, c)).alias(c) for c in docs.columns])


@shipped
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates: five-word shingles, Jaccard similarity of 0.8.

    Each row is judged by its own text, whatever its id: rows with another text under a repeated id, or without an id,
    are documents of their own.  First is the smallest id (none comes last), then the smallest SHA-256 of the text.
    Texts without words have no near-duplicates; of rows equal in id and text one stays.
    """
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).count()
    if ids.filter("id IS NULL OR count > 1").isEmpty():
        later = ngram_join.jaccard_join(docs, k=5, num=80, den=100).filter("component_id <> doc_id").select(F.col("doc_id").alias("_later"))
        return docs.join(later, F.col("doc_id") == F.col("_later"), "left_anti")
    # numbers in the order of the rule stand for the ids; written once, as they depend on the partitions
    names = fresh(docs.columns, "_digest", "_row")
    digest, row = names["_digest"], names["_row"]
    ordered = docs.withColumn(digest, F.sha2(F.col("text").cast("string"), 256)).orderBy(F.col("doc_id").cast("long").asc_nulls_last(), digest)
    rows = cut(ordered.withColumn(row, F.monotonically_increasing_id()))
    joined = ngram_join.jaccard_join(rows.select(F.col(row).alias("doc_id"), "text"), k=5, num=80, den=100)
    later = joined.filter("component_id <> doc_id").select(F.col("doc_id").alias("_later"))
    kept = rows.join(later, F.col(row) == F.col("_later"), "left_anti")
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", digest]).union(kept.filter("doc_id IS NULL")).select(*_own(docs))


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: whole copies, none above twice.

    Null and empty texts have no words, so their copies are drawn but weigh nothing; a null source is a source; repeated rows are documents of
    their own; ties are drawn in a fixed order, so reruns agree.  Extra columns pass through; an empty table stays empty.
    """
    return mixing.repeated(docs)


@shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 4096 tokens; ids as little-endian unsigned 16-bit integers.

    Null and empty texts are documents of the end id alone; copies are laid out one after the other, in a fixed order; long
    texts are cut freely.  Extra columns are not read; an empty table gives no pieces.
    """
    folder = passing(spark, "packing")
    packing.tokenise(docs, vocabulary("word_bpe_49k.json")).write.option("compression", "zstd").parquet(folder)
    return packing.pack(spark.read.parquet(folder), id_bytes=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Two fitted models and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces made of ``documents``; every stage's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            folder = passing(spark, f"stage-{i}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
