"""One query for each operator, with production parameters, over its whole table; and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import byte_bpe, centroids, license_scan, media, mixing, ngram_join, packing, quality, tiered_search, token_records, toxicity, url_reputation, va_search
from loomdex.llm.files import kept
from loomdex.llm.oracles import ORACLE_SQL as ORACLE_SQL
from loomdex.llm.text import vocabulary
from loomdex.plans.lineage import cut
from loomdex.plans.shipping import shipped


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        manifest = media.write(_table(spark, sf_dir, "documents"), folder)
        # the images' headers fill the metadata by range reads, then the whole members are read
        read = media.contents(media.metadata(media.places(manifest), folder), folder)
        columns = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *media.PLACE, *media.HEADER)  # the digest is media_sha256
        return manifest.select("doc_id", "n_bytes", "digest").join(read, "digest").select("doc_id", "n_bytes", *columns)

    return kept(spark, "media", make)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        written = token_records.write(_table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
        rows = token_records.read(written, folder).join(F.broadcast(token_records.starts(written)), "shard")  # a row a file
        return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))

    return kept(spark, "token-records", make)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        packing.tokenise(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).write.option("compression", "zstd").parquet(folder)
        pieces = packing.pack(spark.read.parquet(folder))
        return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

    return kept(spark, "packing", make)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    place = license_scan.document_path(F.col("source"), F.col("lang"), F.col("doc_id"))
    return license_scan.scan(docs.select("doc_id", place.alias("path"), "text"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return quality.classify(docs, labels, ("doc_id", "host", "path"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        vectors = va_search.usable(_table(spark, sf_dir, "embeddings"), 256.0)
        return va_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), folder, k=5)

    return kept(spark, "va", make)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(toxicity.fold(F.col("doc_id")) != 1).select("doc_id", F.col("toxic").alias("y"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "sentences")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are counted once; what is mixed are short rows
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string")))
    sized = cut(_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), key.alias("key")))
    mixed = mixing.mix(sized, words=F.col("words"), key=F.col("key"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # the first part of digits in a page's path is the id of the document that was made into it
    of_doc = pages.select("page_id", F.regexp_extract(url_reputation.path_of(F.col("url")), r"/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"))
    bad = _table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    judged = url_reputation.judge(pages, of_doc.join(bad, "doc_id").select("page_id", "bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks), ranks, keep=("doc_id", "ids"))
    in_decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(in_decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        index = tiered_search.build(_table(spark, sf_dir, "documents"), f"{folder}/index")
        return tiered_search.search(index, _table(spark, sf_dir, "benchmark"), k=20).drop("tier")

    return kept(spark, "tiers", make)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(centroids.usable(_table(spark, sf_dir, "embeddings"), dims=64, scale=64.0), k=16, rounds=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f)
    for f in (
        op1_media_shards,
        op2_token_records,
        op3_packing,
        op4_license_scan,
        op5_ngram_jaccard_join,
        op6_quality_classifier,
        op7_exact_top_k,
        op8_toxicity,
        op9_source_mix,
        op10_url_reputation,
        op11_byte_bpe,
        op12_ranked_search,
        op13_centroid_clusters,
    )
}

