"""A written index of three-character grams, and exact text searches that read the files that can match.

Files are dealt into stripes.  A gram's row in a stripe lists the files that hold it, and for each a mask of the places, modulo 64, where it begins there.  The grams
of a text that is sought stand at known distances, so the masks, each turned by its gram's distance, must have a bit in common: that leaves files that hold all grams in the
right places but for 64, whose lines are then compared.  Only the rarest grams of a long text are looked up.

Letters are compared as small ones.  A text of less than three characters is sought in all files, as is a pattern without such a literal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators.retrieval import grep, line_hits
from loomdex.operators.segments import MOST, SMALL, in_ranges

#: Files of a stripe, folders of grams, grams that are looked up for one literal, and literals for one pattern.
STRIPE, BUCKETS, RAREST, LITERALS = 256, 16, 8, 4
GRAMS = "stripe long, gram long, n int, places array<int>, masks array<long>"
_NEWLINE = 10


def grams_of(text: str) -> list[int]:
    """The grams of a text in order, as numbers; 21 bits a character."""
    c = [ord(x) for x in text]
    return [a << 42 | b << 21 | d for a, b, d in zip(c, c[1:], c[2:])]


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(stripe, place, low)`` to ``GRAMS``, a stripe at a time; grams over an end of line are left out."""
    for batch in batches:
        stripe = batch.column("stripe").to_numpy()
        edges = [0, *(np.flatnonzero(stripe[1:] != stripe[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            gram, file, mask = [], [], []
            for place, text in zip(batch.column("place")[a:b].to_pylist(), batch.column("low")[a:b].to_pylist(), strict=True):
                c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                if len(c) < 3:
                    continue
                inside = (c[:-2] != _NEWLINE) & (c[1:-1] != _NEWLINE) & (c[2:] != _NEWLINE)
                at = np.flatnonzero(inside)
                own, which = np.unique((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[at], return_inverse=True)
                bits = np.zeros(len(own), np.uint64)
                np.bitwise_or.at(bits, which, np.uint64(1) << (at % 64).astype(np.uint64))
                gram.append(own)
                file.append(np.full(len(own), place, np.int32))
                mask.append(bits.view(np.int64))
            if not gram or not sum(map(len, gram)):
                continue
            key, place, bits = np.concatenate(gram), np.concatenate(file), np.concatenate(mask)
            order = np.argsort(key, kind="stable")
            key, place, bits = key[order], place[order], bits[order]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = pa.array(np.append(heads, len(key)).astype(np.int32))
            columns = [np.full(len(heads), stripe[a]), key[heads], np.diff(np.append(heads, len(key))).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(ends, pa.array(place)), pa.ListArray.from_arrays(ends, pa.array(bits))], ["stripe", "gram", "n", "places", "masks"])


def literals(pattern: str) -> list[str]:
    """Texts of three ASCII characters or more, of small letters, that every match of a regular expression holds, longest first."""
    import re._constants as ops
    import re._parser as parser

    found: list[str] = []

    def walk(parsed, run: str) -> str:
        """The run of literals that the parsed part leaves open, where ``run`` stands before it."""
        for op, value in parsed:
            if op is ops.LITERAL and value < 128 and value != _NEWLINE:
                run += chr(value).lower()
                continue
            if op is ops.SUBPATTERN:
                run = walk(value[-1], run)
                continue
            if op is ops.AT:
                continue
            found.append(run)
            run = ""
            if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
                found.append(walk(value[-1], ""))
            elif op is ops.ATOMIC_GROUP:
                found.append(walk(value, ""))
        return run

    try:
        found.append(walk(parser.parse(pattern), ""))
    except (re.error, OverflowError):  # what the other dialect alone knows
        return []
    return sorted({x for x in found if len(x) >= 3}, key=lambda x: (-len(x), x))


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def files(self) -> DataFrame:
        """``(path, content, stripe, place, part)``."""
        return self.spark.read.schema("path string, content string, stripe long, place int, part string").parquet(f"{self.folder}/files")

    def add(self, files: DataFrame, part: str) -> TextIndex:
        """Append ``files(path, content)``, whose paths the index doesn't hold, under the batch's name; null contents are empty."""
        rows = files.select("path", F.coalesce("content", F.lit("")).alias("content"))
        cores = self.spark.sparkContext.defaultParallelism
        if rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * SMALL:
            rows = rows.repartition(cores, "path")  # few files would be few tasks
        number = F.monotonically_increasing_id()
        placed = rows.withColumn("_n", number).select("path", "content", F.floor(F.col("_n") / STRIPE).alias("stripe"), (F.col("_n") % STRIPE).cast("int").alias("place"))
        placed.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", STRIPE).parquet(f"{self.folder}/files/part={part}")
        low = self.files().filter(F.col("part") == part).select("stripe", "place", F.lower("content").alias("low"))
        made = low.mapInArrow(_inverted, GRAMS).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        dealt = made.repartition("bucket", F.pmod("stripe", F.lit(4))).sortWithinPartitions("bucket", "gram", "stripe")
        dealt.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", 1000).parquet(f"{self.folder}/grams/part={part}")
        return self

    def candidates(self, texts: Sequence[str]) -> DataFrame | None:
        """``(part, stripe, place)`` of the files that can hold all texts; None where no gram tells."""
        sought = {i: grams_of(t) for i, t in enumerate(texts) if len(t) >= 3}
        if not sought:
            return None
        rows = self.spark.read.schema(f"{GRAMS}, part string, bucket int").parquet(f"{self.folder}/grams")
        every = sorted({g for own in sought.values() for g in own})
        here = F.col("bucket").isin([F.pmod(F.xxhash64(F.lit(g).cast("long")), F.lit(BUCKETS)).cast("int") for g in every]) & F.col("gram").isin(every)
        uses = {r["gram"]: r["n"] for r in rows.filter(here).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the texts
        # (literal, gram, its distance from the literal's beginning)
        asked = [(i, g, o) for i, own in sought.items() for g, o in sorted(zip(own, range(len(own))), key=lambda x: (uses.get(x[0], 0), x[1]))[:RAREST]]
        chosen, turns = sorted({g for _, g, _ in asked}), F.lit(None)
        for g in chosen:
            own = F.array(*[F.struct(F.lit(i).alias("literal"), F.lit(o % 64).alias("turn")) for i, h, o in asked if h == g])
            turns = F.when(F.col("gram") == g, own).otherwise(turns)
        hits = rows.filter(here & F.col("gram").isin(chosen)).withColumn("turns", turns).select("part", "stripe", "turns", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("masks").alias("mask"))))
        each = hits.select("part", "stripe", "place", "mask", F.inline("turns"))
        turned = F.expr("shiftrightunsigned(mask, turn) | if(turn = 0, 0L, shiftleft(mask, 64 - turn))")
        by_literal = each.groupBy("part", "stripe", "place", "literal").agg(F.bit_and(turned).alias("common"), F.count(F.lit(1)).alias("n"))
        enough = F.lit(False)
        for i in sought:
            enough = enough | ((F.col("literal") == i) & (F.col("n") == sum(1 for x in asked if x[0] == i)))
        whole = by_literal.filter(enough & (F.col("common") != 0)).groupBy("part", "stripe", "place").agg(F.count(F.lit(1)).alias("n"))
        return whole.filter(F.col("n") == len(sought)).drop("n")

    def among(self, texts: Sequence[str]) -> DataFrame:
        """``(path, content)`` of the files that can hold all texts."""
        near = self.candidates(texts)
        if near is None:
            return self.files().select("path", "content")
        stripes = near.select("part", "stripe").distinct().limit(MOST + 1).collect()
        files = self.files()
        if len(stripes) <= MOST:  # the reader passes over the others
            files = files.filter(F.col("part").isin(sorted({r["part"] for r in stripes})) & in_ranges("stripe", [r["stripe"] for r in stripes]))
        return files.join(near, ["part", "stripe", "place"], "left_semi").select("path", "content")

    def grep(self, needle: str, around: int = 0, limit: int | None = None) -> DataFrame:
        """``retrieval.grep`` over all files."""
        low = needle.lower()
        return grep(self.among([low] if "\n" not in low else []), needle, around, limit)

    def match(self, pattern: str, around: int = 0, limit: int | None = None) -> DataFrame:
        """As ``grep``, of the lines that a regular expression finds something in."""
        files = self.among(literals(pattern)[:LITERALS])
        return line_hits(files, lambda line: line.rlike(pattern), around, limit)


def build(files: DataFrame, folder: str) -> TextIndex:
    """The index of ``files(path, content)`` in a new folder."""
    return TextIndex(files.sparkSession, folder).add(files, "0")
