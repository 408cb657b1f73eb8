"""Document quality by hierarchical empirical Bayes.

A document classifier reads shape features of the whole text (letter cases, symbols, repetition, lengths),
each cut at its sample quantiles, with one weight a cell.  Its evidence meets that of the site: the good
share of every host is shrunk to the global share, and that of every path below a host to its host, with
strengths estimated from the spread of shares at each level.  A document's posterior log-odds are the
classifier's plus the path's posterior log-odds less the global ones, so a sparse site changes little.

Site counts come from all labelled documents by grouped aggregation.  The classifier is fitted in one task
to at most ``SAMPLE`` labelled documents, those with the lowest hash of their id; scoring covers every text whole.

Defined cases: null text is empty; null host or path is a group of its own; with no labels, or one label
only, the classifier says that share (1/2 without any) for all; equal texts of one site, and repeated rows, score alike; labels of ids that
have several are taken once, the least; several rows of one labelled id all count for their site; a score at the bound keeps; very long texts are read
whole, one at a time; extra columns pass through under their names, and new ones give way (``fresh``); an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.names import fresh
from loomdex.llm.text import _IS_SPACE, sliced, text_bytes, trimmed, words
from loomdex.plans.lineage import cut

SAMPLE, CELLS, ROUNDS, RATE, DECAY = 12_000, 12, 300, 0.1, 1e-3
MOST_STRENGTH = 1_000.0
MOST_BROADCAST = 100_000
_CLASS = np.zeros(256, np.int64)  # 0 lower-case and other letters, 1 upper case, 2 digits, 3 plain punctuation, 4 other symbols, 5 blanks, 6 newlines
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[ord(c) for c in ".,;:'\"-()?!"]] = 3
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?!"]] = 4
_CLASS[_IS_SPACE] = 5
_CLASS[0x0A] = 6
NAMES = ("upper", "digits", "punctuation", "symbols", "blanks", "newlines", "words", "distinct", "twins", "pairs", "word_length", "marks")


def shapes(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` features for each text."""
    data, bounds = text_bytes(column)
    rows, sizes = len(column), np.diff(bounds)
    of = np.repeat(np.arange(rows), sizes)
    counts = np.bincount(of * 7 + _CLASS[data], minlength=rows * 7).reshape(rows, 7)
    marks = np.bincount(of[data == 0x21], minlength=rows)
    hashes, at = words(column)
    n = np.diff(at)
    out = np.zeros((rows, len(NAMES)))
    out[:, :6] = counts[:, 1:] / np.maximum(sizes, 1)[:, None]
    out[:, 6] = np.log1p(n)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        h = hashes[a:b]
        if b > a:
            s = np.sort(h)
            out[i, 7] = (1 + np.count_nonzero(s[1:] != s[:-1])) / len(h) * np.log1p(len(h))  # distinct words fall with length
        if b - a > 1:
            pair = np.sort(h[1:] * np.uint64(31) + h[:-1])
            out[i, 8] = np.count_nonzero(h[1:] == h[:-1]) / (len(h) - 1)
            out[i, 9] = 1 - (1 + np.count_nonzero(pair[1:] != pair[:-1])) / len(pair)
    out[:, 10] = (counts.sum(axis=1) - counts[:, 5] - counts[:, 6]) / np.maximum(n, 1)
    out[:, 11] = marks / np.maximum(n, 1)
    return out


def _cells(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") + j * (CELLS + 1) for j, e in enumerate(edges)], axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    if not len(y) or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.5}
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CELLS + 1)[1:-1])).tolist() for j in range(x.shape[1])]
    # the rarer label's own range gets cells too
    rare = x[y == (0 if y.mean() > 0.5 else 1)]
    edges = [np.unique([*e[::2], *np.quantile(rare[:, j], np.linspace(0, 1, CELLS // 2 + 1)[1:-1]).tolist()]).tolist()[:CELLS] for j, e in enumerate(edges)]
    at = _cells(x, edges)
    w, b, m, v, mb, vb = np.zeros(len(NAMES) * (CELLS + 1)), 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1) + b, -30, 30)))
        g = (p - y) / len(y)
        gw, gb = np.bincount(at.ravel(), weights=np.repeat(g, at.shape[1]), minlength=len(w)) + DECAY * w / len(w), g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 / (1 - 0.9**t), 1 / (1 - 0.999**t)
        w, b = w - RATE * m * up / (np.sqrt(v * down) + 1e-8), b - RATE * mb * up / (np.sqrt(vb * down) + 1e-8)
    return {"edges": edges, "weights": w.tolist(), "bias": float(b)}


def one_label(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """The classifier of ``docs(doc_id, text)`` and ``labels(doc_id, y)``; it alone comes to the driver."""
    chosen = F.broadcast(one_label(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most ``most`` short rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "text", "y")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                x = shapes(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), part.column("y").cast(pa.int32())], names=["doc_id", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((r["doc_id"], tuple(r["x"]), r["y"]) for b in batches for r in b.to_pylist())
        model = fit(np.array([x for _, x, _ in own]).reshape(-1, len(NAMES)), np.array([y for _, _, y in own], float))
        yield pa.RecordBatch.from_pylist([{"model": json.dumps(model)}])

    shaped = rows.mapInArrow(lambda batches: trimmed(shape(batches)), "doc_id long, x array<double>, y int")
    # the scan stays spread; the sample alone meets in one task
    fitted = shaped.repartition(1).mapInArrow(run, "model string").head()
    return json.loads(fitted[0]) if fitted else fit(np.empty((0, len(NAMES))), np.empty(0))


def evidence(docs: DataFrame, model: dict, passed: tuple[str, ...]) -> DataFrame:
    """The ``passed`` columns of ``docs(..., text)`` and ``_logit``: the classifier's log-odds of good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "_scored_text"):
                if "share" in model:
                    p = np.clip(model["share"], 1e-3, 1 - 1e-3)
                    logit = np.full(part.num_rows, np.log(p / (1 - p)))
                else:
                    logit = np.array(model["weights"])[_cells(shapes(part.column("_scored_text")), model["edges"])].sum(axis=1) + model["bias"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(passed))), pa.array(logit)], names=[*passed, "_logit"])

    mine = docs.select(*[F.col(f"`{c}`") for c in passed], F.col("text").cast("string").alias("_scored_text"))
    return mine.mapInArrow(lambda batches: trimmed(run(batches)), T.StructType([*mine.schema.fields[:-1], T.StructField("_logit", T.DoubleType())]))


def _strength(groups: DataFrame) -> float:
    """Prior strength by moments over ``groups(n, good, mu)``: 1 / rho - 1, rho the intra-group correlation."""
    n, mu = F.col("n"), F.col("mu")
    over, room = groups.filter("n > 1").agg(F.sum(n * (F.col("good") / n - mu) ** 2 - mu * (1 - mu)), F.sum((n - 1) * mu * (1 - mu))).head()
    if not room:
        return MOST_STRENGTH
    return float(min(MOST_STRENGTH, max(1.0, 1 / max(1e-6, min(1.0, over / room)) - 1)))


def sites(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, path, n, path_mean, host_mean, global_mean)`` from the labels of ``docs(doc_id, host, path)``, one row a path."""
    # a row a path, read by every level
    counted = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "host", "path")
        .join(one_label(labels), "doc_id", "left")
        .groupBy("host", "path")
        .agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good"))
    )
    n, good = counted.agg(F.sum("n"), F.sum("good")).head()
    mu = ((good or 0) + 1) / ((n or 0) + 2)
    hosts = counted.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    k = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(mu).alias("mu")))
    hosts = hosts.select(F.col("host").alias("of_host"), ((F.col("host_good") + k * mu) / (F.col("host_n") + k)).alias("host_mean"))
    placed = counted.join(hosts, counted["host"].eqNullSafe(hosts["of_host"])).drop("of_host")
    kp = _strength(placed.select("n", "good", F.col("host_mean").alias("mu")))
    return placed.select("host", "path", "n", ((F.col("good") + kp * F.col("host_mean")) / (F.col("n") + kp)).alias("path_mean"), "host_mean", F.lit(mu).alias("global_mean"))


def classify(docs: DataFrame, labels: DataFrame, passed: tuple[str, ...] = ("doc_id",), model: dict | None = None, at_least: float = 0.5) -> DataFrame:
    """The ``passed`` columns of ``docs(doc_id, text, host, path)`` with ``doc_score, host_mean, path_mean, score, keep`` appended.

    ``labels(doc_id, y)`` has 1 for good.  The table of sites is sent to all tasks if it has ``MOST_BROADCAST`` rows at
    most, which is counted; a larger one is joined by site, with the same results, and Spark splits its hot sites.
    """
    names = fresh(passed, "doc_score", "host_mean", "path_mean", "score", "keep")
    model = model or train(docs, labels)
    scored = evidence(docs.withColumns({"_host": F.col("host").cast("string"), "_path": F.col("path").cast("string")}), model, (*passed, "_host", "_path"))
    known = cut(sites(docs, labels)).withColumnsRenamed({"host": "_of_host", "path": "_of_path", "path_mean": "_path_mean", "host_mean": "_host_mean", "global_mean": "_mean"})
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    joined = scored.join(known, scored["_host"].eqNullSafe(known["_of_host"]) & scored["_path"].eqNullSafe(known["_of_path"]))

    def logit(c: str) -> Column:
        return F.ln(F.col(c) / (1 - F.col(c)))

    def chance(c: Column) -> Column:
        return 1 / (1 + F.exp(-c))

    total = chance(F.col("_logit") + logit("_path_mean") - logit("_mean"))
    made = {"doc_score": chance(F.col("_logit")), "host_mean": F.col("_host_mean"), "path_mean": F.col("_path_mean"), "score": total, "keep": total >= at_least}
    return joined.select(*[F.col(f"`{c}`") for c in passed], *[c.alias(names[n]) for n, c in made.items()])
