"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is a logistic function of how often features occur in it, less a part of the logarithm of its document's
number of sentences (one hit says less in a long text), and a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``.
The weights are fitted to document labels through the noisy-or, so the sentence scores say where the offence lies.

The fit takes at most ``SAMPLE`` labelled documents, those with the lowest hash of their id, whole however long
they are, and the ``FEATURES`` features that speak most for the label 1.  Features are counted and found in many
tasks; no text, only the numbers of the features found, meets in the one task of the fit.  It keeps them on its disk and
holds one block of documents at a time, of ``BLOCK`` documents and hits or a single document.
Scoring covers every text whole.

The sample is dealt into ``FOLDS`` by a hash of the id.  Features are chosen and weights fitted once without each fold, which is
then scored by what it had no part in.  The score that parts the labels best there (by F1) is put on ``TOXIC_FROM`` by one shift of
all log-odds, so that the documents of the sample itself don't flatter the threshold.

Defined cases: null text is empty and scores as one sentence without features; with no labelled rows, or only one label,
every score is that label's share (0 without rows); equal texts, and repeated rows, score alike; features that tie are
taken by hash; labels of ids that have several are taken once, the largest; several texts of one id all count; very long texts
are looked at one at a time; extra columns pass through under their names, and new ones give way (``fresh``); an empty table gives no rows.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.names import fresh
from loomdex.llm.bags import Features, sentence_features
from loomdex.llm.text import mix, sliced, trimmed
from loomdex.plans.lineage import cut

#: ``FEATURES`` is the power of two with the least mean log-loss over five folds of the labelled rows that learning may see, at sf0.1: 64 to 2,048 gave
#: 0.085, 0.083, 0.078, 0.076, 0.072 and 0.080.  No held-out row was looked at for it.
SAMPLE, FEATURES, FOLDS, BLOCK = 12_000, 1024, 5, 1 << 20
LEAST_DF, MOST_COUNT, ROUNDS, RATE, DECAY = 3, 3, 150, 0.15, 1e-4
START_BIAS, TOXIC_FROM = -5.0, 0.7
SENTENCE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def part_of(doc_ids: np.ndarray) -> np.ndarray:
    """The fold of each id in the fit's own calibration."""
    return (mix(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(1)) % np.uint64(FOLDS)).astype(np.int64)


def sample_of(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` of the rows ``(doc_id, y)``, by hash of the id."""
    one = labels.filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slice by slice of ``(doc_id, text, y)``: every feature's hash, its documents and the sum of their labels, fold by fold."""
    for batch in batches:
        for part in sliced(batch, "text"):
            y, fold_of = part.column("y").to_numpy(zero_copy_only=False), part_of(part.column("doc_id").to_numpy(zero_copy_only=False))
            _, rows, where, h = sentence_features(part.column("text"))
            doc = np.repeat(np.arange(part.num_rows), np.diff(rows))[where]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            kinds, at = np.unique(h[new], return_inverse=True)
            cell = at * FOLDS + fold_of[doc[new]]
            df, pos = (np.bincount(cell, w, len(kinds) * FOLDS) for w in (None, y[doc[new]]))
            some = np.flatnonzero(df)
            columns = [pa.array(kinds[some // FOLDS].view(np.int64)), pa.array((some % FOLDS).astype(np.int32)), pa.array(df[some].astype(np.int64)), pa.array(pos[some].astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "part", "df", "pos"])


def _select(rows: DataFrame, totals: dict[int, tuple[int, float]]) -> list[np.ndarray]:
    """Hashes of the features that speak most for label 1, without each fold in turn and last without none.

    ``totals`` are each fold's documents and their labels' sum.  Measure: the log-likelihood ratio of the label given the feature.
    """
    counted = rows.select("doc_id", "text", "y").mapInArrow(lambda batches: trimmed(_counted(batches)), "h long, part int, df long, pos double")

    def of(c: str, i: int) -> Column:
        return F.sum(F.when(F.col("part") == i, F.col(c)).otherwise(0))

    folds = range(FOLDS)
    sums = counted.groupBy("h").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"), *[of(c, i).alias(f"{c}{i}") for i in folds for c in ("df", "pos")])
    sums = cut(sums.filter((F.col("df") >= LEAST_DF) & (F.col("pos") > 0)))

    def best(left_out: int) -> DataFrame:
        n, good = (sum(t[k] for i, t in totals.items() if i != left_out) for k in (0, 1))
        share = min(max(good / max(1, n), 1e-9), 1 - 1e-9)
        df, pos = (F.col(c) - F.col(f"{c}{left_out}") if left_out in folds else F.col(c) for c in ("df", "pos"))
        neg = df - pos
        gain = F.when(pos > 0, pos * F.ln(pos / (df * share))).otherwise(0.0) + F.when(neg > 0, neg * F.ln(neg / (df * (1 - share)))).otherwise(0.0)
        told = sums.filter((df >= LEAST_DF) & (pos > df * share)).select(F.lit(left_out).alias("left_out"), "h", gain.alias("gain"))
        return told.orderBy(F.col("gain").desc(), F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).limit(FEATURES)

    found = reduce(DataFrame.union, [best(i) for i in (*folds, FOLDS)]).select("left_out", "h").collect()  # FEATURES a fold
    return [np.sort(np.array([r["h"] for r in found if r["left_out"] == i], np.int64).view(np.uint64)) for i in (*folds, FOLDS)]


def _found(known: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's label, its number of sentences and of those with known features, and the hits in these.

    A hit is ``sentence * len(known) + feature``, the sentence counted among those with hits, and how often, up to ``MOST_COUNT``.
    """
    features, width = Features(known), max(1, len(known))
    for batch in batches:
        for part in sliced(batch, "text"):
            _, rows, where, h = sentence_features(part.column("text"))
            keys, counts = _hits(features.find(h), where, width)
            ends, bounds = np.searchsorted(keys, rows * width), [0]
            pairs = []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                sentences, dense = np.unique(keys[i:j] // width, return_inverse=True)
                bounds.append(len(sentences))
                pairs.append((dense * width + keys[i:j] % width).astype(np.int64).tobytes())
            columns = [pa.array(np.diff(rows).astype(np.int64)), pa.array(bounds[1:], pa.int64()), pa.array(pairs, pa.binary()), pa.array([counts[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *columns], names=["doc_id", "y", "n_sents", "n_hit", "pairs", "counts"])


def _hits(f: np.ndarray, where: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``sentence * width + feature`` of the features found (none is -1), and their counts."""
    keys, counts = np.unique(where[f >= 0].astype(np.int64) * width + f[f >= 0], return_counts=True)
    return keys, np.minimum(counts, MOST_COUNT).astype(np.uint8)


def forward(theta: np.ndarray, s: np.ndarray, f: np.ndarray, c: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chances of the sentences with hits, of a document's other sentences, how many these are, and -log of 1 less the noisy-or.

    ``theta`` is weights, bias and the part of log(sentences).  Hits are (sentence, feature, count); ``doc`` is each sentence's document, ``n`` a document's sentences.
    """
    base = theta[-2] - theta[-1] * np.log(n)
    p = _chance(base[doc] + np.bincount(s, theta[f] * c, len(doc)))
    p0, rest = _chance(base), n - np.bincount(doc, minlength=len(n))
    return p, p0, rest, np.bincount(doc, -np.log1p(-np.minimum(p, 1 - 1e-12)), len(n)) + rest * -np.log1p(-p0)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def slope(theta: np.ndarray, y: np.ndarray, s: np.ndarray, f: np.ndarray, c: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gradient of the documents' summed log-loss, as long as ``theta``."""
    p, p0, rest, none = forward(theta, s, f, c, doc, n)
    q = np.maximum(-np.expm1(-none), 1e-12)
    # d(loss)/d(none) is 1 for a clean document and -(1 - q) / q for a toxic one, d(none)/d(a sentence's logit) is p
    d = 1 - y - y * (1 - q) / q
    hit = d[doc] * p
    whole = np.bincount(doc, hit, len(n)) + d * p0 * rest
    return np.concatenate([np.bincount(f, hit[s] * c, len(theta) - 2), [whole.sum(), -(whole * np.log(n)).sum()]])


def threshold(y: np.ndarray, q: np.ndarray) -> float | None:
    """The score between two that parts the labels with the best F1; None if all score alike."""
    order = np.argsort(-q, kind="stable")
    y, q = y[order], q[order]
    gaps = np.flatnonzero(q[:-1] > q[1:])
    if not len(gaps) or not y.any():
        return None
    f1 = 2 * np.cumsum(y)[gaps] / (gaps + 1 + y.sum())
    at = gaps[np.argmax(f1)]
    return float(np.sqrt(q[at] * q[at + 1]))


def fit(batches: Iterator[pa.RecordBatch], known: np.ndarray, block: int = BLOCK, chosen: list[np.ndarray] | None = None) -> dict:
    """Weights of the ``known`` features, bias, part of the size and shift, from rows of ``_found``.

    ``chosen`` are the features to use without each fold in turn, then with all; by default all are used and nothing is shifted.
    Blocks of documents wait on disk; one is held at a time.
    """
    width = max(1, len(known))
    masks = np.ones((1, width)) if chosen is None else np.array([np.isin(known, c) for c in chosen], float).reshape(len(chosen), -1)
    if not len(known):
        masks = np.zeros((len(masks), 1))
    left_out = [-1] if chosen is None else [*range(len(masks) - 1), -1]
    with tempfile.TemporaryFile() as file:
        sizes, docs, held = [], [], 0

        def put() -> None:
            y, part, n, hit = (np.array([d[i] for d in docs], kind) for i, kind in enumerate((float, np.int64, np.int64, np.int64)))
            first = np.cumsum(hit) - hit
            keys = np.concatenate([np.frombuffer(d[4], np.int64) + k * width for d, k in zip(docs, first.tolist(), strict=True)])
            counts = np.frombuffer(b"".join(d[5] for d in docs), np.uint8)
            for array in (y, part, n, hit, keys, counts):
                array.tofile(file)
            sizes.append((len(y), len(keys)))

        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            file.seek(0)
            for of_docs, of_keys in sizes:
                y, part, n, hit = (np.fromfile(file, kind, of_docs) for kind in (float, np.int64, np.int64, np.int64))
                keys, counts = np.fromfile(file, np.int64, of_keys), np.fromfile(file, np.uint8, of_keys)
                yield y, part, keys // width, keys % width, counts.astype(float), np.repeat(np.arange(of_docs), hit), n

        for batch in batches:
            parts = part_of(batch.column("doc_id").to_numpy(zero_copy_only=False)).tolist()
            for part, *row in zip(parts, *(batch.column(c).to_pylist() for c in ("y", "n_sents", "n_hit", "pairs", "counts")), strict=True):
                docs.append((row[0], part, *row[1:]))
                held += 1 + len(docs[-1][4]) // 8
                if held >= block:
                    put()
                    docs, held = [], 0
        if docs:
            put()
            docs = []
        whole = list(blocks()) if len(sizes) == 1 else None
        theta = np.zeros((len(masks), width + 2))
        theta[:, -2] = START_BIAS
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        free = np.concatenate([masks, np.ones((len(masks), 2))], axis=1)
        for t in range(1, ROUNDS + 1):
            g, used = np.zeros_like(theta), np.zeros(len(masks))
            for y, part, s, f, c, doc, n in whole or blocks():
                for k, out in enumerate(left_out):
                    # documents of the fold left out are taken out of the sums by their weight
                    take = part != out
                    if take.all():
                        g[k] += slope(theta[k], y, s, f, c, doc, n)
                    elif take.any():
                        at = np.cumsum(take) - 1
                        own = take[doc]
                        of_s = np.cumsum(own) - 1
                        hits = own[s]
                        g[k] += slope(theta[k], y[take], of_s[s[hits]], f[hits], c[hits], at[doc[own]], n[take])
                    used[k] += take.sum()
            g /= np.maximum(used, 1)[:, None]
            g[:, :-2] += DECAY * theta[:, :-2]
            g *= free
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= RATE * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            theta[:, -1] = np.clip(theta[:, -1], 0, 1)
        labels, scores = [], []
        for y, part, s, f, c, doc, n in (whole or blocks()) if chosen is not None else ():
            q = np.zeros(len(y))
            for k, out in enumerate(left_out[:-1]):
                q[part == out] = -np.expm1(-forward(theta[k], s, f, c, doc, n)[3])[part == out]
            labels.append(y)
            scores.append(q)
    parting = threshold(np.concatenate(labels), np.clip(np.concatenate(scores), 1e-9, 1 - 1e-9)) if labels else None
    shift = 0.0 if parting is None else float(np.log(TOXIC_FROM / (1 - TOXIC_FROM)) - np.log(parting / (1 - parting)))
    use = masks[-1] > 0 if len(known) else np.zeros(0, bool)
    return {"hashes": known[use].view(np.int64).tolist(), "weights": theta[-1, :-2][: len(known)][use].tolist(), "bias": float(theta[-1, -2]), "size": float(theta[-1, -1]), "shift": shift}


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, y)``; it alone, and before it the features' hashes, come to the driver."""
    chosen = F.broadcast(sample_of(labels, most))  # at most ``most`` short rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one scan of all texts finds the sample, which is written; all that follows reads it alone
    rows = cut(texts.join(chosen, "doc_id").select("doc_id", "text", F.col("y").cast("double").alias("y")).distinct())

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column("doc_id").to_numpy(zero_copy_only=False)).astype(np.int32)), batch.column("y")], names=["part", "y"])

    by_part = rows.select("doc_id", "y").mapInArrow(total, "part int, y double").groupBy("part").agg(F.count("y").alias("n"), F.sum("y").alias("good")).collect()  # a row a fold
    totals = {r["part"]: (r["n"], r["good"]) for r in by_part}
    n, good = (sum(t[k] for t in totals.values()) for k in (0, 1))
    if good in (0, n):
        return {"share": good / n if n else 0.0}
    sets = _select(rows, totals)
    known = np.unique(np.concatenate(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([{"model": json.dumps(fit(batches, known, chosen=sets))}])

    found = rows.mapInArrow(lambda batches: trimmed(_found(known, batches)), "doc_id long, y double, n_sents long, n_hit long, pairs binary, counts binary")
    # the scans stay spread; what they found in the sample alone meets in one task, in a fixed order
    fitted = found.repartition(1).sortWithinPartitions("doc_id", "n_sents", "pairs", "counts", "y").mapInArrow(lambda batches: trimmed(run(batches)), "model string").head()
    return json.loads(fitted[0])


class Scorer:
    """``sentences`` gives the parts of the noisy-or; ``shift`` is added to log-odds at last."""

    def __init__(self, model: dict):
        self.share, self.shift = model.get("share"), model.get("shift", 0.0)
        self.features = Features(np.array(model.get("hashes", []), np.int64).view(np.uint64))
        self.weights, self.bias, self.size = np.array(model.get("weights", [])), model.get("bias", 0.0), model.get("size", 0.0)

    def sentences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentence starts, each row's bounds among them, and every sentence's probability."""
        starts, rows, where, h = sentence_features(column)
        n = np.repeat(np.diff(rows), np.diff(rows))
        if self.share is not None:
            return starts, rows, 1 - (1 - self.share) ** (1 / n)
        width = max(1, len(self.weights))
        keys, counts = _hits(self.features.find(h), where, width)
        return starts, rows, _chance(self.bias - self.size * np.log(n) + np.bincount(keys // width, self.weights[keys % width] * counts, len(starts)))

    def shifted(self, p: np.ndarray) -> np.ndarray:
        if not self.shift:
            return p
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return _chance(np.log(p) - np.log1p(-p) + self.shift)


def score(docs: DataFrame, model: dict, passed: tuple[str, ...] = ("doc_id",), at_least: float = 0.5) -> DataFrame:
    """The ``passed`` columns of ``docs(..., text)`` with ``score`` and ``sentences`` appended (under names free of clashes).

    ``sentences`` has byte start, end and score of those scored ``at_least`` so.
    """
    names = fresh(passed, "score", "sentences")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in sliced(batch, "_scored_text"):
                starts, rows, p = scorer.sentences(part.column("_scored_text"))
                whole = scorer.shifted(-np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), rows[:-1])))
                p = scorer.shifted(p)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                hit = np.flatnonzero(p >= at_least)
                if len(hit):
                    size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in part.column("_scored_text").to_pylist()])
                    base = np.concatenate([[0], np.cumsum(size)])
                    for i in hit.tolist():
                        row = int(np.searchsorted(rows, i, side="right")) - 1
                        end = starts[i + 1] if i + 1 < rows[row + 1] else base[row + 1]
                        found[row].append({"start": int(starts[i] - base[row]), "end": int(end - base[row]), "score": float(p[i])})
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(passed))), pa.array(np.clip(whole, 0, 1)), pa.array(found, kind)], names=[*passed, *names.values()])

    mine = docs.select(*[F.col(f"`{c}`") for c in passed], F.col("text").cast("string").alias("_scored_text"))
    out = T.StructType([*mine.schema.fields[:-1], T.StructField(names["score"], T.DoubleType()), T.StructField(names["sentences"], T.ArrayType(SENTENCE))])
    return mine.mapInArrow(lambda batches: trimmed(run(batches)), out)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out from learning (a null id has none)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
