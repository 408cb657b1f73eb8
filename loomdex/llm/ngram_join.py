"""Self-join of documents on the Jaccard similarity of their word n-grams, exact at a rational threshold.

The document-by-n-gram incidence matrix is multiplied with its transpose in blocks.  Only documents of a
common block can link, which a size-derived bound proves: linked sets ``a <= b`` in size differ in at most
``d = a * (1 - t) / t`` n-grams.  Sizes are cut into classes, and within a class n-grams are dealt into
``d + 1 + spare`` parts, so linked sets agree on ``spare + 1`` parts at least.  A hash of each part's content is a
signature.  Every document leaves out its ``spare`` most frequent signatures: under one order of all signatures,
the last of those that a linked pair shares is left out by neither.  So passages that many documents share, whose
signatures are frequent, bring no candidates, whatever their number.  Documents that still share a signature
are joined into blocks by connected components.  Inside a block the sparse product accumulates overlap
counts, rare n-grams first, and drops documents of which no pair can still reach its bound.

Equal sets are joined first and only their first document takes part, with their number as weight.  A large
block is dealt into slices, and each pair of slices is a task of its own; pairs never leave the tasks, which
return link counts and a spanning forest.

Defined cases: null text is empty; a document without words has no n-grams and no links; with fewer than
``k`` words the sequence is one n-gram; repeated rows count as documents (a doc_id with several texts is one vertex, as if they linked);
rows with a null doc_id are no vertices and are left out, as no id could be reached from them (give them ids to keep them); sets of equal
size and equal frequency of their signatures go by hash; a very long text is one set; an empty table gives no rows.  Extra columns are not read.
N-grams are compared as 64-bit hashes, sets as 128-bit hashes; shortened hashes serve for candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.files import remove, scratch
from loomdex.llm.text import mix, shingle_sets, sliced, trimmed
from loomdex.operators.components import connected_components
from loomdex.plans.lineage import cut

#: A slice of a block holds about so many documents, or so many n-grams, at most.
SLICE_DOCS, SLICE_GRAMS = 512, 400_000
#: Width of a size class, in steps of the threshold.
CLASS_STEPS = 2
#: Spare parts for each that the bound asks for.
SPARE = 0.3
#: Signatures that a task gathers before it writes them out.
GATHERED = 1_000_000
#: N-grams of all sets together for each bucket of signatures; a bucket has about a quarter as many signatures, at 13 bytes.
BUCKET_GRAMS = 8_000_000
SIZED = "doc_id long, n_shingles long, digest binary, vertex long"
#: A signature that one of so many sets of a task's batch has, and this often at least, is hot.
HOT_SHARE, HOT_LEAST = 256, 256
#: Hot signatures that every task is told of: those named by most batches.  Others are only held like the rest.
MOST_HOT = 100_000
HOT, HOT_USES = -1, 1 << 62
PACKED = "bucket int, signs binary, ids binary, classes binary"
SHARED = "sign long, id long, uses long, spare int"
FOUND = "u long, v long, links long"


class Bounds:
    """Sizes, classes and parts for the threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("threshold must be over 0 and at most 1")
        self.num, self.den = num, den
        self.first = -(-num // (den - num)) if num < den else 1 << 62  # the least size that allows a difference
        self.starts = [self.first]

    def difference(self, a: int) -> int:
        """Most n-grams in which a set of size ``a`` and a linked set no smaller can differ."""
        return a * (self.den - self.num) // self.num

    def overlap(self, a, b):
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def class_of(self, n: int) -> int:
        """Class k >= 1 holds sizes from ``starts[k - 1]`` to below ``starts[k]``; smaller ones are class 0."""
        while self.starts[-1] <= n:
            self._grow()
        return int(np.searchsorted(self.starts, n, side="right"))

    def _grow(self) -> None:
        s = self.starts[-1]
        self.starts.append(max(s + 1, ceil(s * (self.den / self.num) ** CLASS_STEPS)))

    def parts(self, k: int) -> tuple[int, int]:
        """Parts of class k, and how many of them are spare."""
        while len(self.starts) <= k:
            self._grow()
        least = self.difference(self.starts[k] - 1) + 1
        spare = max(1, int(least * SPARE))
        return least + spare, spare

    def reaches_down(self, n: int, k: int) -> bool:
        """Whether a set of size n in class k can link with one in class k - 1."""
        return k > 1 and n * self.num <= (self.starts[k - 1] - 1) * self.den


def signatures(grams: np.ndarray, k: int, bounds: Bounds) -> np.ndarray:
    """Signatures of a set in class k; ``grams`` sorted, so parts are runs of it."""
    parts, _ = bounds.parts(k)
    part = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    counts = np.bincount(part, minlength=parts)
    sums = np.zeros(parts, np.uint64)
    full = np.flatnonzero(counts)
    sums[full] = np.add.reduceat(mix(grams), np.cumsum(counts)[full] - counts[full])
    return mix(mix(np.arange(parts, dtype=np.uint64) + (np.uint64(k) << np.uint64(40))) + sums)


def sized(docs: DataFrame, k: int) -> DataFrame:
    """``SIZED``: set sizes and digests of ``docs(doc_id, text)``; ``vertex`` is the digest's first 46 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                sets = [(len(g), xxhash.xxh3_128_digest(g.tobytes())) for g in shingle_sets(part.column("text"), k)]
                columns = [pa.array([n for n, _ in sets], pa.int64()), pa.array([d for _, d in sets], pa.binary()), pa.array([_vertex(d) for _, d in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_shingles", "digest", "vertex"])

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), SIZED)


def _bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8")[:, 0]


def packed(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """``PACKED``: signatures (48 bits, class included), vertices (46 bits and the role) and classes in runs of a bucket.

    A set counts in its own class (role 0) and, if it can link with smaller ones, in the one below (role 1).
    Sets that allow no difference are left to their digests.  A task writes the signatures of equal sets once,
    and a row for each bucket, so rows follow the tasks, not the documents.  A row of bucket ``HOT`` names a signature
    that is hot in a batch.
    """
    schema = pa.schema([("bucket", pa.int32()), ("signs", pa.binary()), ("ids", pa.binary()), ("classes", pa.binary())])
    gathered, share, least = GATHERED, HOT_SHARE, HOT_LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, seen, held, n = Bounds(num, den), set(), [], 0

        def out() -> pa.RecordBatch:
            signs = np.concatenate([s for s, _, _ in held])
            ids = np.concatenate([np.full(len(s), i, np.uint64) for s, i, _ in held])
            kinds = np.concatenate([np.full(len(s), c, np.uint8) for s, _, c in held])
            bucket = (signs >> np.uint64(48)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            signs, ids, kinds = signs[order], ids[order], kinds[order]
            at = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
            full = [(b, i, j) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            rows = [{"bucket": b, "signs": _bytes(signs[i:j], 6), "ids": _bytes(ids[i:j], 6), "classes": kinds[i:j].tobytes()} for b, i, j in full]
            names, uses = np.unique(_named(signs, bucket[order]), return_counts=True)
            if len(hot := names[uses >= max(least, len(held) // share)]):
                rows += [{"bucket": HOT, "signs": name.tobytes(), "ids": b"", "classes": b""} for name in hot.astype("<u8")]
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for part in sliced(batch, "text"):
                for grams in shingle_sets(part.column("text"), k):
                    kind = bounds.class_of(len(grams))
                    if not kind or (digest := xxhash.xxh3_128_digest(grams.tobytes())) in seen:
                        continue
                    seen.add(digest)  # different sets of one vertex both count
                    vertex = _vertex(digest)
                    for role in range(1 + bounds.reaches_down(len(grams), kind)):
                        signs = signatures(grams, kind - role, bounds)
                        held.append((signs, vertex * 2 + role, kind - role))
                        n += len(signs)
                if n >= gathered:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(lambda batches: trimmed(run(batches)), PACKED)


def _named(signs: np.ndarray, bucket) -> np.ndarray:
    """Names of signatures: a mix of the 48 bits that are written and the bucket."""
    return mix((signs & np.uint64((1 << 48) - 1)) + (np.asarray(bucket, np.uint64) << np.uint64(48)))


def shared(rows: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """``SHARED`` of written ``PACKED`` rows: the signatures that several sets have, each set's once, with their number.

    A bucket meets in one task, which holds what is not hot there: less than one of ``HOT_SHARE`` sets has such a signature.
    Uses of hot signatures go through as they come, several times if several tasks had equal sets; they count as ``HOT_USES``, the
    most, as only an order is wanted.
    """
    named = rows.filter(F.col("bucket") == HOT).groupBy("signs").count().orderBy(F.col("count").desc(), "signs").limit(MOST_HOT).collect()
    hot = np.sort(np.frombuffer(b"".join(r["signs"] for r in named), "<u8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, key, held = Bounds(num, den), None, []

        def passed(own: list[bytes]) -> pa.RecordBatch | None:
            """The hot ones of a row, which keeps the others."""
            s, i, kinds = _values(own[0], 6), _values(own[1], 6), np.frombuffer(own[2], np.uint8)
            name = _named(s, key)
            is_hot = np.isin(name, hot)
            if not is_hot.any():
                return None
            own[:] = [_bytes(s[~is_hot], 6), _bytes(i[~is_hot], 6), kinds[~is_hot].tobytes()]
            spare = np.array([0, *(bounds.parts(k)[1] for k in range(1, int(kinds.max()) + 1))], np.int32)
            columns = [pa.array(name[is_hot].view(np.int64)), pa.array(i[is_hot].astype(np.int64)), pa.array(np.full(int(is_hot.sum()), HOT_USES)), pa.array(spare[kinds[is_hot]])]
            return pa.RecordBatch.from_arrays(columns, names=["sign", "id", "uses", "spare"])

        def done() -> pa.RecordBatch:
            s, i = (_values(b"".join(h[c] for h in held), 6) for c in (0, 1))
            kinds = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
            order = np.lexsort((i, s))
            s, i, kinds = s[order], i[order], kinds[order]
            first = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
            s, i, kinds = s[first], i[first], kinds[first]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            runs = np.diff(np.append(head, len(s)))
            uses = np.repeat(runs, runs)
            many = uses > 1
            spare = np.array([0, *(bounds.parts(k)[1] for k in range(1, int(kinds.max()) + 1))], np.int32)
            sign = _named(s[many], key)
            columns = [pa.array(sign.view(np.int64)), pa.array(i[many].astype(np.int64)), pa.array(uses[many].astype(np.int64)), pa.array(spare[kinds[many]])]
            return pa.RecordBatch.from_arrays(columns, names=["sign", "id", "uses", "spare"])

        for batch in batches:
            for bucket, *own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "signs", "ids", "classes")), strict=True):
                if bucket != key:
                    if held:
                        yield done()
                    key, held = bucket, []
                if len(hot) and (through := passed(own)) is not None:
                    yield through
                if own[0]:
                    held.append(own)
        if held:
            yield done()

    dealt = rows.filter(F.col("bucket") != HOT).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: trimmed(run(batches)), SHARED)


def _vertex(digest: bytes) -> int:
    return int.from_bytes(digest[:6], "little") >> 2


def product(rows: list[tuple], bounds: Bounds, both: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links per row, weighted by copies, and a spanning forest of the links.

    ``rows`` are (size, role, side, copies, grams).  With ``both`` sides only pairs across them count, and
    pairs of two role-1 rows belong to the class above.
    """
    n = len(rows)
    size, role, side, copies = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    keep, alive = np.arange(n), np.ones((n, n), bool)
    alive &= (role[:, None] == 0) | (role[None, :] == 0)
    if both:
        alive &= side[:, None] != side[None, :]
    need = bounds.overlap(size[:, None], size[None, :])
    alive &= need <= np.minimum(size[:, None], size[None, :])
    np.fill_diagonal(alive, False)
    linked = np.zeros((n, n), bool)
    if alive.any():
        of = np.repeat(np.arange(n), size)
        grams = np.concatenate([r[4] for r in rows])
        order = np.argsort(grams, kind="stable")
        grams, of = grams[order], of[order]
        head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        df = np.diff(np.append(head, len(grams)))
        shared = np.flatnonzero(df > 1)
        shared = shared[np.argsort(df[shared], kind="stable")]
        left = np.bincount(of[np.repeat(df, df) > 1], minlength=n)  # shared n-grams that are still to come
        acc = np.zeros((n, n), np.float32)
        at = 0
        while at < len(shared):
            d = int(df[shared[at]])
            if d <= max(8, n // 10):
                to = at + int(np.searchsorted(df[shared[at:]], d, side="right"))
                to = min(to, at + max(1, 4_000_000 // (d * d)))
                docs = of[head[shared[at:to]][:, None] + np.arange(d)]
                i, j = np.triu_indices(d, 1)
                pairs = np.bincount((docs[:, i].astype(np.int64) * n + docs[:, j]).ravel(), minlength=n * n).reshape(n, n)
                acc += pairs + pairs.T
                used = np.bincount(docs.ravel(), minlength=n)
            else:
                to = min(len(shared), at + 4096)
                lens = df[shared[at:to]]
                cols = np.repeat(np.arange(to - at), lens)
                who = of[np.concatenate([np.arange(h, h + w) for h, w in zip(head[shared[at:to]], lens, strict=True)])]
                place = np.full(n, -1)
                place[keep] = np.arange(len(keep))
                m = np.zeros((len(keep), to - at), np.float32)
                ok = place[who] >= 0
                m[place[who[ok]], cols[ok]] = 1
                acc[np.ix_(keep, keep)] += m @ m.T
                used = np.bincount(who, minlength=n)
            left = left - used
            at = to
            alive &= acc + np.minimum(left[:, None], left[None, :]) >= need
            keep = np.flatnonzero(alive.any(axis=1))
            if not len(keep):
                break
        linked = alive & (acc >= need)
    links = linked @ copies
    forest, seen = [], np.zeros(n, bool)
    for root in range(n):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            u = stack.pop()
            new = np.flatnonzero(linked[u] & ~seen)
            seen[new] = True
            forest += [(u, int(v)) for v in new]
            stack += new.tolist()
    return links, forest


def _blocks(k: int, num: int, den: int):
    """Products of the blocks of ``(block, i, j, rep, vertex, role, slice, copies, text)`` rows that come sorted by (block, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, key, ids, rows, seen = Bounds(num, den), None, [], [], set()
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

        def done() -> pa.RecordBatch:
            links, forest = product(rows, bounds, key[1] != key[2])
            some = np.flatnonzero(links)
            u = [ids[i] for i in some] + [ids[i] for i, _ in forest]
            v = [None] * len(some) + [ids[j] for _, j in forest]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([*links[some].tolist(), *[0] * len(forest)], pa.int64())], schema=schema)

        for batch in batches:
            for part in sliced(batch, "text"):
                columns = [part.column(c).to_pylist() for c in ("block", "i", "j", "rep", "vertex", "role", "slice", "copies")]
                for (block, i, j, rep, vertex, role, own, copies), grams in zip(zip(*columns, strict=True), shingle_sets(part.column("text"), k), strict=True):
                    if (block, i, j) != key:
                        if len(rows) > 1:
                            yield done()
                        key, ids, rows, seen = (block, i, j), [], [], set()
                    # a doc_id that has several rows or texts meets each set's place once
                    if (rep, vertex) in seen or _vertex(xxhash.xxh3_128_digest(grams.tobytes())) != vertex:
                        continue
                    seen.add((rep, vertex))
                    ids.append(rep)
                    rows.append((len(grams), role, own, copies, grams))
        if len(rows) > 1:
            yield done()

    return run


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` of ``docs(doc_id, text)``.

    ``n_shingles`` is the size of the document's set of k-word n-grams, ``n_links`` the number of other
    documents with ``den * intersection >= num * union``, ``component_id`` the smallest doc_id reachable over links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    base = cut(sized(docs, k))

    # as many buckets as keep each one's signatures within a task's memory, however many there are
    n_grams = base.agg(F.sum("n_shingles")).head()[0] or 0  # one number
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_grams // BUCKET_GRAMS)
    mine = Window.partitionBy("id").orderBy(F.col("uses").desc(), "sign")  # a set's own signatures
    folder = scratch(docs.sparkSession, "signatures")
    try:
        packed(docs, k, num, den, buckets).write.option("compression", "zstd").parquet(folder)
        ranked = shared(docs.sparkSession.read.parquet(folder), num, den, buckets).withColumn("rank", F.dense_rank().over(mine))
        kept = cut(ranked.filter("rank > spare").select("sign", "id"))
    finally:
        remove(folder)
    pivots = kept.groupBy("sign").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).filter("pivot < most").select("sign", "pivot")
    near = kept.join(pivots, "sign").filter("id <> pivot").select("id", "pivot").distinct()
    blocks = connected_components(near, "id", "pivot")

    sets = cut(base.filter("n_shingles > 0").groupBy("digest", "n_shingles", "vertex").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    members = blocks.select(F.expr("shiftright(id, 1)").alias("vertex"), F.expr("id % 2").alias("role"), F.col("root").alias("block")).join(sets, "vertex")
    loads = (
        members.groupBy("block")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("grams"))
        .filter("n > 1")
        .select("block", F.greatest(F.ceil(F.col("n") / SLICE_DOCS), F.ceil(F.col("grams") / SLICE_GRAMS)).cast("int").alias("slices"))
    )
    placed = cut(members.join(loads, "block").select("block", "role", "rep", "vertex", "copies", "slices", F.expr("pmod(xxhash64(rep), slices)").cast("int").alias("slice")))
    with_text = placed.join(docs.withColumnRenamed("doc_id", "rep"), "rep")
    dealt = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "block", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "rep", "vertex", "role", "slice", "copies", "text"
    )
    blocks = _blocks(k, num, den)
    found = cut(dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(lambda batches: trimmed(blocks(batches)), FOUND))

    roots = connected_components(found.filter("v IS NOT NULL"), "u", "v").select(F.col("id").alias("rep"), F.col("root"))
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    classes = sets.join(roots, "rep", "left").join(counts, "rep", "left").select("digest", "rep", "copies", "root", "links")
    return base.join(classes, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("root", "rep", "doc_id").alias("component_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
    )
