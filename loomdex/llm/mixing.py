"""Mixing sources to target weights by whole-document repetition.

A document is emitted floor(rate) times, rate being its source's target over its size, and once more by a hash-seeded
Bernoulli draw with the rate's fraction as probability.  Each document's probability is that fraction exactly, but the draws of a source depend on one
another, so that its taken words come near the target: documents are dealt by hash into cells of about ``CELL``, and inside a cell, from the largest down,
one undecided document is held against the next.  The chances of the two are moved, so that the words expected stay the same, until one of the chances is 0 or 1;
which way is drawn so that either keeps its mean.  What is left at the end is drawn by its chance.  So a cell misses its part by less than one document, mostly a small one.

Defined cases: null text has size 0; null source is a source of its own, the last; a source of size 0
has target 0 and its documents are taken once; an empty table gives no rows; rows without an id are drawn by their text; rows of equal size are drawn in
order of their draws, then ids, then a hash of the text, so reruns agree; repeated rows share a cell and are drawn apart, by their place in it, ``MOST_TOGETHER`` at
a time, so that no row looks at more, however many there are; documents without words are drawn each by its own; a very long text counts as any other;
extra columns pass through ``mix`` untouched, new names that clash get a suffix from ``fresh``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.names import fresh
from loomdex.plans.lineage import cut

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Documents of a source that are drawn together.
CELL, MOST_TOGETHER = 64, 256
#: Sources whose table is small enough to be sent to every task.
MOST_BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, documents, source_size, target)`` of ``sizes(source, size)``, one row a source.

    The sources share ``share`` times all sizes by weight, none above ``most`` times its own size.  Filling
    from the least cap per unit of weight up, the level at which the rest is dealt follows from sums over
    the sources that are full before it.
    """
    own = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = own.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the first source that its share at this level doesn't fill sets the level for all that follow; of those full at the same level the first has the highest
    stepped = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("full"), (-F.col("level")).alias("minus")))).over(everything)
    return stepped.select("source", "documents", "source_size", F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), -final["minus"] * F.col("w"))).alias("target"))


def draws(key: Column, seed: int) -> tuple[Column, Column]:
    """Two numbers in [0, 1) from 52 bits each of an md5 of the key and the seed, which SQL elsewhere can repeat; null keys draw alike."""
    digest = F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit(f"#{seed}")))
    first, second = (F.conv(F.substring(digest, at, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52)) for at in (1, 14))
    return first, second


def decided(together: Column, fraction: Column) -> Column:
    """Places of the documents taken among ``array<struct<size, draw, place>>``, each with probability ``fraction``.

    ``p`` is the chance of the document held, 0 or 1 once it is decided, and place 0 stands for none.
    """

    def state(p: Column, of: Column, u: Column, out: Column) -> Column:
        return F.struct(p.alias("p"), of["size"].alias("size"), of["place"].alias("place"), u.alias("u"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        ratio = x["size"] / a["size"]
        up, down = F.least(1.0 - a["p"], fraction * ratio), F.least(a["p"], (1.0 - fraction) * ratio)
        with_a, with_x = F.concat(a["out"], F.array(a["place"])), F.concat(a["out"], F.array(x["place"]))
        raised = F.when(1.0 - a["p"] <= fraction * ratio, state(F.greatest(F.lit(0.0), fraction - (1.0 - a["p"]) / ratio), x, a["u"], with_a)).otherwise(state(a["p"] + fraction * ratio, a, a["u"], a["out"]))
        lowered = F.when(a["p"] <= (1.0 - fraction) * ratio, state(F.least(F.lit(1.0), fraction + a["p"] / ratio), x, a["u"], a["out"])).otherwise(state(a["p"] - (1.0 - fraction) * ratio, a, a["u"], with_x))
        alone = state(a["p"], a, a["u"], F.when(x["draw"] < fraction, with_x).otherwise(a["out"]))
        held = F.when(x["draw"] * (up + down) < down, raised).otherwise(lowered)
        return F.when(x["size"] == 0, alone).when(a["place"] == 0, state(fraction, x, x["draw"], a["out"])).otherwise(held)

    none = F.struct(F.lit(0.0).alias("p"), F.lit(1.0).alias("size"), F.lit(0).alias("place"), F.lit(0.0).alias("u"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(together, none, step, lambda a: F.when(a["u"] < a["p"], F.concat(a["out"], F.array(a["place"]))).otherwise(a["out"]))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, words: Column | None = None, key: Column | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies`` appended (names that clash get a suffix from ``fresh``).

    ``words`` is the size, by default the number of words of ``text``; ``key`` is what draws go by, by default the id or, without one, the text's md5.  Sizes are summed per source by partial aggregation; the
    per-source table is counted and sent to every task up to ``MOST_BROADCAST`` rows, else joined by source.  The
    documents are shuffled once, by source and cell, so that a source with a third of all rows is spread as any other.
    """
    names = fresh(docs.columns, "size", "source_size", "target", "copies", "mix_source", "mix_rate", "mix_cell", "mix_draw", "mix_taken", "mix_turn", "mix_place", "mix_key")
    size, rate, cell, draw, taken = (F.col(names[n]) for n in ("size", "mix_rate", "mix_cell", "mix_draw", "mix_taken"))
    sized = docs.withColumn(names["size"], (word_count(F.col("text")) if words is None else words).cast("long"))
    per = cut(targets(sized.select("source", size.alias("size")), share, most, weights))
    per = per.select(F.col("source").alias(names["mix_source"]), "documents", F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]))
    per = per.withColumn(names["mix_rate"], F.when(F.col(names["source_size"]) > 0, F.col(names["target"]) / F.col(names["source_size"])).otherwise(F.lit(1.0)))
    if per.count() <= MOST_BROADCAST:
        per = F.broadcast(per)
    own = per.withColumnRenamed("documents", names["mix_cell"])
    by_text = F.md5(F.col("text").cast("string")) if "text" in docs.columns else F.lit(None).cast("string")
    own_key = F.coalesce(F.coalesce(F.col("doc_id").cast("string"), by_text) if key is None else key, F.lit(""))
    first, second = draws(own_key, seed)
    joined = sized.join(own, sized["source"].eqNullSafe(own[names["mix_source"]]))
    joined = joined.withColumns({names["mix_key"]: own_key, names["mix_draw"]: first, names["mix_cell"]: F.floor(second * F.greatest(F.lit(1), F.floor(cell / CELL)))})
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    order = [size.desc(), draw, F.col("doc_id").asc_nulls_last(), text]
    number = F.row_number().over(Window.partitionBy(names["mix_source"], names["mix_cell"]).orderBy(*order)) - 1
    joined = joined.withColumn(names["mix_place"], number)
    place = F.col(names["mix_place"])
    joined = joined.withColumns({names["mix_turn"]: F.floor(place / MOST_TOGETHER), names["mix_place"]: (place % MOST_TOGETHER + 1).cast("int"), names["mix_draw"]: draws(F.concat(names["mix_key"], F.lit("@"), place.cast("string")), seed)[0]})
    w = Window.partitionBy(names["mix_source"], names["mix_cell"], names["mix_turn"]).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    together = F.collect_list(F.struct(size.cast("double").alias("size"), draw.alias("draw"), place.alias("place"))).over(w)
    drawn = joined.withColumn(names["mix_taken"], together).withColumn(names["mix_taken"], F.array_contains(decided(taken, rate - F.floor(rate)), place))
    out = drawn.withColumn(names["copies"], F.floor(rate) + taken.cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[names[n] for n in ("size", "source_size", "target", "copies")])


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row ``copies`` times."""
    names = fresh(docs.columns, "size", "source_size", "target", "copies", "mix_copy")
    out = mix(docs, **options)
    n = F.col(names["copies"]).cast("int")
    return out.filter(n > 0).withColumn(names["mix_copy"], F.explode(F.sequence(F.lit(1), n))).select(*[F.col(f"`{c}`") for c in docs.columns])
