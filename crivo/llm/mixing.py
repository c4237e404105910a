"""Operator 1: mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``cap``. Among all rates that give each source its target
number of words, those of least bounded relative entropy to the rate cap / 2 are exponentially
tilted by size: rate / (cap - rate) = exp(lambda * size / scale), with one lambda per source. The
lambdas are the maximum of a convex dual. Newton's method finds them in distributed passes over a
histogram (source, size, documents), which is far smaller than the corpus, with a bracket for steps
that would overshoot. Sums are of decimals, so that they don't depend on the order of addition.

Rates become copies: each document gets the whole part, and of the documents of one size some get
one more. How many is rounded along a source's sizes from the largest down, each handing its
remainder on. A large document can leave over more than the smaller ones may take by their rates, so
a second walk gives what is still owed to any size, up to the cap, or takes it back, where more than
NEAR of the target is owed. The smallest LAST_SIZES sizes settle the rest by trying all changes of up
to LAST_CHANGE copies each, so that a few documents give the nearest sum that whole copies can make.
The walks are over the
histogram's rows of one source, of which there are as many as documents have distinct sizes.
Which ones is up to their hashes: those below one threshold per (source, size), found in ranges of
the hash that stay small even if a third of all documents are copies of one text. So what goes to
the documents has a row per (source, size), and is broadcast while its rows are few: texts stay put.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Steps, fresh, fresh_prefix, stored, table

# What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Documents of one cell that the choice of the last copies looks at together, on average at most.
CELL_DOCS = 5_000
#: Rows of decisions up to which they are broadcast to the documents, of about 50 bytes each.
BROADCAST_ROWS = 500_000
STEPS, CLOSE = 60, 1e-9
#: Sizes that settle what rounding leaves over, and by how many copies each.
LAST_SIZES, LAST_CHANGE = 7, 2
#: A miss that whole words can't mend, with room for how closely the dual is solved.
HALF_A_WORD = 0.51
#: A miss, of the target, for which no document of a source with many sizes gets more or less than its rate's neighbours.
NEAR = 1e-3


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Rows (sid, source, source_size, target): each source once, null among them.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    words; a target stops at ``cap`` times its source's words, and the rest goes to the others by
    weight, until none is above. In order of words per weight the sources that stop come first, so
    a running sum over the sources (a row each) finds the level.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(every).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    source = source.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    whole = W.partitionBy(F.lit(0))
    before = W.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum("most").over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    source = source.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - stopped) / left)
    source = source.withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(whole)["level"]
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return source.select("sid", "source", "source_size", target.alias("target"))


def rate(lam: Column, size: Column, scale: Column, cap: int) -> Column:
    return cap / (1 + F.exp(-lam * size / scale))


def solve(histogram: DataFrame, sources: DataFrame, cap: int = 2) -> DataFrame:
    """Rows (sid, scale, lam): the dual's solution for each source with words; lam is null where the target is the cap."""
    exact = lambda c: c.cast("decimal(38,9)")
    scale = histogram.groupBy("sid").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = sources.join(scale, "sid").withColumn("free", (F.col("target") < cap * F.col("source_size")) & (F.col("target") > 0))
    for name, value in (("lam", 0.0), ("low", float("-inf")), ("high", float("inf")), ("off", float("inf"))):
        state = state.withColumn(name, F.lit(value))
    steps = Steps("dual")
    state = steps.store(state.select("sid", "target", "scale", "free", "lam", "low", "high", "off"))
    for _ in range(STEPS):
        w = rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        sums = (
            histogram.join(state.filter("free"), "sid")
            .groupBy("sid")
            .agg(F.sum(exact(F.col("n") * F.col("size") * w)).cast("double").alias("words"), F.sum(exact(F.col("n") * F.col("size") * F.col("size") / F.col("scale") * w * (1 - w / cap))).cast("double").alias("slope"))
        )
        above = F.col("words") - F.col("target")
        low, high = F.when(above < 0, F.col("lam")).otherwise(F.col("low")), F.when(above > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - above / F.when(F.col("slope") > 0, F.col("slope"))
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        far = F.when(above < 0, 2 * F.abs(F.col("lam")) + 1).otherwise(-2 * F.abs(F.col("lam")) - 1)
        bounded = (low > float("-inf")) & (high < float("inf"))
        step = F.when(above == 0, F.col("lam")).when(inside, newton).when(bounded, (low + high) / 2).otherwise(far)
        found = state.join(sums, "sid", "left")
        state = steps.store(
            found.select("sid", "target", "scale", "free", F.when(F.col("free"), step).otherwise(F.col("lam")).alias("lam"), low.alias("low"), high.alias("high"), F.when(F.col("free"), F.abs(above) / F.col("target")).otherwise(F.lit(0.0)).alias("off"))
        )
        if (state.agg(F.max("off")).first()[0] or 0) <= CLOSE:
            break
    return state.select("sid", "scale", F.when(F.col("free"), F.col("lam")).alias("lam"), "target")


def settle(owed: float, size: list[int], copies: list[int], least: list[int], most: list[int]) -> float:
    """Changes the copies of the last few sizes together, by as little as brings what is owed nearest to zero; what is owed then."""
    few = range(max(0, len(size) - LAST_SIZES), len(size))
    ways = [np.arange(max(-LAST_CHANGE, least[k] - copies[k]), min(LAST_CHANGE, most[k] - copies[k]) + 1) for k in few]
    change = np.stack([w.ravel() for w in np.meshgrid(*ways, indexing="ij")], axis=1)
    left = owed - change @ np.array([size[k] for k in few], np.float64)
    best = np.lexsort((np.abs(change).sum(axis=1), np.round(np.abs(left), 6)))[0]
    for k, c in zip(few, change[best].tolist(), strict=True):
        copies[k] += c
    return float(left[best])


def round_rates(cells: pd.DataFrame, cap: int = 2) -> pd.DataFrame:
    """One source's sizes, the largest first, with whole copies: what rounding leaves over goes on to the next size.

    A size takes its rates' floors or ceilings. Only if the sum can't be settled so to within NEAR of
    the target (half a word where the last sizes are all), what is owed is walked down the sizes
    with copies from 0 to the cap.
    """
    cells = cells.sort_values("size", ascending=False)
    size, docs, rates = (cells[c].tolist() for c in ("size", "n", "rate"))
    owed, copies = 0.0, [int(r) * n for r, n in zip(rates, docs, strict=True)]
    near = HALF_A_WORD if len(size) <= LAST_SIZES else max(HALF_A_WORD, NEAR * sum(n * s * r for s, n, r in zip(size, docs, rates, strict=True)))
    floors = list(copies)
    ceilings = [-int(-r // 1) * n for r, n in zip(rates, docs, strict=True)]
    carried = [n * s * (r - int(r)) for s, n, r in zip(size, docs, rates, strict=True)]
    for least, most in ((floors, ceilings), ([0] * len(size), [cap * n for n in docs])):
        for k, s in enumerate(size):
            owed += carried[k]
            more = min(max(round(owed / s), least[k] - copies[k]), most[k] - copies[k])
            owed -= more * s
            copies[k] += more
        if abs(owed) > HALF_A_WORD:
            owed = settle(owed, size, copies, least, most)
        if abs(owed) <= near:
            break
        carried = [0.0] * len(size)
    base, extra = [c // n for c, n in zip(copies, docs, strict=True)], [c % n for c, n in zip(copies, docs, strict=True)]
    return pd.DataFrame({"sid": cells["sid"], "size": size, "docs": docs, "rate": rates, "base": base, "extra": extra})


def hashed(doc_id: Column) -> Column:
    """The 63 bits, as a number that isn't negative, that decide among the documents of one size."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 1)


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, source, size): the sources, and the copies of each (sid, size).

    A size's documents get ``base`` copies, and one more if their hash is below ``below`` (null: all
    if ``extra`` is ``docs``, else none). The hash that parts them is found in two passes: counts in ranges of the
    hash tell in which range it lies, and only that range's documents are put in order.
    """
    sources = stored(targets(sizes, weights, share, cap), "sources")
    numbered = sizes.join(sources.select("sid", "source"), sizes["source"].eqNullSafe(sources["source"])).select("doc_id", "sid", "size")
    buckets = max(1, -(-sizes.count() // CELL_DOCS))
    numbered = numbered.filter("size > 0").withColumn("hash", hashed(F.col("doc_id")))
    numbered = numbered.withColumn("bucket", F.shiftright(F.shiftright("hash", 32) * F.lit(buckets).cast("long"), 31))
    cells = stored(numbered.groupBy("sid", "size", "bucket").agg(F.count("*").alias("n")), "cells")
    histogram = stored(cells.groupBy("sid", "size").agg(F.sum("n").alias("n")), "size-histogram")
    dual = solve(histogram, sources, cap)
    value = F.when(F.col("lam").isNotNull(), rate(F.col("lam"), F.col("size"), F.col("scale"), cap)).when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    rated = histogram.join(dual, "sid").select("sid", "size", "n", value.alias("rate"))
    rounded = stored(rated.groupBy("sid").applyInPandas(lambda part: round_rates(part, cap), "sid long, size long, docs long, rate double, base long, extra long"), "rounded")
    # the range that holds the first document without a further copy, and that document's hash
    before = F.coalesce(F.sum("n").over(W.partitionBy("sid", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = rounded.filter("extra > 0 and extra < docs").select("sid", "size", "extra")
    parted = cells.join(some, ["sid", "size"]).withColumn("before", before).filter("before <= extra and extra < before + n")
    ranked = numbered.join(parted.select("sid", "size", "bucket", (F.col("extra") - F.col("before") + 1).alias("nth")), ["sid", "size", "bucket"])
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("sid", "size", "bucket").orderBy("hash"))).filter(F.col("rank") == F.col("nth"))
    return sources, stored(rounded.join(ranked.select("sid", "size", F.col("hash").alias("below")), ["sid", "size"], "left"), "copies")


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a count of its rows allows it; otherwise a join with it is a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_copies(docs: DataFrame, sources: DataFrame, sized: DataFrame, size: str, out: str) -> DataFrame:
    """``docs`` (with doc_id, source and the column ``size``) and a struct ``out``: source_size, target, rate, copies."""
    p = fresh_prefix(docs, "_mixing_")
    s = small(sources.select(*(F.col(c).alias(p + c) for c in ("sid", "source", "source_size", "target"))))
    c = small(sized.select(*(F.col(c).alias(p + c) for c in ("size", "docs", "rate", "base", "extra", "below")), F.col("sid").alias(p + "of")))
    joined = docs.join(s, F.col("source").cast("string").eqNullSafe(F.col(p + "source")), "left")
    joined = joined.join(c, (F.col(p + "sid") == F.col(p + "of")) & (F.col(size) == F.col(p + "size")), "left")
    more = F.when(F.col(p + "extra") >= F.col(p + "docs"), F.lit(True)).otherwise(F.coalesce(hashed(F.col("doc_id").cast("long")) < F.col(p + "below"), F.lit(False)))
    copies = F.coalesce(F.col(p + "base") + more.cast("long"), F.lit(0))
    return joined.select(*docs.columns, F.struct(F.col(p + "source_size").alias("source_size"), F.col(p + "target").alias("target"), F.coalesce(F.col(p + "rate"), F.lit(0.0)).alias("rate"), copies.alias("copies")).alias(out))


def sizes_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size), stored, so that texts are read once."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size")), "sizes")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    Null and empty texts have size 0 and are taken 0 times; long texts count whole; a null source is
    a source; rows that repeat a doc_id get the same decision, as do rows whose ids have the same
    hash (a tie: none of them gets the copy that would be left for some); other columns don't
    matter; an empty table gives none.
    """
    sizes = sizes_of(docs)
    sources, sized = plan(sizes, weights, share, cap)
    return with_copies(sizes, sources, sized, "size", "mix").select("doc_id", "source", "size", "mix.*", (F.col("size") * F.col("mix.copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sources, sized = plan(sizes_of(docs), weights, share, cap)
    size, out = fresh(docs, "_size"), fresh(docs, "_mix")
    mixed = with_copies(docs.withColumn(size, size_of(F.col("text").cast("string"))), sources, sized, size, out)
    repeated = mixed.filter(F.col(f"{out}.copies") > 0).withColumn(out, F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies").cast("int"))))
    return repeated.select(*docs.columns)


def op1_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
