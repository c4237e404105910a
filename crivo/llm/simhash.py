"""Operator 10: SimHash near-duplicates by anchor-point covering.

Fingerprints are made in one pass over the texts; equal ones collapse to a row. A pair within three
bits differs in one bit at most in one of the two halves of 32 bits. The first 31 bits of a half
are covered by the perfect Hamming code of length 31: every word is within one bit of exactly one
anchor (code word), its own. So the half of one fingerprint is within two bits of the other's own
anchor, and each fingerprint is replicated to the anchors within covering radius 1 plus threshold
1 of each half: 16 or 17 of 67 million. Per anchor, those who own it are compared with all who came.

A group of more than ``GROUP_ROWS`` is dealt into blocks of owners and of comers, every two of which
are a group. A group's members are compared in blocks of rows, and only links that join two groups that were
apart go out, so a large group of near copies gives a spanning tree and not all its pairs.
Components are then found by alternating large-star and small-star steps over the links, each step
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, append_columns, fresh, stored, table

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints of a group that are compared with each other at a time.
BLOCK_ROWS = 2_000
#: Fingerprints of an anchor from which its group is dealt into blocks.
GROUP_ROWS = 20_000
STEPS = 60
#: Crowded anchors (16 bytes each) that are broadcast; more than these are joined by a shuffle.
CROWDED_ROWS = 500_000


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprints (uint64) of whole texts; 0 without words."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes, count = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(lower).split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(np.array([digest(joined, SEED)], np.uint64))
        else:
            # each shingle is a stretch of the joined words
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
            hashes.append(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))
        count[k] = len(hashes[-1])
    have = np.flatnonzero(count)
    if len(have):
        flat = np.concatenate(hashes)
        first = np.concatenate([[0], np.cumsum(count[have])[:-1]])
        value = np.zeros(len(have), np.uint64)
        for bit in range(64):
            ones = np.add.reduceat((flat >> np.uint64(bit) & np.uint64(1)).astype(np.int64), first)
            value |= (2 * ones > count[have]).astype(np.uint64) << np.uint64(bit)
        out[have] = value
    return out


@lru_cache(maxsize=1)
def _near() -> np.ndarray:
    """The 497 words of 31 bits with at most two ones."""
    one = [1 << i for i in range(31)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint32)


def syndrome(words: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of 31-bit words: the exclusive or of the (1-based) places of their ones; 0 for an anchor."""
    out = np.zeros(len(words), np.uint8)
    for k in range(5):
        places = sum(1 << i for i in range(31) if (i + 1) >> k & 1)
        out |= (np.bitwise_count(words & np.uint32(places)) & 1).astype(np.uint8) << k
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors within two bits of each 31-bit word: (row, anchor, whether it is the row's own)."""
    near = _near()
    of_near, own = syndrome(near), syndrome(words)
    rows, found = [], []
    # a word plus a pattern is an anchor where their syndromes are equal
    for s in range(32):
        mine, patterns = np.flatnonzero(own == s), near[of_near == s]
        rows.append(np.repeat(mine, len(patterns)))
        found.append((words[mine, None] ^ patterns[None, :]).ravel())
    row, anchor = np.concatenate(rows), np.concatenate(found)
    return row, anchor, np.bitwise_count(anchor ^ words[row]) <= 1


def replicated(prints: DataFrame) -> DataFrame:
    """Rows (anchor, own, fp) from distinct fingerprints fp: the half is the anchor's 32nd bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(a, 20_000).to_numpy()
                for half in (0, 1):
                    words = (fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
                    row, anchor, own = anchors(words)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | half << 31), pa.array(own), pa.array(fp[row])], names=["anchor", "own", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor long, own boolean, fp long")


def crowded(prints: DataFrame, limit: int) -> DataFrame:
    """Rows (anchor, blocks) of the anchors to which more than ``limit`` fingerprints come, by a count that misses ``limit`` of them at most.

    The count is the sum over the 497 words within two bits of the anchor, of which those with fewer
    than a 497th of ``limit`` are left out: so only words that many share are replicated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                word, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                row, anchor, _ = anchors((word & 0x7FFFFFFF).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | word[row] & 1 << 31), pa.array(n[row])], names=["anchor", "n"])

    half = lambda k: F.shiftright("fp", 32 * k).bitwiseAND(0x7FFFFFFF).bitwiseOR(F.lit(k << 31).cast("long"))
    words = prints.select(F.explode(F.array(half(0), half(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") * len(_near()) > limit)
    counts = words.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
    # a block more for those that the count may miss
    return counts.select("anchor", (F.ceil(F.col("n") / limit) + 1).alias("blocks"))


def dealt(prints: DataFrame, limit: int) -> DataFrame:
    """``replicated``, with the large groups in parts: each block of an anchor's owners meets each block of its comers in a group
    of its own, whose place is in the bits of ``anchor`` above the 32nd."""
    rows, large = replicated(prints), stored(crowded(prints, limit), "crowded")
    n = large.count()
    if not n:
        return rows
    large = F.broadcast(large) if n <= CROWDED_ROWS else large.repartition("anchor")  # beyond, as in ``by_root``
    block, others = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    place = lambda owner, comer, own: F.struct((F.col("anchor") + owner * (1 << 32) + comer * (1 << 47)).alias("anchor"), own.alias("own"))
    came = F.transform(others, lambda o: place(o, block, F.lit(False)))
    owns = F.transform(others, lambda o: place(block, o, F.lit(True)))
    parts = F.when(F.col("blocks").isNull(), F.array(F.struct("anchor", "own"))).when(F.col("own"), F.concat(came, owns)).otherwise(came)
    return rows.join(large, "anchor", "left").select(F.explode(parts).alias("at"), "fp").select("at.anchor", "at.own", "fp")


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = parent[up]


def spanning_links(fp: np.ndarray, own: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``bits`` between those who own a group's anchor and all who came, without those that close a circle."""
    parent = np.arange(len(fp))
    owners, left, right = np.flatnonzero(own), [], []
    for a in range(0, len(owners), BLOCK_ROWS):
        mine = owners[a : a + BLOCK_ROWS]
        for b in range(0, len(fp), BLOCK_ROWS):
            i, j = np.nonzero(np.bitwise_count(fp[mine, None] ^ fp[None, b : b + BLOCK_ROWS]) <= bits)
            i, j = mine[i], j + b
            while len(i):  # joins whole groups at a time: per round the lowest link of every root
                p, q = _roots(parent, i), _roots(parent, j)
                apart = p != q
                i, j, p, q = i[apart], j[apart], p[apart], q[apart]
                high, low = np.maximum(p, q), np.minimum(p, q)
                root, pick = np.unique(high, return_index=True)
                parent[root] = low[pick]
                left.append(i[pick])
                right.append(j[pick])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(prints: DataFrame, bits: int = BITS, limit: int = GROUP_ROWS) -> DataFrame:
    """Rows (a, b), a < b, of distinct fingerprints: enough links within ``bits`` to join all that belong together."""
    if bits > 3:
        raise ValueError("the halves' anchors cover three differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(anchor: np.ndarray, own: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(starts, len(anchor)))
            owners = np.add.reduceat(own.astype(np.int64), starts)
            for n in np.unique(size[(owners > 0) & (size > 1)]):
                groups = starts[(size == n) & (owners > 0)]
                if n <= 8:  # small groups of one size together
                    at = groups[:, None] + np.arange(n)[None, :]
                    f, o = fp[at], own[at]
                    near = np.bitwise_count(f[:, :, None] ^ f[:, None, :]) <= bits
                    g, i, j = np.nonzero(near & (o[:, :, None] | o[:, None, :]) & (np.arange(n)[:, None] < np.arange(n)[None, :]))
                    x, y = f[g, i], f[g, j]
                else:
                    pairs = [(fp[s : s + n], *spanning_links(fp[s : s + n], own[s : s + n], bits)) for s in groups]
                    x, y = np.concatenate([f[i] for f, i, _ in pairs]), np.concatenate([f[j] for f, _, j in pairs])
                if len(x):
                    x, y = x.view(np.int64), y.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            anchor, own, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last group may go on in the next batch
            if cut or held and held[0][0][0] != anchor[0]:
                yield from done(*(np.concatenate(x) for x in zip(*held, (anchor[:cut], own[:cut], fp[:cut]), strict=True)))
                held = []
            held.append((anchor[cut:], own[cut:], fp[cut:]))
        if held and sum(len(x[0]) for x in held):
            yield from done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt(prints, limit).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): for every node of the links (a, b) the least node that it is joined to."""
    steps = Steps("links")
    edges = steps.store(edges.filter("a <> b"))
    seen = None
    for _ in range(STEPS):
        # large star: of a node's neighbours those above it join the least of them and itself
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: of a node's lower neighbours all, and itself, join the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = steps.store(small)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def fingerprint_column(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprints of ``text`` as long (the bits of the unsigned value)."""
    return append_columns(df, text, [T.StructField(name, T.LongType(), True)], lambda texts: [pa.array(fingerprints(texts).view(np.int64))])


def by_root(rows: DataFrame, per_root: DataFrame) -> DataFrame:
    """``rows`` joined with one row per root. Both sides come to the join straight from a shuffle, so that Spark can deal a root
    that much of the corpus has to several tasks, each with a copy of that root's one row."""
    return rows.repartition("root").join(per_root.repartition("root"), "root")


def grouped(docs: DataFrame) -> DataFrame:
    """Rows (fp, root, component_id): each fingerprint's group and the smallest doc_id in it, from stored rows (doc_id, fp)."""
    prints = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    root = components(links(prints))
    of = prints.join(root, prints["fp"] == root["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return by_root(of, least).select("fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id (the smallest doc_id reachable by links).

    Null and wordless texts have fingerprint zero and link like any other. Rows without a doc_id
    take part; the id of their group is the smallest that is not null. Repeated rows and other
    columns don't matter; an empty table gives none.
    """
    prints = stored(fingerprint_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", "fp").drop("text"), "fingerprints")
    return prints.join(grouped(prints), "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs``: that with the smallest doc_id, rows without one last.

    Of rows with one doc_id the one with the smallest hash of its text stays, and any of those that
    are equal in that as well. Rows are told apart by a number of their own that is stored with
    them, so equal rows, and different texts with one doc_id, are decided on each for itself.
    """
    text, fp, row = fresh(docs, "_text"), fresh(docs, "_fp"), fresh(docs, "_row")
    marked = fingerprint_column(docs.withColumn(text, F.col("text").cast("string")), text, fp).drop(text)
    marked = stored(marked.withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    id_ = F.col("doc_id").cast("long")
    prints = marked.select(id_.alias("doc_id"), F.col(fp).alias("fp"), F.struct(id_.isNull(), id_, F.xxhash64(F.col("text").cast("string")), F.col(row)).alias("place"), F.col(row).alias("row"))
    of = prints.join(grouped(prints.select("doc_id", "fp")), "fp").select("root", "place", "row")
    first = of.groupBy("root").agg(F.min("place").alias("first"))
    dropped = by_root(of, first).filter("place <> first").select(F.col("row").alias(row))
    return marked.join(dropped, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
