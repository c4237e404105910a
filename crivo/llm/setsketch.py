"""Operator 11: MinHash near-duplicates by SetSketch registers.

A document's set holds the distinct word shingles of its whole text. Each of ``REGISTERS`` hash
functions gives every element an exponentially spaced value; a register keeps the level
floor(1 - log_b h) of the least value h, truncated to a byte. Registers of a union are the larger
ones of its parts, and two registers are equal the likelier the more alike the sets are.

Sets that are equal collapse to one row. Bands of ``BAND`` registers are bucket keys, and links are
looked for in three rounds. First every bucket of ``FIRST_BANDS`` bands links its members to its first
one. From how many registers of two sets are larger, smaller or equal, and the sets' sizes, their
similarity is estimated by maximum likelihood; a link goes on unless the data speak against the
threshold by more than ``DOUBT``, and is then verified on the full sets. Then every bucket of all bands
links the components that it holds, by a member of each. Then buckets that still hold several
components compare what is in different ones, in blocks of ``GROUP_ROWS``, by the same estimate;
members that it can't refuse come together once more with their full sets, and only links that join
two components go out. So a group of near copies, or of almost near ones, gives a few rows for each
member and not all its pairs.

A pair at the threshold has 0.27 as the chance of an equal band (0.8 is that of a register, and a
little more as levels are rounded), so all 42 bands miss it with a chance of 2e-6, less where it is
more alike; ``DOUBT`` misses it with one of about 1e-6. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Index, append_columns, stored, table
from .simhash import components

SHINGLE, PERCENT, SEED = 5, 80, 42
BAND, BANDS = 6, 42
REGISTERS = BAND * BANDS
#: Bands whose buckets are linked first, which joins most of what is much alike.
FIRST_BANDS = 6
BASE, RATE, TOP = 1.1, 20.0, 255
#: A log-likelihood ratio against the threshold by which an estimate refuses a pair.
DOUBT = 12.5
#: Members of a bucket from which it is compared block by block.
GROUP_ROWS = 2_000
#: Shingles of a bucket's members from which it is compared block by block.
GROUP_ELEMENTS = 2_000_000
#: Rows of ids that are broadcast, of at most 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Elements of a set that are hashed at a time.
STEP_ELEMENTS = 4_096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes (uint64) of its shingles, the whole sequence as one where it has fewer words."""
    index, ids, length = Index(), [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
            length[k] = len(words)
            ids.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in index.new), np.uint64, len(index.new))
    flat = of_word[np.concatenate(ids)] if ids else np.zeros(0, np.uint64)
    ends = np.cumsum(length)
    # the hash of up to `shingle` words from each place; those that leave their text are not used
    held = np.zeros(len(flat), np.uint64)
    partial = []
    for j in range(shingle):
        n = max(0, len(flat) - j)
        held[:n] = mixed(held[:n] * np.uint64(0x9E3779B97F4A7C15) + flat[j:])
        if j < shingle - 1:
            short = length == j + 1
            partial.append((short, held[(ends - length)[short]].copy()))
    out = [np.unique(held[e - n : e - shingle + 1]) if n >= shingle else np.zeros(0, np.uint64) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
    for short, value in partial:
        for k, v in zip(np.flatnonzero(short).tolist(), value, strict=True):
            out[k] = np.array([v], np.uint64)
    return out


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """What makes the hash functions: a value to flip bits by and an odd factor for each."""
    at = mixed(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    half = (at >> np.uint64(32)).astype(np.uint32)
    return half[:REGISTERS, None], half[REGISTERS:, None] | np.uint32(1)


def least_values(elements: np.ndarray) -> np.ndarray:
    """Per hash function the least of the elements' 32-bit values, which are spread alike over their range."""
    flip, factor = _functions()
    x = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), STEP_ELEMENTS):
        np.minimum(least, ((x[None, a : a + STEP_ELEMENTS] ^ flip) * factor).min(axis=1), out=least)
    return least


def levels(least: np.ndarray) -> np.ndarray:
    """Registers of the least values: an evenly spread value becomes an exponential one, that its level."""
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint8)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers (uint8) of a set."""
    return levels(least_values(elements))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _log_likelihood(similarity: np.ndarray, n: tuple[np.ndarray, np.ndarray], seen: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of counts of registers that are larger on the one and on the other side, and equal."""
    shared = similarity / (1 + similarity) * (n[0] + n[1])
    union = n[0] + n[1] - shared
    larger = [-np.log1p(-np.clip((x - shared) / union, 0, 1) * (BASE - 1) / BASE) / np.log(BASE) for x in n]
    p = [*larger, 1 - larger[0] - larger[1]]
    return sum(k * np.log(np.maximum(x, 1e-9)) for k, x in zip(seen, p, strict=True))


def may_be_alike(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of register rows may reach the threshold: False where their sizes rule it out, or the likelihood does."""
    fit = 100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right)
    at = np.flatnonzero(fit)
    left, right = left[at], right[at]
    larger, equal = (left > right).sum(1), (left == right).sum(1)
    seen = (larger[:, None], (REGISTERS - larger - equal)[:, None], equal[:, None])
    n = (n_left[at, None].astype(np.float64), n_right[at, None].astype(np.float64))
    most = np.minimum(*n) / np.maximum(*n)  # no pair of these sizes is more alike
    under = _log_likelihood(percent / 100 * np.linspace(0, 1, 33)[None, :], n, seen).max(1)
    over = _log_likelihood(percent / 100 + (most - percent / 100) * np.linspace(0, 1, 9)[None, :], n, seen).max(1)
    fit[at] = under - over <= DOUBT
    return fit


def _registers(column: pa.Array) -> np.ndarray:
    """The register rows of a binary column without nulls."""
    if not len(column):
        return np.zeros((0, REGISTERS), np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, REGISTERS)


def sketched(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with n_shingles, two digests of the set (d1, d2), and its registers; digests and registers null where it is empty."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("registers", T.BinaryType())]

    def make(texts: list) -> list[pa.Array]:
        sets = shingle_sets(texts, shingle)
        digest = [[int(mixed(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets] for c in (1, 2)]
        return [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(d, pa.int64()) for d in digest), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())]

    return append_columns(docs, text, fields, make)


def banded(sets: DataFrame, *more: str, bands: int = BANDS) -> DataFrame:
    """Rows (key, node, ...) of rows (node, registers, ...) in the first ``bands``: the band's number over its registers, which the key holds as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint64(1) << np.arange(0, 8 * BAND, 8, dtype=np.uint64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                rows = _registers(part.column(0)).reshape(-1, BANDS, BAND)[:, :bands].astype(np.uint64)
                keys = (rows * place).sum(2, dtype=np.uint64) | np.arange(bands, dtype=np.uint64)[None, :] << np.uint64(8 * BAND)
                at = pa.array(np.repeat(np.arange(part.num_rows), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(c.take(at) for c in part.columns[1:])], names=["key", "node", *more])

    return sets.select("registers", "node", *more).mapInArrow(run, f"key long, node long{''.join(f', {c} long' for c in more)}")


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be alike by the registers of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                fit = may_be_alike(_registers(part.column(2)), _registers(part.column(3)), part.column(4).to_numpy(), part.column(5).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(fit))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def star_pairs(sets: DataFrame, percent: int, label: DataFrame | None = None, bands: int = BANDS) -> DataFrame:
    """Pairs (a, b), a < b, of every bucket's first member and the first one of each of its other components of fitting size.

    Components are those of ``label`` (node, root); without it every set is one.
    """
    if label is None:
        heads = banded(sets, "n_shingles", bands=bands)
    else:
        heads = banded(sets.join(label, "node", "left").withColumn("root", F.coalesce("root", "node")), "n_shingles", "root", bands=bands)
        heads = heads.groupBy("key", "root").agg(F.min_by("n_shingles", "node").alias("n_shingles"), F.min("node").alias("node"))
    first = heads.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last"), F.min_by("n_shingles", "node").alias("m")).filter("a < last").select("key", "a", "m")
    fits = 100 * F.least("n_shingles", "m") >= percent * F.greatest("n_shingles", "m")
    return heads.join(first, "key").filter((F.col("node") > F.col("a")) & fits).select("a", F.col("node").alias("b")).distinct()


def pairs_across(band: int, side: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, registers: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Node pairs of a group of ``band`` that may be alike, are in different components, and differ in all earlier bands.

    ``side`` 1 and 2 are the blocks that meet, 0 is one block with itself.
    """
    values, counts = np.unique(label, return_counts=True)
    common = values[counts.argmax()]
    rows = np.flatnonzero(label != common)  # of two in different components one is not in the commonest
    step = max(1, 20_000 // len(node))
    for a in range(0, len(rows), step):
        mine = rows[a : a + step]
        apart = (label[mine, None] != label[None, :]) & ((side[mine, None] == 0) | (side[mine, None] != side[None, :]))
        apart &= 100 * np.minimum(n[mine, None], n[None, :]) >= percent * np.maximum(n[mine, None], n[None, :])
        i, j = np.nonzero(apart)
        i = mine[i]
        earlier = (registers[i, : band * BAND] == registers[j, : band * BAND]).reshape(len(i), band, BAND).all(2).any(1)
        i, j = i[~earlier], j[~earlier]
        fit = may_be_alike(registers[i], registers[j], n[i], n[j], percent)
        yield node[i[fit]], node[j[fit]]


def _each_group(fn: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What maps batches, ordered by their first three columns, by calling ``fn`` with each group of rows equal in those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = [batch.column(c).to_numpy() for c in range(3)]
            cuts = np.flatnonzero((group[0][1:] != group[0][:-1]) | (group[1][1:] != group[1][:-1]) | (group[2][1:] != group[2][:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                this = tuple(int(g[a]) for g in group)
                if held and this != last:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = this
        if held:
            yield from fn(pa.Table.from_batches(held))

    return run


def _across(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``pairs_across`` of a group's rows (key, i, j, side, node, root, n_shingles, registers, ...), as places of rows."""
    key, side, root, n = (rows.column(c).to_numpy() for c in ("key", "side", "root", "n_shingles"))
    registers = np.concatenate([_registers(c) for c in rows.column("registers").chunks])
    return pairs_across(int(key[0]) >> 8 * BAND, side, np.arange(len(key)), root, n, registers, percent)


def joining_links(pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray, flat: np.ndarray, offsets: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """The pairs of places whose full sets reach the threshold, without those whose components are joined by then."""
    universe, at = np.unique(flat, return_inverse=True)
    there, n, parent = np.zeros(len(universe), bool), np.diff(offsets), {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for left, right in pairs:
        for i in np.unique(left).tolist():
            mine = [j for j in right[left == i].tolist() if find(int(root[i])) != find(int(root[j]))]
            if not mine:
                continue
            there[at[offsets[i] : offsets[i + 1]]] = True
            for j in mine:
                shared = int(there[at[offsets[j] : offsets[j + 1]]].sum())
                p, q = find(int(root[i])), find(int(root[j]))
                if p != q and 100 * shared >= percent * (n[i] + n[j] - shared):
                    parent[max(p, q)] = min(p, q)
                    yield i, j
            there[at[offsets[i] : offsets[i + 1]]] = False


def links_between(sets: DataFrame, label: DataFrame, rows: DataFrame, shingle: int, percent: int, limit: int) -> DataFrame:
    """Links (a, b), a < b, between sets that share a bucket and are in different components of ``label`` (node, root): enough to join these."""
    of = sets.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = banded(of, "root", "n_shingles")
    # of two members the one has been compared with the other
    open_ = keyed.groupBy("key").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high and many > 2")
    members = keyed.join(open_.select("key", F.ceil(F.greatest(F.col("many") / limit, F.col("size") / GROUP_ELEMENTS)).alias("blocks")), "key").join(of.select("node", "registers"), "node")
    own = F.pmod(F.xxhash64("node"), "blocks")
    # a block meets itself and every other: (lower block, higher block, which of both this is)
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))
    columns = ["key", "i", "j", "side", "node", "root", "n_shingles", "registers"]
    dealt = members.withColumn("at", F.explode(meet)).select("key", "at.i", "at.j", "at.side", *columns[4:])

    def active(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        met = np.zeros(rows.num_rows, bool)
        for a, b in _across(rows, percent):
            met[a] = met[b] = True
        if met.any():
            yield from rows.filter(pa.array(met)).to_batches()

    def link(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        elements = rows.column("elements").combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(np.asarray(elements.value_lengths()).astype(np.int64))])
        found = list(joining_links(_across(rows, percent), root, np.asarray(elements.flatten()), offsets, percent))
        if found:
            a, b = node[np.array(found)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    met = stored(grouped(dealt).mapInArrow(_each_group(active), dealt.schema), "members")
    full = full_sets(met.select("node"), rows, shingle)
    return grouped(met.join(full, "node").select(*columns, "elements")).mapInArrow(_each_group(link), "a long, b long").distinct()


def full_sets(nodes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, elements) of ``nodes``, from the texts of ``rows`` (node, text)."""
    need = stored(nodes.distinct(), "nodes")
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    make = lambda texts: [pa.array([s.view(np.int64) for s in shingle_sets(texts, shingle)], pa.list_(pa.int64()))]
    full = append_columns(rows.join(need, "node", "left_semi"), "text", [T.StructField("elements", T.ArrayType(T.LongType()))], make)
    return stored(full.select("node", "elements"), "sets")


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets, from the texts of ``rows`` (node, text), reach the threshold."""
    full = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), rows, shingle)
    side = lambda x: full.select(F.col("node").alias(x), F.col("elements").alias(f"e_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("e_a", "e_b")))
    return both.filter(100 * F.col("shared") >= percent * (F.size("e_a") + F.size("e_b") - F.col("shared"))).select("a", "b")


def grouped(marked: DataFrame, shingle: int, percent: int, limit: int = GROUP_ROWS) -> DataFrame:
    """Rows (d1, d2, n_shingles, component_id) of the distinct sets of stored rows (row, doc_id, text, n_shingles, d1, d2, registers)."""
    sets = marked.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers"))
    sets = stored(sets, "sketches")
    texts = marked.select(F.col("row").alias("node"), "text")
    links = label = None
    for bands in (FIRST_BANDS, BANDS):
        near = stored(_estimated(star_pairs(sets, percent, label, bands), sets, percent), "pairs")
        new = stored(verified(near, texts, shingle, percent), "links")
        links = new if links is None else links.union(new)
        label = components(links)
    links = links.union(links_between(sets, label, texts, shingle, percent, limit))
    of = sets.join(components(links), "node", "left").select("d1", "d2", "n_shingles", "doc_id", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "root").select("d1", "d2", "n_shingles", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, limit: int = GROUP_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept.

    Links join sets whose similarity (shared of all) is ``percent`` of a hundred or more, 80 at
    least. Texts that are null or have no word have an empty set, link with nothing, and are their
    own component. Rows without a doc_id take part; the id of their group is the smallest that is
    not null, and where there is none it is null, which counts as equal to theirs. Repeated rows are
    equal sets. Ties of similarity at the threshold link. Other columns don't matter; an empty table
    gives none; a long text is hashed in steps.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 and more")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = stored(sketched(rows, "text", shingle), "sketched")
    of = marked.select("doc_id", "n_shingles", "d1", "d2").join(grouped(marked, shingle, percent, limit), ["d1", "d2", "n_shingles"], "left")
    component: Column = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return of.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: All pairs that share a shingle; few enough at the scale of the correctness check.
ORACLE_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END) AS s FROM words
), elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
    FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def op11_setsketch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
