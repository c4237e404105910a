"""Operator 5: exact top-k inner products by best-first search in M-trees.

Vectors x are given one more coordinate, sqrt(max |x|^2 - |x|^2), and queries a zero there; then the
largest inner products are the smallest distances, and a metric tree applies. Its upper level is a
list of cells: rows belong to the nearest of a bounded number of pivots, and a cell has the least and
the largest distance of its rows to the pivot. Cells near to each other make up shards of bounded
size, and a cell with more rows is dealt into several. Each shard is bulk-loaded into an M-tree of pages: a page has a routing object, its
covering radius, its distance to the parent's routing object, and either child pages or objects with
their distances to the routing object. Pages are stored as a table.

A query is searched in one shard of the nearest cell first, which gives it a first bound, and then
only in the shards whose cells can hold a better object by that bound. Shards that many queries come
to are searched for blocks of them. Within a shard the queries of a block go together: each expands
its open pages in order of their lower bounds, first one, then twice as many each round, until no
open page can hold a better object. Stored distances rule out pages and objects by the triangle
inequality before any distance to them is worked out. A query's best of all shards are merged.

What goes over the network is every page once, every query once for each shard that its bound
admits, and a shard's pages once more for every ``BLOCK_QUERIES`` queries that come to it. Where the
vectors are spread alike in all directions of many dimensions, hardly any bound rules anything out,
and every query visits every shard, as it would in a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

SHARD_ROWS, BLOCK_QUERIES = 20_000, 20_000
LEAF, FAN = 128, 24
#: Numbers that the driver holds of pivots, and eight times as many of the sample that they are chosen from; and the most pivots.
PIVOT_VALUES, PIVOTS = 1 << 19, 4_096
#: Rows of a cell, as long as there are fewer cells than pivots may be.
CELL_ROWS = 128
#: Queries of a block that are searched together.
TOGETHER = 1_000
#: Share of a leaf's (query, object) pairs below which they are worked out one by one.
SPARSE = 0.1
#: Distances are of 64-bit floats; a bound must fail by more than this share to rule anything out.
SLACK = 1e-9

_PAGES = "shard long, page int, parent int, radius double, to_parent double, routing array<double>, ids array<long>, to_routing array<double>, vectors array<double>"


def integer_vectors(df: DataFrame, factor: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, v): floor(factor * x) of every component; rows with a null id or a null or non-finite component are left out."""
    x = F.col(embedding).cast("array<double>")
    good = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.filter(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * factor).cast("double")).alias("v"))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes all of them as long as the longest."""
    return np.concatenate([vectors, np.sqrt(np.maximum(longest - (vectors**2).sum(1), 0))[:, None]], axis=1)


def to_one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to one of them, by differences, so that those of near rows are right as well."""
    return np.sqrt(((x - y) ** 2).sum(1))


def nearest(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The number of the nearest of ``chosen``, which are all of one length, for each row."""
    return (x @ chosen.T).argmax(axis=1)


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` different rows of ``x``, which are all of one length, each the farthest from those before it."""
    alike, chosen, least = x @ x[0], [0], x[0] @ x[0] - 0.25  # of different whole numbers the squared distance is 1 at least
    while len(chosen) < k and alike.min() < least:
        chosen.append(int(alike.argmin()))
        alike = np.maximum(alike, x @ x[chosen[-1]])
    return np.array(chosen)


def bulk_load(x: np.ndarray) -> Iterator[dict]:
    """The pages of an M-tree over the rows of ``x``, the root first: rows are indices into ``x``, a page's routing object first."""
    number = iter(range(len(x) * 2 + 2))
    waiting = [(np.arange(len(x)), 0, -1)] if len(x) else []
    # the routing object of a page is one of its objects
    while waiting:
        rows, routing, parent = waiting.pop()
        page = next(number)
        to_routing = to_one(x[rows], x[routing])
        out = {"page": page, "parent": parent, "routing": int(routing), "radius": float(to_routing.max()), "rows": None, "to_routing": None}
        if len(rows) <= LEAF:
            order = np.argsort(rows != routing, kind="stable")
            yield out | {"rows": rows[order], "to_routing": to_routing[order]}
            continue
        yield out
        k = min(FAN, -(-len(rows) // LEAF))
        chosen = rows[spread(x[rows], k)]
        near = nearest(x[rows], x[chosen])
        # once more from the middle of each part, where its radius is smaller
        parts = [rows[near == c] for c in np.unique(near)]
        chosen = np.array([part[(x[part] @ x[part].mean(axis=0)).argmax()] for part in parts])
        near = nearest(x[rows], x[chosen])
        k = len(chosen)
        if np.bincount(near, minlength=k).max() > 0.9 * len(rows):  # copies of one object, or nearly: any equal parts will do
            k = max(2, k)
            near = np.arange(len(rows)) * k // len(rows)
            chosen = np.array([rows[near == c][0] for c in range(k)])
        for c in range(k):
            part = rows[near == c]
            if len(part):
                waiting.append((part, chosen[c] if (part == chosen[c]).any() else part[0], page))


def build_pages(shard: int, ids: np.ndarray, vectors: np.ndarray, longest: float) -> pa.Table:
    """One shard's pages; ``longest`` is the largest squared length of all vectors."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    x = lifted(vectors, longest)
    loaded = list(bulk_load(x))
    routing = np.array([p["routing"] for p in loaded], np.int64)
    parent = np.array([p["parent"] for p in loaded], np.int32)
    none = np.zeros(0, np.int64)
    rows = [none if p["rows"] is None else p["rows"] for p in loaded]
    to_routing = np.concatenate([none if p["to_routing"] is None else p["to_routing"] for p in loaded]).astype(float) if loaded else np.zeros(0)
    length = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows).astype(np.int64) if rows else none

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))

    width = vectors.shape[1]
    return pa.table(
        [
            pa.array(np.full(len(loaded), shard, np.int64)), pa.array(np.arange(len(loaded), dtype=np.int32)), pa.array(parent), pa.array([p["radius"] for p in loaded], pa.float64()),
            pa.array(np.where(parent < 0, 0.0, to_one(x[routing], x[routing[parent]])) if len(loaded) else np.zeros(0)),
            lists(vectors[routing].ravel(), np.full(len(loaded), width)), lists(ids[flat], length), lists(to_routing, length), lists(vectors[flat].ravel(), length * width),
        ],
        schema=_PAGE_SCHEMA,
    )


_PAGE_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("page", pa.int32()), ("parent", pa.int32()), ("radius", pa.float64()), ("to_parent", pa.float64()), ("routing", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("to_routing", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]
)


class Shard:
    """A shard's pages in memory."""

    def __init__(self, pages: pa.Table) -> None:
        pages = pages.combine_chunks().sort_by("page")
        lists = lambda name: [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in pages.column(name)]
        self.parent, self.radius, self.to_parent = (pages.column(c).to_numpy() for c in ("parent", "radius", "to_parent"))
        self.routing = np.stack(lists("routing"))
        self.ids, self.to_routing = lists("ids"), lists("to_routing")
        self.vectors = [v.reshape(len(i), self.routing.shape[1]) for v, i in zip(lists("vectors"), self.ids, strict=True)]
        self.children = [np.flatnonzero(self.parent == p) for p in range(len(self.parent))]
        self.computed = 0  # inner products, and so distances, worked out in searches

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, longest: float, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ids and scores of its k best objects but itself, ties to smaller ids; -1 and -inf where there are fewer.

        Objects with scores below ``worst`` of their query are not wanted, and may be left out.
        """
        n, n_pages = len(queries), len(self.parent)
        base = (queries**2).sum(1) + longest
        worst = np.full(n, -np.inf) if worst is None else worst
        best_id, best = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
        low = np.full((n, n_pages), np.inf)  # of open pages: no object within can be nearer
        score = np.full((n, n_pages), -np.inf)  # with the routing objects
        score[:, 0] = queries @ self.routing[0]
        self.computed += n
        low[:, 0] = np.maximum(far(score[:, 0], base) - self.radius[0], 0)
        reach = reached(worst, base)
        width = 1
        while True:
            take = min(width, n_pages)
            nearest_pages = np.argpartition(low, take - 1, axis=1)[:, :take] if take < n_pages else np.tile(np.arange(n_pages), (n, 1))
            bound = np.take_along_axis(low, nearest_pages, axis=1)
            q, at = np.nonzero(np.isfinite(bound) & (bound <= reach[:, None]))
            if not len(q):
                return np.where(np.isfinite(best), best_id, -1), best
            page = nearest_pages[q, at]
            order = np.lexsort((q, page))
            q, page = q[order], page[order]
            low[q, page] = np.inf
            starts = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(page)), strict=True):
                p, rows = int(page[a]), q[a:b]
                there = far(score[rows, p], base[rows])[:, None]
                child = self.children[p]
                # without a distance: the page's own rules out what is too far from it, or too near to it
                margin = self.to_routing[p] if len(self.ids[p]) else self.to_parent[child]
                maybe = np.abs(there - margin) - (0 if len(self.ids[p]) else self.radius[child]) <= reach[rows, None]
                if len(self.ids[p]):
                    found = self._scores(queries, rows, self.vectors[p], maybe, score[rows, p])
                    found[query_ids[rows][:, None] == self.ids[p]] = -np.inf
                    self._keep(rows, self.ids[p], found, best_id, best, k)
                    reach[rows] = reached(np.maximum(best[rows, -1], worst[rows]), base[rows])
                    continue
                found = self._scores(queries, rows, self.routing[child], maybe)
                score[np.ix_(rows, child)] = found
                low[np.ix_(rows, child)] = np.where(maybe, np.maximum(far(found, base[rows, None]) - self.radius[child], 0), np.inf)
            width *= 2

    def _scores(self, queries: np.ndarray, rows: np.ndarray, objects: np.ndarray, maybe: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """The scores of queries with objects where ``maybe``, else -inf; ``first`` has those of the first object, if they are known."""
        out = np.full(maybe.shape, -np.inf)
        if first is not None:
            out[:, 0] = np.where(maybe[:, 0], first, -np.inf)
            maybe = maybe.copy()
            maybe[:, 0] = False
        wanted, some = np.count_nonzero(maybe), np.flatnonzero(maybe.any(axis=0))
        if wanted and wanted < SPARSE * len(rows) * len(some):
            q, o = np.nonzero(maybe)
            out[q, o] = np.einsum("ij,ij->i", queries[rows[q]], objects[o])
            self.computed += wanted
        elif wanted:
            mine = np.flatnonzero(maybe.any(axis=1))
            got = queries[rows[mine]] @ objects[some].T
            out[np.ix_(mine, some)] = np.where(maybe[np.ix_(mine, some)], got, -np.inf)
            self.computed += got.size
        return out

    @staticmethod
    def _keep(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, best_id: np.ndarray, best: np.ndarray, k: int) -> None:
        top = score.max(axis=1)
        better = np.flatnonzero((top >= best[rows, -1]) & np.isfinite(top))
        if not len(better):
            return
        rows, score = rows[better], score[better]
        all_scores = np.concatenate([best[rows], score], axis=1)
        all_ids = np.concatenate([best_id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        keep = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best[rows], best_id[rows] = np.take_along_axis(all_scores, keep, axis=1), np.take_along_axis(all_ids, keep, axis=1)


def far(score: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Distances from inner products; ``base`` is the query's squared length and the longest's."""
    return np.sqrt(np.maximum(base - 2 * score, 0))


def reached(score: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Beyond this distance no object scores ``score`` or more."""
    return np.where(np.isfinite(score), far(score, base) + SLACK * (1 + np.sqrt(base)), np.inf)


class Cells:
    """The upper level: pivots, each with the least and largest distance of its rows to it, and the shards of its rows."""

    def __init__(self, pivots: np.ndarray, longest: float) -> None:
        self.pivots, self.longest = pivots, longest
        self.wide = lifted(pivots, longest)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and its distance to the pivot."""
        x = lifted(vectors, self.longest)
        cell = nearest(x, self.wide)
        return cell, to_one(x, self.wide[cell])

    def deal(self, cell: np.ndarray, inner: np.ndarray, outer: np.ndarray, rows: np.ndarray, shard_rows: int) -> None:
        """Fills shards with cells near to each other, up to ``shard_rows``; a cell with more rows has shards of its own."""
        slack = SLACK * (1 + np.sqrt(self.longest))  # a distance is right but for its last digits
        n = len(self.pivots)
        self.inner, self.outer, count = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        self.inner[cell], self.outer[cell], count[cell] = inner - slack, outer + slack, rows
        self.parts = -(-count // shard_rows)
        self.first_shard = np.zeros(n, np.int64)
        self.shards, left = 0, count > 0
        for c in np.flatnonzero(self.parts > 1):
            self.first_shard[c], left[c] = self.shards, False
            self.shards += int(self.parts[c])
        while left.any():
            rest = np.flatnonzero(left)
            rest = rest[np.argsort(-(self.wide[rest] @ self.wide[rest[0]]), kind="stable")]
            fits = rest[: max(1, int((np.cumsum(count[rest]) <= shard_rows).sum()))]
            self.first_shard[fits], left[fits] = self.shards, False
            self.shards += 1

    def first(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The shard that each query is searched in first: one of its nearest cell's."""
        score = queries @ self.pivots.T
        score[:, self.parts == 0] = -np.inf
        cell = score.argmax(axis=1)
        part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.parts[cell]
        return self.first_shard[cell] + part

    def admitted(self, queries: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, shard) for which a cell may hold an object with at least the score ``worst`` of the query."""
        base = (queries**2).sum(1) + self.longest
        d = far(queries @ self.pivots.T, base[:, None])
        low = np.maximum(d - self.outer, self.inner - d)
        q, cell = np.nonzero((low <= reached(worst, base)[:, None]) & (self.parts > 0))
        n = self.parts[cell]
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.repeat(q, n) * self.shards + np.repeat(self.first_shard[cell], n) + part)
        return pairs // self.shards, pairs % self.shards


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def make_cells(vectors: DataFrame, n: int, longest: float, width: int, shard_rows: int) -> tuple[Cells, DataFrame]:
    """The cells of a stored table, and its rows with their shards.

    Pivots are taken far from each other out of a sample, by a hash of vec_id, of at most eight
    times as many rows; what they are changes no result.
    """
    most = max(1, min(PIVOTS, PIVOT_VALUES // (width + 1), -(-n // CELL_ROWS)))
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(8 * most).select("v").toArrow()
    x = matrix(sample.column("v"), width)
    cells = Cells(x[spread(lifted(x, longest), most)], longest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = cells.place(matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d)], names=["row", "vec_id", "v", "cell", "d"])

    placed = stored(vectors.select("row", "vec_id", "v").mapInArrow(place, "row long, vec_id long, v array<double>, cell int, d double"), "mtree-cells")
    known = placed.groupBy("cell").agg(F.min("d").alias("inner"), F.max("d").alias("outer"), F.count("*").alias("n")).toArrow()
    cell, inner, outer, count = (known.column(c).to_numpy() for c in ("cell", "inner", "outer", "n"))
    cells.deal(cell, inner, outer, count, shard_rows)
    parts = vectors.sparkSession.createDataFrame([(int(c), int(cells.first_shard[c]), int(cells.parts[c])) for c in cell], "cell int, start long, parts long")
    shard = F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts"))
    return cells, placed.join(F.broadcast(parts), "cell").select("vec_id", "v", shard.alias("shard"))


def top_k(vectors: DataFrame, is_query: str, k: int = 20, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of (vec_id, v) with ``is_query`` the k largest inner products with the other rows.

    Ties go to the smaller vec_id; rows that repeat a vec_id are candidates each, but never of their
    own id. Shorter vectors count as filled up with zeros; components are integers so small that inner
    products are exact in 64-bit floats. With fewer than k candidates there are fewer rows; an empty table has none.
    """
    # rows are told apart by a number of their own, also where they repeat a vec_id
    vectors = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, longest, width = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)), F.max(F.size("v"))).first()
    longest, width = longest or 0.0, width or 0
    vectors = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, dealt = make_cells(vectors, n, longest, width, shard_rows)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        return build_pages(key[0].as_py(), rows.column("vec_id").to_numpy(), matrix(rows.column("v"), width), longest)

    pages = stored(dealt.groupBy("shard").applyInArrow(build, _PAGES), "mtree-pages")

    def search(key: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(pages) or not len(queries):
            return _FOUND_SCHEMA.empty_table()
        shard, out = Shard(pages), []
        for a in range(0, len(queries), TOGETHER):
            part = queries.slice(a, TOGETHER)
            ids, worst = part.column("vec_id").to_numpy(), part.column("worst").to_numpy()
            found, score = shard.search(ids, matrix(part.column("v"), width), k, longest, worst)
            score[score < worst[:, None]] = -np.inf
            have = np.isfinite(score)
            offsets = pa.array(np.concatenate([[0], np.cumsum(have.sum(axis=1))]), pa.int32())
            worst = np.maximum(worst, score[:, -1])
            hits = [pa.ListArray.from_arrays(offsets, pa.array(x[have].astype(np.int64))) for x in (found, score)]
            out.append(pa.table([part.column("shard"), part.column("vec_id"), part.column("v"), pa.array(worst), *hits], schema=_FOUND_SCHEMA))
        return pa.concat_tables(out)

    def searched(sent: DataFrame, kind: str) -> DataFrame:
        """The rows of (shard, vec_id, v, worst) with what their shards have for them."""
        sent = stored(sent.withColumn("row", F.monotonically_increasing_id()), f"mtree-{kind}")
        blocks = sent.groupBy("shard").agg(F.ceil(F.count("*") / block_queries).alias("blocks"))
        busy = blocks.filter("blocks > 1")
        block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("blocks")))
        sent = sent.join(busy, "shard", "left").withColumn("block", block.cast("long")).drop("blocks", "row")
        copies = pages.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        return stored(copies.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(search, _FOUND), f"mtree-{kind}-found")

    def to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = cells.first(batch.column("vec_id").to_numpy(), matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns, pa.array(np.full(len(shard), -np.inf))], names=["shard", "vec_id", "v", "worst"])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                q, shard = cells.admitted(matrix(part.column("v"), width), part.column("worst").to_numpy())
                other = shard != part.column("shard").to_numpy()[q]
                q, shard = q[other], shard[other]
                for b in range(0, len(q), 10 * TOGETHER):
                    mine = part.select(["vec_id", "v", "worst"]).take(pa.array(q[b : b + 10 * TOGETHER]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[b : b + 10 * TOGETHER]), *mine.columns], names=["shard", "vec_id", "v", "worst"])

    first = searched(vectors.filter(is_query).select("vec_id", "v").mapInArrow(to_first, _SENT), "first")
    others = searched(first.select("shard", "vec_id", "v", "worst").mapInArrow(to_others, _SENT), "others")
    hits = first.union(others).select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.select("query_id", "hit.ids", "hit.scores").toDF("query_id", "vec_id", "score").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: A query on its way to a shard: scores below ``worst`` are not wanted.
_SENT = "shard long, vec_id long, v array<double>, worst double"
_FOUND = _SENT + ", ids array<long>, scores array<long>"
_FOUND_SCHEMA = pa.schema([("shard", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("worst", pa.float64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])


def op5_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
