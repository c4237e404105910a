"""Operator 13: ranked lexical search by norm buckets.

A document's impact vector has, for each term of the queries, the term's weight times its integer
impact in the document; a query's score is the sum over its terms. Vectors are ordered by their length
and searched in buckets from the longest: a bucket is passed over for a query where the product of
both lengths (Cauchy-Schwarz) can't reach the score that the query's last place has so far. Inside a
bucket the coordinates of the query's weightiest terms are summed, and the length that the vector has
besides bounds the rest. Those that may still get in are scored again in 64-bit integers.

Buckets are ranges of rows in order of length, in three rounds of ever more rows; each begins
with the scores of the last places of the rounds before, and every task raises its own on the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ragged, slices, stored, table

K = 50
#: Queries that are searched for at a time: what goes to the tasks is their terms.
ITEMS = 2_000
#: The shares of the vectors, longest first, that the rounds come to.
SHARES = (1 / 64, 1 / 8)
#: Vectors of a bucket, and of a query the terms whose coordinates bound the rest.
BUCKET_ROWS, FOCUS = 4_096, 8
#: Upper-case letters become lower-case ones, what is in no term a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in UTF-8: runs of digits, letters, and all beyond ASCII, only A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Rows (row, doc_id, n, terms, tf) of the documents with a term: all its terms' count, and those in ``numbers`` with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found, n = [], np.zeros(part.num_rows, np.int64)
                for k, text in enumerate(part.column(2).to_pylist()):
                    words = terms(text)
                    n[k] = len(words)
                    found.append(np.fromiter(filter(None, map(numbers.get, words)), np.int64))
                row = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                pair, tf = np.unique(row * (len(numbers) + 1) + np.concatenate(found), return_counts=True)
                row, term = pair // (len(numbers) + 1), pair % (len(numbers) + 1) - 1
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                made = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), *lists], names=["row", "doc_id", "n", "terms", "tf"])
                yield made.filter(pa.array(n > 0))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tf array<int>")


def impacts(rows: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Rows (row, doc_id, terms, impact, norm) of the vectors that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3), batch.column(4)
            term, tf = (np.asarray(x.flatten()).astype(np.int64) for x in lists)
            size = np.asarray(lists[0].value_lengths()).astype(np.int64)
            m = 50 + 50 * batch.column(2).to_numpy() * n_docs // n_terms
            v = weight[term] * (1_000_000_000 * tf // (1_000 * tf + 20 * np.repeat(m, size)))
            offsets = np.concatenate([[0], np.cumsum(size)])
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), v.astype(np.float64) ** 2, len(size)))
            at = pa.array(offsets.astype(np.int32))
            made = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(v)), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "terms", "impact", "norm"]).filter(pa.array(norm > 0))

    return rows.select("row", "doc_id", "n", "terms", "tf").mapInArrow(run, "row long, doc_id long, terms array<int>, impact array<long>, norm double")


class Best:
    """The best places of every query so far: score from above, then doc_id from below (None last), then row."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor = k, floor.copy()
        self.rows = [(np.zeros(0, np.int64),) * 4 for _ in floor]

    def add(self, q: int, score: np.ndarray, doc_id: np.ndarray, none: np.ndarray, row: np.ndarray) -> None:
        held = [np.concatenate(x) for x in zip(self.rows[q], (score, doc_id, none.astype(np.int64), row), strict=True)]
        order = np.lexsort((held[3], held[1], held[2], -held[0]))[: self.k]
        self.rows[q] = tuple(x[order] for x in held)
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.rows[q][0][-1])


def search_bucket(term: np.ndarray, v: np.ndarray, offsets: np.ndarray, norm: np.ndarray, doc_id: np.ndarray, none: np.ndarray, row: np.ndarray, queries: list[np.ndarray], n_places: int, best: Best) -> int:
    """Brings the bucket's vectors into ``best``; ``queries`` have their terms in order of weight. How many vectors were scored."""
    longest, n, scored = float(norm.max()), len(norm), 0
    of = np.repeat(np.arange(n), np.diff(offsets))
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(n_places + 1))
    square = norm**2
    mine = np.zeros(n_places, bool)
    for q, places in enumerate(queries):
        floor = max(1, best.floor[q])
        if not len(places) or math.sqrt(len(places)) * longest * (1 + 1e-9) < floor:
            continue
        focus = places[:FOCUS]
        at = np.concatenate([by_term[starts[t] : starts[t + 1]] for t in focus.tolist()])
        x = v[at].astype(np.float64)
        known, used = np.bincount(of[at], x, n), np.bincount(of[at], x * x, n)
        rest = math.sqrt(len(places) - len(focus)) * np.sqrt(np.maximum(0.0, square - used))
        may = np.flatnonzero((known + rest) * (1 + 1e-9) + 1e-3 >= floor)
        if not len(may):
            continue
        scored += len(may)
        mine[places] = True
        flat, length = ragged(np.arange(len(term)), offsets, may)
        score = np.add.reduceat(np.where(mine[term[flat]], v[flat], 0), np.concatenate([[0], np.cumsum(length)[:-1]]))
        mine[places] = False
        good = score >= floor
        if good.any():
            pick = may[good]
            best.add(q, score[good], doc_id[pick], none[pick], row[pick])
    return scored


def search_round(vectors: DataFrame, queries: list[np.ndarray], n_places: int, floor: np.ndarray, k: int) -> DataFrame:
    """Rows (query, doc_id, score, row): each task's best of its buckets, none below ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floor, k)
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(a, BUCKET_ROWS)
                term, v = (np.asarray(part.column(c).flatten()) for c in (2, 3))
                offsets = np.concatenate([[0], np.cumsum(np.asarray(part.column(2).value_lengths()).astype(np.int64))])
                ids = part.column(1)
                search_bucket(term, v, offsets, part.column(4).to_numpy(), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null().to_numpy(zero_copy_only=False)), part.column(0).to_numpy(), queries, n_places, best)
        for q, (score, doc_id, none, row) in enumerate(best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q, np.int32)), pa.array(doc_id, mask=none.astype(bool)), pa.array(score), pa.array(row)], names=["query", "doc_id", "score", "row"])

    return vectors.mapInArrow(run, "query int, doc_id long, score long, row long")


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """Rows (query, rank, doc_id, score) for the texts ``items``; None where nothing can be found."""
    wanted = [sorted(set(terms(text))) for text in items]
    # numbers from 1, as nothing else is true
    numbers = {t: i + 1 for i, t in enumerate(sorted(set().union(*wanted)))}
    if not numbers:
        return None
    rows = stored(counted(docs, numbers), "terms")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(numbers), np.int64)
    for t, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the queries' terms at most
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = [np.array(sorted((numbers[t] - 1 for t in ts if df[numbers[t] - 1]), key=lambda t: (-weight[t], t)), np.int64) for ts in wanted]
    vectors = impacts(rows, weight, n_docs, n_terms)
    vectors = stored(vectors.repartitionByRange(F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row"), "impacts")
    cuts = vectors.agg(F.percentile_approx("norm", F.array(*(F.lit(1 - s) for s in SHARES)), 10_000)).first()[0]
    if cuts is None:
        return None
    bounds = [math.inf, *sorted(set(cuts), reverse=True), -1.0]
    floor, found = np.zeros(len(items), np.int64), None
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    for high, low in zip(bounds, bounds[1:], strict=False):
        if found is not None and all(math.sqrt(len(q)) * high * (1 + 1e-9) < max(1, f) for q, f in zip(queries, floor.tolist(), strict=True)):
            break  # no vector that is left is long enough for any query
        part = search_round(vectors.filter((F.col("norm") < high) & (F.col("norm") >= low)), queries, len(numbers), floor, k)
        found = part if found is None else found.union(part)
        found = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "best")
        for q, n, least in found.groupBy("query").agg(F.count("*"), F.min("score")).collect():  # a row for each query
            floor[q] = least if n == k else 0
    return found.withColumn("rank", F.row_number().over(order)).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = ITEMS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item.

    Items are read in blocks of ``block``, for each of which the documents are searched; equal items
    count once, and ones with the same id and different texts are ranked each for itself. Null and
    empty texts have no term: such items find nothing, such documents are not found and not counted.
    Equal scores are in ascending order of doc_id, rows without one last; repeated rows take a place
    each. Other columns don't matter; without items or documents there are no rows.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text")
    out, held = None, []
    schema = "item_id long, rank int, doc_id long, score long"

    def answered(out: DataFrame | None, held: list) -> DataFrame | None:
        found = _search_block(docs, [text for _, text in held], k)
        if found is None:
            return out
        ids = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(held)], "query int, item_id long")
        found = found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")  # a block of items
        return found if out is None else out.union(found)

    for item in wanted.toLocalIterator():
        held.append(item)
        if len(held) == block:
            out, held = answered(out, held), []
    if held:
        out = answered(out, held)
    return spark.createDataFrame([], schema) if out is None else out


ORACLE_SQL = """
WITH folded AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents), occurrences AS (
    SELECT doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM folded
), tf AS (SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id), totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scores AS (
    SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op13_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
