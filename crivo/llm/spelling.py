"""Operator 12: spelling variants by pivotal grams.

Two words are near if one edit (a code point inserted, deleted or replaced) makes them equal. The
bigrams of a word in order of their frequency among all words, rarest first, begin with a prefix of
three, of which one edit changes two at most. Two disjoint ones of them, chosen by dynamic programming
for the least frequency, are the word's pivots: one edit changes one of both at most. So of two near
words, that whose prefix ends earlier in the order has a pivot that the other word holds in its own
prefix: among its first three, or, as equal bigrams are in order of their places and an edit brings
two new ones at most, among two more that tie with the third.

The pivots of every word are looked up among the other words' prefixes by position: an edit behind
the first pivot leaves all up to it as it is, one before the second pivot leaves all from it on, and
of what is on the pivot's other side one half is left as it is too. These parts, with the lengths,
are one key, so a common gram gives no large group. Whoever meets by a key is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Distinct words that a task counts before it gives them on.
STEP_WORDS = 200_000
#: Code points of words that are worked on at a time.
STEP_POINTS = 400_000
#: Steps of following forms; each form has ten times the occurrences, so chains are short.
STEPS = 40


def with_slips(doc_id: int | None, word: str) -> str:
    """The word as the document has it where its checksum says so: a code point less."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """Rows (word, n) of the runs of letters of at least ``LEAST_LENGTH`` code points in whole texts, A-Z in lower case.

    ``change`` gives the word for a document's run. Null texts have none; rows without a doc_id
    give ``change`` None; repeated rows count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        given = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    # runs that are equal in lower case are one word of the document, which is changed once
                    for word, n in Counter([w.translate(_LOWER) for w in RUN.findall(text)] if text else ()).items():
                        word = change(doc_id, word) if change else word
                        if len(word) >= LEAST_LENGTH:
                            counts[word] += n
                if len(counts) > STEP_WORDS:
                    yield given()
                    counts.clear()
        yield given()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``words``, lengths, code points with zeros behind them) of words of like length, some ``STEP_POINTS`` at a time."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):
        n = length[order[a:]]  # ascending: as many rows as fit where all are as long as the last
        over = np.flatnonzero(n * np.arange(1, len(n) + 1) > STEP_POINTS)
        b = a + max(1, int(over[0]) if len(over) else len(n))
        at = order[a:b]
        flat = np.frombuffer("".join(words[k] for k in at.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.zeros((len(at), int(length[at].max())), np.uint32)
        points[np.arange(points.shape[1])[None, :] < length[at, None]] = flat
        yield at, length[at], points
        a = b


def gram_counts(words: DataFrame) -> DataFrame:
    """Rows (gram, n): how often each bigram is in the distinct words; at most the square of the letters' number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_grams(points)[np.arange(points.shape[1] - 1)[None, :] < length[:, None] - 1] for _, length, points in blocks(batch.column(0).to_pylist())]
            gram, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _grams(points: np.ndarray) -> np.ndarray:
    return points[:, :-1].astype(np.int64) << 21 | points[:, 1:]


def pivots(rank: np.ndarray, in_prefix: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two disjoint grams of each row's prefix that have the least cost together.

    Dynamic programming over places: the best gram so far, and with it, two places on, the best pair.
    """
    width = rank.shape[1]
    never = np.int64(1) << 40
    # the cost and, below it, the place
    one = np.where(in_prefix, cost, never) * width + np.arange(width)[None, :]
    best = np.minimum.accumulate(one, axis=1)
    pair = np.full(rank.shape, 4 * never)
    pair[:, 2:] = one[:, 2:] // width + best[:, :-2] // width
    second = pair.argmin(axis=1)
    return best[np.arange(len(rank)), second - 2] % width, second


class Keys:
    """Hashes of parts of words, from the sums of a polynomial over their code points."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, points: np.ndarray) -> None:
        width = points.shape[1]
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(width, self.FACTOR)]), dtype=np.uint64)
        # code point k counts FACTOR ** k, so a part's sum is a difference, and its place is taken out by what stands behind
        self.sums = np.zeros((len(points), width + 1), np.uint64)
        np.cumsum(points.astype(np.uint64) * self.power[None, :width], axis=1, dtype=np.uint64, out=self.sums[:, 1:])

    def part(self, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width = len(self.power) - 1
        return (self.sums[row, b] - self.sums[row, a]) * self.power[width - a] * _inverse_power(width)

    @staticmethod
    def mixed(*parts: np.ndarray) -> np.ndarray:
        out = np.uint64(0)
        for p in parts:
            x = (out * np.uint64(0x2545F4914F6CDD1D)) ^ p.astype(np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = x ^ (x >> np.uint64(31))
        return out.view(np.int64)


def _inverse_power(width: int) -> np.uint64:
    """What undoes the factor's power ``width``, so that a key doesn't depend on the block that its word is in."""
    return np.uint64(pow(int(Keys.FACTOR), -width, 1 << 64))


def keyed(words: list[str], order: np.ndarray, frequency: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(place in ``words``, key, whether by a pivot, where the prefix ends in the order) of each key.

    ``order`` has the grams in ascending order of their codes; ``frequency`` what each gram counts.
    """
    by_rank = np.lexsort((order, frequency))
    rank_of = np.empty(len(order), np.int64)
    rank_of[by_rank] = np.arange(len(order))
    for at, length, points in blocks(words):
        code = np.searchsorted(order, _grams(points))
        inside = np.arange(points.shape[1] - 1)[None, :] < length[:, None] - 1
        code[~inside] = 0
        rank = np.where(inside, rank_of[code], len(order))
        place = rank * rank.shape[1] + np.arange(rank.shape[1])[None, :]
        ordered = np.partition(place, (2, min(4, rank.shape[1] - 1)), axis=1)
        last = ordered[:, 2] // rank.shape[1]
        first, second = pivots(rank, place <= ordered[:, 2, None], frequency[code])
        in_prefix = (place <= ordered[:, min(4, rank.shape[1] - 1), None]) & (rank <= last[:, None])
        keys = Keys(points)

        def of(row: np.ndarray, gram: np.ndarray, side: int, other: np.ndarray) -> Iterator[np.ndarray]:
            """Keys of the gram's own side and each half of a remainder on its other side that is ``other`` long with the partner."""
            n, zero = length[row], np.zeros(len(row), np.int64)
            half = other // 2
            tag = np.full(len(row), side, np.int64)
            if side == 0:  # all up to the gram's end, and what follows or what ends the word
                own = keys.part(row, zero, gram + 2)
                near, far = (gram + 2, gram + 2 + half), (n - (other - half), n)
            else:  # all from the gram on, and what stands before it or what begins the word
                own = keys.part(row, gram, n)
                near, far = (gram - half, gram), (zero, other - half)
            for k, (a, b) in enumerate((near, far)):
                fits = (a >= 0) & (b <= n) & (a <= b)
                yield np.flatnonzero(fits), Keys.mixed(tag[fits] * 2 + k, gram[fits] if side == 0 else n[fits] - gram[fits], other[fits], own[fits], keys.part(row[fits], a[fits], b[fits]))

        everyone = np.arange(len(at))
        for side, gram in ((0, first), (1, second)):
            mine = length - gram - 2 if side == 0 else gram
            for more in (-1, 0, 1):  # how much longer the partner is
                for k, key in of(everyone, gram, side, mine + more):
                    yield at[k], key, np.ones(len(k), bool), last[k]
        row, gram = np.nonzero(in_prefix)
        for side in (0, 1):
            for k, key in of(row, gram, side, length[row] - gram - 2 if side == 0 else gram):
                yield at[row[k]], key, np.zeros(len(k), bool), last[row[k]]


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, n_a, b, n_b), a < b, of the distinct words (word, n) that are one edit apart."""
    grams = gram_counts(words).toArrow().sort_by("gram")
    order, frequency = grams.column("gram").to_numpy(), grams.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                for at, key, by_pivot, last in keyed(part.column(0).to_pylist(), order, frequency):
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(by_pivot), pa.array(last), part.column(0).take(at), part.column(1).take(at)], names=["key", "pivot", "last", "word", "n"])

    keys = stored(words.select("word", "n").mapInArrow(run, "key long, pivot boolean, last long, word string, n long"), "grams")
    x, y = (keys.filter(F.col("pivot") == by).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("last", "word", "n"))) for by, s in ((True, "x"), (False, "y")))
    met = x.join(y, "key").filter("last_x <= last_y and word_x <> word_y and abs(char_length(word_x) - char_length(word_y)) <= 1 and levenshtein(word_x, word_y, 1) = 1")
    low = F.col("word_x") < F.col("word_y")
    side = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return met.select(side("word_x", "word_y").alias("a"), side("n_x", "n_y").alias("n_a"), side("word_y", "word_x").alias("b"), side("n_y", "n_x").alias("n_b")).distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Per distinct word (word, n) of four code points or more: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n, of equal ones the smallest in code-point order, if that
    n is ``times`` the word's or more, else null; ``root`` is where forms lead from the word. Rows
    with a null word or n are left out, of repeated words the largest n counts; no words give none.
    Shorter words have no two disjoint bigrams and are refused.
    """
    words = stored(words.filter("word is not null and n is not null").groupBy("word").agg(F.max("n").alias("n")), "words")
    if (words.agg(F.min(F.char_length("word"))).first()[0] or 4) < 4:
        raise ValueError("pivots need words of four code points or more")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    leads = -F.col("best.less") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))
    found = stored(found, "forms")
    # every step doubles the length of the way that a root has come
    root = stored(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(STEPS):
        on = root.alias("a").join(root.alias("b"), F.col("a.root") == F.col("b.word")).select(F.col("a.word").alias("word"), F.col("b.root").alias("next"))
        on = stored(on, "roots")
        if on.isEmpty():
            break
        root = stored(root.join(on, "word", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    else:
        raise RuntimeError("the forms did not settle")
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The checksum's table is made bit by bit; near words are those that become equal by leaving out a code point.
ORACLE_SQL = """
WITH RECURSIVE bits AS (
    SELECT range AS i, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (
    SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL
), bytes AS (
    SELECT doc_id, w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS b FROM counted
), hashed AS (
    SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS h FROM bytes, crc
), changed AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
    SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.part = b.part AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), ways AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON ways.root = forms.word WHERE forms.form IS NOT NULL
)
SELECT forms.word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT ways.word, ways.root FROM ways JOIN forms ON ways.root = forms.word WHERE forms.form IS NULL) USING (word)
"""


def op12_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), with_slips).filter(F.col("n") >= LEAST_COUNT))
