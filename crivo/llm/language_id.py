"""Operator 6: language identification by sparse multinomial logistic regression.

A text's features are the character n-grams (1 to 4) of its lower-cased words with a mark at both
ends, hashed into a fixed number of places and weighted by relative frequency times inverse
document frequency. Weights are learned by follow-the-regularised-leader with an elastic net, so
most are exactly zero; a temperature fitted on rows held back from learning makes the scores
probabilities. Learning takes about ``max_learned`` rows (a parameter), drawn by a hash of doc_id,
whose n-grams are counted in Spark tasks; the model's size depends on the number of places and
languages only. Prediction is a map over whole texts: as features are relative frequencies, a
text's logits are the mean of its words' sums, and a worker works out each distinct word once.
"""

from __future__ import annotations

import gc
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Index, append_columns, fresh, ragged, table

PLACES, LENGTHS = 1 << 18, (1, 2, 3, 4)
MAX_LEARNED, CACHE_BYTES = 3_000, 32_000_000
UNKNOWN = "und"


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all n-grams of ``words`` and the word each is of."""
    joined = "\n" + "\n".join(words) + "\n"  # words have no white space; the line end is the mark at both ends
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mark = points == 10
    word = np.cumsum(mark) - 1  # a mark counts for the word behind it
    at, of = [], []
    for n in LENGTHS:
        if len(points) < n:
            continue
        value = np.full(len(points) - n + 1, n, np.uint64)
        inner = np.zeros(len(value), np.int64)
        for k in range(n):
            part = points[k : k + len(value)]
            value = (value ^ part) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            if 0 < k < n - 1:
                inner += mark[k : k + len(value)]
        first, last = mark[: len(value)], mark[n - 1 :]
        # no mark inside, and not the mark alone or two marks
        good = ~first if n == 1 else (inner == 0) & ~(first & last & (n == 2))
        start = np.flatnonzero(good)
        at.append((value[start] >> np.uint64(40)).astype(np.int64) % PLACES)
        of.append(word[start])
    return (np.concatenate(at), np.concatenate(of)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (PLACES, languages): inverse document frequency times weight
    bias: np.ndarray
    temperature: float = 1.0
    word: Index = field(default_factory=Index, repr=False)
    sums: np.ndarray | None = field(default=None, repr=False)  # per cached word: the sum over its n-grams, and their number

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.weights.any(axis=1))
        return {"languages": self.languages, "used": used, "weights": self.weights[used], "bias": self.bias, "temperature": self.temperature}

    def __setstate__(self, state: dict) -> None:
        weights = np.zeros((PLACES, len(state["languages"])), np.float32)
        weights[state["used"]] = state["weights"]
        self.__init__(state["languages"], weights, state["bias"], state["temperature"])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if self.sums is None or self.word.n_bytes > CACHE_BYTES:
            self.word, self.sums = Index(), np.zeros((0, len(self.languages) + 1), np.float32)
        split = [t.lower().split() if t else [] for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        number = np.fromiter((i for s in split for i in map(self.word.__getitem__, s)), np.int64, int(count.sum()))
        if self.word.new:
            at, of = word_ngrams(self.word.new)
            n = len(self.word.new)
            made = [np.bincount(of, weights=self.weights[at, k], minlength=n) for k in range(len(self.languages))]
            self.sums = np.concatenate([self.sums, np.stack([*made, np.bincount(of, minlength=n)], axis=1).astype(np.float32)])
            self.word.new.clear()
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros((len(texts), len(self.languages) + 1))
        have = np.flatnonzero(count)
        if len(have):
            out[have] = np.add.reduceat(self.sums[number].astype(np.float64), ends[have], axis=0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and calibrated probabilities; ``und`` with score 0 where a text has no letter."""
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        known = np.array([has_letter(t) for t in texts], bool)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p[np.arange(len(texts)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, n_places: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n_places, classes) and bias of sparse rows (places, values), by per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((n_places + 1, n_classes)), np.zeros((n_places + 1, n_classes))  # the last place is the bias
    order = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            places, values = rows[k]
            at, x = np.append(places, n_places), np.append(values, 1.0)
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[y[k]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(n_places + 1))
    return w[:-1], w[-1]


#: Features are relative frequencies; this brings them to the learner's scale.
SCALE = 200.0


@dataclass
class Weighted(Sequence):
    """Rows (places among the used, TF-IDF values), each made when it is asked for: the sample is in memory once, as its counts."""

    samples: list[tuple[str, np.ndarray, np.ndarray]]
    number: np.ndarray  # of a place among the used
    idf: np.ndarray

    def __len__(self) -> int:
        return len(self.samples)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        _, places, times = self.samples[k]
        at = self.number[places]
        return at, SCALE * times / max(1, times.sum()) * self.idf[at]


def learn(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel | None:
    """The model of (language, places, counts) rows; every fifth row only sets the temperature. None without rows."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    y = np.array([languages.index(s[0]) for s in samples])
    # learning is over the places that the sample uses; a row has each of its places once
    documents = np.zeros(PLACES, np.int64)
    for _, places, _ in samples:
        documents[places] += 1
    used = np.flatnonzero(documents)
    number = np.zeros(PLACES, np.int64)
    number[used] = np.arange(len(used))
    idf = np.log((1 + len(samples)) / (1 + documents[used])) + 1
    rows = Weighted(samples, number, idf)
    held = np.arange(len(rows)) % 5 == 4
    if held.all() or not held.any() or len(set(y[~held])) < len(languages):
        held[:] = False
    w, bias = ftrl(Weighted([x for x, h in zip(samples, held, strict=True) if not h], number, idf), y[~held], len(languages), len(used))
    weights = np.zeros((PLACES, len(languages)), np.float32)
    weights[used] = SCALE * idf[:, None] * w
    model = LanguageModel(languages, weights, bias)
    if held.any():
        logits = np.stack([x @ w[at] + bias for at, x in map(rows.__getitem__, np.flatnonzero(held))])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(logits)), y[held]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 50, 121), key=loss))
    return model


def part_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null without an id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % parts


def train(docs: DataFrame, learnable: Column, max_learned: int = MAX_LEARNED) -> LanguageModel | None:
    """The model of the rows with a language for which ``learnable`` is true, or of about ``max_learned`` of them."""
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = rows.count()
    if n > max_learned:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_learned / n))

    def count(texts: list) -> list[pa.Array]:
        words = Index()
        split = [[words[w] for w in t.lower().split()] for t in texts]
        at, of = word_ngrams(words.new) if words.new else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(of, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
        by_word = at[order]  # once for all texts of the step
        made = [np.unique(ragged(by_word, offsets, np.array(s, np.int64))[0], return_counts=True) for s in split]
        ends = np.concatenate([[0], np.cumsum([len(a) for a, _ in made])]).astype(np.int32)
        lists = [np.concatenate([m[k] for m in made] or [np.zeros(0)]).astype(np.int32) for k in (0, 1)]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in lists]

    counted = append_columns(rows, "text", [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))], count)
    sample = counted.select("doc_id", "lang", "places", "times").toArrow()
    order = pc.sort_indices(sample.select(["doc_id", "lang"]), [("doc_id", "ascending"), ("lang", "ascending")]).to_numpy()
    lang = sample.column("lang").to_pylist()
    # views of the lists as they came
    places, times = ([v.values.to_numpy() for c in sample.column(k).chunks for v in c] for k in ("places", "times"))
    model = learn([(lang[k], places[k], times[k]) for k in order.tolist() if len(places[k])])
    del sample, places, times  # the driver keeps the model alone
    gc.collect()
    pa.default_memory_pool().release_unused()
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its calibrated probability.

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a
    model; repeated rows and other columns don't matter.
    """

    def run(texts: list) -> list[pa.Array]:
        if model is None:
            return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
        found, p = model.predict(texts)
        return [pa.array(found, pa.string()), pa.array(p)]

    return append_columns(docs, text, [T.StructField(fresh(docs, prediction), T.StringType()), T.StructField(fresh(docs, score), T.DoubleType())], run)


def learnable(parts: int = 4, held: int = 2) -> Column:
    return F.coalesce(part_of(F.col("doc_id"), parts) != held, F.lit(False))


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a probability of ``least`` or more."""
    model = train(docs, learnable())
    found = identify(docs, model, prediction="_lang_pred", score="_lang_score")
    prediction, score = found.columns[-2:]
    return found.filter((F.col(prediction) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs, learnable()))
    return found.select("doc_id", F.coalesce(part_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
