"""Operator 8: document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's evidence is a set of thresholds on plain figures of
itself and of the lines before and behind it; a chain couples neighbours. Forward and backward
products of 2 by 2 matrices give each line's probability of being good, and a document's score is
their mean, weighted by the lines' lengths. The chain products of all lines of a step are worked out
together by doubling (log2 of the longest document rounds), so a document of many thousand lines
needs no loop of its own.

Learning takes about ``max_learned`` labelled documents (a parameter), drawn by a hash of doc_id,
whose lines' figures are counted in Spark tasks; all lines of a document carry its label.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, table
from .language_id import part_of
from .quality_rules import SYMBOLS, UPPER

MAX_LEARNED = 6_000
CUTS = 8
THRESHOLD = 0.3
FIGURES = 13


def line_figures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The figures (lines, FIGURES) of a whole text's lines, and the lines' weights; null and empty texts are one empty line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    times = Counter(lines)
    out = np.zeros((len(lines), FIGURES), np.float32)
    weight = np.ones(len(lines))
    for k, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        solid = size - line.count(b" ")
        less = lambda chars, line=line: len(line) - len(line.translate(None, chars))
        weight[k] = size
        out[k] = (
            np.log1p(n), solid / n, less(SYMBOLS) / n, less(UPPER) / solid, less(b"0123456789") / solid, less(b".,;:?") / n, line.count(b"!") / n,
            line.count(b"|") / n, len(set(words)) / n, times[line] > 1, line.rstrip().endswith((b".", b"!", b"?")), max(map(len, words)), less(b"()[]{}=_/\\@~^+-\"'`") / n,
        )
    return out, weight


def neighbours(figures: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each line's figures, and those of the lines before and behind it (zero beyond the text)."""
    before, behind = np.zeros_like(figures), np.zeros_like(figures)
    before[1:], behind[:-1] = figures[:-1], figures[1:]
    before[first], behind[last] = 0, 0
    return np.concatenate([figures, before, behind], axis=1)


def products(steps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Running products of 2 by 2 matrices from each chain's first (place 0) on, by doubling; scaled to a largest entry of 1."""
    out, d, longest = steps.copy(), 1, int(place.max(initial=0))
    while d <= longest:
        at = np.flatnonzero(place >= d)
        new = np.einsum("nij,njk->nik", out[at - d], out[at])
        out[at] = new / new.max(axis=(1, 2), keepdims=True)
        d *= 2
    return out


@dataclass
class LineField:
    """Thresholds per figure, weights of the threshold tests, and the chain's weights; state 1 is good."""

    cuts: np.ndarray  # (figures of a line and its neighbours, CUTS)
    weight: np.ndarray
    bias: float
    couple: np.ndarray  # (2, 2)

    def evidence(self, rich: np.ndarray) -> np.ndarray:
        out = np.full(len(rich), self.bias)
        for k in range(rich.shape[1]):
            # the tests that a value passes are the first ones, so their weights' running sum is looked up
            steps = np.concatenate([[0.0], np.cumsum(self.weight[k])])
            out += steps[np.searchsorted(self.cuts[k], rich[:, k], side="right")]
        return out

    def marginals(self, evidence: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being good, and (lines, 2, 2) of it and the line before (zero for first lines)."""
        n = len(evidence)
        first = np.repeat(np.cumsum(count) - count, count)
        place = np.arange(n) - first
        back = np.repeat(count, count) - 1 - place
        e = np.clip(evidence, -30, 30)
        factor = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))], axis=1)  # e ** (0, evidence), scaled
        chain = np.exp(self.couple - self.couple.max())
        step = chain[None] * factor[:, None, :]
        opened = step.copy()
        opened[place == 0] = factor[place == 0, None, :]
        forward = products(opened, place)[:, 0, :]
        # from the last line backwards the matrices are transposed, so that products run the same way
        turned = np.swapaxes(step, 1, 2)[::-1]
        tail = products(turned, back[::-1])[::-1]  # the product of the steps of this line and those behind, transposed
        behind = np.ones((n, 2))
        inner = np.flatnonzero(back > 0)
        behind[inner] = tail[inner + 1].sum(axis=1)
        behind /= behind.max(axis=1, keepdims=True)
        both = forward * behind
        good = both[:, 1] / both.sum(axis=1)
        pair = np.zeros((n, 2, 2))
        at = np.flatnonzero(place > 0)
        joint = forward[at - 1][:, :, None] * step[at] * behind[at][:, None, :]
        pair[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return good, pair

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        made = [line_figures(t) for t in texts]
        count = np.array([len(f) for f, _ in made])
        ends = np.cumsum(count)
        weight = np.concatenate([w for _, w in made])
        rich = neighbours(np.concatenate([f for f, _ in made]), ends - count, ends - 1)
        good, _ = self.marginals(self.evidence(rich), count)
        return np.add.reduceat(good * weight, ends - count) / np.add.reduceat(weight, ends - count)


def learn(figures: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.05, penalty: float = 1e-3) -> LineField:
    """The field that makes the documents' labels likeliest on all their lines, by full gradients with adaptive steps."""
    ends = np.cumsum(count)
    rich = neighbours(figures, ends - count, ends - 1)
    cuts = np.sort(np.quantile(rich, (np.arange(CUTS) + 0.5) / CUTS, axis=0).T.astype(np.float64), axis=1)
    place = np.stack([np.searchsorted(c, rich[:, k], side="right") for k, c in enumerate(cuts)], axis=1)
    flat = place + np.arange(rich.shape[1]) * (CUTS + 1)
    y = np.repeat(label, count).astype(float)
    inner = np.ones(len(y), bool)
    inner[ends - count] = False
    # a document counts once however many lines it has
    share = np.repeat(1.0 / count, count)
    agreeing = np.diag([(share[inner] * (y[inner] == s)).sum() for s in (0, 1)])
    field = LineField(cuts, np.zeros((rich.shape[1], CUTS)), 0.0, np.zeros((2, 2)))
    theta = np.zeros(rich.shape[1] * CUTS + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        good, pair = field.marginals(field.evidence(rich), count)
        off = (y - good) * share
        per_bin = np.bincount(flat.ravel(), weights=np.repeat(off, rich.shape[1]), minlength=rich.shape[1] * (CUTS + 1)).reshape(-1, CUTS + 1)
        # a test's gradient is over all values that pass it
        passed = np.cumsum(per_bin[:, ::-1], axis=1)[:, ::-1][:, 1:]
        couple = agreeing - (pair * share[:, None, None]).sum(axis=0)
        gradient = np.concatenate([passed.ravel(), [off.sum()], couple.ravel()]) / len(count) - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        field = LineField(cuts, theta[:-5].reshape(-1, CUTS), float(theta[-5]), theta[-4:].reshape(2, 2))
    return field


def train(docs: DataFrame, labels: DataFrame, learnable: Column, max_learned: int = MAX_LEARNED) -> LineField | None:
    """The field of the labelled documents for which ``learnable`` (over doc_id) is true, or of about ``max_learned`` of them; None without both labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(learnable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    n = known.count()
    if n > max_learned:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_learned / n))

    def count(texts: list) -> list[pa.Array]:
        made = [line_figures(t)[0] for t in texts]
        ends = np.concatenate([[0], np.cumsum([f.size for f in made])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f.ravel() for f in made]) if made else np.zeros(0, np.float32)))]

    # at most about max_learned rows of 12 bytes are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    seen = append_columns(rows, "text", [T.StructField("figures", T.ArrayType(T.FloatType()))], count).select("doc_id", "quality", "figures").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    label = np.array(seen.column(1).to_pylist(), int)
    if not len(label) or label.min() == label.max():
        return None
    figures = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32).reshape(-1, FIGURES) for c in seen.column(2).chunks for v in c]
    return learn(np.concatenate(figures), np.array([len(f) for f in figures]), label)


def score(docs: DataFrame, field: LineField | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the quality score (0 to 1) of ``text``.

    Null and empty texts are one empty line and have a score as well; without a field, as no label
    could be learned from, all have 0.5; repeated rows and other columns don't matter.
    """
    made = lambda texts: [pa.array(np.full(len(texts), 0.5) if field is None else field.scores(texts))]
    return append_columns(docs, text, [T.StructField(fresh(docs, name), T.DoubleType())], made)


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(part_of(F.col("doc_id"), 5) == 0, F.lit(False))
    field = train(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, field).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
