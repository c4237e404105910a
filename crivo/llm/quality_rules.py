"""Operator 3: quality rules as a learned decision list.

Statistics of whole texts are counted in one pass. From the statistics of labelled documents,
sequential covering learns an ordered list of rules, each a conjunction of thresholds on shares
that a person can read: a rule is grown by information gain on two thirds of the rows that no rule
covers yet, pruned on the rest, and taken while its precision is surely high enough. The list becomes one ordered
Spark conditional expression, so applying it is a projection over the statistics.

The learner sees a sample of about ``max_labelled`` labelled rows, drawn by a hash of doc_id (a
parameter, and the only bound here); statistics and rules apply to every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh_prefix, table

# White space between words, and the characters that count as symbols.
WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".!?"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops", "n_distinct_words")
MAX_LABELLED = 20_000


def repeated_words(words: list[bytes]) -> int:
    """Words within windows of three that the text has twice or more, the first such window included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    number: dict = {}
    of = [number.setdefault(w, len(number)) for w in windows]
    if len(number) == len(windows):
        return 0
    of = np.array(of)
    twice = np.bincount(of)[of] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The figures of STATISTICS for one whole text; null has no words."""
    if not text:
        return (0,) * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (len(words), len(text) - less(WHITE), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(UPPER), less(STOPS), len(set(words)))


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the columns of STATISTICS (long), their names behind ``prefix``."""

    def run(texts: list) -> list[pa.Array]:
        made = np.array([text_statistics(t) for t in texts], np.int64).reshape(len(texts), len(STATISTICS))
        return [pa.array(made[:, k]) for k in range(len(STATISTICS))]

    return append_columns(df, text, [T.StructField(prefix + n, T.LongType(), True) for n in STATISTICS], run)


def shares(prefix: str = "") -> dict[str, Column]:
    """What rules are about, from the statistics' columns; 0 where there are no words."""
    c = {n: F.col(prefix + n).cast("double") for n in STATISTICS}
    by = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "words": c["n_words"],
        "mean_word_chars": by("word_chars", "n_words"),
        "symbols_per_word": by("n_symbols", "n_words"),
        "dup_line_share": by("n_dup_lines", "n_lines"),
        "repeat_word_share": by("n_repeat_words", "n_words"),
        "words_per_line": by("n_words", "n_lines"),
        "upper_share": by("n_upper", "word_chars"),
        "stops_per_word": by("n_stops", "n_words"),
        # the logarithms' ratio hardly depends on a text's length, unlike the share itself
        "distinct_words_power": F.when(c["n_words"] > 1, F.ln(c["n_distinct_words"]) / F.ln(c["n_words"])).otherwise(F.lit(1.0)),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (share, is upper bound, threshold) that rejects, and how it did in learning."""

    tests: tuple[tuple[str, bool, float], ...]
    covered: int = 0
    precision: float = 0.0

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, upper, x in self.tests:
            out = out & (of[name] <= x if upper else of[name] >= x)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if u else '>='} {x:.6g}" for n, u, x in self.tests)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self, prefix: str = "") -> Column:
        """The first rule that rejects a document, as text; null if none does."""
        of = shares(prefix)
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(rule.column(of), F.lit(str(rule))).otherwise(out)
        return out


def surely(share: float, n: int, z: float = 1.64) -> float:
    """The lower end of Wilson's interval of a share seen in ``n`` rows: few rows prove little."""
    return (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n) if n else 0.0


class Learner:
    """Sequential covering of the bad rows of (x, bad)."""

    def __init__(self, names: list[str], cuts: int = 64, max_tests: int = 4, max_rules: int = 24, precision: float = 0.85, least: int = 5) -> None:
        self.names, self.cuts, self.max_tests, self.max_rules, self.precision, self.least = names, cuts, max_tests, max_rules, precision, least

    def _covers(self, x: np.ndarray, tests: list) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, upper, t in tests:
            out &= x[:, k] <= t if upper else x[:, k] >= t
        return out

    def _grow(self, x: np.ndarray, bad: np.ndarray) -> list:
        tests, inside = [], np.ones(len(x), bool)
        while len(tests) < self.max_tests:
            p, n = int((bad & inside).sum()), int((~bad & inside).sum())
            if not p or not n:
                break
            before, best = np.log2(p / (p + n)), (1e-9, None)
            for k in range(x.shape[1]):
                values = x[inside, k]
                for t in np.unique(np.quantile(values, np.linspace(0, 1, self.cuts), method="nearest")):
                    for upper in (False, True):
                        hit = values <= t if upper else values >= t
                        q = int((hit & bad[inside]).sum())
                        if q >= self.least and (gain := q * (np.log2(q / int(hit.sum())) - before)) > best[0]:
                            best = (gain, (k, upper, float(t)))
            if best[1] is None:
                break
            tests.append(best[1])
            inside = self._covers(x, tests)
        return tests

    def learn(self, x: np.ndarray, bad: np.ndarray) -> DecisionList:
        left, rules = np.ones(len(x), bool), []
        prune = np.arange(len(x)) % 3 == 2
        while len(rules) < self.max_rules and (bad & left).sum() >= self.least:
            tests = self._grow(x[left & ~prune], bad[left & ~prune])
            if not tests:
                break
            held_x, held_bad = x[left & prune], bad[left & prune]

            def worth(n: int, tests=tests, held_x=held_x, held_bad=held_bad) -> float:
                hit = self._covers(held_x, tests[:n])
                p, q = int((hit & held_bad).sum()), int((hit & ~held_bad).sum())
                return (p - 4 * q) / max(1, p + q), n == len(tests)

            tests = tests[: max(range(1, len(tests) + 1), key=worth)]
            hit = self._covers(x, tests) & left
            n, right = int(hit.sum()), int((hit & bad).sum()) / max(1, int(hit.sum()))
            if surely(right, n) < self.precision:
                break
            rules.append(Rule(tuple((self.names[k], u, t) for k, u, t in tests), n, round(right, 4)))
            left &= ~hit
        return DecisionList(rules)


def hashed_sample(labels: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows at most, drawn by a hash of doc_id, so that every run draws the same."""
    n = labels.count()
    return labels if n <= bound else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """The decision list of documents that ``labels`` (doc_id, quality) calls bad (0) and the base rules let pass; without both kinds it is empty."""
    known = hashed_sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)"), max_labelled)
    # at most about max_labelled rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    of = shares()
    seen = with_statistics(rows).filter(~base_failed()).select("doc_id", "quality", *(c.alias(n) for n, c in of.items())).toPandas().sort_values(["doc_id", "quality", *of], kind="stable")
    bad = seen["quality"].to_numpy() == 0
    return Learner(list(of)).learn(seen[list(of)].to_numpy(np.float64), bad) if bad.any() and not bad.all() else DecisionList()


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, and the rule that rejects; one row per row of ``docs``.

    Null and empty texts have no words and fail the base rules. Labels that are null or for no
    document are left out; repeated labels count each; other columns don't matter.
    """
    rules = learn_rules(docs, labels, max_labelled)
    seen = with_statistics(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
    out = seen.withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list reject, with their columns."""
    rules = learn_rules(docs, labels, max_labelled)
    prefix = fresh_prefix(docs, "_stat_")
    return with_statistics(docs, prefix=prefix).filter(~base_failed(prefix) & rules.verdict(prefix).isNull()).select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
