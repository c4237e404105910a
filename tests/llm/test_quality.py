import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crivo.llm import quality_crf as crf
from crivo.llm import quality_rules as qr

from .conftest import AWKWARD


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", [t for _, t, *_ in AWKWARD] + ["a b c a b c d", "a b a b a b", "x\nx\n x\nx", "é # é é", "a\x0bb\x0cc\rd"])
def test_statistics(text):
    assert qr.text_statistics(text)[:5] == plain_statistics(text)


def test_learner_finds_a_planted_rule_and_spark_applies_it(spark):
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    bad = (x[:, 1] > 0.8) & (x[:, 2] < 0.5)
    names = ["words", "mean_word_chars", "symbols_per_word"]
    rules = qr.Learner(names).learn(x, bad).rules
    hit = np.zeros(2000, bool)
    for r in rules:
        one = np.ones(2000, bool)
        for n, upper, t in r.tests:
            v = x[:, names.index(n)]
            one &= v <= t if upper else v >= t
        hit |= one
    assert rules and (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.05 * bad.sum()


def test_few_rows_prove_nothing():
    assert qr.surely(1.0, 3) < 0.85 < qr.surely(1.0, 100) and qr.surely(0.5, 0) == 0
    assert qr.Learner(["words"]).learn(np.arange(10.0)[:, None], np.arange(10) > 6).rules == []


def test_judge_on_awkward_rows(awkward, nothing, labels):
    rows = qr.judge(awkward, labels).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = qr.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(r["kept"] for r in rows)
    assert qr.judge(nothing, labels).count() == 0 and qr.judge(awkward, labels.limit(0)).count() == len(AWKWARD)


def test_op3_keeps_good_and_drops_bad(spark, sf):
    from crivo.llm.registry import QUERIES

    sf = sf.replace("0.001", "0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[1:6]) == plain_statistics(docs[r["doc_id"]])
    told = [(r["kept"], quality[r["doc_id"]]) for r in rows if r["doc_id"] in quality and not r["base_failed"]]
    good = [k for k, q in told if q]
    bad = [k for k, q in told if not q]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    field = crf.LineField(np.zeros((1, 1)), np.zeros((1, 1)), 0.0, rng.normal(size=(2, 2)))
    count, e, at = np.array([1, 5, 2, 8]), rng.normal(size=16) * 2, 0
    good, pair = field.marginals(e, count)
    for c in count:
        total, one, two = 0.0, np.zeros(c), np.zeros((c, 2, 2))
        for path in itertools.product((0, 1), repeat=int(c)):
            p = np.exp(sum(e[at + i] * y for i, y in enumerate(path)) + sum(field.couple[a, b] for a, b in zip(path, path[1:])))
            total += p
            one += p * np.array(path)
            for i in range(1, c):
                two[i, path[i - 1], path[i]] += p
        assert np.allclose(one / total, good[at : at + c]) and np.allclose(two[1:] / total, pair[at + 1 : at + c])
        at += c


def test_long_chains_stay_finite():
    field = crf.LineField(np.zeros((1, 1)), np.zeros((1, 1)), 0.0, np.array([[3.0, -3.0], [-3.0, 3.0]]))
    good, _ = field.marginals(np.full(50_000, -0.5), np.array([50_000]))
    assert np.isfinite(good).all() and good.max() < 0.5


def test_score_on_awkward_rows(awkward, nothing, labels):
    from pyspark.sql import functions as F

    field = crf.train(awkward, labels, F.lit(True))
    rows = crf.score(awkward, field).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score_"] <= 1 and r["score"] == "x" for r in rows)
    assert crf.train(awkward, labels.limit(0), F.lit(True)) is None
    assert {r["score_"] for r in crf.score(awkward, None).collect()} == {0.5} and crf.score(nothing, field).count() == 0


def test_op8_on_held_out_labels(spark, sf):
    from crivo.llm.registry import QUERIES

    sf = sf.replace("0.001", "0.01")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_crf"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
