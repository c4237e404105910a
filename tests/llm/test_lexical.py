import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crivo.llm import lexical as lx

from .conftest import AWKWARD


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(docs, items, k):
    counts = [Counter(plain_terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = set()
    for item_id, text in items:
        found = []
        for (doc_id, _), c in zip(docs, counts):
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1_000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort()
        out |= {(item_id, rank + 1, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("text", [t for _, t, *_ in AWKWARD] + ["A1b-C d\x00e\x7f", "naïve İstanbul 漢字, x_y", "a\x85b", "[]{}`~@"])
def test_terms(text):
    assert [t.decode() for t in lx.terms(text)] == plain_terms(text)


def made(n, seed):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(rng.randrange(n // 2), " ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 30, 300))))) for _ in range(n)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 20))))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("bucket", [lx.BUCKET_ROWS, 16])
def test_search_against_all_scores(spark, monkeypatch, bucket):
    docs, items = made(600, 1)
    # the tasks' workers read the bucket's size from the module; local functions carry it
    monkeypatch.setattr(lx, "BUCKET_ROWS", bucket)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in lx.search(d, b, 7).collect()} == plain_search(docs, items, 7)
    assert {tuple(r) for r in lx.search(d, b, 7, block=4).collect()} == plain_search(docs, items, 7)


def test_bounds_leave_out_no_vector_and_spare_some():
    rng = np.random.default_rng(3)
    n, places = 3_000, 60
    size = rng.integers(1, 12, n)
    offsets = np.concatenate([[0], np.cumsum(size)])
    term = np.concatenate([rng.choice(places, s, replace=False) for s in size])
    v = (rng.pareto(0.8, len(term)) * 1000).astype(np.int64) + 1
    norm = np.sqrt(np.add.reduceat(v.astype(float) ** 2, offsets[:-1]))
    queries = [rng.choice(places, s, replace=False) for s in (1, 5, 20)]
    order = np.argsort(-norm)
    best, scored = lx.Best(np.zeros(3, np.int64), 10), 0
    for a in range(0, n, 200):
        pick = order[a : a + 200]
        flat, length = lx.ragged(np.arange(len(term)), offsets, pick)
        scored += lx.search_bucket(term[flat], v[flat], np.concatenate([[0], np.cumsum(length)]), norm[pick], pick, np.zeros(200, bool), pick, queries, places, best)
    for q, places_ in enumerate(queries):
        score = np.add.reduceat(np.where(np.isin(term, places_), v, 0), offsets[:-1])
        want = sorted(zip((-score).tolist(), range(n)))[:10]
        assert [(-s, d) for s, d in zip(best.rows[q][0].tolist(), best.rows[q][1].tolist())] == want
    assert scored < 0.5 * n * len(queries)


def test_awkward_rows(spark, awkward, nothing):
    docs = [(k, t) for k, t, *_ in AWKWARD]
    items = [(1, "the CAT word"), (2, None), (3, ""), (4, "nowhere"), (None, "mat"), (5, "12345 漢字かな"), (5, "12345 漢字かな")]
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, score string")
    # repeated rows take a place each
    got = sorted((tuple(r) for r in lx.search(awkward, b).collect()), key=str)
    assert set(got) == plain_search(docs, list(dict.fromkeys(items)), 50)
    assert lx.search(nothing, b).count() == 0 and lx.search(awkward, b.limit(0)).count() == 0
    assert lx.search(awkward.filter("text is null"), b).count() == 0
    assert lx.search(awkward, b).columns == ["item_id", "rank", "doc_id", "score"]


def test_op13_against_all_scores(spark, sf):
    from crivo.llm.registry import QUERIES

    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert {tuple(r) for r in QUERIES["op13_norm_bucket_search"](spark, sf).collect()} == plain_search(docs, items, 50)
