import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crivo.llm import spelling as sp

from .conftest import AWKWARD


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def plain_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return n


def made_words(n, seed):
    """Words of few letters with edits at every place, repeated letters and letters beyond ASCII among them."""
    rng, out = random.Random(seed), set()
    while len(out) < n:
        w = [rng.choice("abcéÿ") for _ in range(rng.choice((7, 8, 9, 12, 20)))] if rng.random() < 0.8 else ["a"] * rng.randint(7, 12)
        for _ in range(12):
            out.add("".join(w))
            k, kind = rng.randrange(len(w) + 1), rng.random()
            if kind < 0.4:
                w.insert(k, rng.choice("abcéÿ"))
            elif len(w) > 7 and kind < 0.7:
                w.pop(min(k, len(w) - 1))
            else:
                w[min(k, len(w) - 1)] = rng.choice("abcéÿ")
    return sorted(out)


def test_pivots_are_the_best_disjoint_pair():
    rng = np.random.default_rng(5)
    rank = rng.integers(0, 9, (300, 11))
    cost = rank * 7 + 1
    last = np.partition(rank, 2, axis=1)[:, 2]
    inside = rank <= last[:, None]
    a, b = sp.pivots(rank, inside, cost)
    for k in range(300):
        at = np.flatnonzero(inside[k])
        best = min(cost[k][i] + cost[k][j] for i in at for j in at if j - i >= 2)
        assert inside[k][a[k]] and inside[k][b[k]] and b[k] - a[k] >= 2 and cost[k][a[k]] + cost[k][b[k]] == best


def test_keys_do_not_depend_on_the_block():
    words = made_words(50, 6)
    order = np.array(sorted({ord(a) << 21 | ord(b) for w in words for a, b in zip(w, w[1:])}))
    frequency = np.ones(len(order), np.int64)
    of = lambda ws: {(ws[i], k, p) for at, key, by, _ in sp.keyed(ws, order, frequency) for i, k, p in zip(at.tolist(), key.tolist(), by.tolist())}
    assert of(words) == set().union(*(of([w]) for w in words))


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, seed):
    words = made_words(500, seed)
    rng = random.Random(seed)
    counts = {w: rng.choice((2, 3, 20, 30, 200, 2000)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in sp.variants(df).collect()} == plain_variants(counts)


def test_ties_and_chains(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdefi": 20, "abcdxfh": 200, "abcyxfh": 2000, "zzzzzzz": 5}
    df = spark.createDataFrame([*counts.items(), ("abcdefg", 1), (None, 7), ("nonumber", None)], "word string, n long")
    got = {r["word"]: r for r in sp.variants(df).collect()}
    assert {tuple(r) for r in got.values()} == plain_variants(counts)
    assert got["abcdefg"]["form"] == "abcdefh" and got["abcdefg"]["root"] == "abcyxfh" and got["zzzzzzz"]["n_near"] == 0


def test_counts_with_slips(spark, awkward, nothing):
    docs = [(k, t) for k, t, *_ in AWKWARD]
    want = {w: n for w, n in plain_counts(docs).items()}
    assert {tuple(r) for r in sp.word_counts(awkward, sp.with_slips).collect()} == set(want.items())
    assert sp.variants(sp.word_counts(awkward, sp.with_slips)).count() == len(want)
    assert sp.variants(sp.word_counts(nothing)).count() == 0
    with pytest.raises(ValueError):
        sp.variants(spark.createDataFrame([("abc", 1)], "word string, n long"))


def test_op12_against_all_pairs(spark, sf):
    from crivo.llm.registry import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = {w: n for w, n in plain_counts(docs).items() if n >= 2}
    # all pairs by the words that become equal without a code point, as there are many
    parts = {}
    for w in counts:
        for k in range(len(w)):
            parts.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    some = random.Random(7).sample(sorted(counts), 60)
    got = {r["word"]: r for r in QUERIES["op12_pivotal_variants"](spark, sf).collect()}
    assert {w: r["n"] for w, r in got.items()} == counts
    for w in some:
        near = {v for k in range(len(w)) for v in parts[w[:k] + w[k + 1 :]]} | parts.get(w, set()) | {w[:k] + w[k + 1 :] for k in range(len(w))} & set(counts)
        assert got[w]["n_near"] == sum(one_edit(w, v) for v in near)
