import random
import re

import numpy as np
import pytest

from crivo.llm import setsketch as ss

from .conftest import AWKWARD


def plain_set(text, shingle):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < shingle:
        return {" ".join(words)} if words else set()
    return {" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)}


def plain_components(sets, percent=80):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            k = len(a & b)
            if k and 100 * k >= percent * (len(a) + len(b) - k):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("shingle", [1, 2, 5])
def test_sets(shingle):
    texts = [t for _, t, *_ in AWKWARD] + ["A B", "a b", "a", "b a b a b", "a b c d", "x\x0by z", "É é"]
    got = ss.shingle_sets(texts, shingle)
    want = [plain_set(t, shingle) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]), (texts[i], texts[j])


def test_registers():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (20_000, 300))
    union = ss.sketch(np.concatenate([a, b]))
    assert (union == ss.merged(ss.sketch(a), ss.sketch(b))).all()
    assert (ss.sketch(a) == ss.sketch(a[::-1])).all()
    # a register's level is that of the least of n exponential values
    for n in (1, 10, 1_000, 100_000):
        level = ss.sketch(rng.integers(0, 1 << 64, n, dtype=np.uint64)).astype(float)
        assert abs(level.mean() - 1 / 2 - np.log(ss.RATE * n * np.exp(0.5772)) / np.log(ss.BASE)) < 3


def test_estimate_keeps_what_is_alike():
    rng = np.random.default_rng(2)
    kept = {}
    for share in (0.3, 0.6, 0.8, 0.9):
        left, right, n = [], [], []
        for _ in range(300):
            size = int(rng.choice([10, 40, 400]))
            both = max(1, round(size * share))
            a = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            b = np.concatenate([a[:both], rng.integers(0, 1 << 64, (size - both) // 2, dtype=np.uint64)])
            a = a[: both + (size - both) - (size - both) // 2]
            left.append(ss.sketch(a)), right.append(ss.sketch(b)), n.append((len(a), len(b), both / (len(a) + len(b) - both)))
        fit = ss.may_be_alike(np.array(left), np.array(right), *(np.array([x[k] for x in n]) for k in (0, 1)))
        alike = np.array([x[2] >= 0.8 for x in n])
        assert fit[alike].all()
        kept[share] = fit[~alike].mean() if (~alike).any() else 0
    assert kept[0.3] < 0.01


def test_bands_hold_the_registers(spark):
    a = ss.sketch(np.arange(50, dtype=np.uint64) << np.uint64(32))
    b = a.copy()
    b[:: ss.BAND] ^= 1
    b[0] = a[0]
    df = spark.createDataFrame([(1, bytearray(a)), (2, bytearray(b))], "node long, registers binary")
    keys = {1: set(), 2: set()}
    for r in ss.banded(df).collect():
        keys[r["node"]].add(r["key"])
    assert len(keys[1]) == ss.BANDS and len(keys[1] & keys[2]) == 1


def drifting(n, seed):
    """Texts that change a word at a time around a few templates, with similarities on both sides of the threshold."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 12, 40, 120)))]
        for _ in range(rng.choice((1, 4, 30))):
            out.append(" ".join(words))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
    return out[:n]


@pytest.mark.parametrize("limit", [ss.GROUP_ROWS, 5])
def test_components_against_all_pairs(spark, limit):
    texts = drifting(400, 3)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ss.near_duplicates(docs, 2, limit=limit).collect()}
    assert [got[k] for k in range(len(texts))] == plain_components([plain_set(t, 2) for t in texts])


def test_large_group_gives_few_links(spark):
    """Near copies of one text: every member is verified against a few others, not against all."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:k] + [f"x{rng.randrange(10**6)}"] + base[k + 1 :]) for k in (rng.randrange(200) for _ in range(300))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    marked = ss.stored(ss.sketched(docs.selectExpr("doc_id as row", "doc_id", "text"), "text", 2), "sketched")
    sets = marked.selectExpr("row as node", "n_shingles", "registers")
    assert ss.star_pairs(sets, 80, bands=ss.FIRST_BANDS).count() <= 300 * ss.FIRST_BANDS
    one = sets.selectExpr("node", "0L as root")
    assert ss.star_pairs(sets, 80, one).count() == 0
    assert ss.links_between(sets, one, marked.selectExpr("row as node", "text"), 2, 80, 50).count() == 0
    assert {r["component_id"] for r in ss.grouped(marked, 2, 80).collect()} == {0}


def test_links_that_join():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(60, 40, replace=False)) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    root = np.arange(40) // 2
    pairs = [(np.array([i]), np.array([j])) for i in range(40) for j in range(i) if root[i] != root[j]]
    alike = {(i, j) for i in range(40) for j in range(i) if root[i] != root[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    found = list(ss.joining_links(iter(pairs), root, np.concatenate(sets), offsets, 50))
    assert set(found) <= alike

    def joined(links):
        at = root.copy()
        for i, j in links:
            at[at == max(at[i], at[j])] = min(at[i], at[j])
        return at.tolist()

    assert joined(found) == joined(alike) and len(found) == len(set(root.tolist())) - len(set(joined(alike)))


def test_awkward_rows(awkward, nothing):
    rows = ss.near_duplicates(awkward, 2).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)]
    assert by[5] == [(1, 5, True)] and by[7][0] == by[7][1] and by[None][0][1:] == (None, True)
    assert ss.near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        ss.near_duplicates(nothing, percent=70)


def test_null_ids_of_a_group(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (9, "A B c D"), (4, "a b  c\td"), (None, "q r s t"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in ss.near_duplicates(docs, 2).collect()), key=str)
    assert got == sorted([(None, 4, False), (9, 4, False), (4, 4, True), (None, None, True), (None, None, True)], key=str)


def test_op11_against_all_pairs(spark, sf):
    from crivo.llm.registry import QUERIES

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    sets = [plain_set(t, 2) for _, t in docs]
    want = {(i, len(s), docs[c][0], docs[c][0] == i) for (i, _), s, c in zip(docs, sets, plain_components(sets))}
    assert {tuple(r) for r in QUERIES["op11_setsketch_components"](spark, sf).collect()} == want
