import random
import re

import numpy as np
import pytest
import xxhash

from crivo.llm import simhash as sh

from .conftest import AWKWARD


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("text", [t for _, t, *_ in AWKWARD] + ["A B", "a b c", "É Éa AÉ x", "one two\x0bthree four"])
def test_fingerprints(text):
    assert int(sh.fingerprints([text])[0]) == plain_fingerprint(text)


def test_anchors_cover():
    words = np.random.default_rng(2).integers(0, 1 << 31, 500, dtype=np.uint32)
    row, anchor, own = sh.anchors(words)
    assert (sh.syndrome(anchor) == 0).all() and (np.bitwise_count(anchor ^ words[row]) <= 2).all()
    assert np.bincount(row[own], minlength=500).tolist() == [1] * 500
    # whoever is within one bit comes to the own anchor
    near = words ^ (np.uint32(1) << np.arange(500, dtype=np.uint32) % np.uint32(31))
    mine = dict(zip(row[own].tolist(), anchor[own].tolist()))
    r2, a2, _ = sh.anchors(near)
    come = set(zip(r2.tolist(), a2.tolist()))
    assert all((k, mine[k]) in come for k in range(500))


def plain_components(fp):
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def clustered(n, seed):
    """Fingerprints in chains and clouds, with distances around the threshold."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 30))):
            out.append(x)
            base = rng.choice(out[-5:])
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
    return out[:n]


def test_components_against_all_pairs(spark):
    fp = clustered(500, 5)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fp]
    docs = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in sh.grouped(docs).collect()}
    assert [got[x] - 1000 for x in signed] == plain_components(fp)


def test_long_chain(spark):
    fp = [0]
    for k in range(40):
        fp.append(fp[-1] ^ (1 << k))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(fp)], "doc_id long, fp long")
    assert {r["component_id"] for r in sh.grouped(docs).collect()} == {0}


def test_groups_larger_than_a_block(monkeypatch):
    monkeypatch.setattr(sh, "BLOCK_ROWS", 7)
    fp = np.unique(np.array([(1 << k) | (1 << j) for k in range(20) for j in range(20)], np.uint64))
    own = np.arange(len(fp)) % 3 == 0
    i, j = sh.spanning_links(fp, own)
    assert len(i) < len(fp)
    parent = list(range(len(fp)))
    for a, b in zip(i.tolist(), j.tolist()):
        assert (int(fp[a]) ^ int(fp[b])).bit_count() <= 3
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        assert x != y
        parent[max(x, y)] = min(x, y)


def test_awkward_rows(awkward, nothing):
    rows = sh.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in by.values())
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2}
    one = sh.one_of_each(awkward)
    assert one.columns == awkward.columns and {r["doc_id"] for r in one.collect()} >= {None, 1, 2}
    assert sh.near_duplicates(nothing).count() == 0 and sh.one_of_each(nothing).count() == 0


def test_op10_against_all_pairs(spark, sf):
    from crivo.llm.registry import QUERIES

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fp = [plain_fingerprint(t) for _, t in docs]
    want = {(i, f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fp, plain_components(fp))}
    assert {tuple(r) for r in QUERIES["op10_simhash_components"](spark, sf).collect()} == want
