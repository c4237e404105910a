"""Large groups of an anchor, dealt into blocks."""

import numpy as np
from pyspark.sql import functions as F

from crivo.llm import simhash


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_large_anchors_are_dealt_into_blocks(spark):
    rng = np.random.default_rng(7)
    # one half in common, and the other within few bits of three centres; and halves the other way round
    centre = rng.integers(0, 2**31, 3, dtype=np.uint64)
    low = np.array([centre[k % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, k % 6 + 1, dtype=np.uint64)) for k in range(500)], np.uint64)
    fp = np.unique(np.concatenate([low | np.uint64(0xABCDEF01) << np.uint64(32), low[:200] << np.uint64(32) | np.uint64(77), rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    near = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    own = fp.view(np.int64).tolist()
    want = groups([(own[i], own[j]) for i, j in near], own)
    prints = spark.createDataFrame([(v,) for v in own], "fp long")
    whole = simhash.replicated(prints).groupBy("anchor").count()
    largest = whole.agg(F.max("count")).first()[0]
    for limit in (40, 10_000):
        links = [tuple(r) for r in simhash.links(prints, limit=limit).collect()]
        assert all(a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
        assert groups(links, own) == want
    # every anchor above twice the limit is known, with its blocks, and its groups are small
    large = {r["anchor"]: r["blocks"] for r in simhash.crowded(prints, 40).collect()}
    assert {r["anchor"] for r in whole.collect() if r["count"] > 80} <= set(large) <= {r["anchor"] for r in whole.collect() if r["count"] > 40}
    assert largest > 400 and simhash.dealt(prints, 40).groupBy("anchor").count().agg(F.max("count")).first()[0] <= 4 * 40


def test_crowded_anchors_without_a_broadcast(spark, monkeypatch):
    """More crowded anchors than may be broadcast are joined by a shuffle, with the same links."""
    from pyspark.sql import functions as F

    from crivo.llm import simhash

    df = spark.range(3_000).select((F.col("id") * 37 % 4096).alias("fp")).distinct()
    least = lambda: {(r["node"], r["root"]) for r in simhash.components(simhash.links(df, limit=50)).collect()}
    broadcast = least()
    monkeypatch.setattr(simhash, "CROWDED_ROWS", 0)
    assert broadcast and least() == broadcast
