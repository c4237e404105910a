import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crivo.llm import mixing


def shared_out(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by handing the excess on until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        out = {s: cap * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if out[s] > cap * sizes[s]}
        if not above:
            return out
        capped |= above


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i * 37 % 91 + 1), [None, "b", "a", "é", "a"][i % 5]) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_targets_rates_and_copies(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_DOCS", 50)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 600
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r["size"] == r["doc_id"] * 37 % 91 + 1 and 0 <= r["taken"] <= 2 * r["size"]
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    want = shared_out(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.01 * want[s]
        met = sum(r["rate"] * r["size"] for r in rows if r["source"] == s)
        assert met == pytest.approx(want[s], rel=1e-6)
    assert sorted(map(tuple, mixing.mix_report(docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_rates_are_exponentially_tilted(docs):
    import math

    rows = [r for r in mixing.mix_report(docs).collect() if r["source"] == "a" and 0 < r["rate"] < 2]
    tilt = {round(math.log(r["rate"] / (2 - r["rate"])) / r["size"], 9) for r in rows}
    assert len(rows) > 5 and max(tilt) - min(tilt) < 1e-6


def test_awkward_rows_and_copies_of_rows(awkward, nothing):
    rows = mixing.mix_report(awkward).collect()
    assert len(rows) == 11
    assert all(r["taken"] == 0 for r in rows if not r["size"])
    assert len({r["copies"] for r in rows if r["doc_id"] == 7}) == 1
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_equal_shares_when_all_sources_stop(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a", "y")], "doc_id long, text string, source string")
    rows = {r["source"]: r for r in mixing.mix_report(docs).collect()}
    want = shared_out({"x": 3, "y": 1})
    assert {s: r["target"] for s, r in rows.items()} == pytest.approx(want)


def rounded(sizes, target, cap=2):
    """The words that rounding takes, with rates that are all alike."""
    counted = {s: sizes.count(s) for s in sizes}
    cells = pd.DataFrame({"sid": 1, "size": list(counted), "n": list(counted.values()), "rate": target / sum(sizes)})
    out = mixing.round_rates(cells, cap)
    assert ((out["base"] >= 0) & (out["extra"] < out["docs"]) & (out["base"] * out["docs"] + out["extra"] <= cap * out["docs"])).all()
    return int((out["size"] * (out["base"] * out["docs"] + out["extra"])).sum())


@pytest.mark.parametrize("docs", [1, 2, 3, 5])
def test_few_documents_get_the_nearest_sum_of_all(docs):
    draw = random.Random(docs)
    for _ in range(60):
        sizes = draw.sample(range(1, 3000), docs)
        target = draw.uniform(0, 2 * sum(sizes))
        best = min(abs(target - sum(c * s for c, s in zip(copies, sizes, strict=True))) for copies in itertools.product(range(3), repeat=docs))
        assert abs(target - rounded(sizes, target)) == pytest.approx(best, abs=1e-5)


def test_what_a_large_document_leaves_over_goes_to_others():
    sizes = [2065, 453, 372, 261, 243, 189, 150, 142, 141, 46]
    assert abs(rounded(sizes, 2865) - 2865) <= 3
    assert rounded([10**6, *range(1, 50)], 2000) == 2000


def test_documents_table_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix_report(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("above"), F.count("*").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()
    assert sum(r["n"] for r in rows) == docs.count()
    for r in rows:
        assert r["above"] <= 0 and abs(r["taken"] - r["target"]) <= max(r["least"], mixing.NEAR * r["target"]), r
