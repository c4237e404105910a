from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crivo.llm import language_id, mixing, quality_rules, simhash
from crivo.llm.bpe import default_vocabulary
from crivo.llm.common import stored, table

from .test_quality import plain_statistics
from .test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, sf), "t")
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(steps, spark, sf):
    assert all(made.columns == table(spark, sf, "documents").columns for _, made in steps[:-1])


def test_quality_stage(steps, spark, sf):
    before, after = map(rows, steps[0])
    rejected = quality_rules.judge(steps[0][0], table(spark, sf, "labels")).filter("not kept").count()
    assert len(after) == len(before) - rejected
    for i in after:
        n, _, _, _, repeated = plain_statistics(before[i]["text"])
        assert n >= 50 and 100 * repeated <= 50 * n


def test_language_stage_keeps_what_it_knows(steps):
    before, after = map(rows, steps[1])
    found = language_id.identify(steps[1][0], language_id.train(steps[1][0], language_id.learnable())).collect()
    assert set(after) == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert len(after) >= 0.98 * len(before)


def test_one_of_each_group_stays(steps):
    before, after = map(rows, steps[2])
    ids = sorted(before)
    roots = plain_components([plain_fingerprint(before[i]["text"]) for i in ids])
    assert set(after) == {ids[k] for k in set(roots)}


def test_mixing_stage_repeats_rows(steps):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(steps[3][0]).collect()}
    got = Counter(r["doc_id"] for r in steps[3][1].collect())
    assert got == Counter({i: n for i, n in copies.items() if n})


def test_encoding_stage(steps):
    t = Tokenizer.from_file(default_vocabulary())
    before, after = (list(df.collect()) for df in steps[4])
    assert len(before) == len(after)
    n = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in before}
    assert all(r["n_tokens"] == n[r["doc_id"]] for r in after)


def test_fingerprint_stage_is_the_query(steps):
    assert simhash.near_duplicates(steps[2][0]).filter("doc_id = component_id").count() == steps[2][1].count()


def test_pipeline_on_awkward_rows(spark, sf, tmp_path):
    """Null ids and texts, empty texts, repeated rows and columns that clash with the stages' own: copies differ only as mixing asks."""
    from .conftest import CLASHING

    docs = table(spark, sf, "documents")
    some = docs.limit(120)
    odd = some.limit(3).selectExpr("cast(null as bigint) as doc_id", *(f"`{c}`" for c in docs.columns if c != "doc_id"))
    odd = odd.unionByName(some.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(some.limit(2).withColumn("text", F.lit("")))
    odd = odd.unionByName(some.limit(3).withColumn("source", F.lit(None).cast("string")))
    made = some.unionByName(some.limit(10)).unionByName(odd)
    for c in CLASHING:
        if c.lower() not in [x.lower() for x in made.columns]:
            made = made.withColumn(c, F.lit("x"))
    made.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, sf, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    before = Counter()
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, str(tmp_path)), "t")
        if name != "bpe_round_trip":
            assert after.columns == docs.columns, name
        if name not in ("source_mixing", "bpe_round_trip"):  # those take rows away, and make none
            assert after.exceptAll(docs).isEmpty(), name
        if name == "simhash_near_dedup":
            prints = [plain_fingerprint(r["text"]) for r in docs.collect()]
            assert after.count() == len(set(plain_components(prints)))
        if name == "source_mixing":
            of = Counter((r["doc_id"], r["text"]) for r in docs.collect())
            before = Counter((r["doc_id"], r["text"]) for r in after.collect())
            assert set(before) <= set(of) and all(n <= 2 * of[k] for k, n in before.items())
        docs = after
    assert docs.count() == sum(before.values()) > 0


def test_pipeline_on_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        table(spark, sf, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
