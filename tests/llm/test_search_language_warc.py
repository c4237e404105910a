import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crivo.llm import language_id as lid
from crivo.llm import mtree, warc
from crivo.llm.common import shared_dir

from .conftest import AWKWARD


def plain_top(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def floored(rows):
    return [(i, [math.floor(64 * x) for x in v]) for i, v in rows]


@pytest.mark.parametrize("shard_rows,block", [(10**6, 1000), (150, 7)])
def test_top_k_against_brute_force(spark, shard_rows, block):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(500)]
    rows += [(i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(500, 800)]  # one vector very often
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mtree.top_k(mtree.integer_vectors(df), "vec_id % 20 = 0", 20, shard_rows, block).collect()
    seen = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == plain_top(floored(seen), 20)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (None, [9.0, 9.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    assert sorted(map(tuple, mtree.top_k(mtree.integer_vectors(df), "vec_id % 20 = 0").collect())) == [(0, 1, 6, 4096), (0, 2, 5, 2048)]
    assert mtree.top_k(mtree.integer_vectors(df.limit(0)), "vec_id % 20 = 0").count() == 0


def test_bounds_avoid_computations():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 5)) * 200
    x = np.floor(centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 5)))
    longest = (x**2).sum(1).max()
    shard = mtree.Shard(mtree.build_pages(0, np.arange(6000), x, longest))
    ids, score = shard.search(np.arange(20), x[:20], 5, longest)
    want = [sorted((-(x[q] @ x[i]), i) for i in range(6000) if i != q)[:5] for q in range(20)]
    assert ids.tolist() == [[i for _, i in w] for w in want]
    assert shard.computed < 20 * 6000 / 2


def clustered_vectors(n, clusters, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * 0.1
    return np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None])


def cells_and_shards(x, pivots, shard_rows):
    longest = (x**2).sum(1).max()
    cells = mtree.Cells(x[mtree.spread(mtree.lifted(x, longest), pivots)], longest)
    cell, d = cells.place(x)
    known, count = np.unique(cell, return_counts=True)
    cells.deal(known, *(np.array([f(d[cell == c]) for c in known]) for f in (np.min, np.max)), count, shard_rows)
    return cells, cells.first_shard[cell], longest


def test_few_shards_and_few_pairs_of_64_dimensions():
    x = clustered_vectors(8000, 40, 64, 5)
    ids = np.arange(8000)
    cells, of, longest = cells_and_shards(x, 80, 600)
    shards = {s: mtree.Shard(mtree.build_pages(s, ids[of == s], x[of == s], longest)) for s in np.unique(of)}
    assert len(shards) > 10 and all(len(np.concatenate(s.ids)) <= 600 for s in shards.values())
    queries = ids[::20]
    found = {}
    first = cells.first(queries, x[queries])
    worst = np.full(len(queries), -np.inf)
    for s, shard in shards.items():
        rows = np.flatnonzero(first == s)
        if len(rows):
            i, score = shard.search(queries[rows], x[queries[rows]], 20, longest)
            worst[rows] = score[:, -1]
            for r, a, b in zip(rows, i, score):
                found.setdefault(r, []).extend(zip(-b, a))
    q, to = cells.admitted(x[queries], worst)
    assert len(q) < 2 * len(queries)  # hardly any query goes on beyond its first shard
    for s, shard in shards.items():
        rows = q[(to == s) & (first[q] != s)]
        if len(rows):
            i, score = shard.search(queries[rows], x[queries[rows]], 20, longest, worst[rows])
            for r, a, b in zip(rows, i, score):
                found.setdefault(r, []).extend(zip(-b, a))
    scores = x[queries] @ x.T
    for r, query in enumerate(queries):
        order = np.lexsort((ids, -scores[r]))
        assert [i for _, i in sorted(found[r])[:20]] == order[order != query][:20].tolist()
    assert sum(s.computed for s in shards.values()) < 0.1 * len(queries) * 8000


def test_vectors_alike_in_all_directions_cost_a_scan_at_most():
    x = np.floor(64 * (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(np.random.default_rng(8).normal(size=(3000, 64))))
    longest = (x**2).sum(1).max()
    shard = mtree.Shard(mtree.build_pages(0, np.arange(3000), x, longest))
    shard.search(np.arange(150), x[:150], 20, longest)
    assert shard.computed < 1.02 * 150 * 3000


def test_copies_of_the_longest_vector(spark):
    # equal vectors are at no distance, whatever the rounding of the coordinate that is added
    rows = [(i, [0.7, 0.1, 3.3]) for i in range(300)] + [(i, [0.3, 0.2, i / 300]) for i in range(300, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (50, 10**6):
        assert sorted(map(tuple, mtree.top_k(mtree.integer_vectors(df), "vec_id % 20 = 0", 20, shard_rows).collect())) == plain_top(floored(rows), 20)


def test_rows_that_repeat_a_vec_id(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, mtree.top_k(mtree.integer_vectors(df), "vec_id % 20 = 0", 20, 10, 2).collect()))
    assert got == plain_top(floored(rows), 20) and sum(i == 7 for _, _, i, _ in got) > 3


def test_op5_against_brute_force(spark, sf):
    from crivo.llm.registry import QUERIES

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op5_mtree_top_k"](spark, sf).collect())) == plain_top(floored(rows), 20)


def test_ngrams():
    seen = set()
    for words in (["ab"], ["ab", "c"]):
        at, of = lid.word_ngrams(words)
        first = sorted(at[of == 0].tolist())
        seen.add(tuple(first))
    # ^a, ab, b$, ^ab, ab$, ^ab$, a, b: a word has the same n-grams wherever it stands
    assert len(seen) == 1 and len(first) == 8
    assert [len(x) for x in lid.word_ngrams([])] == [0, 0]


def test_learned_languages_and_und(spark, awkward, nothing):
    rng = random.Random(2)
    made = {"xx": "ba be bi bo".split(), "yy": "ka ke ki ko".split()}
    rows = [(i, " ".join(rng.choice(made[lang]) for _ in range(20)), lang) for i, lang in enumerate(["xx", "yy"] * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs, lid.learnable())
    out = lid.identify(docs, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) == 300 and all(0 <= r["score"] <= 1 for r in out)
    assert (model.weights == 0).mean() > 0.99
    odd = lid.identify(awkward, model)
    rows = odd.collect()
    assert len(rows) == len(AWKWARD) and odd.columns[: len(awkward.columns)] == awkward.columns
    for r in rows:
        assert (r["lang_pred_"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert lid.identify(nothing, model).count() == 0
    assert {r["lang_pred"] for r in lid.identify(docs, lid.train(nothing, lid.learnable())).collect()} == {"und"}
    assert lid.keep_known(awkward).columns == awkward.columns


def test_languages_of_held_out_rows_are_not_learned(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "abc abd", "zz" if i in held else "aa") for i in range(200)], "doc_id long, text string, lang string")
    assert lid.train(docs, lid.learnable()).languages == ["aa"]


def test_op6_on_held_out_rows(spark, sf):
    from crivo.llm.registry import QUERIES

    sf = sf.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op6_language_id"](spark, sf).collect() if r["held_out"]]
    assert {r["doc_id"] for r in rows} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


PAGES = [(1, None, None), (2, "u", "a" * 250), (3, "u v\r\nX: y", "a" * 250), (None, "x", "a" * 250), (5, "é", "é\r\n\r\nWARC/1.1\r\n" * 3000), (6, "z", "short"), (7, "z", "short"), (8, "w", "é\r\n\r\nWARC/1.1\r\n" * 3000)]


def test_records_and_chunks(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    folder = shared_dir(spark, "warc")
    shards = warc.write_warc(pages, folder)
    assert shards.agg(F.sum("n_records")).first()[0] == len(PAGES)
    rows = warc.read_chunks(shards, folder, 1000).collect()
    html = {i: (h or "").encode() for i, _, h in PAGES}
    refers = {3: 2, 8: 5}
    for i, payload in html.items():
        own = sorted((r for r in rows if r["page_id"] == i), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in own] == list(range(len(own))) and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        assert own[-1]["payload_bytes"] == len(payload) and own[-1]["payload_digest"] == hashlib.sha256(payload).hexdigest()
        assert own[-1]["refers_to"] == refers.get(i) and own[-1]["record_type"] == ("revisit" if i in refers else "response")
        if i not in refers:
            assert b"".join(bytes(r["data"]) for r in own) == payload
            at = 0
            for r in own:  # digests run along
                at += len(r["data"])
                assert len(r["data"]) <= 1000 and r["payload_digest"] == hashlib.sha256(payload[:at]).hexdigest()


def test_shards_are_gzip_members_of_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = shared_dir(spark, "warc")
    names = [r["shard"] for r in warc.write_warc(pages, folder).collect()]
    text = b"".join(gzip.open(f"{folder.removeprefix('file://')}/{n}").read() for n in names)
    assert text.count(b"WARC-Type: revisit") == 2 and b"X: y\r\n" not in text.replace(b"%0D%0AX:%20y", b"")


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_dir(spark, "warc")
    shards = warc.write_warc(pages, folder)
    assert shards.count() == 0 and warc.read_chunks(shards, folder).count() == 0


def test_broken_records_are_told():
    import io

    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(io.BufferedReader(io.BytesIO(b"HTTP/1.1\r\n")), 10))


def test_op7_against_its_sql(spark, sf):
    import duckdb

    from crivo.llm.registry import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    out = QUERIES["op7_warc_chunks"](spark, sf)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(con.execute(ORACLE["op7_warc_chunks"]).fetchall(), key=repr)
