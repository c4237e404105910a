import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crivo.llm import bpe, token_counts
from crivo.llm.bpe import ByteBPE, default_vocabulary

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return ByteBPE(default_vocabulary())


def ids_of(own, texts):
    ids, n = own.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_like_the_library_on_random_texts(library, own):
    rng = random.Random(3)
    letters = " \n\t'sabETé1²!\xa0　 \x1c\x85字ab  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    assert ids_of(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_like_the_library_on_any_text(library, own, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = ids_of(own, texts)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat = np.concatenate([np.array(x, np.int64) for x in got])
    assert own.decode(flat, np.array(list(map(len, got)))) == [library.decode(x, skip_special_tokens=False) for x in got]


def test_broken_bytes_and_unknown_ids_decode(own):
    half = own.encode(["字"])[0][:1].astype(np.int64)
    assert own.decode(np.concatenate([half, [10**6]]), np.array([1, 1])) == ["�", ""]


def test_merges_repeated_pairs_from_the_left(library, own):
    texts = ["a" * n for n in range(1, 40)] + ["ab" * 9 + "a", "hahahahaha", "!!!!!!!", "0" * 31]
    assert ids_of(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_operator_on_awkward_rows(awkward, nothing, library):
    out = bpe.decode(bpe.encode(awkward, default_vocabulary()), default_vocabulary(), "ids_", "again").collect()
    assert len(out) == len(AWKWARD)
    for row in out:
        assert row["ids_"] == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["again"] == (row["text"] or "") and row["ids"] == "x"
    assert bpe.round_trip(nothing, default_vocabulary()).count() == 0


def test_op2_against_the_library(spark, sf, library):
    from crivo.llm.registry import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op2_bpe_round_trip"](spark, sf).collect()
    assert len(out) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("block_bytes", [1, 100, 10**9])
def test_counts_on_awkward_rows(awkward, library, block_bytes, monkeypatch):
    made = token_counts.blocks(awkward, default_vocabulary(), block_bytes)
    monkeypatch.setattr(token_counts, "blocks", lambda *_: made)
    out = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(awkward, default_vocabulary()).collect())
    want = []
    for i, t, *_ in AWKWARD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or 0, len((t or "").encode()), n, n > 512))
    assert out == sorted(want)


def test_counts_of_nothing(nothing):
    assert token_counts.count_tokens(nothing, default_vocabulary()).count() == 0


def test_packing_is_exact():
    x = np.array([0, 1, -5, 2**31 - 1, -(2**31)], np.int64)
    assert token_counts.unpacked(token_counts.packed(x)).tolist() == x.tolist()
