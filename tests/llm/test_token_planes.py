import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crivo.llm import token_planes as tp
from crivo.llm.common import shared_dir

from .conftest import AWKWARD


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_planes_round_trip(ids, bits):
    x = np.array(ids, np.uint32)
    assert tp.from_planes(tp.to_planes(x, bits), len(x), bits).tolist() == ids


def test_encoder_is_the_library():
    t, own = Tokenizer.from_file(tp.default_vocabulary()), tp.WordEncoder(tp.default_vocabulary())
    texts = [x for _, x, *_ in AWKWARD] + ["x<|endoftext|>Y z", "Ünïcode İΣ ΑΣ é ẛ̣", "it's 'S 12's a\x1cb", "１２ ﬁ"]
    ids, n = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_every_character_below_0x300_and_some_words(monkeypatch):
    t, own = Tokenizer.from_file(tp.default_vocabulary()), tp.WordEncoder(tp.default_vocabulary())
    texts = [f"a{chr(c)}B {chr(c)} {chr(c)}{chr(c)}'s it'{chr(c)}ve 1{chr(c)}" for c in range(0x300)] + ["</w> a</w>b </W>", "漢字 end</w> かな。x", "€ 5€"]
    for words in (1, 1000):
        monkeypatch.setattr(tp, "CUT_WORDS", words)
        ids, n = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        own.word, own.part = tp._Cache(), tp._Cache()


class Counted:
    """A tokenizer that keeps which words it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **how):
        self.asked += [w for x in texts for w in x.split()]
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_a_full_cache_keeps_the_words_used_most(monkeypatch):
    monkeypatch.setattr(tp, "CACHE_BYTES", 20_000)
    t, own = Tokenizer.from_file(tp.default_vocabulary()), tp.WordEncoder(tp.default_vocabulary())
    own.tokenizer = asked = Counted(own.tokenizer)
    rare = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) + "q" for i in range(5_000)]
    for a in range(0, len(rare), 50):
        text = "the cat. " * 20 + " ".join(rare[a : a + 50])
        assert own.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    assert [asked.asked.count(w) for w in ("the", "cat", rare[0], rare[-1])] == [1, 1, 1, 1]


def expected(rows, end=1):
    t, at, out = Tokenizer.from_file(tp.default_vocabulary()), 0, []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_shards_and_blocks_of_any_size(spark, awkward, monkeypatch):
    monkeypatch.setattr(tp, "BLOCK_IDS", 7)
    for bits in (True, False):
        folder = shared_dir(spark, "t")
        shards = tp.write_tokens(awkward, tp.default_vocabulary(), folder, bits=bits)
        rows = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in tp.read_tokens(shards, folder).collect()]
        order = sorted(((i, x) for i, x, *_ in AWKWARD), key=lambda r: (r[0] is None, r[0] or 0))
        assert sorted(rows, key=lambda r: r[1]) == expected(order)


def test_nothing_has_no_shards(spark, nothing):
    folder = shared_dir(spark, "t")
    shards = tp.write_tokens(nothing, tp.default_vocabulary(), folder)
    assert shards.count() == 0 and tp.read_tokens(shards, folder).count() == 0


def test_one_block_can_be_read_alone(spark, awkward):
    folder = shared_dir(spark, "t")
    shard = tp.write_tokens(awkward, tp.default_vocabulary(), folder).orderBy("shard").first()["shard"]
    files, top = tp.filesystem(folder)
    with files.open_input_file(f"{top}/{shard}") as f:
        head, index = tp.read_index(f, f.size())
        every = list(tp.read_blocks(f, head, index))
        assert next(tp.read_blocks(f, head, index, len(every) - 1)).tolist() == every[-1].tolist()
        assert sum(map(len, every)) == head["n_ids"]


def test_op4_on_documents(spark, sf):
    from crivo.llm.registry import QUERIES

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op4_token_planes"](spark, sf).collect())) == expected(docs)
