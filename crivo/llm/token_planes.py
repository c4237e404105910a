"""Operator 4: token ids in files of compressed bit planes.

Documents are dealt by ranges of doc_id and sorted within each; every task encodes its range and
writes shard files of bounded size. A shard holds blocks of a fixed number of ids. A block's ids
are transposed into planes (plane b has bit b, or byte b, of every id), as many as its largest id
needs, and each plane is a zstandard frame of its own: high planes are nearly constant and shrink
to almost nothing. Behind the blocks stand the table of documents and the index of chunks, which
says where each block and plane lies, so that any range of ids can be read without the rest.

Layout of a shard (integers little-endian):
  b"CRVPLN01" | planes of block 0 | planes of block 1 | ... | index (zstandard) | uint64 length of the index | b"CRVPLN01"
The index is JSON lines of its scalar fields, then raw arrays: see ``_Writer.close``.

Shards are written under a name of the attempt and renamed, so a repeated or doubled task leaves
the same file once. The list of shards, a row each, is a table in the shared folder; the running
sum over it gives every shard's first id.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import SPACES
from .common import Index, Rows, kept, ragged, shared_dir, slices, stored, table

MAGIC = b"CRVPLN01"
#: Ids in a block, and in a shard at most (a document is never cut, so one more document may follow).
BLOCK_IDS, SHARD_IDS = 65_536, 16_000_000
#: Bytes that a worker's words, and the parts that they share, may take each, about, before half of them go.
CACHE_BYTES = 64_000_000
#: Parts that go to the library as one text.
JOINED = 64
#: Words that are cut into parts at a time; what is no part, nor has ids, stands behind each.
CUT_WORDS, BREAK = 1000, "\n"

_BETWEEN = regex.compile(f"[{SPACES} ]+")

# How the word-level vocabulary marks the last token of a part, and how it cuts its lower-cased text.
END = "</w>"
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")


def filesystem(uri: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


class _Cache:
    """Rows of ids by text, numbered in order of first use, and how often each was used, so that a full cache keeps the half that pays most."""

    def __init__(self) -> None:
        self.index, self.rows, self.uses, self.n_bytes = defaultdict(itertools.count().__next__), Rows(), np.zeros(0, np.int64), 0

    def numbers(self, texts: Iterator[str], n: int) -> tuple[np.ndarray, list[str]]:
        """The row of each of ``n`` texts, and those that have none yet, whose rows ``rows.extend`` must get next."""
        number = np.fromiter(map(self.index.__getitem__, texts), np.int64, n)
        new = [*islice(reversed(self.index), len(self.index) - len(self.uses))][::-1]
        self.n_bytes += sum(map(len, new)) + Index.ENTRY * len(new)
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)]) + np.bincount(number, minlength=len(self.index))
        return number, new

    def get(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged(self.rows.flat, self.rows.offsets, number)

    def trim(self) -> None:
        """Beyond CACHE_BYTES, keeps the texts used most, up to half of that; older uses count half as much each time."""
        if self.n_bytes <= CACHE_BYTES:
            return
        texts = list(self.index)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + Index.ENTRY
        order = np.argsort(-self.uses, kind="stable")
        keep = np.sort(order[np.cumsum(size[order]) <= CACHE_BYTES // 2])
        flat, lengths = self.get(keep)
        self.index = defaultdict(itertools.count(len(keep)).__next__, ((texts[i], k) for k, i in enumerate(keep.tolist())))
        self.rows, self.uses, self.n_bytes = Rows(), self.uses[keep] // 2, int(size[keep].sum())
        self.rows.extend(flat, lengths)


class WordEncoder:
    """The library's ids of whole texts, asked for once per distinct word of the worker's cache.

    The vocabulary's normaliser and pattern never look across white space, so a text has the ids
    of its words, one behind the other. Texts with a special token's string go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a word with other characters than these, or with a special token's string, goes to the library whole
        self.whole, self.any_whole = (re.compile("|".join([f"[^{more}!-~\xa1-\u02ff]", *map(re.escape, self.special)])).search for more in ("", BREAK))
        vocab = self.tokenizer.get_vocab()
        #: Which ids end a part.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(END)]] = True
        self.word, self.part = _Cache(), _Cache()

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if any(s in text for s in self.special):
            return [text]
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # no white space to the vocabulary's pattern
            return [w for w in _BETWEEN.split(text) if w]
        return text.split()

    def parts(self, word: str) -> list[str]:
        """A word's parts as the pattern cuts them; scripts in which normalising may do more stay whole."""
        if not (word.isascii() and word.isalpha()) and self.whole(word):
            return [word]
        low = word.lower()
        return [low] if low.isalpha() else _WORDS.findall(low)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each text by itself."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, which go to the library many to a call, with spaces between; every part's last id says that it ends one."""
        plain = np.array([p.isascii() and p.isalpha() or not self.whole(p) for p in parts], bool)
        if not plain.all():
            ids, lengths = self.library([p for p, k in zip(parts, plain.tolist(), strict=True) if not k])
            more, of = self.encode_parts([p for p, k in zip(parts, plain.tolist(), strict=True) if k])
            row = np.where(plain, np.cumsum(plain) - 1 + len(lengths), np.cumsum(~plain) - 1)
            return ragged(np.concatenate([ids, more]), np.concatenate([[0], np.cumsum(np.concatenate([lengths, of]))]), row)
        ids, _ = self.library([" ".join(parts[a : a + JOINED]) for a in range(0, len(parts), JOINED)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(parts) or (len(ids) and last[-1] != len(ids) - 1):  # a vocabulary that marks ends in another way, or not all
            return self.library(parts)
        return ids, np.diff(last, prepend=-1)

    def cut(self, words: list[str]) -> Iterator[str]:
        """The parts of all words, BREAK behind each word's."""
        for a in range(0, len(words), CUT_WORDS):
            some = words[a : a + CUT_WORDS]
            joined = BREAK.join(some) + BREAK
            yield from (p for w in some for p in (*self.parts(w), BREAK)) if self.any_whole(joined) else _WORDS.findall(joined.lower())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each text has."""
        self.word.trim()
        self.part.trim()
        split = [self.words(t) for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        number, new = self.word.numbers(chain.from_iterable(split), int(n_words.sum()))
        if new:
            cut = list(self.cut(new))
            which, parts = self.part.numbers(cut, len(cut))
            if parts:
                self.part.rows.extend(*self.encode_parts(parts))
            flat, lengths = self.part.get(which)
            self.word.rows.extend(flat, np.diff(np.cumsum(lengths)[which == self.part.index[BREAK]], prepend=0))
        ids, lengths = self.word.get(number)
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_words)])])


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary; the library's own threads stay off, as Spark deals out the work."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("word_encoder", path), lambda: WordEncoder(path))


def to_planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """The bit or byte planes of uint32 ids, lowest first, as many as the largest id needs."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    used = int(ids.max(initial=0)).bit_length()
    raw = raw[:, : -(-used // 8)]
    if not bits:
        return [np.ascontiguousarray(raw[:, b]).tobytes() for b in range(raw.shape[1])]
    return [np.packbits(raw[:, b // 8] >> (b % 8) & 1).tobytes() for b in range(used)]


def from_planes(planes: list[bytes], n: int, bits: bool = True) -> np.ndarray:
    """The ids that ``to_planes`` has taken apart."""
    if not bits:
        out = np.zeros((n, 4), np.uint8)
        for b, plane in enumerate(planes):
            out[:, b] = np.frombuffer(plane, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return out


class _Writer:
    """One shard."""

    def __init__(self, folder: str, name: str, bits: bool) -> None:
        self.fs, top = filesystem(folder)
        self.name, self.final, self.own = name, f"{top}/{name}", f"{top}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(top, recursive=True)
        self.out, self.bits, self.pack = self.fs.open_output_stream(self.own, compression=None), bits, zstandard.ZstdCompressor(level=3)
        self.out.write(MAGIC)
        self.at, self.held, self.n_held, self.n_ids = len(MAGIC), [], 0, 0
        self.block_ids, self.block_planes, self.plane_bytes, self.doc_ids, self.doc_tokens = [], [], [], [], []

    def add(self, doc_ids: list, ids: np.ndarray, count: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.doc_tokens.append(count)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) - len(ids) % BLOCK_IDS
            for a in range(0, whole, BLOCK_IDS):
                self._block(ids[a : a + BLOCK_IDS])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.pack.compress(p) for p in to_planes(ids, self.bits)]
        self.block_ids.append(len(ids))
        self.block_planes.append(len(frames))
        for f in frames:
            self.plane_bytes.append(len(f))
            self.out.write(f)

    def close(self) -> dict:
        if self.n_held:
            self._block(np.concatenate(self.held))
        count = np.concatenate(self.doc_tokens) if self.doc_tokens else np.zeros(0, np.int64)
        arrays = {
            "block_ids": np.array(self.block_ids, "<i8"), "block_planes": np.array(self.block_planes, "<i8"), "plane_bytes": np.array(self.plane_bytes, "<i8"),
            "doc_id": np.array([i or 0 for i in self.doc_ids], "<i8"), "doc_known": np.array([i is not None for i in self.doc_ids], "u1"), "doc_tokens": count.astype("<i8"),
        }
        head = {"bits": self.bits, "n_ids": self.n_ids, "arrays": [[k, a.dtype.str, len(a)] for k, a in arrays.items()]}
        index = self.pack.compress(json.dumps(head).encode() + b"\n" + b"".join(a.tobytes() for a in arrays.values()))
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.final)
        return {"shard": self.name, "n_docs": len(self.doc_ids), "n_ids": self.n_ids}


def read_index(file, size: int) -> tuple[dict, dict[str, np.ndarray]]:
    """The scalar fields and arrays of a shard's index."""
    tail = file.read_at(16, size - 16)
    if tail[8:] != MAGIC:
        raise ValueError("no shard of token planes, or not all of it")
    n = int.from_bytes(tail[:8], "little")
    head, _, raw = zstandard.ZstdDecompressor().decompress(file.read_at(n, size - 16 - n)).partition(b"\n")
    head, arrays, at = json.loads(head), {}, 0
    for name, kind, length in head["arrays"]:
        arrays[name] = np.frombuffer(raw, kind, length, at)
        at += arrays[name].nbytes
    return head, arrays


def read_blocks(file, head: dict, index: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
    """The ids of blocks ``first`` to ``last`` (left out), a block at a time."""
    unpack = zstandard.ZstdDecompressor()
    plane = np.concatenate([[0], np.cumsum(index["block_planes"])])
    at = np.concatenate([[0], np.cumsum(index["plane_bytes"])]) + len(MAGIC)
    for b in range(first, len(index["block_ids"]) if last is None else last):
        lo, hi = plane[b], plane[b + 1]
        raw = file.read_at(int(at[hi] - at[lo]), int(at[lo]))
        yield from_planes([unpack.decompress(raw[at[k] - at[lo] : at[k + 1] - at[lo]]) for k in range(lo, hi)], int(index["block_ids"][b]), head["bits"])


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 1, bits: bool = True) -> DataFrame:
    """Writes the ids of all texts in ascending order of doc_id; the list of shards (shard, n_docs, n_ids).

    Null and empty texts have only the end id. Rows without a doc_id come last; equal doc_ids in
    the order of a hash of their texts. Other columns don't matter; an empty table has no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, writer, done = TaskContext.get().partitionId(), 0, None, []
        encoder = word_encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                ids, count = encoder.encode(part.column(1).to_pylist())
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(count), end_id)
                    count = count + 1
                if writer is None:
                    writer, n = _Writer(folder, f"ids-{task:08d}-{n:05d}", bits), n + 1
                writer.add(part.column(0).to_pylist(), ids, count)
                if writer.n_ids >= SHARD_IDS:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    return stored(dealt.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "shard string, n_docs long, n_ids long"), "token-shards")


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (uint32, little-endian, as binary)."""
    # one row per shard, so the running sum is small however large the corpus is
    first = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_ids")
    n = max(1, shards.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, top = filesystem(folder)
                with files.open_input_file(f"{top}/{shard}") as file:
                    head, index = read_index(file, file.size())
                    known, doc, count = index["doc_known"].astype(bool), index["doc_id"], index["doc_tokens"]
                    ends = np.cumsum(count)
                    held, at, k = np.zeros(0, np.uint32), 0, 0  # ids not yet given out, the place of their first, the next document
                    for ids in read_blocks(file, head, index):
                        held = np.concatenate([held, ids]) if len(held) else ids
                        upto = int(np.searchsorted(ends, at + len(held), side="right"))
                        if upto > k:
                            cut = ends[k:upto] - at
                            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), upto - k, [None, pa.py_buffer(np.concatenate([[0], cut * 4]).astype(np.int64)), pa.py_buffer(held[: cut[-1]].astype("<u4"))]).cast(pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.array(doc[k:upto], mask=~known[k:upto]), pa.array(start + ends[k:upto] - count[k:upto]), pa.array(count[k:upto]), data], names=["doc_id", "start", "n_tokens", "ids"])
                            held, at, k = held[cut[-1] :], int(ends[upto - 1]), upto
                    if k < len(doc):  # documents without any id at the end of a shard
                        yield pa.RecordBatch.from_arrays([pa.array(doc[k:], mask=~known[k:]), pa.array(start + ends[k:]), pa.array(count[k:]), pa.array([b""] * (len(doc) - k), pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.select("shard", first.alias("first")).repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-planes")
    shards = write_tokens(table(spark, sf_dir, "documents"), default_vocabulary(), folder)
    return read_tokens(shards, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
