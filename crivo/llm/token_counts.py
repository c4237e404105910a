"""Operator 9: token counts from per-document pre-token frequencies.

Each task turns a run of documents into one block: the block's distinct pre-tokens, and for each
document the places of its pre-tokens in that list with their frequencies (compressed). Blocks
are written once to the shared folder. Their lists, a small part of the corpus, are dealt by
pre-token, so that the pieces of each distinct one are counted once; the counts go back to the
places in the lists, are gathered per block (as bounded as the block is), joined to the block and
multiplied by the frequencies. No id is ever stored, and a pre-token that half of the corpus uses
takes a row per block, not per use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBPE, byte_bpe, default_vocabulary
from .common import ragged, slices, stored, table

#: Bytes of text in a block, about: the larger, the fewer lists have a pre-token.
BLOCK_BYTES = 32_000_000

_BLOCK = "block long, docs array<struct<doc_id:bigint,n_bytes:bigint,n_distinct:int>>, places binary, times binary, pretokens array<string>"


_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_distinct", pa.int32())]))), ("places", pa.binary()), ("times", pa.binary()), ("pretokens", pa.list_(pa.string()))])


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed: most of the upper bytes are zero."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class _Block:
    """Documents with their pre-token numbers and frequencies, not yet a row."""

    def __init__(self) -> None:
        self.docs, self.pretokens, self.times, self.n_bytes = [], [], [], 0

    def add(self, bpe: ByteBPE, doc_ids: list, texts: list[str | None]) -> None:
        number, count = bpe.numbered(texts)
        if bpe.piece.new:  # the rows of pieces live as long as the cache does
            bpe.piece_rows.extend(*bpe.new_pretokens())
        flat, lengths = ragged(bpe.piece_rows.flat, bpe.piece_rows.offsets, number)
        doc = np.repeat(np.repeat(np.arange(len(texts)), count), lengths)
        pair, times = np.unique(doc << 32 | flat, return_counts=True)
        self.pretokens.append((pair & 0xFFFFFFFF).astype(np.int32))
        self.times.append(times.astype(np.int32))
        distinct = np.bincount(pair >> 32, minlength=len(texts)).tolist()
        size = [len(t.encode()) if t else 0 for t in texts]
        self.docs += [{"doc_id": i, "n_bytes": b, "n_distinct": k} for i, b, k in zip(doc_ids, size, distinct, strict=True)]
        self.n_bytes += sum(size)

    def row(self, bpe: ByteBPE, block: int) -> pa.RecordBatch:
        used, place = np.unique(np.concatenate(self.pretokens), return_inverse=True)
        words = list(bpe.pretoken)
        columns = {"block": [block], "docs": [self.docs], "places": [packed(np.diff(place, prepend=0))], "times": [packed(np.concatenate(self.times))], "pretokens": [[words[i] for i in used.tolist()]]}
        return pa.RecordBatch.from_pydict(columns, _BLOCK_ARROW)


def blocks(docs: DataFrame, vocabulary: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the documents of each input partition, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, task, n = byte_bpe(vocabulary, "pretokens"), TaskContext.get().partitionId(), 0
        bpe.trim()
        held = _Block()
        for batch in batches:
            for part in slices(batch, 1):
                held.add(bpe, part.column(0).to_pylist(), part.column(1).to_pylist())
                if held.n_bytes >= block_bytes:
                    yield held.row(bpe, task << 20 | n)
                    bpe.trim()
                    held, n = _Block(), n + 1
        if held.docs:
            yield held.row(bpe, task << 20 | n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCK)


def piece_counts(slots: DataFrame, vocabulary: str, parts: int) -> DataFrame:
    """Rows (block, at, n) from rows (block, at, pretoken): the pre-tokens come together in ``parts`` partitions and each is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = byte_bpe(vocabulary, "ids"), (None, 0)
        for batch in batches:
            words = batch.column(2).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            n = np.ones(len(distinct), np.int64)
            plain = [i for i, w in enumerate(distinct) if w not in bpe.special and w != last[0]]
            n[plain] = bpe.merge([distinct[i] for i in plain])[1]
            if distinct and distinct[0] == last[0]:
                n[0] = last[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n[words.indices.to_numpy()].astype(np.int32))], names=["block", "at", "n"])
            last = (distinct[-1], n[-1]) if distinct else last

    return slots.repartition(parts, "pretoken").sortWithinPartitions("pretoken").mapInArrow(run, "block long, at int, n int")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and tokens; a null doc_id stays null; repeated rows are
    counted each; other columns are not looked at. An empty table gives none.
    """
    spark, made = docs.sparkSession, stored(blocks(docs, vocabulary), "token-blocks")
    # partitions grow with the blocks, whatever number the session has: about a block's list for each
    parts = max(made.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a block has each of its pre-tokens once, so none has more rows than there are blocks
    slots = made.select("block", F.posexplode("pretokens").alias("at", "pretoken"))
    # one block's counts in order of its list, which is as long as the block has distinct pre-tokens
    counts = piece_counts(slots, vocabulary, parts).repartition(parts, "block")
    per_block = counts.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs_, places, times, n = (batch.column(i)[k] for i in range(4))
                n = np.asarray(n.values.to_numpy(zero_copy_only=False), np.int64) if n.is_valid else np.zeros(0, np.int64)
                at = np.cumsum(unpacked(places.as_py()), dtype=np.int64)
                times = unpacked(times.as_py()).astype(np.int64)
                docs_ = docs_.values
                ends = np.concatenate([[0], np.cumsum(docs_.field("n_distinct").to_numpy())])
                total = np.concatenate([[0], np.cumsum(n[at] * times)])[ends]
                yield pa.RecordBatch.from_arrays([docs_.field("doc_id"), docs_.field("n_bytes"), pa.array(np.diff(total))], names=["doc_id", "n_bytes", "n_tokens"])

    joined = made.select("block", "docs", "places", "times").join(per_block, "block", "left")
    out = joined.select("docs", "places", "times", "n").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
