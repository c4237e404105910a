"""Operator 2: byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many distinct pre-tokens lie in one flat array. In each round the pairs of
neighbours are looked up by binary search among the sorted pair keys of the merge table, every
pre-token merges its pair of lowest rank (all its places, from the left, without overlap), and
pre-tokens without a pair leave the array. Texts are then put together from the rows of their
pieces, so a pre-token is merged once per worker and not once per place.

Encoding and decoding are maps over rows: no shuffle, no state between tasks but a cache of
bounded bytes in each Python worker, which a lost executor only has to fill again. A worker has one
vocabulary at a time, and lets it go when it comes to serve another operator.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .common import Index, Rows, append_columns, fresh, kept, ragged, table

#: Bytes that a worker's cache may take, about, before it starts anew.
CACHE_BYTES = 48_000_000
#: Ids that are decoded at a time, and bytes of text that are encoded at a time; a longer text is cut between pieces.
DECODE_IDS, ENCODE_BYTES = 300_000, 1_000_000

# The pattern that splits text before the merges, of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space other than the plain space, as the pattern's \s has it.
SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_WHITE = SPACES + " "
_PRETOKEN = regex.compile(PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]"))
_PIECE = regex.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_CUT = regex.compile(f"[^{_WHITE}] ")
_ASCII_ENDS = [c + " " for c in SPACES[:5]]
_OTHER_ENDS = [c + " " for c in SPACES[5:]]


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else n))
        n += b not in plain
    return out


def pieces(text: str) -> list[str]:
    """``text`` in pieces that the pattern treats one by one: no pre-token crosses from one into the next.

    A plain space opens the piece behind it. That cut is right wherever no white space stands
    before the space; other texts are cut by a pattern.
    """
    parts = text.split(" ")
    if "" not in parts and not any(e in text for e in _ASCII_ENDS) and (text.isascii() or not any(e in text for e in _OTHER_ENDS)):
        return [parts[0], *[" " + p for p in parts[1:]]]
    return _PIECE.findall(text)


class ByteBPE:
    """A byte-level vocabulary in the JSON form of the tokenizers library, and a cache of encoded pieces."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        rank = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[rank], rank.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[rank]
        byte = {c: b for b, c in enumerate(chars)}
        words = {i: bytes(byte[c] for c in w) for w, i in vocab.items()} | {i: w.encode() for w, i in self.special.items()}
        self.size = max(words) + 1
        lengths = np.array([len(words.get(i, b"")) for i in range(self.size)], np.int64)
        self.bytes = np.frombuffer(b"".join(words.get(i, b"") for i in range(self.size)), np.uint8)
        self.byte_offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.use = None
        self.clear()

    def clear(self) -> None:
        self.piece, self.piece_rows = Index(), Rows()
        self.pretoken, self.pretoken_rows = Index(), Rows()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words``, each a pre-token, one behind the other, and the number of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        count = np.array([len(r) for r in raw], np.int64)
        symbol = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), count)
        done_symbols, done_words = [], []
        while len(symbol):
            pair = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.full(len(symbol), len(self.keys), np.int64)
            rank[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(starts, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), length)
            live = lowest < len(self.keys)
            done_symbols.append(symbol[~live])
            done_words.append(word[~live])
            chosen = live & (rank == lowest)
            places = np.flatnonzero(chosen)
            # the same pair twice in a row overlaps; every other place of such a run merges, from its left
            run = np.concatenate([[True], np.diff(places) != 1]) if len(places) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
            symbol[places] = self.merged[at[places]]
            live[places + 1] = False
            symbol, word = symbol[live], word[live]
        symbols, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_words))
        order = np.argsort(of, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(of, minlength=len(words))

    def trim(self) -> None:
        """Starts the cache anew once it is beyond its bound; a step adds no more to it than its own text."""
        if self.piece.n_bytes + self.pretoken.n_bytes > CACHE_BYTES:
            self.clear()

    def cuts(self, text: str | None) -> list[str | None]:
        """``text`` in parts of about ENCODE_BYTES characters that have the ids of the whole, one behind the other.

        A cut is where a plain space stands behind other than white space, as it opens a piece. A
        text that may hold a special token's string, or has no such place, stays whole.
        """
        if text is None or len(text) <= ENCODE_BYTES or any(s in text for s in self.special):
            return [text]
        out, a = [], 0
        while len(text) - a > ENCODE_BYTES:
            found = _CUT.search(text, a + ENCODE_BYTES)
            if not found:
                break
            out.append(text[a : found.end() - 1])
            a = found.end() - 1
        return [*out, text[a:]]

    def split(self, text: str | None) -> list[str]:
        """The pieces of a text; a special token's string is a piece of its own."""
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return pieces(text)
        return [p for i, part in enumerate(self.cut.split(text)) for p in ([part] if i % 2 else pieces(part) if part else [])]

    def pretokens(self, piece: str) -> list[str]:
        if piece in self.special:
            return [piece]
        if piece.isascii() or max(piece) < "\u0530":
            return _PRETOKEN.findall(piece)
        # what is a letter or a number beyond these scripts depends on the Unicode version: the library's own counts
        return [piece[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(piece)]

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of all texts, one behind the other, and how many each text has."""
        split = [self.split(t) for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        number = self.piece.__getitem__
        return np.fromiter((i for s in split for i in map(number, s)), np.int64, int(count.sum())), count

    def new_pretokens(self) -> tuple[np.ndarray, np.ndarray]:
        """The pre-token numbers of the pieces met since the last call, and how many each has."""
        split = [self.pretokens(p) for p in self.piece.new]
        self.piece.new.clear()
        count = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter((self.pretoken[w] for s in split for w in s), np.int64, int(count.sum())), count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each text has."""
        parts = [self.cuts(t) for t in texts]
        if all(len(p) == 1 for p in parts):
            return self._encode(texts)
        made = [[self._encode([x]) for x in p] for p in parts]
        return np.concatenate([ids for p in made for ids, _ in p]), np.array([sum(int(n[0]) for _, n in p) for p in made])

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        self.trim()
        number, count = self.numbered(texts)
        if self.piece.new:
            which, per_piece = self.new_pretokens()
            if self.pretoken.new:
                plain = [w for w in self.pretoken.new if w not in self.special]
                ids, lengths = self.merge(plain)
                if len(plain) < len(self.pretoken.new):
                    place = np.cumsum([w not in self.special for w in self.pretoken.new]) - 1
                    ends = np.cumsum(lengths)
                    rows = [np.array([self.special[w]], np.int32) if w in self.special else ids[ends[k] - lengths[k] : ends[k]] for w, k in zip(self.pretoken.new, place, strict=True)]
                    ids, lengths = np.concatenate(rows), np.array(list(map(len, rows)))
                self.pretoken_rows.extend(ids, lengths)
                self.pretoken.new.clear()
            flat, lengths = ragged(self.pretoken_rows.flat, self.pretoken_rows.offsets, which)
            ends, bounds = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(per_piece)])
            self.piece_rows.extend(flat, np.diff(ends[bounds]))
        ids, lengths = ragged(self.piece_rows.flat, self.piece_rows.offsets, number)
        ends, bounds = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of id lists; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        known = (ids >= 0) & (ids < self.size)
        raw, lengths = ragged(self.bytes, self.byte_offsets, np.where(known, ids, 0).astype(np.int64)) if known.all() else self._decode_known(ids, known)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(count)])]
        data = raw.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]

    def _decode_known(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, some = ragged(self.bytes, self.byte_offsets, ids[known].astype(np.int64))
        lengths = np.zeros(len(ids), np.int64)
        lengths[known] = some
        return raw, lengths


def byte_bpe(path: str, use: str) -> ByteBPE:
    """The worker's vocabulary of ``path``; the cache starts anew with another use, as each fills it with rows of its own."""
    bpe = kept(("byte_bpe", path), lambda: ByteBPE(path))
    if bpe.use != use:
        bpe.clear()
        bpe.use = use
    return bpe


def lists(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """An array of lists of ``count`` elements each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as array<int> in a new column ``ids``.

    Null and empty texts have an empty list. The string of a special token counts as that token.
    Long texts are worked on whole; repeated rows, ties and other columns don't matter; a column
    that is already called ``ids`` makes the new one ``ids_``.
    """

    def run(texts: list) -> list[pa.Array]:
        return [lists(*byte_bpe(vocabulary, "ids").encode(texts))]

    return append_columns(df, text, [T.StructField(fresh(df, ids), T.ArrayType(T.IntegerType()), True)], run, ENCODE_BYTES, ("byte_bpe", vocabulary))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts of the id lists in ``ids`` in a new column ``text``; null and empty lists give the empty text."""
    schema = T.StructType([*df.schema.fields, T.StructField(fresh(df, text), T.StringType(), True)])
    at, names = df.columns.index(ids), to_arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, "ids")
        for batch in batches:
            # runs of rows with about DECODE_IDS ids together
            size = np.asarray(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // DECODE_IDS)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                given = part.column(at).fill_null([])
                count = np.diff(given.offsets.to_numpy())
                flat = np.asarray(given.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bpe.decode(flat, count), pa.string())], names=names)

    return df.mapInArrow(run, schema)


def code(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with both the ids of ``text`` and the text that those decode to: ``encode`` and ``decode`` in one pass, so that
    a task has one Python worker and one vocabulary."""

    def run(texts: list) -> list[pa.Array]:
        bpe = byte_bpe(vocabulary, "ids")
        flat, count = bpe.encode(texts)
        return [lists(flat, count), pa.array(bpe.decode(flat.astype(np.int64), count), pa.string())]

    fields = [T.StructField(fresh(df, ids), T.ArrayType(T.IntegerType()), True), T.StructField(fresh(df, decoded), T.StringType(), True)]
    return append_columns(df, text, fields, run, ENCODE_BYTES, ("byte_bpe", vocabulary))


def digests(ids: str, decoded: str) -> list[Column]:
    """Number of tokens, and digests of the decimal ids and of the decoded text."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document its id, number of tokens, and digests of the ids and of the text that they decode to."""
    return code(docs.select("doc_id", F.col("text").cast("string").alias("text")), vocabulary).select("doc_id", *digests("ids", "decoded"))


def encoded_corpus(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs`` doc_id, lang, source, its ids, and the figures of ``round_trip``, which prove that the ids decode to the text.

    Repeated rows stay, each with its ids; nulls in doc_id, lang and source stay null; a null or empty text has no ids.
    """
    coded = code(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source"), vocabulary)
    return coded.select("doc_id", "lang", "source", "ids", *digests("ids", "decoded"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
