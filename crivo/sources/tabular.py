"""Delimited text: delimiter, encoding and header are found, records read by Spark over all their splits.

A quoted cell may go over line ends, and so over the ends of the splits that Spark reads. What a split
does to that state is a small function of the state at its start: with it closed or open, how many
records begin, whether a cell is open at the end, and how wide records are. A first pass works these
functions out, split by split, and they are composed in order of each file; the second pass joins the
lines of each split from its own start. Splits are known by their file, start and length, which every
line carries along, so neither pass depends on which task reads a split.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import is_blank, strip
from .detect import SCAN_ROWS, TYPE_ROWS, Rejected, choose_sheet, header_scores, headers, sheet_scores, unique_names

__all__ = ["Found", "Rejected", "choose_sheet", "footer_like", "header_scores", "headers", "read_all_text", "read_delimited", "records", "sheet_scores", "sniff", "unique_names"]

HEAD_BYTES = 8192
DELIMITERS = ",;\t|"
#: The rest of a quoted cell up to its end, quotes in it doubled.
QUOTED = re.compile(rb'(?:[^"]++|"")*+')
BATCH = 1_000
PIECES = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("line", pa.int64()), ("whole", pa.bool_()), ("value", pa.binary()), ("cells", pa.list_(pa.string()))])


@dataclass
class Found:
    """How a table lies in its files; ``header_row`` counts from 1. ``splits`` has where each split starts: within a cell, behind how many records."""

    names: list[str]
    header_row: int
    confidence: float
    delimiter: str = ","
    encoding: str = "UTF-8"
    alternatives: list[int] = field(default_factory=list)
    latin: frozenset[int] = frozenset()
    splits: dict[tuple[int, int, int], tuple[bool, int]] = field(default_factory=dict)
    files: int = 1


def advance(line: bytes, delimiter: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a quoted cell is open at a line's end, and the delimiters outside of quotes, by the rules of ``csv.reader``: a quote opens at a cell's start only."""
    if b'"' not in line:
        return inside, 0 if inside else line.count(delimiter)
    at = parted = 0
    while True:
        if not inside:
            inside = line[at : at + 1] == b'"'
            at += inside
        if inside:
            at = QUOTED.match(line, at).end()
            if at == len(line):
                return True, parted
            inside = False
        at = line.find(delimiter, at) + 1
        if not at:
            return False, parted
        parted += 1


class Transfer:
    """What a split does, from a closed (0) and from an open cell (1): records that begin, the open cell at its end, and widths."""

    def __init__(self, delimiter: bytes) -> None:
        self.delimiter, self.valid = delimiter, True
        self.inside, self.begun, self.most = [False, True], [0, 0], [0, 0]
        #: delimiters of the record that is open now, and, of one that was open at the start, up to its end
        self.open, self.head = [0, 0], [-1, -1]
        self.began_here = [False, False]

    def feed(self, lines: pa.Array, valid: bool) -> None:
        self.valid = self.valid and valid
        if not pc.any(pc.match_substring(lines, '"')).as_py():
            most = pc.max(pc.count_substring(lines, self.delimiter)).as_py() + 1
            for k in (0, 1):
                if not self.inside[k]:
                    self.begun[k] += len(lines)
                    self.most[k] = max(self.most[k], most)
            return
        for line in lines.to_pylist():
            for k in (0, 1):
                if not self.inside[k]:
                    self.begun[k] += 1
                    self.open[k], self.began_here[k] = 0, True
                self.inside[k], parted = advance(line, self.delimiter, self.inside[k])
                self.open[k] += parted
                if not self.inside[k]:
                    if self.began_here[k]:
                        self.most[k] = max(self.most[k], self.open[k] + 1)
                    else:
                        self.head[k], self.began_here[k] = self.open[k], True

    def row(self, key: tuple[int, int, int]) -> dict:
        return {"file": key[0], "start": key[1], "length": key[2], "valid": self.valid, "begun": self.begun, "inside": self.inside, "most": self.most, "open": self.open, "head": self.head, "began_here": self.began_here}


TRANSFERS = "file long, start long, length long, valid boolean, begun array<long>, inside array<boolean>, most array<long>, open array<long>, head array<long>, began_here array<boolean>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (value, file, start, length): each line, and the split that it is read by."""
    at = F.col("_metadata")
    return spark.read.text(path).select(F.col("value").cast("binary").alias("value"), F.xxhash64(at["file_path"]).alias("file"), at["file_block_start"].alias("start"), at["file_block_length"].alias("length"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Each batch in runs of lines of one split, with (file, start, length)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in (1, 2, 3)])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)


def transfers(spark: SparkSession, path: str, delimiter: str) -> list:
    """A row per split, in order of files and places: some hundred bytes for each come to the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], Transfer] = {}
        for key, run in _runs(batches):
            if key not in found:
                found[key] = Transfer(delimiter.encode())
            found[key].feed(run.column(0), pc.all(run.column(4)).as_py())
        rows = [t.row(key) for key, t in found.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    lines = _lines(spark, path)
    return sorted(lines.withColumn("valid", F.is_valid_utf8(F.col("value").cast("string"))).mapInArrow(scan, TRANSFERS).collect(), key=lambda r: (r["file"], r["start"]))


def composed(rows: list) -> tuple[dict[tuple[int, int, int], tuple[bool, int]], int]:
    """Where each split starts, and the widest record, from the splits' rows in order."""
    starts, widest, file, inside, at, parted = {}, 0, None, False, 0, 0
    for r in rows:
        if r["file"] != file:
            if inside:
                break
            file, at = r["file"], 0
        k = int(inside)
        starts[r["file"], r["start"], r["length"]] = (inside, at)
        at += r["begun"][k]
        ended = inside and r["head"][k] >= 0
        if ended:
            widest = max(widest, parted + r["head"][k] + 1)
        widest = max(widest, r["most"][k])
        parted = r["open"][k] if r["began_here"][k] else parted + r["open"][k]
        inside = r["inside"][k]
    if inside:
        raise Rejected("aspas abertas sem fim")
    return starts, widest


def sniff(spark: SparkSession, path: str, header_row: int | None = None) -> Found:
    """Delimiter and header of delimited files, from the first lines of the first one, and what all lines tell.

    A file is UTF-8 if every line is, else Latin-1. ``path`` may be a folder or pattern: every file then
    has the header's row, with the same names, and its records are numbered for themselves.
    """
    text = spark.read.text(path)
    files = sorted(text.inputFiles())
    if not files:
        raise Rejected("arquivo vazio")
    # splits end at line ends, so the first lines are a bounded read
    head = spark.read.text(files[0]).select(F.col("value").cast("binary")).limit(max(SCAN_ROWS, header_row or 0) + TYPE_ROWS + 1).collect()
    raw = [bytes(r[0]) for r in head]
    sample = b"\n".join(raw)[:HEAD_BYTES].decode("UTF-8", "replace").lstrip("﻿")
    try:
        delimiter = csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        delimiter = ","
    rows = transfers(spark, path, delimiter)
    if not rows:
        raise Rejected("arquivo vazio")
    splits, width = composed(rows)
    latin = frozenset(r["file"] for r in rows if not r["valid"])
    first = spark.range(1).select(F.xxhash64(F.lit(files[0]))).first()[0]
    encoding = "ISO-8859-1" if first in latin or len({r["file"] for r in rows}) == 1 and latin else "UTF-8"
    lines = [r.decode(encoding, "replace") for r in raw]
    if lines:
        lines[0] = lines[0].lstrip("﻿")
    found = Found([], header_row or 0, 1.0, delimiter, encoding, [], latin, splits, len({r["file"] for r in rows}))
    if header_row is None:
        grid = [("", i, k, c) for i, row in enumerate(csv.reader(lines, delimiter=delimiter), 1) for k, c in enumerate(row, 1)]
        cells, widths = spark.createDataFrame(grid, "sheet string, line long, col int, value string"), spark.createDataFrame([("", width)], "sheet string, width long")
        best = headers(header_scores(cells, widths)).first()
        if best is None:
            raise Rejected("nenhuma linha de cabecalho plausivel")
        found.header_row, found.confidence, found.alternatives = best["header_row"], best["confidence"], list(best["alternatives"])
    of_header = parsed(records(spark, path, found).filter(F.col("line") == found.header_row), found).select("cells").distinct().limit(2).collect() if found.files > 1 or header_row else None
    if of_header is None:
        row = list(csv.reader(lines, delimiter=delimiter))[found.header_row - 1]
    elif len(of_header) == 1:
        row = of_header[0]["cells"]
    else:
        raise Rejected(f"linha de cabecalho {found.header_row} fora do arquivo" if not of_header else "os arquivos tem cabecalhos diferentes")
    row = [c.lstrip("﻿") for c in row]
    found.names = unique_names([*row, *[None] * (width - len(row))])
    return found


def records(spark: SparkSession, path: str, found: Found) -> DataFrame:
    """Rows (file, line, value, cells): the records of the files, decoded, with their place; lines are joined (by \\n) while a quoted cell is open.

    ``cells`` is null where a record has no quote, as its cells are then the parts between delimiters.
    Only records that go over a split's end are put together by a shuffle. Files that have changed, or
    are split in another way, since ``found`` was made are refused.
    """
    delimiter, splits, latin = found.delimiter, found.splits, found.latin
    encoding = lambda file: "ISO-8859-1" if file in latin else "UTF-8"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        key, out, held, inside, at, whole = None, [], [], False, 0, True

        def piece(done: bool) -> dict:
            value = b"\n".join(held)
            cells = next(csv.reader(io.StringIO(value.decode(encoding(key[0])), newline=""), delimiter=delimiter), []) if done and b'"' in value else None
            return {"file": key[0], "start": key[1], "line": at, "whole": done, "value": value, "cells": cells}

        for this, run in _runs(batches):
            if this != key:
                if held:
                    out.append(piece(False))
                if this not in splits:
                    raise Rejected("o arquivo mudou desde que foi examinado: examine-o de novo")
                key, held = this, []
                inside, at = splits[key]
                whole = not inside
            lines = run.column(0)
            if not inside and not pc.any(pc.match_substring(lines, '"')).as_py():
                if out:
                    yield pa.RecordBatch.from_pylist(out, PIECES)
                    out = []
                n = len(lines)
                same = lambda x, kind: pa.array(np.full(n, x), kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(key[0], pa.int64()), same(key[1], pa.int64()), pa.array(np.arange(at + 1, at + n + 1)), same(True, pa.bool_()), lines, pa.nulls(n, PIECES.field("cells").type)], schema=PIECES)
                at += n
                continue
            for line in lines.to_pylist():
                if not inside:
                    at += 1
                held.append(line)
                inside = advance(line, delimiter.encode(), inside)[0]
                if not inside:
                    out.append(piece(whole))
                    held, whole = [], True
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_pylist(out, PIECES)
                    out = []
        if held:
            out.append(piece(False))
        yield pa.RecordBatch.from_pylist(out, PIECES)

    pieces = _lines(spark, path).mapInArrow(join, "file long, start long, line long, whole boolean, value binary, cells array<string>")
    value = F.col("value").cast("string")
    if latin:
        value = F.when(F.col("file").isin(*latin), F.decode("value", "ISO-8859-1")).otherwise(value)
    pieces = pieces.withColumn("value", value)
    if not any(begins for begins, _ in splits.values()):
        return pieces.select("file", "line", "value", "cells")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            cells = [next(csv.reader(io.StringIO(v, newline=""), delimiter=delimiter), []) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.string()))], names=["file", "line", "value", "cells"])

    parts = pieces.filter("not whole").groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = parts.select("file", "line", F.array_join("parts.value", "\n").alias("value")).mapInArrow(cut, "file long, line long, value string, cells array<string>")
    return pieces.filter("whole").select("file", "line", "value", "cells").union(joined)


def parsed(rows: DataFrame, found: Found) -> DataFrame:
    """``records`` with the cells of every row."""
    return rows.withColumn("cells", F.coalesce("cells", F.split("value", re.escape(found.delimiter), -1)))


def read_delimited(spark: SparkSession, path: str, header_row: int | None = None, found: Found | None = None) -> DataFrame:
    """All cells as text, null where empty, and ``line``, the record's place in its file (header row and blank records counted).

    Blank records are left out. Cells beyond the header's are columns ``coluna_N``, as many as the widest
    record has. A record goes on over line ends within quotes; a file that ends within quotes is refused.
    Where there are several files, ``file`` tells them apart.
    """
    found = found or sniff(spark, path, header_row)
    rows = parsed(records(spark, path, found).filter(F.col("line") > found.header_row), found)
    cells = {n: F.nullif(F.get("cells", F.lit(k)), F.lit("")) for k, n in enumerate(found.names)}
    blank = F.lit(True)
    for c in cells.values():
        blank = blank & is_blank(c)
    more = [F.col("file")] if found.files > 1 else []
    return rows.filter(~blank).select(*(c.alias(n) for n, c in cells.items()), "line", *more)


def read_all_text(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Header in the first row, every cell text, blanks instead of nulls."""
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=False).na.fill("")


def footer_like(df: DataFrame, columns: list[str]) -> bool:
    """Whether the last row looks like totals: sparse with a number, or a cell that says so. One aggregate, one row."""
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    last = df.agg(F.max_by(F.array(*cells), "line").alias("r")).select(F.explode("r").alias("c")).select(strip(F.col("c")).alias("c")).filter("c is not null and c <> ''")
    kinds = last.select(parse.cell_type(F.col("c")).alias("t"), F.lower("c").rlike("total|soma").alias("told")).collect()
    sparse = 0 < len(kinds) <= 0.6 * len(columns)
    return sparse and any(k["t"] in ("inteiro", "decimal", "moeda") for k in kinds) or any(k["told"] for k in kinds)
