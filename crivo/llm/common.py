"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text that one step of a task holds as Python objects.
STEP_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark, as the folder may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders made within the ``scratch`` blocks that are open now, the innermost last.
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that driver and executors share.

    ``spark.checkpoint.dir`` names that folder on a cluster. Only in local mode, where all run on
    one machine, a folder of this machine may stand in for it; elsewhere its lack is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators make within the block are deleted at its end; what is read from them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def stored(df: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """The tables of an iteration: a step is stored, and the one before it deleted, as nothing reads that again."""

    def __init__(self, kind: str) -> None:
        self.kind, self.last = kind, None

    def store(self, df: DataFrame) -> DataFrame:
        path = shared_dir(df.sparkSession, self.kind)
        out = stored(df, self.kind, path)
        if self.last:
            remove(df.sparkSession, self.last)
        self.last = path
        return out


#: What this Python worker keeps from one task to the next: one object, by its use.
_KEPT: dict = {}


def let_go(but: object = None) -> None:
    """Drops what the worker keeps for another use than ``but``, and gives its memory back."""
    other = [use for use in _KEPT if use != but]
    for use in other:
        del _KEPT[use]
    if other:
        gc.collect()
        pa.default_memory_pool().release_unused()


def kept(use: tuple, make: Callable[[], object]) -> object:
    """The worker's object for ``use``, made where there is none; a worker keeps one at a time, whatever stages it serves."""
    let_go(use)
    if use not in _KEPT:
        _KEPT[use] = make()
    return _KEPT[use]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, with underscores behind it until no column of ``df`` begins so."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def slices(batch: pa.RecordBatch, text: int, chars: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``chars`` bytes together; a longer text is a run of its own."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    step = (np.cumsum(size) - size) // chars
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[list], list[pa.Array]], chars: int = STEP_CHARS, use: tuple | None = None) -> DataFrame:
    """``df`` with ``fields`` behind its columns, which ``fn`` makes from a list of texts (None where null).

    One pass without a shuffle; every other column goes along as it is. What the worker keeps for
    another use than ``use`` is dropped first.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(use)
        for batch in batches:
            for part in slices(batch, at, chars):
                made = fn(part.column(at).to_pylist())
                made = [c.cast(f.type) for c, f in zip(made, list(arrow)[batch.num_columns :], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=arrow.names)

    return df.mapInArrow(run, schema)


def ragged(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of ``rows`` of a list of lists, one behind the other, and each row's length."""
    length = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[rows] - ends + length, length)
    return flat[at], length


class Index(dict):
    """Numbers texts in order of their first use; ``new`` holds those not yet worked on, ``n_bytes`` about what all take in memory."""

    #: Bytes of an entry besides its characters: the text's object, its place in the table, its number, and its row elsewhere.
    ENTRY = 180

    def __init__(self) -> None:
        self.new: list = []
        self.n_bytes = 0

    def __missing__(self, key):
        i = self[key] = len(self)
        self.new.append(key)
        self.n_bytes += self.ENTRY + len(key)
        return i


class Rows:
    """A growing list of integer lists in one flat array."""

    def __init__(self) -> None:
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.int32, copy=False)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths, dtype=np.int64)])
