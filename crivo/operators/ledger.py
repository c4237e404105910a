"""Sending once: a ledger of outcomes by key, which a run that comes after a killed one goes on from.

Rows are written to a Spark data source whose writer calls the transport. Each task keeps what it has
been answered in the ledger as it goes, a small file for every ``flush`` calls, so what is lost with an
executor, a job or a driver is at most the calls since the last of these; the receiver knows them by
their Idempotency-Key. A task that Spark repeats, and a later run, send only keys without an outcome.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.web import idempotency_key
from .delivery import Retry, Transport, call, payload_columns, with_outcome

ENTRY = pa.schema([("idempotency_key", pa.string()), ("status_http", pa.int32()), ("body", pa.string()), ("tentativas", pa.int32())])
OUTCOMES = "idempotency_key string, status_http int, body string, tentativas int"


@dataclass
class Sent(WriterCommitMessage):
    calls: int


class Entries:
    """The ledger's files of one part of a run, in any store that Arrow reads by its address."""

    def __init__(self, folder: str, prefix: str) -> None:
        self.fs, top = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.top, self.prefix, self.held = f"{top}/outcomes", prefix, []

    def keys(self) -> set[str]:
        """The keys that this part has answers for, from an attempt that was lost."""
        self.fs.create_dir(self.top)
        mine = [f.path for f in self.fs.get_file_info(pafs.FileSelector(self.top)) if f.base_name.startswith(self.prefix)]
        return {k for p in mine for k in pq.read_table(p, columns=["idempotency_key"], filesystem=self.fs).column(0).to_pylist()}

    def add(self, entry: tuple, flush: int) -> None:
        self.held.append(entry)
        if len(self.held) >= flush:
            self.flush()

    def flush(self) -> None:
        if self.held:
            name = uuid.uuid4().hex
            half = f"{self.top}/_{name}"  # readers pass over names that begin so
            pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.held, strict=True), ENTRY, strict=True)], schema=ENTRY), half, filesystem=self.fs)
            self.fs.move(half, f"{self.top}/{self.prefix}{name}.parquet")
            self.held = []


class Writer(DataSourceArrowWriter):
    def __init__(self, transport: Transport, retry: Retry, options: dict) -> None:
        self.transport, self.retry = transport, retry
        self.ledger, self.run, self.flush = options["ledger"], options["run"], int(options["flush"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        entries = Entries(self.ledger, f"{self.run}-{TaskContext.get().partitionId()}-")
        done, calls = entries.keys(), 0
        for batch in iterator:
            for row in batch.to_pylist():
                key = row.pop("idempotency_key")
                if key in done:
                    continue
                status, body, attempts = call(self.transport, {n: "" if v is None else v for n, v in row.items()}, {"Idempotency-Key": key}, self.retry)
                calls += 1
                entries.add((key, status, body, attempts), self.flush)
        entries.flush()
        return Sent(calls)

    def commit(self, messages: list[Sent | None]) -> None:
        """Outcomes are in the ledger already; the run is told to have come to its end."""
        entries = Entries(self.ledger, "")
        entries.fs.create_dir(f"{entries.top}/../runs")
        with entries.fs.open_output_stream(f"{entries.top}/../runs/{self.run}") as f:
            f.write(str(sum(m.calls for m in messages if m)).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        """What was answered stays: it was sent."""


def _source(transport: Transport, retry: Retry) -> type[DataSource]:
    class Sender(DataSource):
        @classmethod
        def name(cls) -> str:
            return "crivo_sender"

        def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
            return Writer(transport, retry, self.options)

    return Sender


def outcomes(spark: SparkSession, ledger: str, again: bool = False) -> DataFrame:
    """The latest outcome of each key; without those that may be sent again if ``again``."""
    entries = Entries(ledger, "")
    entries.fs.create_dir(entries.top)
    files = [f for f in entries.fs.get_file_info(pafs.FileSelector(entries.top)) if not f.base_name.startswith("_")]
    if not files:
        return spark.createDataFrame([], OUTCOMES)
    rows = spark.read.schema(OUTCOMES).option("recursiveFileLookup", "true").parquet(f"{ledger.rstrip('/')}/outcomes").withColumn("_at", F.col("_metadata.file_modification_time"))
    rows = rows.groupBy("idempotency_key").agg(F.max_by(F.struct("status_http", "body", "tentativas"), "_at").alias("o")).select("idempotency_key", "o.*")
    final = F.coalesce(F.col("status_http").isNotNull() & ~((F.col("status_http") == 429) | (F.col("status_http") >= 500)), F.lit(False))
    return rows.filter(final) if again else rows


def send_once(df: DataFrame, transport: Transport, ledger: str, retry: Retry | None = None, flush: int = 100, again: bool = False) -> DataFrame:
    """``df`` with the outcome's columns of ``delivery.send``, each key sent once over all runs with this ledger.

    Rows with one key (all columns equal but those that begin with an underscore and ``line``) are one
    call and share its outcome. With ``again`` keys are sent anew whose failure may have gone away.
    What is returned reads the ledger, so no use of it sends.
    """
    spark, names, retry = df.sparkSession, payload_columns(df), retry or Retry()
    keyed = df.withColumn("idempotency_key", idempotency_key(names))
    payload = keyed.select("idempotency_key", *(F.col(f"`{n}`").cast("string").alias(n) for n in names)).dropDuplicates(["idempotency_key"])
    left = payload.join(outcomes(spark, ledger, again).select("idempotency_key"), "idempotency_key", "left_anti")
    spark.dataSource.register(_source(transport, retry))
    left.write.format("crivo_sender").mode("append").options(ledger=ledger, run=uuid.uuid4().hex, flush=str(flush)).save()
    told = outcomes(spark, ledger).withColumnRenamed("body", "_body")
    return with_outcome(keyed.join(told, "idempotency_key", "left")).drop("_body")
