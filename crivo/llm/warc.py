"""Operator 7: WARC archives, written from pages and read back as a table of record chunks.

Payloads are told apart by SHA-256 in Spark; of equal ones the page with the smallest id is kept
and the others refer to it (one grouped minimum and one join on the digest, which adaptive
execution splits where a third of all pages are copies). Every task then streams its pages into
gzip members, one per record, in shards of bounded size, each under a name of the attempt and
renamed when whole.

Reading streams a shard: a payload comes as rows (record, chunk number) of at most ``chunk_bytes``,
each with the running SHA-256 and byte count, so neither side holds more of an oversized record
than a chunk. The last chunk's digest is the payload's.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table
from .token_planes import filesystem

#: Bytes of a payload in one chunk row, and of records in one shard before the next begins.
CHUNK_BYTES, SHARD_BYTES = 1 << 20, 256 << 20
#: Payloads below this many bytes are stored each time.
REVISIT_BYTES = 100
RECORD_URI = "urn:page:"

# Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and the page that each revisits (null: a response)."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256))
    first = (
        page.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "first")
    )
    return page.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


class _Writer:
    def __init__(self, folder: str, name: str) -> None:
        self.fs, top = filesystem(folder)
        self.fs.create_dir(top, recursive=True)
        self.name, self.final, self.own = name, f"{top}/{name}", f"{top}/.{name}.{uuid.uuid4().hex}"
        self.out, self.n, self.size = self.fs.open_output_stream(self.own, compression=None), 0, 0

    def record(self, page_id: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None) -> None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_URI}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
        if url is not None:
            head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
        head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
        if refers_to is not None:
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_URI}{refers_to}>"]
            payload = payload[:0]
        head.append(f"Content-Length: {len(block) + len(payload)}")
        member = zlib.compressobj(3, zlib.DEFLATED, 31)
        self.out.write(member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block))
        for a in range(0, len(payload), CHUNK_BYTES):
            self.out.write(member.compress(payload[a : a + CHUNK_BYTES]))
        self.out.write(member.compress(b"\r\n\r\n") + member.flush())
        self.n += 1
        self.size += len(payload)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.own, self.final)
        return {"shard": self.name, "n_records": self.n}


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``pages``; the list of shards (shard, n_records).

    A null html is an empty payload, a null url leaves the target out. A page without an id is
    always a response and never referred to; rows that repeat the smallest id of their payload
    are all responses. Other columns don't matter; an empty table has no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, writer, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            page, url, payload, digest, refers = batch.columns
            for k in range(batch.num_rows):
                if writer is None:
                    writer, n = _Writer(folder, f"pages-{task:08d}-{n:05d}.warc.gz"), n + 1
                writer.record(page[k].as_py(), url[k].as_py(), memoryview(payload[k].as_buffer()), digest[k].as_py(), refers[k].as_py())
                if writer.size >= SHARD_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return stored(planned(pages).mapInArrow(run, "shard string, n_records long"), "warc-shards")


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        key, _, value = line.partition(b":")
        out[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(RECORD_URI)
    return int(number) if number else None


def records(stream: io.BufferedReader, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of one archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = _fields(stream)
        left = int(head["content-length"])
        first = stream.readline()
        http, at = {}, len(first)
        while at < left and (line := stream.readline()):
            at += len(line)
            if not line.strip():
                break
            key, _, value = line.partition(b":")
            http[key.decode().lower()] = value.decode("utf-8", "replace").strip()
        left -= at
        row = {"record_id": head["warc-record-id"].strip("<>"), "page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to"))}
        stated = head["warc-payload-digest"].removeprefix("sha256:")
        if row["record_type"] == "revisit":
            yield row | {"chunk": 0, "last": True, "data": b"", "payload_bytes": int(http["content-length"]), "payload_digest": stated}
            continue
        sha, n, chunk = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"{row['record_id']} ends early")
            left -= len(data)
            n += len(data)
            sha.update(data)
            if not left and sha.hexdigest() != stated:
                raise ValueError(f"{row['record_id']} has another payload than its digest says")
            yield row | {"chunk": chunk, "last": not left, "data": data, "payload_bytes": n, "payload_digest": sha.hexdigest()}
            chunk += 1
            if not left:
                break


_CHUNKS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def read_chunks(shards: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunk rows of all shards; payload_bytes and payload_digest run up to and with each chunk.

    A revisit is one chunk without data, with the size and digest of the full payload. ``data``
    false leaves the bytes null once they are digested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                files, top = filesystem(folder)
                with files.open_input_stream(f"{top}/{shard}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                    for row in records(stream, chunk_bytes):
                        size += len(row["data"])
                        held.append(row if data else row | {"data": None})
                        if len(held) >= 4000 or data and size >= 16 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(held, _CHUNKS)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _CHUNKS)

    schema = "record_id string, page_id long, url string, record_type string, refers_to long, chunk int, last boolean, data binary, payload_bytes long, payload_digest string"
    return shards.select("shard").repartition(max(1, shards.count())).mapInArrow(run, schema)


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    shards = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_chunks(shards, folder, data=False).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
