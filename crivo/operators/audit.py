"""The audit log: appending, reading and the report over it.

Counts, shares and averages are grouped aggregates with partial sums; the latest entries are
top-k. Nothing sorts the whole log.
"""

from __future__ import annotations

import os
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.web import hmac_sha256

#: Parts of a log in which rows are numbered apart.
RANGES = 100
FAILURES = ("failure", "partial")
SCHEMA = "id long, timestamp timestamp, task_name string, user string, status string, environment string, input_hash string, args string, duration_ms long, rows_affected long, rows_failed long, error_message string"


#: Of an id's 63 bits those of a row's place within its append, and of these those within a part.
ROW_BITS, PART_BITS = 40, 24


def reserved(spark: SparkSession, path: str) -> int:
    """The number of this append among all to the log: the first free one, taken by making its file, which one caller can only."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(f"{path.rstrip('/')}/_appends")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    n = 1 + max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)
    while True:
        name = f"{n:012d}"
        try:
            if fs.getUri().getScheme() == "file":  # whose Hadoop client looks first and creates then
                os.close(os.open(os.path.join(at.toUri().getPath(), name), os.O_CREAT | os.O_EXCL))
            else:
                fs.create(jvm.Path(at, name), False).close()
            return n
        except (FileExistsError, Py4JJavaError):  # another caller was faster
            if not fs.exists(jvm.Path(at, name)):
                raise
        n += 1


def append(df: DataFrame, path: str, inputs: str | None = None, secret: str = "") -> None:
    """Adds entries; a log is only ever appended to, each time by a folder of its own, so that appends don't meet.

    Entries without an id get one: the append's number, which no other append has, and below it their
    place in order of time. With ``inputs``, a column that is not stored, input_hash is the HMAC of each
    entry's input by ``secret`` (without one its SHA-256), empty where there is no input.
    """
    spark = df.sparkSession
    if inputs:
        digest = hmac_sha256(F.col(f"`{inputs}`").cast("string"), secret)
        df = df.withColumn("input_hash", F.when(F.coalesce(F.col(f"`{inputs}`").cast("string"), F.lit("")) == "", "").otherwise(digest))
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(None).cast("long"))
    given, number = df.filter("id is not null"), reserved(spark, path)
    order = F.monotonically_increasing_id()
    row, part = order.bitwiseAND((1 << 33) - 1), F.shiftright(order, 33)
    fits = (row < 1 << PART_BITS) & (part < 1 << (ROW_BITS - PART_BITS))
    place = F.when(fits, F.shiftleft(part, PART_BITS) + row).otherwise(F.raise_error(F.lit("too many entries for one append")).cast("long"))
    new = df.filter("id is null").repartitionByRange("timestamp").sortWithinPartitions("timestamp").withColumn("id", F.lit(number << ROW_BITS) + place)
    columns = [c for c in T._parse_datatype_string(SCHEMA).fieldNames() if c in df.columns]
    given.select(columns).unionByName(new.select(columns)).write.parquet(f"{path.rstrip('/')}/append-{number:012d}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def typed(df: DataFrame) -> DataFrame:
    """Entries from text columns: what is no timestamp is null, what is no number 0."""
    number = lambda n: F.coalesce(F.col(n).cast("string").try_cast("long"), F.lit(0)).alias(n)
    return df.select("id", F.try_to_timestamp(F.col("timestamp").cast("string")).alias("timestamp"), *(c for c in df.columns if c not in ("id", "timestamp", "duration_ms", "rows_affected", "rows_failed")), *map(number, ("duration_ms", "rows_affected", "rows_failed")))


def period(since: str | None = None, until: str | None = None, days: int | None = None, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """The half-open period of a report; times without zone are UTC; ``since`` goes before ``days``."""
    at = lambda s: None if s is None else (t if (t := datetime.fromisoformat(s)).tzinfo else t.replace(tzinfo=UTC))
    start, end = at(since), at(until)
    if start is None and days is not None:
        start = (now or datetime.now(UTC)) - timedelta(days=days)
    if start and end and start >= end:
        raise ValueError("since must be before until")
    return start, end


def filtered(df: DataFrame, task: str | None = None, status: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """All given conditions at once; since is in, until is out. They reach the scan."""
    for test in (
        F.col("task_name") == task if task else None,
        F.col("status") == status if status else None,
        F.col("timestamp") >= F.lit(since) if since else None,
        F.col("timestamp") < F.lit(until) if until else None,
    ):
        if test is not None:
            df = df.filter(test)
    return df


def counts(df: DataFrame, by: str, share: bool = False) -> DataFrame:
    """Entries per value of ``by``, most first; with their share of all in percent."""
    out = df.groupBy(by).agg(F.count("*").alias("n"))
    if share:
        out = out.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 1))
    return out


def crosstab(df: DataFrame) -> DataFrame:
    return df.groupBy("task_name", "status").agg(F.count("*").alias("n"))


def average_duration(df: DataFrame) -> DataFrame:
    return df.filter(F.col("duration_ms").isNotNull()).groupBy("task_name").agg(F.round(F.avg("duration_ms"), 2).alias("avg_ms"))


def totals(df: DataFrame) -> DataFrame:
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return df.agg(F.count("*").alias("n"), some("rows_affected"), some("rows_failed"), F.count_if(F.col("status").isin(*FAILURES)).alias("failures"))


def summary(df: DataFrame) -> DataFrame:
    """Per task in one aggregate: entries, entries by outcome, average duration, rows."""
    per = lambda s: F.count_if(F.col("status") == s).alias(s)
    return df.groupBy("task_name").agg(
        F.count("*").alias("n"), per("success"), per("partial"), per("failure"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("rows_affected")
    )


def latest(df: DataFrame, limit: int = 100, only: Column | None = None) -> DataFrame:
    """The last entries by id."""
    if limit <= 0:
        raise ValueError("limit must be above 0")
    return (df if only is None else df.filter(only)).orderBy(F.col("id").desc()).limit(limit)


def recent_failures(df: DataFrame, limit: int = 5) -> DataFrame:
    return latest(df, limit, F.col("status").isin(*FAILURES))


def verified(df: DataFrame, inputs: DataFrame, digest: Column) -> DataFrame:
    """Entries joined with given inputs (id, input): whether the stored digest is theirs; an empty one never is."""
    joined = df.join(inputs, "id")
    return joined.select("id", ((F.col("input_hash") != "") & (F.col("input_hash") == digest)).alias("verified"))


def numbered(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``df`` with each row's number (from 1) within its key by a numeric column, as row_number has it.

    Rows are numbered within ranges of that column, and what a key has in the ranges before is added:
    a key of any size is sorted by many tasks.
    """
    bounds = df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    above = sum(((F.col(order) > b).cast("int") for b in sorted(set(bounds))), F.lit(0))
    ranged = df.withColumn("_range", F.coalesce(above, F.lit(0)))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(key, "_range").orderBy(order))
    joined = ranged.withColumn(name, own).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def attached(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """The k-th run of a task with the k-th oldest entry of that task; runs beyond the entries stay alone."""
    return numbered(runs, "task_name", "run_id", "k").join(numbered(entries, "task_name", "id", "k"), ["task_name", "k"], "left")
