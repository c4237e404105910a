"""Folders of files as tables, JSON record stores, and their fingerprints."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; in local mode one of this machine where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once in the shared folder and read back, so that what reads it twice has the same rows."""
    path = shared_dir(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Rows (path, name, modificationTime, length); contents are not read. Spark's file source leaves empty files out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length")


def fingerprint(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of JSON records (one array per file)."""
    return spark.read.json(path, schema=schema, multiLine=True)


def by_key(store: DataFrame, test: Column) -> DataFrame:
    """The records that a point test fits; it reaches the scan where the format allows."""
    return store.filter(test)
