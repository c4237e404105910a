"""Routing by rules: the first rule whose pattern fits gives a row its destination."""

from __future__ import annotations

import fnmatch
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import numbered

ACTIONS, CONFLICTS = ("move", "copy"), ("skip", "overwrite", "rename")


@dataclass(frozen=True)
class Route:
    name: str
    patterns: tuple[str, ...]
    destination: str


@dataclass(frozen=True)
class Routes:
    rules: tuple[Route, ...] = field(default_factory=tuple)
    target_root: str = ""
    action: str = "move"
    on_conflict: str = "skip"

    @staticmethod
    def load(text: str) -> Routes:
        raw = yaml.safe_load(text) or {}
        out = Routes(tuple(Route(r["name"], tuple(r["patterns"]), r.get("destination", "")) for r in raw.get("rules", [])), raw.get("target_root", ""), raw.get("action", "move"), raw.get("on_conflict", "skip"))
        if out.action not in ACTIONS or out.on_conflict not in CONFLICTS or not out.rules or any(not r.patterns for r in out.rules):
            raise ValueError("rules need patterns, and a known action and on_conflict")
        return out


def glob(pattern: str, case_sensitive: bool = True) -> str:
    """A shell pattern as a regular expression for a whole name."""
    body = fnmatch.translate(pattern)
    body = body.removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
    return rf"\A(?s{'' if case_sensitive else 'i'}:{body})\z"


def matched_rule(name: Column, routes: Routes, case_sensitive: bool = True) -> Column:
    """The first rule with a pattern that fits, else ``unmatched``: one conditional chain, no join."""
    out = F.lit("unmatched")
    for rule in reversed(routes.rules):
        test = F.lit(False)
        for p in rule.patterns:
            test = test | name.rlike(glob(p, case_sensitive))
        out = F.when(test, rule.name).otherwise(out)
    return out


#: Rules that are sent to all rows.
MAX_RULES = 10_000


def matched_by_table(df: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """The same from a table of rules (ord, rule, regex), for rule sets too long for a chain; more than ``MAX_RULES`` are refused.

    The rules go to every row as one list in their order, so each row stays, repeated ones as well.
    """
    if rules.count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    own = next(c for c in map("_rules{}".format, range(len(df.columns) + 1)) if c not in df.columns)
    listed = rules.filter("ord is not null").agg(F.array_sort(F.collect_list(F.struct("ord", "rule", "regex"))).alias(own))
    fits = F.filter(own, lambda r: F.rlike(F.col(f"`{name}`"), r["regex"]))
    return df.crossJoin(F.broadcast(listed)).select(*(f"`{c}`" for c in df.columns), F.coalesce(F.get(fits, F.lit(0))["rule"], F.lit("unmatched")).alias("rule"))


def destination(name: Column, modified: Column, routes: Routes, rule: Column) -> Column:
    """The rule's template with {year}, {month:02d}, {day:02d} and {ext} of the row, and the name behind it."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)\z", 1))
    out = F.lit(None).cast("string")
    for r in routes.rules:
        c = F.lit(r.destination)
        for mark, value in (("{year}", F.date_format(modified, "yyyy")), ("{month:02d}", F.date_format(modified, "MM")), ("{day:02d}", F.date_format(modified, "dd")), ("{month}", F.month(modified).cast("string")), ("{day}", F.dayofmonth(modified).cast("string")), ("{ext}", ext)):
            c = F.replace(c, F.lit(mark), value)
        out = F.when(rule == r.name, F.concat_ws("/", F.lit(routes.target_root) if routes.target_root else F.lit(None), F.nullif(c, F.lit("")), name)).otherwise(out)
    return out


#: Numbers that a renamed file may get; fixed by the format of names.
LAST_NUMBER = 1_000
NUMBERED = r"\A(.*)_([1-9][0-9]{0,3})(\.[^./]+)?\z"


def _numbers_taken(names: DataFrame) -> DataFrame:
    """Rows (destination, below) of ``names`` (destination): for each name with numbered ones ``stem_N``, how many free numbers are below each of these, ascending."""
    part = lambda k: F.regexp_extract("destination", NUMBERED, k)
    used = names.filter(F.col("destination").rlike(NUMBERED)).select(F.concat(part(1), part(3)).alias("destination"), part(2).cast("int").alias("n")).filter(F.col("n") <= LAST_NUMBER).distinct()
    # at most LAST_NUMBER of a name
    listed = used.groupBy("destination").agg(F.array_sort(F.collect_list("n")).alias("n"))
    return listed.select("destination", F.transform("n", lambda n, i: n - i - 1).alias("below"))


def plan(files: DataFrame, routes: Routes, existing: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """``files`` with rule, destination and status: what would be done with each file, by the conflict policy.

    A destination that exists (``existing`` has its path), or that an earlier file has, is a conflict.
    Of files with one destination the first by ``order`` (a numeric column; else a hash of the row) has
    it, if it is free. The others are ``skipped``, or done all the same (``overwrite``), or take the
    free numbers ``stem_N`` from 1 on (``rename``), where names that exist and names that files bring
    along are not free; above ``LAST_NUMBER`` the status is ``error`` and there is no destination. So
    no two files are done with one destination but under ``overwrite``. A name that many files have is
    numbered in ranges, not in one task.
    """
    ruled = files.withColumn("rule", matched_rule(F.col("name"), routes))
    ruled = ruled.withColumn("destination", destination(F.col("name"), F.col("modificationTime"), routes, F.col("rule")))
    done = "moved" if routes.action == "move" else "copied"
    columns, fits = [*ruled.columns, "status"], F.col("rule") != "unmatched"
    rest = ruled.filter(~fits).withColumn("status", F.lit("unmatched"))
    if routes.on_conflict == "overwrite":
        return ruled.filter(fits).withColumn("status", F.lit(done)).unionByName(rest)
    ranked = numbered(ruled.filter(fits).withColumn("_order", F.col(f"`{order}`") if order else F.xxhash64(*(f"`{c}`" for c in files.columns))), "destination", "_order", "_k")
    there = existing.select(F.col("path").alias("destination")).distinct() if existing is not None else ruled.select("destination").limit(0)
    ranked = ranked.join(there.withColumn("_there", F.lit(True)), "destination", "left")
    # how many files before this one go by another name, this one counted; 0 where it keeps its own
    nth = F.col("_k") - F.when(F.col("_there"), 0).otherwise(1)
    if routes.on_conflict == "skip":
        return ranked.withColumn("status", F.when(nth > 0, "skipped").otherwise(done)).select(columns).unionByName(rest)
    taken = _numbers_taken(there.union(ruled.filter(fits).select("destination")).distinct())
    free = nth + F.coalesce(F.size(F.filter("below", lambda x: x < nth)), F.lit(0))
    named = F.concat(F.regexp_extract("destination", r"\A(.*?)(\.[^./]+)?\z", 1), F.lit("_"), free.cast("string"), F.regexp_extract("destination", r"\A(.*?)(\.[^./]+)?\z", 2))
    out = ranked.join(taken, "destination", "left").withColumn("status", F.when((nth > 0) & (free > LAST_NUMBER), "error").otherwise(done))
    out = out.withColumn("destination", F.when(nth == 0, F.col("destination")).when(F.col("status") == done, named))
    return out.select(columns).unionByName(rest)


DONE = "source string, destination string, action string, status string, error string"


def local_file(source: str, destination: str, action: str) -> None:
    """Moves or copies within a file system that every task mounts; done again, it finds that it is done.

    What is copied is complete before it has its name.
    """
    if action == "move" and not os.path.exists(source) and os.path.exists(destination):
        return
    os.makedirs(os.path.dirname(destination), exist_ok=True)
    half = f"{destination}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(source, half)
        os.replace(half, destination)
    finally:
        if os.path.exists(half):
            os.remove(half)
    if action == "move":
        os.remove(source)


def keep_plan(planned: DataFrame, journal: str, action: str) -> None:
    """Writes what ``plan`` gives for files with a ``path`` into the new folder ``journal``, for ``execute``."""
    done = F.col("status").isin("moved", "copied")
    planned.filter(done).select(F.col("path").alias("source"), "destination", F.lit(action).alias("action")).write.parquet(f"{journal}/plan")


def execute(spark: SparkSession, journal: str, act: Callable[[str, str, str], None] = local_file) -> DataFrame:
    """Does what a kept plan says and gives rows (source, destination, action, status, error), status ``success`` or ``error``.

    Outcomes are written beside the plan. A run that is repeated, or comes after one that was killed,
    takes the same plan and does what has no success yet; ``act`` must know what it has done before.
    """
    planned = spark.read.parquet(f"{journal}/plan")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for row in batch.itertuples(index=False):
                try:
                    act(row.source, row.destination, row.action)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield batch.assign(status=["error" if e else "success" for e in errors], error=errors)

    done = spark.read.schema(DONE).parquet(*_runs(spark, journal)) if _runs(spark, journal) else spark.createDataFrame([], DONE)
    left = planned.join(done.filter("status = 'success'").select("source", "destination"), ["source", "destination"], "left_anti")
    left.select("source", "destination", "action").mapInPandas(run, DONE).write.parquet(f"{journal}/run-{uuid.uuid4().hex}")
    told = spark.read.schema(DONE).parquet(*_runs(spark, journal))
    # a success, where there is one
    return told.groupBy("source", "destination", "action").agg(F.max("status").alias("status"), F.min_by("error", F.col("status") != "success").alias("error"))


def _runs(spark: SparkSession, journal: str) -> list[str]:
    """The folders of runs that came to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(journal)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)]
    return sorted(p.toString() for p in found if p.getName().startswith("run-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def counters(planned: DataFrame) -> DataFrame:
    return planned.groupBy("status").agg(F.count("*").alias("n"))


def included(files: DataFrame, excludes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files none of whose path parts fits an exclusion, and the others."""
    any_fits = "|".join(f"(?:{glob(p)})" for p in excludes)
    test = F.exists(F.split("path", "/"), lambda part: part.rlike(any_fits)) if excludes else F.lit(False)
    return files.filter(~test), files.filter(test)
