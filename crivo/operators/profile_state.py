"""Profiles from stored states: what a table's profile needs, kept so that new rows are merged and not all scanned again.

A state is three tables: how often each column has each value, the first cells of each column that show
what a finding is about, and how often each row occurs, by digest. Each is an aggregate whose parts add
up, so the state of two tables together is made from the states of both.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import is_blank
from ..sources.files import stored
from . import profile
from .rules import cell_text

#: Cells of a column that are shown, and changes of a whole table.
SAMPLES, CHANGES = 5, 20


@dataclass(frozen=True)
class State:
    """``cells`` (column, value, n), ``heads`` (column, kind, line, value) and ``rows`` (key, n, filled) of the table's ``columns``."""

    columns: tuple[str, ...]
    cells: DataFrame
    heads: DataFrame
    rows: DataFrame

    def save(self, folder: str) -> None:
        for name in ("cells", "heads", "rows"):
            getattr(self, name).write.parquet(f"{folder}/{name}")
        self.cells.sparkSession.createDataFrame([(k, c) for k, c in enumerate(self.columns)], "at int, column string").coalesce(1).write.parquet(f"{folder}/columns")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> State:
        columns = tuple(r["column"] for r in spark.read.parquet(f"{folder}/columns").orderBy("at").collect())
        return State(columns, *(spark.read.parquet(f"{folder}/{name}") for name in ("cells", "heads", "rows")))

    def merged(self, other: State) -> State:
        """The state of both tables' rows; lines of the one must not be lines of the other."""
        if self.columns != other.columns:
            raise ValueError("the tables have different columns")
        cells, rows = self.cells.unionByName(other.cells), self.rows.unionByName(other.rows)
        return State(self.columns, cells.groupBy("column", "value").agg(F.sum("n").alias("n")), _first(self.heads.unionByName(other.heads)), rows.groupBy("key").agg(F.sum("n").alias("n"), F.first("filled").alias("filled")))


def _first(heads: DataFrame) -> DataFrame:
    """The first cells of each column and kind, of which Spark keeps so many in every task before the shuffle."""
    rank = F.row_number().over(W.partitionBy("column", "kind").orderBy("line"))
    return heads.withColumn("_k", rank).filter(F.col("_k") <= SAMPLES).drop("_k")


def state(df: DataFrame, columns: Sequence[str]) -> State:
    """The state of ``df`` (line and the columns), two aggregates and a top of each column."""
    long = profile.long_form(df, columns)
    v, filled = F.col("value"), ~is_blank(F.col("value"))
    kinds = F.array_compact(F.array(F.when(filled, "filled"), F.when(filled & profile.has_space_issue(v), "spaces")))
    heads = _first(long.select("column", F.explode(kinds).alias("kind"), "line", "value"))
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    n_filled = reduce(lambda a, b: a + b, (F.when(~is_blank(c), 1).otherwise(0) for c in cells))
    rows = df.select(F.sha2(F.to_json(F.array(*map(cell_text, cells))), 256).alias("key"), n_filled.alias("filled")).groupBy("key").agg(F.count("*").alias("n"), F.first("filled").alias("filled"))
    return State(tuple(columns), profile.cell_counts(df, columns), heads, rows)


def findings(of: State) -> DataFrame:
    """``profile.findings`` with samples: the first cells of a column with several types or surplus spaces, errors in order of their text."""
    found = profile.findings(profile.figures(of.cells))
    kind = F.create_map(F.lit("tipos_misturados"), F.lit("filled"), F.lit("espacos_extras"), F.lit("spaces"))
    heads = of.heads.groupBy("column", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("samples"))
    errors = of.cells.filter(parse.is_sheet_error(F.trim("value"))).groupBy("column").agg(F.slice(F.array_sort(F.collect_set("value")), 1, SAMPLES).alias("errors"))
    joined = found.withColumn("kind", kind[F.col("code")]).join(heads, ["column", "kind"], "left").join(errors, "column", "left")
    samples = F.when(F.col("code") == "erro_excel", F.col("errors")).otherwise(F.col("samples"))
    return joined.select("column", "code", "severity", "count", F.coalesce(samples, F.array().cast("array<string>")).alias("samples"))


def ends(of: State, typings: dict[str, profile.Typing]) -> DataFrame:
    """Rows (column, min, max) as text, of columns of numbers and dates; each distinct value is parsed once."""
    parts = []
    for name, typing in typings.items():
        if typing.type not in (*profile.NUMBERS, *profile.DATES):
            continue
        typed = profile.typed_value(F.col("value"), typing)
        text = lambda c, t=typing.type: parse.trimmed_number(c) if t in profile.NUMBERS else F.date_format(c, "yyyy-MM-dd")
        parts.append(of.cells.filter(F.col("column") == name).agg(F.lit(name).alias("column"), text(F.min(typed)).alias("min"), text(F.max(typed)).alias("max")))
    return reduce(DataFrame.unionByName, parts) if parts else of.cells.sparkSession.createDataFrame([], "column string, min string, max string")


def report(of: State, changes: DataFrame | None = None, reading: dict | None = None, now: datetime | None = None) -> dict:
    """The profile as a tree of plain values: a row for each column and finding, and some samples, come to the driver.

    ``changes`` are rows (line, column, original, normalized, rule), of which the first are shown; ``reading``
    is what is known of the file (name, sheet, header row, warnings).
    """
    cells = stored(of.cells, "cells")
    of = State(of.columns, cells, of.heads, of.rows)
    figures = {r["column"]: r for r in profile.figures(cells).collect()}
    typings = {c: profile.decide(figures[c]) for c in of.columns if c in figures}
    least = {r["column"]: r for r in ends(of, typings).collect()}
    shown: dict[str, list] = {}
    for r in of.heads.filter("kind = 'filled'").orderBy("column", "line").collect():
        shown.setdefault(r["column"], []).append(r["value"])
    at = {c: k for k, c in enumerate(of.columns)}
    found = sorted((r.asDict() for r in findings(of).collect()), key=lambda f: (at[f["column"]], f["code"]))
    table = profile.table_of(of.rows, len(of.columns)).first()
    n_changes, first = (changes.count(), [r.asDict() for r in changes.orderBy("line", "column").limit(CHANGES).collect()]) if changes is not None else (0, [])
    columns = [
        {
            "name": c, "inferred_type": t.type, "type_confidence": round(t.confidence, 3), "total_count": f["rows"], "filled_count": f["filled"], "empty_count": f["empty"], "fill_rate": f["fill_rate"],
            "distinct_count": f["distinct_count"], "uniqueness_rate": f["uniqueness_rate"], "duplicate_value_count": f["surplus"], "mixed_types": t.type == "misto", "excel_error_count": f["sheet_errors"],
            "whitespace_issue_count": f["space_issues"], "minimum": least[c]["min"] if c in least else None, "maximum": least[c]["max"] if c in least else None, "sample_values": shown.get(c, []), "observations": list(t.observations),
        }
        for c, t in typings.items() for f in [figures[c]]
    ]
    return {
        "metadata": {"generated_at": (now or datetime.now(UTC)).isoformat(), **{k: v for k, v in (reading or {}).items() if k in ("source_file", "file_type")}},
        "leitura": {**{k: v for k, v in (reading or {}).items() if k not in ("source_file", "file_type", "warnings")}, "conversion_count": n_changes, "conversions_sample": first},
        "estrutura": {
            "row_count": table["rows"], "column_count": len(of.columns), "total_cells": table["cells"], "filled_cells": table["filled_cells"], "empty_cells": table["cells"] - table["filled_cells"], "fill_rate": table["fill_rate"],
            "duplicate_row_count": table["duplicate_rows"], "completely_empty_row_count": table["empty_rows"], "completely_empty_column_count": sum(c["filled_count"] == 0 for c in columns),
            "mixed_type_column_count": sum(c["mixed_types"] for c in columns), "excel_error_count": sum(c["excel_error_count"] for c in columns),
        },
        "columns": columns,
        "findings": found,
        "reader_warnings": (reading or {}).get("warnings", []),
    }
