"""Running a pipeline: steps around one result contract, and a record of the run in the audit log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession

from ..operators import audit

STATUSES = ("success", "failure", "partial", "dry_run", "skipped")


class ExpectedError(Exception):
    """A failure that a run reports instead of raising."""


@dataclass
class Result:
    status: str
    message: str = ""
    rows_affected: int = 0
    rows_failed: int = 0
    duration_ms: int = 0
    data: dict[str, Any] = field(default_factory=dict)
    error: str | None = None

    def __post_init__(self) -> None:
        if self.status not in STATUSES:
            raise ValueError(f"unknown status {self.status!r}")


class Pipeline:
    """Subclasses give ``name`` and ``execute``; ``before`` and ``after`` may be overridden. Only ExpectedError becomes a result."""

    name = "pipeline"

    def before(self) -> None:
        pass

    def execute(self) -> Result:
        raise NotImplementedError

    def after(self, result: Result) -> None:
        pass

    def run(self, spark: SparkSession, log: str | None = None, user: str = "", environment: str = "", inputs: str = "", secret: str = "") -> Result:
        """``inputs`` tells what the run is given; the log has its HMAC by ``secret``, and not what it is."""
        began = time.monotonic()
        try:
            self.before()
            result = self.execute()
        except ExpectedError as e:
            result = Result("failure", str(e), error=type(e).__name__)
        result.duration_ms = int((time.monotonic() - began) * 1000)
        self.after(result)
        if log:
            row = (None, datetime.now(UTC), self.name, user, result.status, environment, "", None, result.duration_ms, result.rows_affected, result.rows_failed, result.error, inputs)
            try:
                audit.append(spark.createDataFrame([row], f"{audit.SCHEMA}, _inputs string"), log, "_inputs", secret)
            except Exception as e:  # noqa: BLE001  a log that can't be written doesn't undo the run
                result.data["audit_error"] = str(e)
        return result


def chained(extract: Callable[[], Any], deliver: Callable[[Any], Result]) -> Result:
    """Extraction handed to delivery without a file between them; a failure says in which stage it was."""
    try:
        rows = extract()
    except ExpectedError as e:
        return Result("failure", str(e), data={"stage": "extract"}, error=type(e).__name__)
    try:
        return deliver(rows)
    except ExpectedError as e:
        return Result("failure", str(e), data={"stage": "send"}, error=type(e).__name__)
