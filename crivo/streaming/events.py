"""Streams: a rate limiter, replays, expiry and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import numbered
from ..sources.files import stored

DECISIONS = "key long, event_id long, ts timestamp, allowed boolean"


def decide(hits: list[float], now: float, limit: int, window: float) -> tuple[bool, list[float]]:
    """Whether fewer than ``limit`` allowed hits lie in the window; only allowed ones are kept."""
    hits = [h for h in hits if now - h <= window]
    return (True, [*hits, now]) if len(hits) < limit else (False, hits)


def rate_limited(events: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """Streamed rows (key, event_id, ts) with ``allowed``. The state of a key is its allowed hits, ``limit`` at most."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        hits, out = list(state.get[0]) if state.exists else [], []
        for ts in rows["ts"]:
            ok, hits = decide(hits, ts.timestamp(), limit, window)
            out.append(ok)
        state.update((hits,))
        yield rows.assign(allowed=out)[["key", "event_id", "ts", "allowed"]]

    return events.groupBy("key").applyInPandasWithState(run, DECISIONS, "hits array<double>", "append", GroupStateTimeout.NoTimeout)


class _Limiter(StatefulProcessor):
    """A key's allowed hits, and a timer for when it has been idle long enough to be forgotten."""

    def __init__(self, limit: int, window: float, idle: float) -> None:
        self.limit, self.window, self.idle = limit, window, int(1000 * idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getValueState("hits", "hits array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        # a state without a hit is that of a key which has had denied ones only
        hits, out = list(self.hits.get()[0]) if self.hits.exists() else [], []
        for ts in batch["ts"]:
            ok, hits = decide(hits, ts.timestamp(), self.limit, self.window)
            out.append(ok)
        self.hits.update((hits,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(batch["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle)
        yield batch.assign(allowed=out)[["key", "event_id", "ts", "allowed"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited_expiring(events: DataFrame, limit: int, window: float = 60.0, idle: float = 900.0, delay: str = "1 minute") -> DataFrame:
    """``rate_limited`` with states that go: a key that has had no event for ``idle`` seconds of event time is forgotten.

    Events later than the watermark (``delay`` behind the latest) have no decision: they are left out
    and counted by Spark among the rows dropped. ``idle`` is one window at least, as the limiter looks
    back that far. State is kept in RocksDB, which the session has to name as its state store.
    """
    if idle < window:
        raise ValueError("a key must not be forgotten within its window")
    processor = _Limiter(limit, window, idle)
    return events.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(processor, DECISIONS, "append", "eventTime")


#: Events of a key that one task decides on, and most rounds of handing states on.
RANGE_ROWS, ROUNDS = 200_000, 10_000


def rate_limited_batch(events: DataFrame, limit: int, window: float = 60.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The same over a finished table.

    The limiter is a state machine whose state is a key's allowed hits within one window, ``limit`` at
    most. A key's events are numbered in ranges of time and cut into ranges of ``range_rows``; a range
    is decided by one task, in order, from the state at its start. All ranges begin with no hits; then
    those are decided again whose start isn't the state that the range before has ended in, until all
    agree. Decisions from different starts soon fall together, so few rounds are needed, and a key of
    any size is many tasks. Events at one time are in order of event_id; ones without a time or key are
    a range of their own key (null), and null times come first and are not limited.
    """
    at = F.col("ts").cast("timestamp").cast("double")
    rows = stored(events.select("key", "event_id", "ts", F.coalesce(at, F.lit(float("-inf"))).alias("at")), "limited")
    bounds = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > range_rows)
    # only keys of more than one range are cut
    cut = numbered(rows.join(bounds.select("key"), "key", "left_semi"), "key", "at", "_k").select("key", "event_id", "ts", "at", F.floor((F.col("_k") - 1) / range_rows).alias("part"))
    # equal times stay together, or their order would depend on how they are cut
    first = cut.groupBy("key", "at").agg(F.min("part").alias("part"))
    cut = cut.drop("part").join(first, ["key", "at"])
    whole = rows.join(bounds.select("key"), "key", "left_anti").withColumn("part", F.lit(0).cast("long"))
    ranges = stored(whole.unionByName(cut), "ranges")
    spark = events.sparkSession

    def passed(starts: DataFrame | None, ends: bool) -> DataFrame:
        """The decisions of ranges from their starts (key, part, hits), or the states that they end in."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, hits, made = None, [], []
            for batch in batches:
                out = []
                for key, part, now, start in zip(batch["key"], batch["part"], batch["at"], batch["hits"], strict=True):
                    key = None if pd.isna(key) else key
                    if (key, part) != last:
                        if ends and last is not None:
                            made.append((*last, hits))
                        last, hits = (key, part), [] if start is None else list(start)
                    ok, hits = (True, hits) if now == float("-inf") else decide(hits, now, limit, window)
                    out.append(ok)
                if not ends:
                    yield batch.assign(allowed=out)[["key", "event_id", "ts", "allowed"]]
            if ends and last is not None:
                made.append((*last, hits))
            if ends:
                yield pd.DataFrame(made, columns=["key", "part", "hits"])

        of = ranges.withColumn("hits", F.lit(None).cast("array<double>")) if starts is None else ranges.join(starts.withColumnRenamed("part", "_part").withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "inner" if ends else "left").drop("_key", "_part")
        # rows stream through a task in order, so a range takes the memory of one batch
        sorted_ = of.repartition("key", "part").sortWithinPartitions("key", "part", "at", "event_id")
        return sorted_.mapInPandas(run, f"key {dict(ranges.dtypes)['key']}, part long, hits array<double>" if ends else DECISIONS)

    several = ranges.groupBy("key").agg(F.max("part").alias("last")).filter("last > 0")
    if several.isEmpty():
        return passed(None, False)
    parts = stored(ranges.join(several.select("key"), "key", "left_semi").select("key", "part").distinct(), "parts")
    starts = stored(parts.withColumn("hits", F.array().cast("array<double>")), "starts")
    changed, states = starts, spark.createDataFrame([], starts.schema)
    for _ in range(ROUNDS):
        new = stored(passed(changed, True), "ends")
        states = stored(states.join(new, ["key", "part"], "left_anti").unionByName(new), "ends")
        # ranges of a key are numbered without gaps but for those whose events all have a time of the range before
        order = W.partitionBy("key").orderBy("part")  # a row per range
        told = states.withColumn("next", F.lead("part").over(order)).filter("next is not null").select("key", F.col("next").alias("part"), F.col("hits").alias("handed"))
        changed = stored(starts.join(told, ["key", "part"]).filter(F.col("hits") != F.col("handed")).select("key", "part", F.col("handed").alias("hits")), "starts")
        if changed.isEmpty():
            return passed(starts, False)
        starts = stored(starts.join(changed.select("key", "part"), ["key", "part"], "left_anti").unionByName(changed), "starts")
    raise RuntimeError("the states did not settle")


def hits_in_window(events: DataFrame, window: int = 60) -> DataFrame:
    """An approximation that counts denied hits as well: each event's number of events in its last seconds."""
    # a key is cut into buckets of one window; events also go to the next bucket, whose events look back at them
    at = F.col("ts").cast("timestamp").cast("long")
    bucket = F.floor(at / max(window, 1))
    both = F.when(at.isNull(), F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")))).otherwise(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own"))))
    span = W.partitionBy("key", "_in.bucket").orderBy(at).rangeBetween(-window, 0)
    return events.withColumn("_in", F.explode(both)).withColumn("hits", F.count("*").over(span)).filter("_in.own").drop("_in")


def first_per_key(stream: DataFrame, key: str = "idempotency_key", time: str = "ts", delay: str = "15 minutes") -> DataFrame:
    """Replays dropped: a key counts once within the watermark, after which its state goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def unexpired(df: DataFrame, now, time: str = "ts", minutes: int = 15) -> DataFrame:
    return df.filter(F.col(time) >= F.lit(now) - F.expr(f"interval {minutes} minutes"))


def windowed_counts(stream: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per window and type; state goes as the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


class Progress(StreamingQueryListener):
    """Calls back with (rows so far, rows of the batch); the callback's errors don't reach the query."""

    def __init__(self, callback: Callable[[int, int], None]) -> None:
        self.callback, self.total = callback, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += event.progress.numInputRows
        try:
            self.callback(self.total, event.progress.numInputRows)
        except Exception:  # noqa: BLE001
            pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
