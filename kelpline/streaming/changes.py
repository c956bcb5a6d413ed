"""Change events: tiers, routing and debouncing, the same expressions for batch and Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "path string, kind string, ts timestamp"
HOT_SECONDS, WARM_REFERENCES, WARM_ACCESSES = 300, 5, 10


def tier(entry: Column, seconds_since: Column, references: Column, accesses: Column, hot_seconds: int = HOT_SECONDS) -> Column:
    """Hot for entry points and recent accesses, Warm for much used files, Cold otherwise and for unknown paths."""
    return F.when(F.coalesce(entry, F.lit(False)) | (seconds_since < hot_seconds), "Hot").when((references > WARM_REFERENCES) | (accesses > WARM_ACCESSES), "Warm").otherwise("Cold")


def action(kind: Column, tier_: Column) -> Column:
    return F.when(kind == "Deleted", "RemoveFromIndex").when(tier_ == "Hot", "IndexImmediate").when(tier_ == "Warm", "QueueForIndex").otherwise("Ignore")


def access_state(log: DataFrame) -> DataFrame:
    """Access log (path, ts, is_entry, references) folded to one row per path."""
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_access"), F.max("is_entry").alias("is_entry"), F.max_by("references", "ts").alias("references"))


def route(events: DataFrame, state: DataFrame, now: Column | None = None) -> DataFrame:
    """Events with tier and action; ``state`` is the folded access state (static side of a streaming join)."""
    at = F.col("ts") if now is None else now
    s = state.select(F.col("path").alias("s_path"), "accesses", "last_access", "is_entry", "references")
    both = events.join(s, F.col("path") == F.col("s_path"), "left")
    seconds = F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.col("last_access").cast("timestamp"))
    t = tier(F.col("is_entry"), seconds, F.col("references"), F.col("accesses"))
    return both.withColumn("tier", t).withColumn("action", action(F.col("kind"), F.col("tier"))).select("path", "kind", "ts", "tier", "action")


def debounce(events: DataFrame, gap: str = "1 second", watermark: str | None = None) -> DataFrame:
    """One row per burst: each event of a path starts the gap anew; the last kind of the burst counts."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max_by("kind", "ts").alias("kind")).select("path", F.col("w.start").alias("first_ts"), F.col("w.end").alias("ready_at"), "events", "kind")


def debounce_live(events: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """The same with processing-time timers: a path is emitted once it was quiet for the gap."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, n = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "kind": [kind], "events": [n]})
            return
        kind, n = state.get if state.exists else (None, 0)
        for b in batches:
            if len(b):
                kind, n = b.sort_values("ts")["kind"].iloc[-1], n + len(b)
        state.update((kind, n))
        state.setTimeoutDuration(gap_ms)

    return events.groupBy("path").applyInPandasWithState(run, "path string, kind string, events bigint", "kind string, events bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files (JSON lines of path, kind, ts) dropped into a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Created, Modified and Deleted events between two listings (path, modified_at, size)."""
    b = before.select(F.col("path").alias("b_path"), F.struct("modified_at", "size").alias("b"))
    a = after.select(F.col("path").alias("a_path"), F.struct("modified_at", "size").alias("a"))
    both = a.join(b, F.col("a_path") == F.col("b_path"), "full")
    kind = F.when(F.col("b_path").isNull(), "Created").when(F.col("a_path").isNull(), "Deleted").when(~F.col("a").eqNullSafe(F.col("b")), "Modified")
    return both.select(F.coalesce("a_path", "b_path").alias("path"), kind.alias("kind")).where("kind is not null")


def start(events: DataFrame, state: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Debounced events through routing into ``apply`` per micro-batch; state is read anew for every batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        apply(route(debounce(batch).withColumn("ts", F.col("ready_at")), state()), batch_id)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
