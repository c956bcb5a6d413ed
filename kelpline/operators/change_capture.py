"""Only new or changed records, run by run: log-based change capture.

A feed is a log split into ``partitions`` by key hash; a record's offset is its insert id. A run's batch
plan is one offset range per partition, from the end its partition had when a run last succeeded to the
last offset among the batches the run sees, and the last batch of either. Offsets need not rise with the
batches: a run takes the records of its batches up to its end, but for those that the run before it had
in its batches and offsets. Plans are written to a shared folder before any work and read back from there;
a run takes what its plan holds and nothing else. A run that dies leaves its plan without a commit, and the
next call replays that very plan before it plans anything new: a record that arrived in between lies
beyond the plan's end and waits. The sink keeps one row per (run, key), that of the offset which decided,
and a replay overwrites its own rows, so nothing is skipped or repeated.

Current value of a key: that of the record with the greatest (modified_at, insert_id) delivered so
far; late records and records with a misleading ``modified_at`` are therefore judged by value, not
by time. Defined results: records delivered again change nothing; null ``modified_at`` sorts below
every number; a null hash is a value of its own; null keys, offsets and batch numbers are never
delivered; runs that did not succeed yield nothing and leave their ranges to the next run; an empty
feed or no succeeded run gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions.paths import canonical_path
from kelpline.runtime import SharedFiles, cut, scratch

PARTITIONS = 64
#: Plans of at most this many ranges travel to the tasks whole; larger ones are joined by partition.
PLAN_ROWS = 200_000
#: Deltas of the state that may lie beside its base before they are folded into it.
DELTAS = 16


def normalise_feed(feed: DataFrame) -> DataFrame:
    path = canonical_path(F.col("path"))
    log = feed.select(path.alias("path"), F.col("hash").alias("hash"), F.col("modified_at").cast("long").alias("modified_at"), F.col("insert_id").cast("long").alias("insert_id"), F.col("batch_no").cast("int").alias("batch_no"))
    return log.where("path is not null and batch_no is not null and insert_id is not null")


def partition_of(partitions: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(partitions)).cast("int")


def offset_plan(log: DataFrame, runs: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """(run_id, part, start, end, after, upto) of every succeeded run and partition: it takes the offsets up to ``end``
    of the batches up to ``upto``, but for the offsets up to ``start`` of the batches up to ``after``.

    ``log`` is reduced to its last offset by (partition, batch) first; what a run sees ends at the
    greatest of those up to its ``last_batch_no``.
    """
    done = runs.where("status = 'succeeded' and last_batch_no is not null").groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.max(F.col("last_batch_no").cast("int")).alias("batch_no"))
    ends = log.groupBy(partition_of(partitions).alias("part"), "batch_no").agg(F.max("insert_id").alias("end"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("part")
    # a run never falls behind the batches and the end of a run before it
    before = Window.partitionBy("part").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    seen_by = done.select(parts, "run_id", "batch_no").withColumn("after", F.max("batch_no").over(before)).withColumn("batch_no", F.greatest("batch_no", "after"))
    both = ends.unionByName(seen_by, allowMissingColumns=True)
    seen = Window.partitionBy("part").orderBy("batch_no", F.col("run_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs_of = both.withColumn("end", F.max("end").over(seen)).where("run_id is not null")
    start = F.max("end").over(before)
    return runs_of.withColumn("start", start).where("end is not null and (after is null or batch_no > after)").select("run_id", "part", "start", "end", "after", F.col("batch_no").alias("upto"))


def planned_records(log: DataFrame, plan: DataFrame, partitions: int, ranges: int) -> DataFrame:
    """The records a plan holds, each with the run that takes it; ``ranges`` is the number of its rows."""
    if ranges <= PLAN_ROWS:
        plan = F.broadcast(plan)  # its size is known: it was written by this run
    inside = (F.col("batch_no") <= F.col("upto")) & (F.col("insert_id") <= F.col("end"))
    had = F.coalesce((F.col("batch_no") <= F.col("after")) & (F.col("insert_id") <= F.col("start")), F.lit(False))
    return log.withColumn("part", partition_of(partitions)).join(plan, "part").where(inside & ~had).drop("start", "end", "after", "upto")


def fold_changes(records: DataFrame) -> DataFrame:
    """(run_id, path, hash, insert_id) wherever a path's current hash differs from that at the run before.

    ``records``: run_id (rising), path, modified_at, insert_id, hash; prior state may come as rows of an earlier run.
    """
    best = records.groupBy("path", "run_id").agg(F.max(F.struct("modified_at", "insert_id", "hash")).alias("best"))
    w = Window.partitionBy("path").orderBy("run_id")
    current = best.withColumn("now", F.max("best").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seen = current.withColumn("before", F.lag("now").over(w))
    changed = seen.where(F.col("before").isNull() | ~F.col("before.hash").eqNullSafe(F.col("now.hash")))
    return changed.select("run_id", "path", F.col("now.hash").alias("hash"), F.col("now.insert_id").alias("insert_id"), F.col("now.modified_at").alias("modified_at"))


def changes_by_run(feed: DataFrame, runs: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """(run_id, path, hash, insert_id, modified_at): the changes of all succeeded runs, from their plans in one pass.

    The plan of every run is written ahead to the shared folder and read back; lost tasks read it again
    and take the same ranges. Its size is partitions times runs, whatever the number of records.
    """
    spark, log = feed.sparkSession, normalise_feed(feed)
    where = scratch(spark, "plans")
    offset_plan(log, runs, partitions).write.parquet(where)
    plan = spark.read.parquet(where)
    taken = planned_records(log, plan, partitions, plan.count())
    return fold_changes(taken.select("run_id", "path", "modified_at", "insert_id", "hash"))


@dataclass
class ChangeCapture:
    """The same, one run at a time, with its plans, commits, state and sink in ``home``, a folder all executors share.

    The state holds the deciding record of every key: a base and one delta per run, which holds only the
    keys that moved; after ``DELTAS`` runs they become the next base. A run reads the state of its own keys.
    """

    spark: SparkSession
    home: str
    partitions: int = PARTITIONS

    def __post_init__(self) -> None:
        self.files = SharedFiles(self.spark, self.home)

    def _list(self, kind: str) -> list[int]:
        return [int(x[:-5]) for x in self.files.names(kind) if x.endswith(".json")]

    def _put(self, kind: str, run_id: int, body: dict) -> None:
        self.files.write(f"{kind}/{run_id:020d}.json", json.dumps(body))

    def _get(self, kind: str, run_id: int) -> dict:
        return json.loads(self.files.read(f"{kind}/{run_id:020d}.json"))

    def committed(self) -> list[int]:
        return self._list("commits")

    def plan(self, feed: DataFrame, run_id: int, last_batch_no: int) -> dict:
        """Writes the offset ranges ahead; at most ``partitions`` numbers reach the driver."""
        done = self.committed()
        last = self._get("plans", done[-1]) if done else {"end": {}, "upto": None}
        start, upto = last["end"], max(last_batch_no, last_batch_no if last["upto"] is None else last["upto"])
        seen = normalise_feed(feed).where(F.col("batch_no") <= last_batch_no).groupBy(partition_of(self.partitions).alias("part")).agg(F.max("insert_id").alias("end")).collect()
        end = dict(start)
        for r in seen:
            end[str(r["part"])] = max(r["end"], start.get(str(r["part"]), r["end"]))
        body = {"run_id": run_id, "start": start, "end": end, "after": last["upto"], "upto": upto, "behind": done[-1] if done else None}
        self._put("plans", run_id, body)
        return body

    def _state(self) -> DataFrame | None:
        """The deciding record of every key, as of the last commit."""
        done = self.committed()
        if not done:
            return None
        last = self._get("commits", done[-1])
        parts = [*([f"base/{last['base']}"] if last["base"] is not None else []), *(f"delta/{r}" for r in last["deltas"])]
        return self.spark.read.parquet(*(f"{self.home}/state/{x}" for x in parts))

    def _execute(self, feed: DataFrame, plan: dict, fail_at: str | None = None) -> None:
        run_id = plan["run_id"]
        ranges = [(run_id, int(p), plan["start"].get(p), e, plan["after"], plan["upto"]) for p, e in plan["end"].items()]
        plan_rows = self.spark.createDataFrame(ranges, "run_id bigint, part int, start bigint, end bigint, after int, upto int")
        new = planned_records(normalise_feed(feed), plan_rows, self.partitions, len(ranges)).select("run_id", "path", "modified_at", "insert_id", "hash")
        old = self._state()
        if old is not None:
            known = old.join(new.select("path").distinct(), "path", "left_semi")
            new = new.unionByName(known.select(F.lit(plan["behind"]).cast("long").alias("run_id"), "path", "modified_at", "insert_id", "hash"))
        if fail_at == "before_sink":
            raise RuntimeError("run stopped before the sink")
        changed = fold_changes(new).where(F.col("run_id") == run_id)
        changed.select("path", "hash", "insert_id", "modified_at").write.mode("overwrite").parquet(f"{self.home}/sink/run_id={run_id}")
        if fail_at == "before_state":
            raise RuntimeError("run stopped before the state")
        # of every key the run saw, the deciding record; keys it did not see keep theirs in older deltas
        best = new.groupBy("path").agg(F.max(F.struct("modified_at", "insert_id", "hash")).alias("b")).select("path", "b.modified_at", "b.insert_id", "b.hash")
        best.write.mode("overwrite").parquet(f"{self.home}/state/delta/{run_id}")
        done = self.committed()
        last = self._get("commits", done[-1]) if done else {"base": None, "deltas": []}
        base, deltas = last["base"], [*last["deltas"], run_id]
        if len(deltas) > DELTAS:
            whole = best if old is None else old.select(best.columns).unionByName(self.spark.read.parquet(f"{self.home}/state/delta/{run_id}"))
            whole = whole.groupBy("path").agg(F.max(F.struct("modified_at", "insert_id", "hash")).alias("b")).select("path", "b.modified_at", "b.insert_id", "b.hash")
            whole.write.mode("overwrite").parquet(f"{self.home}/state/base/{run_id}")
            base, deltas = run_id, []
        if fail_at == "before_commit":
            raise RuntimeError("run stopped before the commit")
        self._put("commits", run_id, {"run_id": run_id, "base": base, "deltas": deltas})
        for gone in set(last["deltas"]) - set(deltas):
            self.files.remove(f"state/delta/{gone}")
        if last["base"] not in (None, base):
            self.files.remove(f"state/base/{last['base']}")

    def run(self, feed: DataFrame, run_id: int, last_batch_no: int, fail_at: str | None = None) -> DataFrame:
        """Replays an open plan, then processes what is new up to ``last_batch_no``; returns this run's changes."""
        for open_run in sorted(set(self._list("plans")) - set(self.committed())):
            self._execute(feed, self._get("plans", open_run))
        if run_id not in self.committed():
            self._execute(feed, self.plan(feed, run_id, last_batch_no), fail_at)
        return self.changes(run_id)

    def changes(self, run_id: int) -> DataFrame:
        return cut(self.spark.read.parquet(f"{self.home}/sink/run_id={run_id}"))
