"""The job queue as tables and streams: transitions, requeues of silent workers, assignment.

A log row (job_id, id, status, ts, max_attempts) says what a worker or user reported. A
job's state follows from its rows in order of (ts, id): 'done' and 'cancelled' are final,
a failure queues again while attempts are left, any other status is the state. A running
job of which nothing is heard for `silent_s` seconds goes back to the queue. Batch and
stream give the same transitions; the stream gives those that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexforge.operators.ranks import placed

FINAL = ("cancelled", "done")
SILENT_S = 300
#: Keyed state with timers is kept by this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TRANSITION = "job_id long, ts timestamp, id long, old_state string, new_state string, failures long, silent boolean"


def transitions(log: DataFrame, as_of: Column, silent_s: int = SILENT_S) -> DataFrame:
    """Every change of state up to `as_of`: (job_id, ts, id of the last row heard, old_state, new_state, failures, silent)."""
    w = Window.partitionBy("job_id").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.first(F.when(F.col("status").isin(*FINAL), F.col("status")), ignorenulls=True).over(upto)
    rows = log.filter(F.col("ts") <= as_of).withColumns({"failures": F.count_if(F.col("status") == "failed").over(upto), "most": F.max("max_attempts").over(upto), "ended": ended})
    state = F.when(F.col("ended").isNotNull(), F.col("ended")).when((F.col("status") == "failed") & (F.col("failures") < F.col("most")), "queued").otherwise(F.col("status"))
    lost_at = F.timestamp_micros(F.unix_micros("ts") + silent_s * 1_000_000)
    stated = rows.withColumns({"state": state, "lost_at": lost_at, "next": F.lead("ts").over(w)})
    lost = (F.col("state") == "running") & F.when(F.col("next").isNull(), F.col("lost_at") <= as_of).otherwise(F.col("next") > F.col("lost_at"))
    seen = stated.withColumn("lost", lost).withColumn("before", F.lag(F.when(F.col("lost"), "queued").otherwise(F.col("state"))).over(w))
    moved = seen.filter(~F.col("before").eqNullSafe(F.col("state"))).select("job_id", "ts", "id", F.col("before").alias("old_state"), F.col("state").alias("new_state"), "failures", F.lit(False).alias("silent"))
    return moved.union(seen.filter("lost").select("job_id", "lost_at", "id", "state", F.lit("queued"), "failures", F.lit(True)))


def bucketed(rows: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """rows with the `bucket` of their key, and `none` in place of a null key, which becomes 0.

    A call on state costs far more than a row, so a bucket's keys share their calls. A
    bucket's state is read whole; give so many that its rows fit a task, some thousands
    each. The number stays with a checkpoint. By default it is 16 a shuffle partition.
    """
    many = buckets or 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = rows.withColumn("none", F.col(key).isNull()).withColumn(key, F.coalesce(key, F.lit(0)))
    return filled.withColumn("bucket", F.pmod(F.xxhash64("none", key), F.lit(many)).cast("int"))


class JobProcessor(StatefulProcessor):
    """Rows of a bucket of jobs wait in list state until the watermark passes them, then move their jobs in order; timers tell both that and silence."""

    def __init__(self, silent_s: int) -> None:
        self.silent_us = silent_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", "none boolean, job_id long, ts long, id long, state string, failures long, most long, ended string")
        self.waiting = handle.getListState("waiting", "ts long, id long, status string, most long, none boolean, job_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            fresh = list(zip(*(frame[c].tolist() for c in ("us", "id", "status", "max_attempts", "none", "job_id")), strict=True))
            self.waiting.appendList(fresh)
            self.handle.registerTimer(-(-min(r[0] for r in fresh) // 1000))
        return iter(())

    def moved(self, job: tuple | None, due: list[tuple], now: int) -> tuple[tuple | None, list[tuple]]:
        """A job after its due rows and the time reached, and its transitions."""
        out = []
        for row in [*due, None]:  # None stands for the time reached
            if job and job[2] == "running" and (job[0] + self.silent_us < row[0] if row else job[0] + self.silent_us <= now):
                out.append((job[0] + self.silent_us, job[1], "running", "queued", job[3], True))
                job = (*job[:2], "queued", *job[3:])
            if row:
                old, failures, most, ended = (job[2], *job[3:]) if job else (None, 0, row[3], None)
                ts, i, status, limit = row
                failures, most = failures + (status == "failed"), max(most, limit)
                ended = ended or (status if status in FINAL else None)
                state = ended or ("queued" if status == "failed" and failures < most else status)
                if state != old:
                    out.append((ts, i, old, state, failures, False))
                job = (ts, i, state, failures, most, ended)
        return job, out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] <= now]
        left = waiting[len(due) :]
        jobs = {tuple(r)[:2]: tuple(r)[2:] for r in self.jobs.get()}
        reached: dict[tuple[bool, int], list[tuple]] = {k: [] for k, job in jobs.items() if job[2] == "running"}
        for *row, none, k in due:
            reached.setdefault((none, k), []).append(tuple(row))
        out = []
        for k, rows in reached.items():
            jobs[k], moves = self.moved(jobs.get(k), rows, now)
            out += [(None if k[0] else k[1], *m) for m in moves]
        if due or out:
            self.jobs.put([(*k, *job) for k, job in jobs.items()])
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self.handle.registerTimer(-(-left[0][0] // 1000))
        lost = [job[0] + self.silent_us for job in jobs.values() if job[2] == "running"]
        if lost:
            self.handle.registerTimer(-(-min(lost) // 1000))
        if out:
            frame = pd.DataFrame(out, columns=["job_id", "ts", "id", "old_state", "new_state", "failures", "silent"])
            yield frame.assign(job_id=frame["job_id"].astype("Int64"), ts=pd.to_datetime(frame["ts"], unit="us"))

    def close(self) -> None:
        pass


def transition_stream(log: DataFrame, late: str = "10 minutes", silent_s: int = SILENT_S, buckets: int | None = None) -> DataFrame:
    """The same of a stream, each transition once its time is passed by the watermark; rows later than `late` are dropped.

    State is kept for `buckets` of jobs, as `bucketed` says. Sets the session's state store
    to the one that keeps timers; streams that run keep theirs.
    """
    log.sparkSession.conf.set(*STORE)
    rows = log.select(F.col("job_id").cast("long"), F.col("id").cast("long"), "status", F.col("max_attempts").cast("long"), F.col("ts").cast("timestamp"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    keyed = bucketed(rows, "job_id", buckets).withWatermark("ts", late).groupBy("bucket")
    return keyed.transformWithStateInPandas(statefulProcessor=JobProcessor(silent_s), outputStructType=T._parse_datatype_string(TRANSITION), outputMode="append", timeMode="eventTime")


def assigned(jobs: DataFrame, polls: DataFrame) -> DataFrame:
    """(job_id, worker_id, poll_id): the first poll gets the head of the queue, the next one the job after it.

    jobs hold id, priority and created_at; polls poll_id, worker_id and ts. Both are put
    in places by ranges, so neither one priority nor one time makes a hot task.
    """
    heads = placed(jobs.select("id", "priority", "created_at"), [F.col("priority").desc(), F.col("created_at"), F.col("id")])
    asking = placed(polls.select("poll_id", "worker_id", "ts"), [F.col("ts"), F.col("poll_id")])
    return heads.join(asking, "place").select(F.col("id").alias("job_id"), "worker_id", "poll_id")


def assign_stream(polls: DataFrame, jobs: DataFrame, path: str) -> Any:
    """A writer that gives each micro-batch of polls the heads of what is left of the queue, at path/batch=N.

    A batch that is run again writes its own folder again, from what the batches before it
    left; so a job is given to one poll, however often a batch is replayed. Start it with
    the options of any stream: assign_stream(...).option("checkpointLocation", ...).start().
    """
    spark = jobs.sparkSession

    def give(batch: DataFrame, number: int) -> None:
        before = assignments(spark, path).filter(F.col("batch") < number)
        left = jobs.filter("status = 'queued'").join(before.select(F.col("job_id").alias("id")), "id", "left_anti")
        assigned(left, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return polls.writeStream.foreachBatch(give)


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """What has been assigned so far: (job_id, worker_id, poll_id, batch)."""
    empty = spark.createDataFrame([], "job_id long, worker_id long, poll_id long, batch long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(empty.schema).parquet(path) if files.exists(folder) else empty
