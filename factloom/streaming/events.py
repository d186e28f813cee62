"""Run events as streams: classification, windows, late data and state (Z-01..Z-10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.runtime import shared_folder

# What the lines of a run's log look like.
PAGE_PROGRESS = r"(?:page|Page|trang)\s*(\d+)\s*(?:/|of|trên)\s*(\d+)"
ERROR = r"(?:Error|❌|Lỗi|failed|Failed)"
WARNING = r"(?:Warning|⚠️|Cảnh báo)"


def classify_line(c: Column) -> Column:
    """Z-02: error before warning before progress before info."""
    return F.when(c.rlike(ERROR), "error").when(c.rlike(WARNING), "warning").when(c.rlike(PAGE_PROGRESS), "progress").otherwise("info")


def line_progress(c: Column) -> Column:
    """Z-03: struct(current, total) of a progress line, else null."""
    n = lambda i: F.regexp_extract(c, PAGE_PROGRESS, i).try_cast("int")
    return F.when(c.rlike(PAGE_PROGRESS), F.struct(n(1).alias("current"), n(2).alias("total")))


def event_json(*columns: str) -> Column:
    """Z-01: JSON of an event, null fields left out."""
    return F.to_json(F.struct(*columns))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream, with an event time that watermarks accept."""
    path = f"{folder}/events*.parquet"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Counts and sums by type and tumbling window; with a watermark, later events are dropped."""
    e = events.withWatermark("ts", watermark) if watermark else events
    return e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Sessions of a user: events no more than `gap` apart."""
    e = events.withWatermark("ts", watermark) if watermark else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def last_events(events: DataFrame, n: int = 500) -> DataFrame:
    """Z-04 in a batch: the n latest events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return events.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def ring_buffer(events: DataFrame, n: int = 500) -> DataFrame:
    """Z-04 as a stream: per user the ids of the n latest events so far, kept in state; a row whenever they change."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held = sorted({*held, *f.event_id.tolist()})[-n:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(held)], "oldest": [held[0]], "newest": [held[-1]]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n int, oldest long, newest long", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


def after(events: DataFrame, last_id: int) -> DataFrame:
    """Z-05: what a reader that has seen `last_id` still has to get."""
    return events.filter(F.col("event_id") > last_id)


#: Status of a run -> status of its steps before, at and after the current one.
STEP_STATUS = {
    "completed": ("completed", "completed", "completed"),
    "running": ("completed", "running", "queued"),
    "failed": ("completed", "failed", "queued"),
    "cancelled": ("completed", "cancelled", "cancelled"),
}
WAITING = ("completed", "queued", "queued")  # of any other run


def step_status(status: Column, current: Column, i: Column) -> Column:
    """Z-07: status of step i of a run, looked up by the run's status and by which side of the current step it is on. A run
    without current step hasn't begun; its steps come after."""
    by_run = F.create_map(*[x for run, steps in STEP_STATUS.items() for x in (F.lit(run), F.array(*map(F.lit, steps)))])
    side = 1 + F.signum(i - F.coalesce(current, F.lit(-1))).cast("int")
    return F.get(F.coalesce(F.try_element_at(by_run, status), F.array(*map(F.lit, WAITING))), side)


def run_state(events: DataFrame, key: str = "user_id", status: str = "event_type") -> DataFrame:
    """Z-08: latest status of each run."""
    return events.groupBy(key).agg(F.max_by(status, "event_id").alias("status"), F.max("event_id").alias("event_id"))


#: Z-08: the states a run may go to from each state; "" is a run not seen before.
NEXT = {
    "": ("idle", "uploaded"), "idle": ("uploaded",), "uploaded": ("starting", "cancelled"), "starting": ("running", "failed", "cancelled"),
    "running": ("completed", "failed", "cancelled"), "failed": ("starting",), "cancelled": ("starting",), "completed": (),
}
FINAL = ("completed", "failed", "cancelled")


def transitions(events: DataFrame, key: str = "run_id", status: str = "status", order: str = "event_id") -> DataFrame:
    """Z-08: each event with the state before it and whether the step is allowed (a failed or cancelled run may start again,
    a completed one never). A status repeated is no step. Null and unknown states are never allowed."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag(status).over(w), F.lit(""))
    allowed = F.create_map(*[x for a, to in NEXT.items() for x in (F.lit(a), F.array(*map(F.lit, to)).cast("array<string>"))])
    ok = F.coalesce((before == F.col(status)) | F.array_contains(F.try_element_at(allowed, before), F.col(status)), F.lit(False))
    return events.withColumn("before", before).withColumn("allowed", ok)


def until_final(events: DataFrame, key: str = "run_id", status: str = "status", order: str = "event_id") -> DataFrame:
    """Z-06: what a reader of a run's events gets: all up to the first final status, none after it."""
    ended = F.max(F.col(status).isin(*FINAL).cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_ended", ended).filter("coalesce(_ended, 0) = 0").drop("_ended")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Z-06, Z-09: runs a stream over all that is there and returns its result, written as Parquet a batch below the shared
    folder: the last batch of a complete result, all of an update or append one. A batch run again replaces its own."""
    spark = stream.sparkSession
    folder = f"{(checkpoint or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    complete = mode == "complete"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result" if complete else f"{folder}/result/batch={number}")

    begun = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode)
    begun.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    found = spark.read.schema(stream.schema).option("ignoreMissingFiles", "true")
    exists = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/result")
    if not exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists):
        return empty
    return found.parquet(f"{folder}/result").select(*stream.columns)
