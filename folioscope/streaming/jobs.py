"""Structured Streaming: newly submitted jobs, their analysis and their current status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import append_new
from ..sources import commits
from .queue import JobQueue
from .status import KEEP, LIMIT, changes

EVENTS = "job_id string, text_id string, user_id string, title string, status string, updated_at timestamp, error string"
RESULTS = "job_id string, result_json string"


def job_stream(spark: SparkSession, path: str, texts: DataFrame, schema: str = EVENTS, delay: str = "1 day") -> DataFrame:
    """Pending jobs of a folder of events, each once within the watermark, with their text;
    unknown ids go."""
    events = spark.readStream.schema(schema).parquet(path).where("status = 'pending'")
    once = events.withWatermark("updated_at", delay).dropDuplicatesWithinWatermark(["job_id"])
    return once.join(texts.select("text_id", "content"), "text_id")


def claimed(spark: SparkSession, queue: str, texts: DataFrame, member: int = 0, members: int = 1, limit: int = 0) -> DataFrame:
    """The jobs that this member of a worker group takes from the queue, with their text; unknown
    ids go. A job that is in the queue twice comes twice: results are unique by job id."""
    spark.dataSource.register(JobQueue)
    jobs = spark.readStream.format("jobqueue").options(path=queue, member=member, members=members, limit=limit).load()
    return jobs.join(texts.select("text_id", "content"), "text_id")


def analyse(stream: DataFrame, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, results: str = RESULTS):
    """Start a query that runs the batch pipeline on every micro-batch and commits its results
    by the batch's number: a batch that fails after its write and runs again replaces what it wrote.
    A job that another batch has a result of gets no second one."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # the checkpoint's, the same after a restart
        have = commits.committed(spark, out, results, but=commits.batch_folder(name, number))
        commits.put(append_new(have, run(batch)), out, name, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(stream: DataFrame, out: str, checkpoint: str, limit: float = LIMIT, keep: float = KEEP, clock: str = "ProcessingTime", delay: str = "1 day", every: str = "10 seconds"):
    """Start a query that keeps every job's status as state and appends its changes to ``out``,
    each batch once. ``status.current`` reads the state, ``status_log`` the changes. By the cluster's
    clock it runs until it is stopped, by the events' own until all there is has been read."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()  # the state's operator runs once
        try:
            if not batch.isEmpty():
                commits.put(batch, out, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number)
        finally:
            batch.unpersist()

    write = changes(stream, limit, keep, clock, delay).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (write.trigger(processingTime=every) if clock == "ProcessingTime" else write.trigger(availableNow=True)).start()


def finished(spark: SparkSession, out: str, results: str = RESULTS) -> DataFrame:
    """The committed results."""
    return commits.committed(spark, out, results)


def status_log(spark: SparkSession, out: str) -> DataFrame:
    """The committed changes of status, as events."""
    return commits.committed(spark, out, EVENTS).select(*[F.col(c.split()[0]) for c in EVENTS.split(", ")])
