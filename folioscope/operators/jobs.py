"""Job and text tables: validation, latest states, pages, results and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "completed", "failed")


def status_rank(c):
    return F.when(c == "pending", 0).when(c == "processing", 1).otherwise(2)


def validated(uploads: DataFrame) -> DataFrame:
    """Uploads with defaults and an ``errors`` array (empty if good)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    errors = F.array_compact(F.array(
        F.when(blank("user_id"), "user_id is required"), F.when(blank("filename") & blank("title"), "title is required"), F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "content is required"),
    ))
    return uploads.withColumn("errors", errors).withColumn("title", F.when(blank("title"), F.col("filename")).otherwise(F.col("title"))).withColumn("format", F.when(blank("format"), "txt").otherwise(F.lower("format")))


def created(uploads: DataFrame) -> DataFrame:
    """Pending jobs with a deterministic id."""
    return uploads.select(F.sha2(F.concat_ws("|", "user_id", "text_id"), 256).alias("job_id"), "text_id", "user_id", "title", F.lit("pending").alias("status"), F.col("created_at").alias("updated_at"))


def latest(events: DataFrame) -> DataFrame:
    """One row per job: the last by time, then by rank of its status; a partial maximum, so a
    job with many events is one row per task before the shuffle."""
    names = [c for c in events.columns if c not in ("job_id", "updated_at")]
    best = F.max(F.struct("updated_at", status_rank(F.col("status")).alias("rank"), *names)).alias("x")
    return events.groupBy("job_id").agg(best).select("job_id", "x.updated_at", *[f"x.{n}" for n in names])


def user_jobs(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """Jobs with their text, newest first within a user; jobs without a text are skipped."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    return jobs.join(texts.select("text_id", "user_id", "created_at"), "text_id").withColumn("place", F.row_number().over(order))


def texts_page(texts: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of every user's texts, newest first, with the user's total."""
    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy(F.col("created_at").desc(), F.col("text_id").desc()))
    rows = texts.withColumns({"place": place, "total": F.count("*").over(w)})
    return rows.where((F.col("place") > max(offset, 0)) & (F.col("place") <= max(offset, 0) + limit))


def job_results(requests: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, asked_by) -> outcome: ok, not found (also another user's) or not complete."""
    j = requests.join(jobs, "job_id", "left").join(results.select("job_id", F.lit(True).alias("has")), "job_id", "left")
    outcome = F.when(F.col("user_id").isNull() | (F.col("user_id") != F.col("asked_by")), "not found").when(F.col("status") != "completed", "not complete").when(F.col("has").isNull(), "not found").otherwise("ok")
    return j.select("job_id", "asked_by", outcome.alias("outcome"))


def delete_texts(texts: DataFrame, results: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return texts.join(gone, "text_id", "left_anti"), results.join(gone, "text_id", "left_anti")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def transitions(events: DataFrame) -> DataFrame:
    """Every event with the state before it and whether the step is allowed: to pending from
    nothing, to processing from pending, to completed or failed from processing. Events of one
    time are ordered by status rank."""
    order = Window.partitionBy("job_id").orderBy("updated_at", status_rank(F.col("status")), "status")
    before, now = F.col("previous"), F.col("status")
    ok = F.when(before.isNull(), now == "pending").when(before == "pending", now == "processing").when(before == "processing", now.isin("completed", "failed")).otherwise(False)
    return events.withColumn("previous", F.lag("status").over(order)).withColumn("allowed", ok)


def overdue(jobs: DataFrame, now, seconds: int = 14_400) -> DataFrame:
    """Jobs in processing for longer than ``seconds`` become failed with an error text."""
    late = (F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > seconds)
    return jobs.withColumn("error", F.when(late, F.format_string("timed out after %d s", F.lit(seconds))).otherwise(F.col("error"))).withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def append_new(results: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose job has no result yet, one per job, with non-empty content."""
    one = incoming.where((F.coalesce("result_json", F.lit("")) != "") & F.col("job_id").isNotNull()).dropDuplicates(["job_id"])
    return one.join(results.select("job_id"), "job_id", "left_anti")
