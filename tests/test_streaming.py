import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from folioscope.sources import commits
from folioscope.streaming import jobs as X
from folioscope.streaming import queue as Q
from folioscope.streaming import status as S

NOW = dt.datetime(2026, 1, 1)
TEXTS = "text_id string, content string"


def add(spark, path, *rows):
    spark.createDataFrame([(j, "t1", "u", "a", s, t, None) for j, s, t in rows], X.EVENTS).coalesce(1).write.mode("append").parquet(path)


def shout(batch):
    return batch.select("job_id", F.upper("content").alias("result_json"))


def test_stream_analyses_each_job_once(spark, tmp_path):
    src, out = str(tmp_path / "events"), str(tmp_path / "out")
    rows = [("j1", "t1", "u", "a", "pending", NOW, None), ("j1", "t1", "u", "a", "pending", NOW, None), ("j2", "none", "u", "a", "pending", NOW, None)]
    spark.createDataFrame(rows, X.EVENTS).write.parquet(src)
    texts = spark.createDataFrame([("t1", "hello")], TEXTS)
    for k in range(2):  # another stream over the same events has nothing to add
        X.analyse(X.job_stream(spark, src, texts), shout, out, str(tmp_path / f"c{k}")).awaitTermination()
    assert [tuple(r) for r in X.finished(spark, out).collect()] == [("j1", "HELLO")]


def test_a_batch_that_fails_after_its_write_runs_again_without_a_trace(spark, tmp_path, monkeypatch):
    src, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "c"))
    texts = spark.createDataFrame([("t1", "hello")], TEXTS)
    add(spark, src, ("j1", "pending", NOW), ("j2", "pending", NOW))
    put, calls = commits.put, []

    def torn(*args):
        put(*args)
        calls.append(args[3])
        if len(calls) == 1:
            raise OSError("lost after the write")

    monkeypatch.setattr(commits, "put", torn)
    query = X.analyse(X.job_stream(spark, src, texts), shout, out, checkpoint)
    with pytest.raises(Exception, match="lost after the write"):
        query.awaitTermination()
    add(spark, src, ("j2", "pending", NOW), ("j3", "pending", NOW))
    X.analyse(X.job_stream(spark, src, texts), shout, out, checkpoint).awaitTermination()
    assert calls[:2] == [0, 0]
    assert sorted(tuple(r) for r in X.finished(spark, out).collect()) == [("j1", "HELLO"), ("j2", "HELLO"), ("j3", "HELLO")]


def test_a_batch_without_its_success_file_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    commits.put(spark.createDataFrame([("j1", "x")], X.RESULTS), out, "s", 0)
    commits.put(spark.createDataFrame([("j2", "x")], X.RESULTS), out, "s", 1)
    os.remove(f"{out}/stream=s/batch=1/_SUCCESS")
    assert [r.job_id for r in X.finished(spark, out).collect()] == ["j1"]
    assert X.finished(spark, str(tmp_path / "none")).count() == 0


def test_status_of_late_repeated_and_replayed_events(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "c"))
    session = S.stateful(spark)
    hour = dt.timedelta(hours=1)

    def run():
        X.current_status(session.readStream.schema(X.EVENTS).parquet(src), out, checkpoint, clock="EventTime").awaitTermination()
        return {r.job_id: r.status for r in S.current(spark, checkpoint).collect()}

    add(spark, src, ("j1", "pending", NOW), ("j1", "pending", NOW), ("j2", "processing", NOW), (None, "pending", NOW), ("j4", "odd", NOW))
    assert run() == {"j1": "pending", "j2": "processing"}
    # the same second: the rank decides; an older event changes nothing
    add(spark, src, ("j1", "completed", NOW + hour), ("j1", "processing", NOW + hour), ("j1", "failed", NOW), ("j3", "pending", NOW + hour))
    assert run() == {"j1": "completed", "j2": "processing", "j3": "pending"}
    add(spark, src, ("j1", "pending", NOW), ("j3", "pending", NOW + hour))
    before = X.status_log(spark, out).count()
    assert run() == {"j1": "completed", "j2": "processing", "j3": "pending"}
    assert X.status_log(spark, out).count() == before == 4


def test_status_after_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    src, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "c"))
    session = S.stateful(spark)
    start = lambda: X.current_status(session.readStream.schema(X.EVENTS).parquet(src), out, checkpoint, clock="EventTime")
    add(spark, src, ("j1", "pending", NOW), ("j2", "pending", NOW))
    start().awaitTermination()
    add(spark, src, ("j1", "processing", NOW))
    put = commits.put

    def torn(*args):
        put(*args)
        raise OSError("lost after the write")

    monkeypatch.setattr(commits, "put", torn)
    with pytest.raises(Exception, match="lost after the write"):
        start().awaitTermination()
    monkeypatch.setattr(commits, "put", put)
    start().awaitTermination()
    assert {r.job_id: r.status for r in S.current(spark, checkpoint).collect()} == {"j1": "processing", "j2": "pending"}
    assert sorted((r.job_id, r.status) for r in X.status_log(spark, out).collect()) == [("j1", "pending"), ("j1", "processing"), ("j2", "pending")]


def test_a_job_without_further_events_fails_by_itself(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "c"))
    session = S.stateful(spark)
    now = dt.datetime.now(dt.UTC)
    add(spark, src, ("j1", "processing", now), ("j2", "pending", now), ("j3", "processing", now), ("j3", "completed", now))
    query = X.current_status(session.readStream.schema(X.EVENTS).parquet(src), out, checkpoint, limit=3, every="1 second")
    try:
        until = time.time() + 60
        while time.time() < until and X.status_log(spark, out).where("status = 'failed'").isEmpty():
            time.sleep(1)
    finally:
        query.stop()
    got = {r.job_id: (r.status, r.error) for r in S.current(spark, checkpoint).collect()}
    assert got == {"j1": ("failed", "job exceeded 3s timeout"), "j2": ("pending", None), "j3": ("completed", None)}
    failed = X.status_log(spark, out).where("status = 'failed'").collect()
    assert [r.job_id for r in failed] == ["j1"]
    assert 2.9 < (failed[0].updated_at.replace(tzinfo=dt.UTC) - now).total_seconds() < 3.1 or time.localtime().tm_gmtoff


def test_ended_jobs_are_forgotten(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "c"))
    session = S.stateful(spark)
    add(spark, src, ("j1", "completed", NOW), ("j2", "pending", NOW + dt.timedelta(days=3)))
    X.current_status(session.readStream.schema(X.EVENTS).parquet(src), out, checkpoint, keep=3600, clock="EventTime").awaitTermination()
    assert [r.job_id for r in S.current(spark, checkpoint).collect()] == ["j2"]


def jobs(spark, names):
    return spark.createDataFrame([(n, "t1", "u", "é", None) for n in names], Q.SCHEMA)


def test_queue_gives_each_job_to_one_member_over_kills_and_restarts(spark, tmp_path, monkeypatch):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    spark.dataSource.register(Q.JobQueue)
    texts = spark.createDataFrame([("t1", "hello")], TEXTS)
    put_in = lambda names: jobs(spark, names).repartition(3).write.format("jobqueue").options(path=queue, lanes=5).mode("append").save()
    seen = {0: [], 1: []}

    def run(member):
        def work(batch):
            seen[member] += [r.job_id for r in batch.select("job_id").collect()]
            return shout(batch)

        X.analyse(X.claimed(spark, queue, texts, member, 2), work, out, str(tmp_path / f"c{member}")).awaitTermination()

    first, second = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    put_in(first)
    run(0)
    put = commits.put

    def killed(*args):
        raise OSError("killed")

    monkeypatch.setattr(commits, "put", killed)
    with pytest.raises(Exception, match="killed"):
        run(1)
    monkeypatch.setattr(commits, "put", put)
    lost, seen[1] = seen[1], []
    put_in(second)
    run(1)  # takes the batch it was killed in
    run(1)  # and what is new
    run(0)
    assert set(lost) <= set(seen[1]) and not set(seen[0]) & set(seen[1])
    assert sorted(seen[0] + seen[1]) == sorted(first + second)
    assert sorted(r.job_id for r in X.finished(spark, out).collect()) == sorted(first + second)
    assert all(Q.lane_of(j, 5) % 2 == m for m in (0, 1) for j in seen[m])


def test_queue_limits_batches_and_refuses_null_ids(spark, tmp_path):
    queue = str(tmp_path / "queue")
    spark.dataSource.register(Q.JobQueue)
    for k in range(4):
        jobs(spark, [f"j{k}"]).coalesce(1).write.format("jobqueue").options(path=queue, lanes=1).mode("append").save()
    reader = Q._Reader({"path": queue, "limit": "3"}, jobs(spark, ["x"]).schema)
    assert reader.latestOffset() == {"0": 3}
    parts = reader.partitions({"0": 0}, {"0": 3})
    assert [r[0] for p in parts for r in reader.read(p)] == ["j0", "j1", "j2"]
    assert reader.latestOffset() == {"0": 4}
    with pytest.raises(Exception, match="has an id"):
        jobs(spark, [None]).write.format("jobqueue").option("path", queue).mode("append").save()
    assert Q._Reader({"path": queue}, jobs(spark, ["x"]).schema).latestOffset() == {"0": 4}
