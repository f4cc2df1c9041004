"""The current status of every job as keyed state, with a time limit of its own.

``transformWithState`` keeps one value per job in RocksDB: the latest event by time and, within a
second, by status rank. Late and repeated events change nothing, and neither does a batch that runs
again, as state is committed with the batch. A job in ``processing`` has a timer at the
time of that event plus the limit; if it goes off, the job is failed, without any further event.
Rows come out for changes only, so a batch costs what it brings, however many jobs are known.
The state itself can be read as a table (``current``), nothing is rewritten.

The clock is the cluster's (``ProcessingTime``, for a stream that runs all the time) or the events'
own (``EventTime``, for one that replays what there is: now is the watermark, the latest
event less ``delay``, and events older than it are ignored).

Jobs that ended are forgotten ``keep`` seconds after; an event of such a job that comes even
later begins anew. Events without a job, a known status or a time are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

LIMIT = 14_400
KEEP = 30 * 86_400
RANK = {"pending": 0, "processing": 1, "completed": 2, "failed": 2}
#: Times are microseconds in the state, which no time zone can shift.
FIELDS = "status string, updated_at long, text_id string, user_id string, title string, error string"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application with RocksDB as the state store."""
    session = spark.newSession()
    for c in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        value = spark.conf.get(c, None)
        if value and session.conf.get(c, None) != value:
            session.conf.set(c, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


class JobStatus(StatefulProcessor):
    def __init__(self, limit: float = LIMIT, keep: float = KEEP, clock: str = "ProcessingTime") -> None:
        self.limit, self.keep, self.clock = int(limit * 1000), int(keep * 1000), clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", f"{FIELDS}, timer long")

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.clock == "ProcessingTime" else timerValues.getCurrentWatermarkInMs()

    def _put(self, values: tuple, now: int) -> None:
        """Keep the values, with a timer for the time limit or for forgetting."""
        old = self.job.get()
        if old is not None and old[-1] is not None:
            self.handle.deleteTimer(old[-1])
        rank = RANK[values[0]]
        timer = values[1] // 1000 + self.limit if rank == 1 else max(now, values[1] // 1000) + self.keep if rank == 2 else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.job.update((*values, timer))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        order = lambda x: (x[1], RANK[x[0]], tuple("" if v is None else v for v in x))
        old = self.job.get()
        best = before = tuple(old)[:-1] if old is not None else None
        for row in rows:
            new = tuple(row[n] for n in _NAMES)
            if new[0] in RANK and new[1] is not None and (best is None or order(new) > order(best)):
                best = new
        if best != before:
            self._put(best, self._now(timerValues))
            yield Row(job_id=key[0], **dict(zip(_NAMES, best, strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.job.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if old is None or old[-1] != at:
            return
        if RANK[old[0]] == 2:
            self.job.clear()
            return
        values = dict(zip(_NAMES, tuple(old)[:-1], strict=True)) | {"status": "failed", "error": f"job exceeded {self.limit // 1000}s timeout"}
        values["updated_at"] = at * 1000
        self.job.update((*values.values(), None))
        self._put(tuple(values.values()), self._now(timerValues))
        yield Row(job_id=key[0], **values)


def changes(events: DataFrame, limit: float = LIMIT, keep: float = KEEP, clock: str = "ProcessingTime", delay: str = "1 day") -> DataFrame:
    """A stream of events (of a ``stateful`` session) -> a stream of changes of status."""
    if clock == "EventTime":
        events = events.withWatermark("updated_at", delay)
    have = [F.unix_micros("updated_at").alias(n) if n == "updated_at" else (F.col(n) if n in events.columns else F.lit(None)).cast("string").alias(n) for n in _NAMES]
    rows = events.where("job_id IS NOT NULL").select(F.col("job_id").cast("string").alias("job_id"), *have)
    out = rows.groupBy("job_id").transformWithState(JobStatus(limit, keep, clock), f"job_id string, {FIELDS}", "Update", clock)
    return out.withColumn("updated_at", F.timestamp_micros("updated_at"))


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of all jobs as a table, as of the last batch of the stream with this checkpoint."""
    state = stateful(spark).read.format("statestore").option("path", checkpoint).option("stateVarName", "job").load()
    return state.select(F.col("key.job_id").alias("job_id"), *[F.col(f"value.{n}").alias(n) for n in _NAMES]).withColumn("updated_at", F.timestamp_micros("updated_at"))
