"""A job queue in a shared folder, as a Spark data source (``jobqueue``), to write and to stream.

The folder has a fixed number of lanes; a job belongs to the lane of its id's checksum. A lane
is a row of numbered segments, files of JSON lines that are linked into place under the next free
number and never change. An offset is a number of segments for every lane, so a stream's checkpoint
says exactly what was taken, and a batch that runs again reads the same segments.

A member of a worker group reads the lanes whose number is its own modulo the group's size, each
lane as one partition: a job goes to one member only, and members need not know of each other.
The folder must be one that the driver and all executors see under the same path.

    spark.dataSource.register(JobQueue)
    jobs.write.format("jobqueue").option("path", folder).mode("append").save()
    spark.readStream.format("jobqueue").option("path", folder).option("member", 0).option("members", 2).load()

A job that is put in twice is in the queue twice (the stream's deduplication and the results' unique
job id deal with it). Ids must not be null; other columns of the schema may be. ``limit``: the
segments of a lane that one batch takes at most.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "job_id string, text_id string, user_id string, title string, submitted_at string"
LANES = 16


def lane_of(job_id: str, lanes: int) -> int:
    return zlib.crc32(job_id.encode()) % lanes


def _segment(path: str, lane: int, number: int) -> str:
    return os.path.join(path, f"lane={lane:05d}", f"{number:012d}.jsonl")


def _lanes(path: str, wanted: int) -> int:
    """The queue's number of lanes, which its first writer fixes."""
    os.makedirs(path, exist_ok=True)
    known = os.path.join(path, "lanes")
    try:
        with open(known) as f:
            return int(f.read())
    except FileNotFoundError:
        draft = f"{known}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(str(wanted))
        try:
            os.link(draft, known)
        except FileExistsError:
            pass
        os.remove(draft)
        return _lanes(path, wanted)


@dataclass
class Lane(InputPartition):
    path: str
    lane: int
    start: int
    end: int


@dataclass
class Drafts(WriterCommitMessage):
    files: list


class JobQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jobqueue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a queue can only be appended to")
        return _Writer(self.options, schema)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.columns = options["path"], schema.fieldNames()
        self.lanes = _lanes(self.path, int(options.get("lanes", LANES)))
        member, members = int(options.get("member", 0)), int(options.get("members", 1))
        if not 0 <= member < members:
            raise ValueError("member must be from 0 to members - 1")
        self.own = [k for k in range(self.lanes) if k % members == member]
        self.limit = int(options.get("limit", 0))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {str(k): 0 for k in self.own}

    def latestOffset(self) -> dict:
        out = {}
        for k in self.own:
            n = first = self.at.get(str(k), 0)
            while os.path.exists(_segment(self.path, k, n)) and not (self.limit and n - first >= self.limit):
                n += 1
            out[str(k)] = n
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        return [Lane(self.path, int(k), start.get(k, 0), n) for k, n in end.items() if n > start.get(k, 0)]

    def read(self, part: Lane) -> Iterator[tuple]:
        for n in range(part.start, part.end):
            with open(_segment(part.path, part.lane, n), encoding="utf-8") as f:
                for line in f:
                    row = json.loads(line)
                    yield tuple(row.get(c) for c in self.columns)

    def commit(self, end: dict) -> None:
        """Segments stay: another group may read the queue from its start."""


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.columns = options["path"], schema.fieldNames()
        self.lanes = _lanes(self.path, int(options.get("lanes", LANES)))
        os.makedirs(os.path.join(self.path, "drafts"), exist_ok=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """A draft for each lane; nothing can be seen of it yet."""
        files: dict[int, tuple] = {}
        try:
            for row in rows:
                if row["job_id"] is None:
                    raise ValueError("a job in the queue has an id")
                lane = lane_of(row["job_id"], self.lanes)
                if lane not in files:
                    name = os.path.join(self.path, "drafts", f"{lane}-{uuid.uuid4().hex}")
                    files[lane] = name, open(name, "w", encoding="utf-8")
                files[lane][1].write(json.dumps({c: row[c] for c in self.columns}, ensure_ascii=False, default=str) + "\n")
        finally:
            for _, f in files.values():
                f.close()
        return Drafts([(lane, name) for lane, (name, _) in files.items()])

    def commit(self, messages: list) -> None:
        for lane, draft in (x for m in messages if m is not None for x in m.files):
            os.makedirs(os.path.dirname(_segment(self.path, lane, 0)), exist_ok=True)
            n = 0
            while True:
                while os.path.exists(_segment(self.path, lane, n)):
                    n += 1
                try:  # fails if another writer took the number
                    os.link(draft, _segment(self.path, lane, n))
                    break
                except FileExistsError:
                    pass
            os.remove(draft)

    def abort(self, messages: list) -> None:
        for _, draft in (x for m in messages if m is not None for x in m.files):
            if os.path.exists(draft):
                os.remove(draft)
