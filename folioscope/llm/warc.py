"""WARC records in seekable Zstandard bundles, written and read back as Spark tables.

A bundle is a series of independent Zstandard frames, each of whole WARC records, closed
by a skippable frame with the seek table (sizes of every frame). The archive table has a
row per frame, in order: ``bundle``, ``seq``, ``data`` (the frame's bytes) and ``records``
(record id, offset in the decompressed frame, length). Concatenating a bundle's ``data``
by ``seq`` gives the .warc.zst file; any reader of the seekable format can open it. Rows
go through Spark's committer, so a lost executor's bundle is written anew. Records are read
back one by one from their offsets in the frame. Payloads are dealt by id and digest, so
neither empty pages nor one page with very many copies meet in one task; only ids are joined
by digest.

Of the records with equal payloads of at least ``min_bytes`` bytes, the one with the
smallest id is a response and the others revisit it; the payload is not stored again.
A null html is an empty payload; a very long one is a frame of its own. Rows that repeat the smallest id with the same payload
are responses too; a null id is written as ``null`` and is never referred to while
another id exists. Extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
MIN_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
ARCHIVE = "bundle string, seq long, data binary, records array<struct<id: string, offset: long, length: long>>"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    value = record[len("<urn:page:") : -1] if record else "null"
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with its HTTP block; a revisit has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(compressed, decompressed) sizes of a bundle's frames, from its last bytes."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    return [struct.unpack("<II", bundle[-9 - 8 * (n - k) :][:8]) for k in range(n)]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(level=3)
    schema = pa.schema([("bundle", pa.string()), ("seq", pa.int64()), ("data", pa.binary()), ("records", pa.list_(pa.struct([("id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])
    frame, index, sizes, size, total = [], [], [], 0, 0

    def row(data: bytes, records: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"bundle": f"bundle-{part:06d}-{made:04d}", "seq": len(sizes), "data": data, "records": records}], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            payload = r["payload"]
            revisit = r["first"] is not None and r["first"] != r["page_id"]
            data = record(r["page_id"], r["url"], payload, r["digest"], r["first"], revisit)
            index.append({"id": record_id(r["page_id"]), "offset": size, "length": len(data)})
            frame.append(data)
            size += len(data)
            if size >= FRAME_BYTES:
                packed = press.compress(b"".join(frame))
                yield row(packed, index)
                sizes.append((len(packed), size))
                total += len(packed)
                frame, index, size = [], [], 0
                if total >= BUNDLE_BYTES:
                    yield row(seek_table(sizes), [])
                    made, sizes, total = made + 1, [], 0
    if frame:
        packed = press.compress(b"".join(frame))
        yield row(packed, index)
        sizes.append((len(packed), size))
    if sizes:
        yield row(seek_table(sizes), [])


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The archive table of all pages; write it as Parquet."""
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    large = p.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    named = lambda d: d.withColumns({"none": F.col("page_id").isNull(), "at": F.coalesce("page_id", F.lit(0))})
    marks = named(large.distinct().join(firsts, "digest")).select("none", "at", "digest", "first")
    rows = named(p).join(marks, ["none", "at", "digest"], "left").select("page_id", "url", "payload", "digest", "first")
    return rows.mapInArrow(_bundles, ARCHIVE)


def parse_record(data: bytes) -> tuple:
    """One record in RECORD's columns; its digest is checked."""
    end = data.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(b": ", 1) for x in block[: cut - 4].split(b"\r\n")[1:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else block[cut:]
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{head['WARC-Record-ID']}: payload does not match its digest")
    return page_of(head["WARC-Record-ID"]), head["WARC-Type"], page_of(head.get("WARC-Refers-To")), int(http[b"Content-Length"]), digest, head.get("WARC-Target-URI"), payload


def frame_of(bundle: bytes, seq: int) -> bytes:
    """One decompressed frame of a whole bundle, found by its seek table."""
    sizes = read_seek_table(bundle)
    start = sum(packed for packed, _ in sizes[:seq])
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + sizes[seq][0]], max_output_size=sizes[seq][1])


def _unpack(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for packed, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if wanted:  # a seek table has no records
                    frame = unpress.decompress(packed.as_py())
                    rows = [parse_record(frame[r["offset"] : r["offset"] + r["length"]]) for r in wanted]
                    rows = [r if with_payload else (*r[:-1], None) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def records(stored: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record that an archive table (or rows of it with some of their records) names."""
    return stored.select("data", "records").mapInArrow(_unpack(with_payload), RECORD)


def fetch(stored: DataFrame, ids: DataFrame, key: str = "page_id") -> DataFrame:
    """Records by id: only the frames that hold a wanted id are opened, and in them only the
    wanted offsets are read."""
    wanted = ids.select(F.when(F.col(key).isNull(), "<urn:page:null>").otherwise(F.concat(F.lit("<urn:page:"), F.col(key).cast("string"), F.lit(">"))).alias("id")).distinct()
    index = stored.select("bundle", "seq", F.explode("records").alias("r")).select("bundle", "seq", "r", F.col("r.id").alias("id"))
    frames = index.join(wanted, "id", "left_semi").groupBy("bundle", "seq").agg(F.collect_list("r").alias("records"))  # of one frame
    return records(stored.drop("records").join(frames, ["bundle", "seq"]))
