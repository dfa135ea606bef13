"""WARC archives with Zstandard: written and read by Spark tasks, one file for each partition.

Layout of a file: a leading skippable frame that holds the compression dictionary, then one
Zstandard frame for each record. Records with equal payloads of at least ``REVISIT_BYTES`` are
written in full once (the largest page_id), the others as ``revisit`` records that refer to it;
which record is which comes from one pre-aggregated grouping by digest. Only pages whose digest's
slot holds a repeated one travel, for a join that Spark may split; all others stay where they are.

Files are written below a folder that all executors share (any file system that pyarrow opens,
among them file, s3, gs and hdfs), under a temporary name that is moved into place when
the task's file is whole; names come from the partition, so a repeated task replaces its own file
with equal content. The reader goes by the list of written files, streams a file frame by frame
and checks each record's version line, header fields, block length and payload digest.

Defined results: a null html counts as empty; a null page_id is kept in the record as an empty
field and read back as null; a null url is written as an empty target; rows that repeat a page_id
and payload: all are responses where the page_id is the largest; empty tables give no files;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_dir, slot, slots_of

REVISIT_BYTES = 1000
#: Magic number of the skippable frame that carries the dictionary (fixed by the format).
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = (0xFD2FB528).to_bytes(4, "little")
DICTIONARY_BYTES = 65_536
#: Pages that are held at a time; the first of them train their file's dictionary by SAMPLE_BYTES of each.
BATCH_PAGES, SAMPLE_BYTES = 200, 4096
LEVEL = 3
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string"


class BadRecord(ValueError):
    """A record or frame that does not hold what its headers say."""


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, payload, digest, record_type, refers_to."""
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    at = fresh_dir(pages.sparkSession, "repeated")
    repeated = full.filter(large).groupBy(F.col("digest").alias("f_digest")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated.select("f_digest", "first", F.xxhash64("f_digest").alias("f_key")).write.parquet(at)
    firsts = pages.sparkSession.read.parquet(at)
    slots, in_slot = slots_of(firsts, "f_key"), large & (slot(F.xxhash64("digest")) == F.col("_slot"))
    alone = full.join(slots, in_slot, "left_anti").withColumn("first", F.lit(None).cast("long"))
    met = full.join(slots, in_slot, "left_semi").join(firsts, F.col("digest") == F.col("f_digest"), "left")
    joined = met.select("page_id", "url", "payload", "digest", "first").unionByName(alone)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_bytes(page_id: int | None, url: str, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; BadRecord where a header, a length or a digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord(f"no WARC header: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadRecord(f"no header field: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise BadRecord(f"{needed} is missing")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[int(length) :] != b"\r\n\r\n":
        raise BadRecord(f"the block has {len(rest) - 4} bytes; content-length says {length}")
    kind, payload = fields["warc-type"], rest[: int(length)]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = int(fields.get("x-payload-length", length))
    if kind == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise BadRecord(f"the payload of {fields['warc-record-id']} is not what its headers say")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise BadRecord("a revisit refers to no record")
    page = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
    return {
        "page_id": page(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "url": fields.get("warc-target-uri", ""),
        "payload": payload,
    }


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where there is too little to train on."""
    parts = [s[:SAMPLE_BYTES] for s in samples if s]
    if len(parts) >= 32:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def skippable(content: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Writes ``with_types`` rows as archives below ``folder``; (file, n_records) of each, written there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        final = f"{root}/part-{task.partitionId():06d}.warc.zst"
        out, press, n, temp = None, None, 0, f"{final}.{task.taskAttemptId()}.tmp"
        for rows in (batch.slice(at, BATCH_PAGES).to_pylist() for batch in batches for at in range(0, batch.num_rows, BATCH_PAGES)):
            if out is None:
                fs.create_dir(root, recursive=True)
                words = dictionary_of([record_bytes(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in rows])
                press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True)
                out = fs.open_output_stream(temp, compression=None)
                out.write(skippable(words))
            for r in rows:
                out.write(press.compress(record_bytes(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"])))
                n += 1
        if out is not None:
            out.close()
            fs.move(temp, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "n_records": pa.array([n], pa.int64())})

    typed.select("page_id", "url", "payload", "payload_bytes", "digest", "record_type", "refers_to").mapInArrow(run, "file string, n_records long").write.parquet(f"{folder}/_files")
    return typed.sparkSession.read.parquet(f"{folder}/_files")


def frames(stream) -> Iterator[bytes]:
    """Decoded records of an archive: the dictionary first, then one frame at a time."""
    head = stream.read(8)
    words = None
    if head[:4] == DICTIONARY_MAGIC.to_bytes(4, "little"):
        size = int.from_bytes(head[4:8], "little")
        words = stream.read(size)
        if len(words) != size:
            raise BadRecord("the dictionary frame is cut off")
        held = b""
    else:
        held = head
    if words and words[:4] == FRAME_MAGIC:  # the format lets the dictionary itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words, max_output_size=1 << 27)
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    while True:
        held = held or stream.read(READ_BYTES)
        if not held:
            return
        if held[:4] != FRAME_MAGIC[: len(held[:4])]:
            raise BadRecord("a frame does not begin where the last one ended")
        one, parts = opened.decompressobj(), []
        while True:
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
            if one.eof:
                break
            held = stream.read(READ_BYTES)
            if not held:
                raise BadRecord("the last frame is cut off")
        yield b"".join(parts)


def read_archives(spark: SparkSession, files: DataFrame, payloads: bool = True) -> DataFrame:
    """(file, n_records) -> RECORDS; fails where a file holds other records than it should.

    Without ``payloads`` the payload column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("file", pa.string())])
        for batch in batches:
            for listed in batch.to_pylist():
                fs = pafs.FileSystem.from_uri(listed["uri"])[0] if "://" in listed["uri"] else pafs.LocalFileSystem()
                n, rows, held = 0, [], 0
                with fs.open_input_stream(listed["file"], compression=None) as stream:
                    for raw in frames(stream):
                        row = parse_record(raw) | {"file": listed["file"]}
                        held += len(raw) if payloads else 256
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        n += 1
                        if held > 4 * READ_BYTES or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if n != listed["n_records"]:
                    raise BadRecord(f"{listed['file']} has {n} records, not {listed['n_records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n_files = max(1, files.count())  # a number keeps Spark from putting the short list into one task
    return files.select("file", "n_records", "uri").repartition(n_files, "file").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Writes ``pages`` as archives below ``folder`` (default: a new one in the shared folder) and reads them back."""
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    files = write_archives(with_types(pages), folder)
    return read_archives(spark, files.withColumn("uri", F.lit(folder)), payloads)
