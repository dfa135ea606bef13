"""Content-addressed blobs: files named by the SHA-256 of their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(root: str, digest: str) -> str:
    return f"{root}/{digest[:2]}/{digest[2:4]}/{digest}"


def write_blobs(rows: DataFrame, folder: str) -> DataFrame:
    """(content) -> (sha256, size_bytes): each distinct content once, moved into place when whole."""
    distinct = rows.select(F.sha2("content", 256).alias("sha256"), "content").filter("content is not null").dropDuplicates(["sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for digest, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = _place(root, digest)
                temp = f"{at}.{TaskContext.get().taskAttemptId()}.tmp"  # attempts do not share a file
                if fs.get_file_info(at).type == pafs.FileType.NotFound:
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    with fs.open_output_stream(temp, compression=None) as out:
                        out.write(content)
                    fs.move(temp, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in batch.column(1).to_pylist()], pa.int64())], names=["sha256", "size_bytes"])

    return distinct.mapInArrow(run, "sha256 string, size_bytes long")


#: Bytes of blobs that a task hands on at once.
READ_BYTES = 8 << 20


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, size_bytes, content) of all blobs below a folder; tasks list it, so no list of files passes the driver."""
    of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["sha256", "size_bytes", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for first in (n for batch in batches for n in batch.column(0).to_pylist()):
            rows, held = [], 0
            for info in fs.get_file_info(pafs.FileSelector(f"{root}/{first:02x}", allow_not_found=True, recursive=True)):
                if info.type != pafs.FileType.File or info.base_name.endswith(".tmp"):
                    continue
                with fs.open_input_stream(info.path, compression=None) as file:
                    rows.append((info.base_name, info.size, file.read()))
                held += info.size
                if held >= READ_BYTES:
                    yield of(rows)
                    rows, held = [], 0
            if rows:
                yield of(rows)

    return spark.range(0, 256, 1, 64).mapInArrow(run, "sha256 string, size_bytes long, content binary")


def reference_counts(documents: DataFrame) -> DataFrame:
    """(sha256, n): how many documents have each blob."""
    return documents.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


def unreferenced(blobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Blobs that no document has."""
    return blobs.join(documents.select("sha256").distinct(), "sha256", "left_anti")
