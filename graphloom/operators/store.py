"""The quad store: scans, set insert and delete, versions as immutable snapshots.

A store is a folder of snapshots, each a parquet table partitioned by graph and sorted by
predicate and subject (row groups can be skipped), and a pointer table that names the current
one. Writers make a new snapshot and then the pointer; readers never see half a write, and going
back is a pointer to an older snapshot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.sources.mapping import QUAD

#: Stands for "any graph" in scans, as opposed to None, the default graph.
ANY = object()
#: Lines of a block, which a task packs; 10,000 blocks of these may travel in one batch where bytes are not bounded.
BLOCK_LINES = 1000
BLOCKS = pa.schema([("g", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("block", pa.binary())])
SCHEMA = "g string, s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string"


def match(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, graph=ANY, s_kind: str = "iri", o_kind: str | None = None, o_dt: str | None = None, o_lang: str | None = None) -> DataFrame:
    """Quads that agree with all that is given. ``graph=None`` is the default graph."""
    tests: list[Column] = []
    if graph is not ANY:
        tests.append(F.col("g").isNull() if graph is None else F.col("g") == graph)
    if s is not None:
        tests += [F.col("s_kind") == s_kind, F.col("s") == s]
    for name, value in (("p", p), ("o", o), ("o_kind", o_kind), ("o_dt", o_dt), ("o_lang", o_lang)):
        if value is not None:
            tests.append(F.col(name) == value)
    for test in tests:
        quads = quads.filter(test)
    return quads


def _same(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in QUAD:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def insert(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Set union: quads that are there already change nothing."""
    return quads.select(QUAD).unionByName(new.select(QUAD)).distinct()


def remove(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """Set difference: quads that are not there change nothing."""
    return quads.select(QUAD).alias("a").join(gone.select(QUAD).alias("b"), _same("a", "b"), "left_anti")


def contains(quads: DataFrame, probe: DataFrame) -> DataFrame:
    """The rows of ``probe`` that are in the store."""
    return probe.select(QUAD).alias("a").join(quads.select(QUAD).alias("b"), _same("a", "b"), "left_semi")


def replace_graph(quads: DataFrame, graph: str, new: DataFrame) -> DataFrame:
    """The graph's quads are those of ``new``, whatever graph these name; other graphs stay."""
    return quads.filter(~F.col("g").eqNullSafe(F.lit(graph))).select(QUAD).unionByName(new.withColumn("g", F.lit(graph)).select(QUAD)).distinct()


def merged(quads: DataFrame, graphs: list[str]) -> DataFrame:
    """RDF merge of graphs: triples that are in several count once."""
    return quads.filter(F.col("g").isin(graphs)).select(QUAD[1:]).distinct()


def counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def lines(quads: DataFrame) -> DataFrame:
    """(line): the distinct N-Quads lines."""
    return quads.select(T.line_of().alias("line")).distinct()


def diff_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, line): lines that ``after`` added or took away; trailing blanks do not count."""
    trimmed = lambda d: d.select(F.regexp_replace("line", r"[\r ]+$", "").alias("line"))
    a, b = trimmed(before), trimmed(after)
    added = b.subtract(a).select(F.lit("added").alias("op"), "line")
    return added.unionByName(a.subtract(b).select(F.lit("removed").alias("op"), "line"))


def _line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, line), sorted -> blocks of a graph's lines without repeats, each ended by a line feed, with their place."""
    part, seq, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_LINES):
            rows = [r for r, _ in groupby(zip(*(c.to_pylist() for c in batch.slice(at, BLOCK_LINES).columns), strict=True))]
            if rows[0] == last:
                del rows[0]
            for g, some in groupby(rows, itemgetter(0)):
                yield pa.RecordBatch.from_pydict({"g": [g], "part": [part], "seq": [seq], "block": ["".join(f"{line}\n" for _, line in some).encode()]}, BLOCKS)
                seq += 1
            last = rows[-1] if rows else last


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, block), in order -> the SHA-256 of each graph's blocks."""
    g, digest = None, None
    told = lambda: pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([digest.hexdigest()])], names=["g", "signature"])
    for batch in batches:
        for name, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if digest is None or name != g:
                if digest is not None:
                    yield told()
                g, digest = name, hashlib.sha256()
            digest.update(block.as_buffer())
    if digest is not None:
        yield told()


def layer_signature(quads: DataFrame) -> DataFrame:
    """(g, signature): SHA-256 of each graph's sorted distinct lines.

    Lines are sorted by range, made distinct and packed into blocks in many tasks. The digest of a
    sequence can only be made from its begin to its end, so the blocks of a graph stream through
    one task in order; it holds a batch of blocks at a time, whatever the layer's size.
    """
    line = quads.select("g", T.line_of().alias("line"))
    blocks = line.repartitionByRange("g", "line").sortWithinPartitions("g", "line").mapInArrow(_line_blocks, "g string, part int, seq long, block binary")
    return blocks.repartition("g").sortWithinPartitions("g", "part", "seq").select("g", "block").mapInArrow(_digests, "g string, signature string")


def set_fingerprint(quads: DataFrame) -> DataFrame:
    """(g, n, fingerprint): an order-free fingerprint of each graph for layers of any size.

    The sum of 64-bit line hashes modulo 2^64 with the count; merges by partial sums, so no task
    needs a whole graph.
    """
    line = quads.select("g", T.line_of().alias("line")).distinct()
    total = F.sum(F.xxhash64("line").cast("decimal(38,0)"))
    return line.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.pmod(total, F.lit(str(2**64)).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


class SnapshotStore:
    """Versions of a quad table below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, snapshot string").json(f"{self.root}/pointers")
        except Exception as e:  # the folder does not exist before the first commit
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def versions(self) -> list[tuple[int, str]]:
        """(version, snapshot), oldest first; one row for each commit."""
        found = self._pointers()
        return [] if found is None else [(r["version"], r["snapshot"]) for r in found.orderBy("version").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        names = [n for v, n in known if version is None or v == version]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/snapshots/{names[-1]}").select(QUAD)

    def _point(self, snapshot: str) -> int:
        known = self.versions()
        version = known[-1][0] + 1 if known else 1
        self.spark.createDataFrame([(version, snapshot)], "version long, snapshot string").coalesce(1).write.mode("append").json(f"{self.root}/pointers")
        return version

    def commit(self, quads: DataFrame) -> int:
        """Writes a snapshot and makes it current; the new version."""
        name = uuid.uuid4().hex
        laid_out = quads.select(QUAD).distinct().repartitionByRange("g", "p", "s").sortWithinPartitions("g", "p", "s")
        laid_out.write.partitionBy("g").parquet(f"{self.root}/snapshots/{name}")
        return self._point(name)

    def revert(self, version: int) -> int:
        """Makes an older version's content current, as a new version."""
        return self._point(dict(self.versions())[version])


def predicate_patterns(quads: DataFrame) -> DataFrame:
    """(p, n, subjects): statistics that say in what order patterns are best joined."""
    return quads.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("subjects"))
