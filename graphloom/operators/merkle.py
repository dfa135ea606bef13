"""Versions of a layer as Merkle trees: a diff reads only the ranges of lines that changed.

A line's place is its SHA-256, so ranges are by content: the same line falls into the same range in
every version, ranges are of one size whatever the lines are, and nothing is sorted over the whole
layer. The first ``digits`` hexadecimal digits of the place name a range; a version is a table of
lines partitioned by range, and a tree of nodes: the digest of a range is over its lines' places in
order, that of a node above is over its children's digests, up to one root. Two versions of one
content have one root.

A diff goes down from the roots, level by level, to the children of nodes that differ; the ranges
it ends in (at most 16^digits names) prune both tables while they are planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T

#: Hexadecimal digits that name a range: 256 ranges; give more to layers beyond some 10^8 lines.
DIGITS = 2
#: Lines of a range are digested in parts of so many digits more, so that no task gathers a range.
PART_DIGITS = 2


def _leaf_digests(lines: DataFrame, digits: int) -> DataFrame:
    """(place, range) -> (node, digest, n): parts of a range first, then their digests in order."""
    part = F.substring("place", 1, digits + PART_DIGITS)
    small = lines.groupBy("range", part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("place")), "").cast("binary"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    told = F.array_sort(F.collect_list(F.struct("part", "d")))
    return small.groupBy(F.col("range").alias("node")).agg(F.sha2(F.to_json(told).cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))


def write_version(quads: DataFrame, path: str, digits: int = DIGITS) -> None:
    """Writes a layer's distinct lines by range, and its tree: below ``path``, lines and tree."""
    spark = quads.sparkSession
    line = quads.select(T.line_of().alias("line")).distinct().withColumn("place", F.sha2(F.col("line").cast("binary"), 256))
    ranged = line.withColumn("range", F.substring("place", 1, digits))
    ranged.repartition("range").write.partitionBy("range").parquet(f"{path}/lines")
    written = spark.read.schema("line string, place string, range string").parquet(f"{path}/lines")
    level = _leaf_digests(written, digits)
    for depth in range(digits, -1, -1):
        level.select("node", "digest", "n").write.parquet(f"{path}/tree/depth={depth}")
        below = spark.read.schema("node string, digest string, n long").parquet(f"{path}/tree/depth={depth}")
        up = F.expr(f"substring(node, 1, {max(depth - 1, 0)})")
        level = below.groupBy(up.alias("node")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node", "digest")))).cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))


def nodes(spark: SparkSession, path: str, depth: int) -> DataFrame:
    return spark.read.schema("node string, digest string, n long").parquet(f"{path}/tree/depth={depth}")


def root(spark: SparkSession, path: str) -> str | None:
    """The digest of a whole version; null if it has no lines."""
    first = nodes(spark, path, 0).select("digest").first()
    return first and first["digest"]


def changed_ranges(spark: SparkSession, before: str, after: str, digits: int = DIGITS) -> list[str]:
    """The names of ranges whose lines differ, found from the roots down: at most 16^digits."""
    open_ = [""]
    for depth in range(digits + 1):
        some = lambda path, name: nodes(spark, path, depth).filter(F.col("node").substr(1, max(depth - 1, 0)).isin(open_)).select("node", F.col("digest").alias(name))  # noqa: E731, B023
        met = some(before, "a").join(some(after, "b"), "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        open_ = sorted(r["node"] for r in met.select("node").collect())  # names of ranges
        if not open_:
            break
    return open_


def diff(spark: SparkSession, before: str, after: str, digits: int = DIGITS) -> tuple[DataFrame, int, int]:
    """((op, line), ranges read, ranges there are): lines added and removed between two versions."""
    ranges = changed_ranges(spark, before, after, digits)
    every = nodes(spark, before, digits).select("node").union(nodes(spark, after, digits).select("node")).distinct().count()
    lines = lambda path: spark.read.schema("line string, place string, range string").parquet(f"{path}/lines").filter(F.col("range").isin(ranges)).select("range", "place", "line")
    a, b = lines(before), lines(after)
    keys = ["range", "place"]
    added, removed = b.join(a.select(*keys), keys, "left_anti"), a.join(b.select(*keys), keys, "left_anti")
    out = added.select(F.lit("added").alias("op"), "line").unionByName(removed.select(F.lit("removed").alias("op"), "line"))
    return out, len(ranges), every
