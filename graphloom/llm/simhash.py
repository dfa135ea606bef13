"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints (64 bits) are split into three segments of 21, 21 and 22 bits. Of at most four
differing bits, the two segments with the fewest hold at most two between them. Each segment is
padded to the 23 bits of the perfect binary Golay code; decoding the segment and its 23
neighbours at one flipped bit gives one codeword index (if the segment is within two bits of a
codeword) or six. Two segments at a distance of at most two have a common neighbour, hence a
common index, so every pair to be linked meets under the index pair of some two segments.

Equal fingerprints are merged before any key is made, so groups of copies cost one fingerprint.
Under a key the fingerprints are verified exactly, each with each (some 84 keys a fingerprint over
50 million keys, so a key holds few of up to 10^8 fingerprints), and only a spanning forest of the
links leaves the task. Buckets above ``BUCKET_ROWS`` are
cut into chunks and every two chunks meet in a task of their own, which keeps memory bounded and
loses no link. Components come from the forest edges by rounds of minimum labels, each round
checkpointed in the shared folder. Joins of many rows with one (all copies of a text, all members
of a large component) spread the keys that have many rows over several tasks.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other;
a text of fewer than four words has one shingle; rows that repeat a doc_id are kept and linked
each by its own text; component_id is the smallest doc_id reachable (null if there is none);
other columns stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, UPPER, cut, fresh_dir, row_key, sorted_groups, spread_join, without

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: (shift, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BUCKET_ROWS = 4096
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 4-word shingles of one text."""
    words = (text or "").encode("utf-8").translate(_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.r_[0, ends[:-1]]
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :] - 1
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(begins[:n].tolist(), last[:n].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounds the unpacked bits
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, doc_key, fp long): the id, a key of id and text, and the fingerprint's
    bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "doc_key", "fp"])

    return docs.select("doc_id", row_key("doc_id", "text").alias("doc_key"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_key long, fp long")


@cache
def golay_table() -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word, as an array of 2^23 int16."""
    message = np.arange(4096, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    words = message << 11 | rest
    patterns = [0]
    bits = [1 << b for b in range(23)]
    patterns += bits
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table = np.full(1 << 23, -1, np.int16)
    for p in patterns:
        table[words ^ p] = message
    if (table < 0).any():
        raise AssertionError("the code is not perfect")
    return table


def segment_indices(words: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """The distinct indices of each 23-bit word and its 23 neighbours: one array for each word."""
    near = table[words[:, None] ^ np.r_[0, 1 << np.arange(23)][None, :]]
    near.sort(axis=1)
    fresh = np.c_[np.ones(len(near), bool), near[:, 1:] != near[:, :-1]]
    return [row[f] for row, f in zip(near, fresh, strict=True)]


def keys(fps: DataFrame) -> DataFrame:
    """(fp) -> (key, fp): several keys of each fingerprint, one for each index pair of two segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            table = golay_table()
            for at in range(0, whole.num_rows, 2048):
                fp = whole.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).astype(np.int64)
                bits = fp.view(np.uint64)
                seg = [segment_indices(((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64), table) for s, n in SEGMENTS]
                out_key, out_fp = [], []
                for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                    for k in range(len(fp)):
                        both = (seg[i][k].astype(np.int64)[:, None] << 12 | seg[j][k].astype(np.int64)[None, :]).ravel()
                        out_key.append(both | pair << 24)
                        out_fp.append(np.full(len(both), fp[k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key).astype(np.int32)), pa.array(np.concatenate(out_fp))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key int, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; counted on unsigned values, since numpy counts those of absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside ``a``, or between ``a`` and ``b``: two index arrays.

    With ``b``, indices of ``b`` count on from len(a). One vectorised row of distances at a time;
    each label that a row reaches gives one edge and is merged.
    """
    nodes = a if b is None else np.r_[a, b]
    label = np.arange(len(nodes))
    left, right = [], []
    for i in range(len(a)):
        shift = i + 1 if b is None else len(a)
        near = np.nonzero(_distance(nodes[shift:], a[i]) <= MAX_BITS)[0] + shift
        near = near[label[near] != label[i]]
        if len(near):
            others, at = np.unique(label[near], return_index=True)
            left += [i] * len(others)
            right += near[at].tolist()
            label[np.isin(label, others)] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


#: Groups up to this size are compared all at once, lag by lag.
SMALL_GROUP = 6


def _links_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, chunk, fp): forest of the links in each chunk of a bucket."""
    for starts, stops, cols in sorted_groups(batches):
        fps, sizes = cols[-1], stops - starts
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lag in range(1, SMALL_GROUP):
            some = (sizes > lag) & (sizes <= SMALL_GROUP)
            n = sizes[some] - lag
            if not len(n):
                continue
            at = np.repeat(starts[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            a, b = fps[at], fps[at + lag]
            close = _distance(a, b) <= MAX_BITS
            left.append(a[close])
            right.append(b[close])
        for i in np.nonzero(sizes > SMALL_GROUP)[0]:
            group = np.unique(fps[starts[i] : stops[i]])
            a, b = forest(group)
            left.append(group[a])
            right.append(group[b])
        left, right = np.concatenate(left), np.concatenate(right)
        if len(left):
            yield _edges(left, right)


def _links_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, chunk, other, side, fp): forest of the links between two chunks of a bucket."""
    held: tuple[tuple, np.ndarray] | None = None
    for starts, stops, cols in sorted_groups(batches):
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            pair, side, fps = tuple(int(c[s]) for c in cols[:3]), cols[3][s], np.unique(cols[-1][s:e])
            if side == 0:
                held = (pair, fps)
            elif held and held[0] == pair:
                a, b = forest(held[1], fps)
                both = np.r_[held[1], fps]
                yield _edges(both[a], both[b])


def links(fps: DataFrame) -> DataFrame:
    """Distinct (fp) -> (a, b): edges whose components are those of all links.

    Every two fingerprints of at most MAX_BITS differing bits are connected by the edges, and
    every edge is such a link.
    """
    # each row becomes some 84, so small partitions must not be put together first
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keys(cut(fps.repartition(parts, "fp")))
    large = keyed.groupBy("key").count().filter(F.col("count") > BUCKET_ROWS).withColumn("chunks", F.ceil(F.col("count") / BUCKET_ROWS).cast("int")).select("key", "chunks")
    has_large = large.limit(1).count() > 0
    if not has_large:
        dealt = keyed.withColumn("chunk", F.lit(0))
    else:
        large = cut(large)
        marked = keyed.join(large, "key", "left")
        dealt = marked.withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("chunks"))).cast("int"))
    columns = ["key", "chunk", "fp"]
    inside = dealt.select(columns).repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(_links_inside, "a long, b long")
    if not has_large:
        return inside.distinct()
    hot = dealt.filter("chunks is not null")
    others = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(F.least(F.col("chunk"), o).alias("chunk"), F.greatest(F.col("chunk"), o).alias("other"), F.when(F.col("chunk") < o, 0).otherwise(1).alias("side")),
    )
    met = hot.select("key", "fp", F.explode(F.filter(others, lambda o: o["chunk"] < o["other"])).alias("o")).select("key", "o.chunk", "o.other", "o.side", "fp")
    across = met.repartition("key", "chunk", "other").sortWithinPartitions("key", "chunk", "other", "side").mapInArrow(_links_across, "a long, b long")
    return inside.unionByName(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): connected components by alternating large and small stars.

    One row for each node that is not its component's smallest, the root.

    Every round takes two aggregations over at most the edges; edges shrink to stars around the
    smallest node of each component. A hub's edges meet its minimum in a join that Spark may split.
    """
    current, last = cut(edges.filter("a <> b").select("a", "b")), None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        current = cut(small.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        last = state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, doc_key, fp, root, component_id), one row for each row of ``docs``.

    ``root`` is the component's smallest fingerprint.
    """
    per_doc = cut(fingerprints(docs))
    distinct = cut(per_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_rows")))
    below = components(links(distinct.select("fp")))
    roots = below.unionByName(below.select(F.col("root").alias("node"), "root").distinct())
    linked = cut(roots.join(distinct, roots["node"] == distinct["fp"]).select("node", "root", "least_id"))
    least = linked.groupBy(F.col("root").alias("l_root")).agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
    of_node = spread_join(linked, least, "root", "l_root", "n_rows").select("node", "root", "component_id")
    joined = distinct.join(of_node, distinct["fp"] == of_node["node"], "left")
    component = F.when(F.col("node").isNull(), F.col("least_id")).otherwise(F.col("component_id"))
    of_fp = joined.select(F.col("fp").alias("c_fp"), F.coalesce("root", "fp").alias("root"), component.alias("component_id"), "n_rows")
    return spread_join(per_doc, of_fp, "fp", "c_fp", "n_rows").select("doc_id", "doc_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Of rows that share that id the one with the smallest key of id and text stays, of equal texts
    the one with the smallest hash of all columns. Rows without a doc_id come after all others; of
    a group of such rows one stays as well. Rows are judged each by its own text.
    """
    spark, at = docs.sparkSession, fresh_dir(docs.sparkSession, "copies")
    found = cut(near_duplicates(docs))
    first = found.groupBy(F.col("root").alias("f_root")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key")).alias("first"), F.count(F.lit(1)).alias("n_rows")
    )
    several = first.filter("n_rows > 1").select("f_root", F.col("first.doc_key").alias("first_key"), "n_rows")
    seen = spread_join(found, several, "root", "f_root", "n_rows").groupBy("doc_id", "doc_key").agg(F.max(F.col("doc_key") == F.col("first_key")).alias("stays"), F.count(F.lit(1)).alias("n"))
    seen.filter("n > 1 or not stays").select(F.col("doc_id").alias("g_id"), F.col("doc_key").alias("g_key"), "stays").write.parquet(at)
    gone, key = spark.read.parquet(at), row_key("doc_id", "text")
    others = without(docs, gone, key)
    twice = gone.filter("stays").select("g_key")
    if not twice.limit(1).count():
        return others
    again = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.xxhash64(*docs.columns).alias("hash")).join(twice, F.col("key") == F.col("g_key"), "left_semi")
    return others.unionByName(again.groupBy("key").agg(F.min_by("row", "hash").alias("row")).select("row.*"))
