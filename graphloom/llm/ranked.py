"""Ranked lexical search: document-at-a-time merges over compressed postings, shard by shard.

Every input partition is cut into shards of at most SHARD_DOCS documents or SHARD_POSTINGS
postings; a shard is one row: its terms in order, their document frequencies, and for each term the
postings in order of doc_id as gaps and counts in variable-length bytes. Shards are a table in the
shared folder, so a lost executor costs its tasks only. The number of documents and of words is
summed over all shards, and document frequencies of the asked terms too, so scores are global and
the shards' best merge exactly.

A task holds a block of queries (BLOCK_TERMS of their terms at most, which bounds what is
broadcast) and goes through its shards. Of a shard only the asked lists are decoded. For each query
a heap holds the cursors of its lists by the last document of the block of BLOCK postings each
stands in; the smallest of these ends a window in which every list's postings are at hand, so the
documents up to there are scored in full, in the order of doc_id, and offered to the query's
result heap of k entries keyed by score, then doc_id; then that cursor moves to its next block.
Each task tells its k best for each query, and a last merge ranks those.

Scores are whole numbers (see ``gains`` and ``weight``) and sums are exact: in doubles below
2^53, in 64-bit integers where a query could reach that.

Defined results: null or empty texts and queries match nothing, and documents without a term do
not count; rows without doc_id or item_id are left out; ties go to the smaller doc_id; document
rows that repeat a doc_id are separate documents, query rows that repeat an item_id are one query
of all their words; fewer than k matches give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_dir
from graphloom.llm.topk import _CELLS, _packed, _ranges, _unpacked

SHARD_DOCS, SHARD_POSTINGS = 8192, 2_500_000
#: Terms of a block of queries; postings that a cursor stands in at once.
BLOCK_TERMS, BLOCK = 500_000, 1024
ROW_GROUP = 16 << 20
SHARD = "n_docs long, n_words long, ids binary, lengths binary, terms binary, dfs binary, sizes binary, postings binary"
_SHARD = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in ("ids", "lengths", "terms", "dfs", "sizes", "postings")]])
RESULT = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CELLS).split()


def to_bytes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits, the lowest first, the last without the high bit; and how many bytes each has."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        size += v >= np.uint64(1 << (7 * k))
    at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        low = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[at[some] + k] = low | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def from_bytes(raw: np.ndarray) -> np.ndarray:
    """The numbers that ``to_bytes`` wrote."""
    if not len(raw):
        return np.empty(0, np.int64)
    begin = np.r_[0, np.flatnonzero(raw < 128)[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.r_[begin, len(raw)]))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin)


class _Writer:
    """Documents of a shard that is not full yet."""

    def __init__(self):
        self.places: dict[bytes, int] = {}
        self.ids, self.lengths, self.kinds, self.term, self.tf = array("q"), array("q"), array("q"), array("i"), array("q")

    def add(self, doc: int, text: str | None) -> None:
        counts = Counter(terms_of(text))
        if counts:
            places = self.places
            self.ids.append(doc)
            self.lengths.append(counts.total())
            self.kinds.append(len(counts))
            self.term.extend([places.setdefault(t, len(places)) for t in counts])
            self.tf.extend(counts.values())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.term) >= SHARD_POSTINGS

    def row(self) -> dict:
        ids, lengths = np.frombuffer(self.ids, np.int64), np.frombuffer(self.lengths, np.int64)
        n, names = len(ids), sorted(self.places)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        named = np.empty(len(names), np.int64)
        named[[self.places[t] for t in names]] = np.arange(len(names))
        term = named[np.frombuffer(self.term, np.int32)]
        doc = rank[np.repeat(np.arange(n), np.frombuffer(self.kinds, np.int64))]
        by = np.argsort(term * n + doc)
        term, doc, tf = term[by], doc[by], np.frombuffer(self.tf, np.int64)[by]
        first = np.r_[True, term[1:] != term[:-1]]
        gap = np.where(first, doc + 1, doc - np.r_[0, doc[:-1]])
        raw, size = to_bytes(np.stack([gap, tf], axis=1).ravel())
        begin = np.flatnonzero(first)
        return {
            "n_docs": n, "n_words": int(lengths.sum()), "ids": _packed(ids[order], np.int64), "lengths": _packed(lengths[order], np.int64), "terms": zstandard.compress(b" ".join(names), 1),
            "dfs": _packed(np.diff(np.r_[begin, len(term)]), np.int32), "sizes": _packed(np.add.reduceat(size, 2 * begin), np.int64), "postings": raw.tobytes(),
        }


def build_index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> SHARD rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Writer()
        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                shard.add(doc.as_py(), text.as_py())
                if shard.full():
                    yield pa.RecordBatch.from_pylist([shard.row()], schema=_SHARD)
                    shard = _Writer()
        if len(shard.ids):
            yield pa.RecordBatch.from_pylist([shard.row()], schema=_SHARD)

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SHARD)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(*batch.columns, strict=True):
            counts = Counter(terms_of(text.as_py()))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), item.as_py(), np.int64)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "term", "times"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _Block:
    """Queries of a block: the terms of each and how often each has them."""

    def __init__(self, rows: pa.Table):
        item, term, times = rows["item_id"].to_numpy(), rows["term"].to_pylist(), rows["times"].to_numpy()
        self.terms = sorted(set(term))
        places = {t: i for i, t in enumerate(self.terms)}
        place = np.array([places[t] for t in term], np.int64)
        order = np.lexsort((place, item))
        item, self.place, self.times = item[order], place[order], times[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        self.items, self.bounds = item[first], np.r_[first, len(item)]
        self.weights, self.n, self.words = np.zeros(len(self.terms), np.int64), 0, 1

    def among(self, terms: bytes) -> np.ndarray:
        """Where the block's terms are among a shard's, -1 where they are not."""
        at = {t: i for i, t in enumerate(zstandard.decompress(terms).split(b" "))}
        return np.array([at.get(t, -1) for t in self.terms], np.int64)


def _frequencies(block: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        df = np.zeros(len(b.terms), np.int64)
        for batch in batches:
            for terms, dfs in zip(*batch.columns, strict=True):
                at = b.among(terms.as_py())
                df += np.where(at >= 0, _unpacked(dfs.as_py(), np.int32)[at], 0)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], names=["place", "df"])

    return run


class _Lists:
    """A shard's postings of a block's terms, each list in the order of doc_id."""

    def __init__(self, row: dict, b: _Block):
        self.ids, lengths = _unpacked(row["ids"].as_py(), np.int64), _unpacked(row["lengths"].as_py(), np.int64)
        self.n = len(self.ids)
        at, df, size = b.among(row["terms"].as_py()), _unpacked(row["dfs"].as_py(), np.int32), _unpacked(row["sizes"].as_py(), np.int64)
        begin, there = np.cumsum(size) - size, at >= 0
        self.size = np.where(there, df[at], 0).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        numbers = from_bytes(np.frombuffer(row["postings"].as_buffer(), np.uint8)[_ranges(begin[at[there]], size[at[there]])])
        gap, tf = numbers[::2], numbers[1::2]
        owner = np.repeat(np.arange(len(self.size)), self.size)
        total = np.cumsum(gap)
        self.doc = total - np.repeat(np.r_[0, total][self.begin], self.size) - 1
        self.key = owner * self.n + self.doc
        m = 25 + (75 * lengths * b.n) // b.words
        self.gain = b.weights[owner] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))

    def merge(self, terms: np.ndarray, times: np.ndarray, exact: bool, best: list[tuple[int, int]], k: int) -> None:
        """Takes this shard's documents for one query into ``best``, a heap of (score, -doc_id)."""
        some = self.size[terms] > 0
        terms, times = terms[some], times[some]
        cursor, end = self.begin[terms].copy(), self.begin[terms] + self.size[terms]
        heap = [(int(self.doc[cursor[i] + BLOCK - 1]), i) for i in np.flatnonzero(end - cursor > BLOCK).tolist()]
        heapq.heapify(heap)
        low = 0
        while low < self.n and len(terms):
            edge = heap[0][0] if heap else self.n - 1
            stop = np.searchsorted(self.key, terms * self.n + edge, "right")
            rows, reps = _ranges(cursor, stop - cursor), np.repeat(times, stop - cursor)
            if exact:
                score = np.bincount(self.doc[rows] - low, weights=self.gain[rows] * reps, minlength=edge - low + 1)
            else:
                score = np.zeros(edge - low + 1, np.int64)
                np.add.at(score, self.doc[rows] - low, self.gain[rows] * reps)
            self.offer(score, low, best, k)
            cursor, low = stop, edge + 1
            while heap and heap[0][0] < low:
                _, i = heapq.heappop(heap)
                if end[i] - cursor[i] > BLOCK:
                    heapq.heappush(heap, (int(self.doc[cursor[i] + BLOCK - 1]), i))

    def offer(self, score: np.ndarray, low: int, best: list[tuple[int, int]], k: int) -> None:
        found = np.flatnonzero(score >= (best[0][0] if len(best) >= k else 1))
        if len(found) > k:  # no more than k of a window can stay; documents are in the order of doc_id
            found = found[np.argsort(-score[found], kind="stable")[:k]]
        for i in found.tolist():
            one = (int(score[i]), -int(self.ids[low + i]))
            if len(best) < k:
                heapq.heappush(best, one)
            else:
                heapq.heappushpop(best, one)


def _search(block: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best: list[list[tuple[int, int]]] = [[] for _ in b.items]
        spans = [slice(x, y) for x, y in zip(b.bounds[:-1], b.bounds[1:], strict=True)]
        exact = [float((b.times[s] * b.weights[b.place[s]]).sum()) * 1e6 < 2**53 for s in spans]
        for batch in batches:
            for i in range(batch.num_rows):  # one shard at a time
                lists = _Lists({c: batch.column(c)[i] for c in ("ids", "lengths", "terms", "dfs", "sizes", "postings")}, b)
                for q, s in enumerate(spans):
                    lists.merge(b.place[s], b.times[s], exact[q], best[q], k)
        sizes = [len(h) for h in best]
        flat = np.array([x for h in best for x in h], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.items, sizes)), pa.array(-flat[:, 1]), pa.array(flat[:, 0].copy())], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, text), (item_id, text) -> item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    at = fresh_dir(spark, "ranked")
    build_index(docs).write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/shards")
    shards = spark.read.parquet(f"{at}/shards")
    facts = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    asked = items.filter("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_asked, "item_id long, term binary, times long")
    asked.groupBy("item_id", "term").agg(F.sum("times").alias("times")).write.parquet(f"{at}/asked")
    asked = spark.read.parquet(f"{at}/asked")
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    found = None
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow()  # about BLOCK_TERMS rows
        if not rows.num_rows or not facts["n"]:
            continue
        block = _Block(rows)
        block.n, block.words = facts["n"], facts["words"]
        shared = spark.sparkContext.broadcast(block)
        df = shards.select("terms", "dfs").mapInArrow(_frequencies(shared), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block
        shared.destroy()
        for place, n in zip(df["place"].to_pylist(), df["df"].to_pylist(), strict=True):
            block.weights[place] = weight(block.n, n)
        shared = spark.sparkContext.broadcast(block)
        shards.mapInArrow(_search(shared, k), RESULT).write.parquet(f"{at}/found-{i}")
        shared.destroy()
        part = spark.read.schema(RESULT).parquet(f"{at}/found-{i}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
