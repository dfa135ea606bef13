"""Exact top-k search: BM25 over a sharded inverted index, with block bounds on long lists.

Every input partition is cut into shards of at most ``SHARD_DOCS`` documents or
``SHARD_POSTINGS`` postings; a shard is one row of sorted term hashes, list bounds and postings,
written as a table in the shared folder. Documents of a shard, and queries of a block, are ordered by which of the most
frequent terms they have, which brings languages and kinds together and makes block maxima tell them apart. Document frequencies are summed over all shards for the
query terms, and the number of documents and their mean length over all of them, so every shard
scores with global statistics and the shards' top k merge exactly.

A task holds a block of queries (``BLOCK_POSTINGS`` of their terms at most, which bounds what is
broadcast) and goes through its shards, carrying each query's k-th best score on as threshold.
One shard in eight is searched first, and the k-th best scores there are where the others begin.
Within a shard, documents lie in blocks. What a list holds in a block where it is long is a row of
that block's matrix, with its maximum; all else are short lists, added up posting by posting. A document
block is scored for a query only if the largest sum of its short lists and the block maxima of
the query's long lists together reach the threshold (the WAND condition, with block maxima as
bounds); the queries that are left at a block are scored there by one matrix product. Documents
that reach the threshold are scored again in doubles, term by term in one order. Scores are ranked
as rounded to six digits, so threshold and bounds give way by that rounding step and, relative to
the score, by the worst error of single-precision sums of so many terms: nothing that belongs to
the top k, ties included, is pruned.

Each block's results are written before the next block begins, and what was broadcast for it is
destroyed then, so the driver and the executors hold one block at a time.

Defined results: null or empty texts and queries match nothing; rows without doc_id are left out;
scores are rounded to six digits and ties go to the smaller doc_id; document rows that repeat a
doc_id are separate documents, query rows that repeat a query_id are one query of all their words; fewer than k matches give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM_WORD, UPPER, fresh_dir

K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_POSTINGS = 4096, 2_000_000
BLOCK_POSTINGS = 1_000_000
#: Documents of a block; queries scored together; a list is long in a block if the geometric mean of the shares of
#: the block's documents and of all queries that have its term is above 1 / LONG.
DOC_BLOCK, QUERY_BATCH, LONG = 256, 128, 24
#: Postings of short lists that are added up together, which stay in a core's cache.
ADDED = 64_000
#: The most frequent terms by which documents and queries are brought together.
MARKS = 24
#: Shards whose documents are put in order together.
ORDERED_SHARDS = 4
#: One shard in so many is searched first; its k-th best scores are the others' thresholds.
FIRST_PART = 8
#: Above the two roundings to six digits that a threshold and a score have.
STEP = 1.1e-6
#: Bytes of a row group of the index, which bounds what a task reads ahead.
ROW_GROUP = 16 << 20
#: Bytes of words lower-cased, all others as spaces.
_CELLS = bytes(b if re.match(ALNUM_WORD.encode(), bytes([b])) else b + 32 if chr(b) in UPPER else 32 for b in range(256))


def slack(terms: np.ndarray) -> np.ndarray:
    """Worst error of single-precision sums of so many products, relative to the sum."""
    return (terms + 8.0) * 2.0**-23


RESULT = "query_id long, doc_id long, score double"
SHARD = "n_docs long, n_words long, ids binary, lengths binary, terms binary, bounds binary, docs binary, tfs binary"


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted term hashes, counts, number of words) of a text."""
    words = Counter((text or "").encode("utf-8").translate(_CELLS).split())
    h = xxhash.xxh3_64_intdigest
    terms, counts = np.fromiter(map(h, words), np.uint64, len(words)), np.fromiter(words.values(), np.int64, len(words))
    order = np.argsort(terms)
    return terms[order], counts[order], int(counts.sum())


def _packed(a: np.ndarray, kind: type) -> bytes:
    """An array as a Zstandard frame: rows of the index stay small where Spark holds them."""
    return zstandard.compress(a.astype(kind).tobytes(), 1)


def _unpacked(raw, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def _shard(held: list[tuple[int, np.ndarray, np.ndarray, int]]) -> dict:
    ids = np.array([d for d, _, _, _ in held], np.int64)
    lengths = np.array([n for *_, n in held], np.int64)
    term = np.concatenate([t for _, t, _, _ in held])
    tf = np.concatenate([c for _, _, c, _ in held]).astype(np.int32)
    doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for _, t, _, _ in held])
    order = np.argsort(term, kind="stable")
    term, tf, doc = term[order], tf[order], doc[order]
    first = np.nonzero(np.r_[True, term[1:] != term[:-1]])[0] if len(term) else np.empty(0, np.int64)
    return {
        "n_docs": len(ids), "n_words": int(lengths.sum()), "ids": _packed(ids, np.int64), "lengths": _packed(lengths, np.int64), "terms": _packed(term[first], np.uint64),
        "bounds": _packed(np.r_[first, len(term)], np.int64), "docs": _packed(doc, np.int32), "tfs": _packed(tf, np.int32),
    }


def _kinds(owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts a number that says which of the most frequent terms it has, the first of them heaviest."""
    known, df = np.unique(term[owner % 8 == 0] if n >= 4096 else term, return_counts=True)  # of some texts where there are many: this is for the order only
    marks = np.sort(known[np.lexsort((known, -df))[:MARKS]])
    if not len(marks):
        return np.zeros(n, np.int64)
    place = np.empty(len(marks), np.int64)
    place[np.lexsort((marks, -df[np.searchsorted(known, marks)]))] = len(marks) - 1 - np.arange(len(marks))
    at = np.minimum(np.searchsorted(marks, term), len(marks) - 1)
    mark = np.where(marks[at] == term, place[at], -1)
    kind = np.zeros(n, np.int64)
    np.add.at(kind, owner[mark >= 0], 1 << mark[mark >= 0])
    return kind


def _shards(held: list[tuple[int, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    """Shards of documents ordered by the most frequent terms that they have, so that blocks are of one kind."""
    owner = np.repeat(np.arange(len(held)), [len(d[1]) for d in held])
    kind = _kinds(owner, np.concatenate([d[1] for d in held]), len(held)).tolist()
    held = [held[i] for i in sorted(range(len(held)), key=lambda i: (kind[i], held[i][0]))]
    rows, begin, size = [], 0, 0
    for i, d in enumerate(held):
        size += len(d[1])
        if i + 1 - begin >= SHARD_DOCS or size >= SHARD_POSTINGS or i + 1 == len(held):
            rows.append(_shard(held[begin : i + 1]))
            begin, size = i + 1, 0
    schema = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in ("ids", "lengths", "terms", "bounds", "docs", "tfs")]])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def build_index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> SHARD rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                one = term_counts(text.as_py())
                held.append((doc.as_py(), *one))
                size += len(one[0])
                if len(held) >= ORDERED_SHARDS * SHARD_DOCS or size >= ORDERED_SHARDS * SHARD_POSTINGS:
                    yield _shards(held)
                    held, size = [], 0
        if held:
            yield _shards(held)

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SHARD)


def _shard_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, bounds in zip(batch.column(0), batch.column(1), strict=True):
            t, b = _unpacked(terms.as_py(), np.int64), _unpacked(bounds.as_py(), np.int64)
            for at in range(0, len(t), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(t[at : at + 100_000]), pa.array(np.diff(b)[at : at + 100_000])], names=["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for query, text in zip(*batch.columns, strict=True):
            terms, counts, _ = term_counts(text.as_py())
            if len(terms):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), query.as_py(), np.int64)), pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], names=["query_id", "term", "qtf"])


class _Block:
    """Queries of one block: which of the block's terms each has, with idf times query count."""

    def __init__(self, rows, n_docs: int, mean_length: float):
        query, term = rows["query_id"].to_numpy(), rows["term"].to_numpy().view(np.uint64)
        idf = np.log(1 + (n_docs - rows["df"].to_numpy() + 0.5) / (rows["df"].to_numpy() + 0.5))
        order = np.lexsort((term, query))
        query, term, weight = query[order], term[order], (idf * rows["qtf"].to_numpy())[order]
        self.terms, self.place = np.unique(term, return_inverse=True)
        first = np.nonzero(np.r_[True, query[1:] != query[:-1]])[0]
        sizes = np.diff(np.r_[first, len(query)])
        self.asked = np.bincount(self.place, minlength=len(self.terms)) / max(len(first), 1)  # share of the queries that have a term
        # queries of one kind are scored together
        order = np.argsort(_kinds(np.repeat(np.arange(len(first)), sizes), term, len(first)), kind="stable")
        rows = _ranges(first[order], sizes[order])
        self.queries, self.bounds, self.weights, self.place, self.mean_length = query[first][order], np.r_[0, np.cumsum(sizes[order])], weight[rows], self.place[rows], mean_length


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


class _Lists:
    """A shard's postings of a block's terms: short lists, long lists as a matrix, block maxima."""

    def __init__(self, row: dict, block: _Block):
        self.ids, lengths = _unpacked(row["ids"], np.int64), _unpacked(row["lengths"], np.int64)
        terms, bounds = _unpacked(row["terms"], np.uint64), _unpacked(row["bounds"], np.int64)
        self.n = n = len(self.ids)
        at = np.minimum(np.searchsorted(terms, block.terms), max(len(terms) - 1, 0))
        there = terms[at] == block.terms if len(terms) else np.zeros(len(block.terms), bool)
        begin = np.where(there, bounds[at], 0)
        self.size = np.where(there, bounds[at + 1] - begin, 0) if len(terms) else np.zeros(len(block.terms), np.int64)
        rows = _ranges(begin, self.size)
        self.begin = np.cumsum(self.size) - self.size
        self.doc = _unpacked(row["docs"], np.int32)[rows]
        tf = _unpacked(row["tfs"], np.int32)[rows]
        norm = K1 * (1 - B + B * lengths / block.mean_length)
        self.impact = tf * (K1 + 1) / (tf + norm[self.doc])
        del rows, tf
        owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        # the same postings by document, for exact scores
        by_doc = np.argsort(self.doc, kind="stable").astype(np.int32)
        self.f_term, self.f_impact = owner[by_doc], self.impact[by_doc]
        self.f_bounds = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.scratch = np.zeros(len(self.size))
        # what a list has in a block where it is long is a row of the block's matrix, the rest are short lists
        self.blocks = -(-n // DOC_BLOCK)
        part = owner.astype(np.int64) * self.blocks + self.doc // DOC_BLOCK
        first = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0] if len(part) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[first, len(part)])
        heavy = sizes * block.asked[owner[first]] > DOC_BLOCK / LONG**2
        row_term, row_block = np.divmod(part[first[heavy]], max(self.blocks, 1))
        long_ = np.unique(row_term)
        self.row_of = np.full(len(self.size), -1)
        self.row_of[long_] = np.arange(len(long_))
        self.long = len(long_)
        by_block = np.argsort(row_block, kind="stable")
        matrix = np.zeros((len(row_term), DOC_BLOCK), np.float32)
        row = np.empty(len(row_term), np.int64)
        row[by_block] = np.arange(len(row_term))
        mine = np.repeat(heavy, sizes)
        matrix[np.repeat(row, sizes[heavy]), self.doc[mine] % DOC_BLOCK] = self.impact[mine]
        cuts = np.searchsorted(row_block[by_block], np.arange(self.blocks + 1))
        rows = self.row_of[row_term[by_block]]
        self.parts = [(rows[a:b], matrix[a:b], matrix[a:b].max(axis=1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.short = np.bincount(owner[~mine], minlength=len(self.size))
        self.begin = np.cumsum(self.short) - self.short
        # document and impact of a posting side by side, as they are read: (int32, float32) in 8 bytes
        self.pairs = np.empty(2 * int(self.short.sum()), np.int32)
        self.pairs[::2], self.pairs[1::2] = self.doc[~mine], self.impact[~mine].astype(np.float32).view(np.int32)
        del self.doc, self.impact

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores in doubles; terms are added in the order of their hashes."""
        self.scratch[terms] = weights
        sizes = self.f_bounds[docs + 1] - self.f_bounds[docs]
        rows = _ranges(self.f_bounds[docs], sizes)
        scores = np.bincount(np.repeat(np.arange(len(docs)), sizes), weights=self.scratch[self.f_term[rows]] * self.f_impact[rows], minlength=len(docs))
        self.scratch[terms] = 0
        return scores

    def candidates(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) pairs, by query, that can belong to the top k.

        ``query``, ``terms``, ``weights``: the query terms of a batch; ``least``: each query's
        threshold so far, 0 where there is none.
        """
        n, width = len(least), self.blocks * DOC_BLOCK
        error = slack(np.bincount(query, minlength=n))
        score = np.zeros(n * width, np.float32)
        low, pairs = weights.astype(np.float32), self.pairs.view(np.int64)
        ends = np.cumsum(self.short[terms])
        first = 0
        while first < len(terms):  # so many postings of short lists at a time
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + ADDED, "right")))
            sizes = self.short[terms[first:last]]
            found = pairs[_ranges(self.begin[terms[first:last]], sizes)]
            cell = np.repeat(query[first:last].astype(np.int64) * width, sizes)
            cell += found.view(np.int32)[::2]
            part = np.repeat(low[first:last], sizes)
            part *= found.view(np.float32)[1::2]
            np.add.at(score, cell, part)
            first = last
        score = score.reshape(n, width)
        row = self.row_of[terms]
        heavy = np.zeros((self.long, n), np.float32)
        heavy[row[row >= 0], query[row >= 0]] = weights[row >= 0]
        used = np.bincount(row[row >= 0], minlength=self.long) > 0
        floor = least * (1 - error) - STEP
        alive = np.empty((n, self.blocks), bool)
        most = score.reshape(n, self.blocks, DOC_BLOCK).max(axis=2)
        for b, (rows, matrix, top) in enumerate(self.parts):
            at, here = slice(b * DOC_BLOCK, (b + 1) * DOC_BLOCK), used[rows]
            mine = heavy[rows[here]]
            alive[:, b] = most[:, b] + top[here] @ mine >= floor
            some = np.nonzero(alive[:, b])[0]
            if len(some) and len(mine):
                matrix = matrix if here.all() else matrix[here]
                if len(some) == n:
                    score[:, at] += mine.T @ matrix
                else:
                    score[some, at] += mine[:, some].T @ matrix
        many = np.nonzero((least <= 0) | ((score >= floor[:, None]).sum(axis=1) > 4 * k))[0]
        if len(many) and width >= k:  # no use in scoring more than can be the best k here
            floor[many] = np.maximum(floor[many], np.partition(score[many], width - k, axis=1)[:, width - k] * (1 - 2 * error[many]) - STEP)
        low = np.nextafter(np.maximum(floor, 1e-30).astype(np.float32), np.float32(0))
        of, doc = np.divmod(np.flatnonzero(score >= low[:, None]), max(width, 1))
        inside = (doc < self.n) & alive[of, doc // DOC_BLOCK]
        return of[inside], doc[inside]


def _search_task(block: Broadcast, k: int):
    """Task that searches its shards for the block's queries; ``block`` holds (_Block, thresholds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, known = block.value
        n = len(b.queries)
        owner = np.repeat(np.arange(n), np.diff(b.bounds))
        least = known.copy()
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * n
        for batch in batches:
            for i in range(batch.num_rows):  # one shard at a time
                lists = _Lists({c: batch.column(c)[i].as_buffer() for c in ("ids", "lengths", "terms", "bounds", "docs", "tfs")}, b)
                for first in range(0, n, QUERY_BATCH):
                    last = min(n, first + QUERY_BATCH)
                    span = slice(b.bounds[first], b.bounds[last])
                    query, doc = lists.candidates(owner[span] - first, b.place[span], b.weights[span], least[first:last], k)
                    cuts = np.searchsorted(query, np.arange(last - first + 1))
                    for j in np.unique(query):
                        q, docs = first + j, doc[cuts[j] : cuts[j + 1]]
                        mine = slice(b.bounds[q], b.bounds[q + 1])
                        new = np.round(lists.exact(docs, b.place[mine], b.weights[mine]), 6)
                        scores, ids = np.concatenate((best[q][0], new)), np.concatenate((best[q][1], lists.ids[docs]))
                        top = np.lexsort((ids, -scores))[:k]
                        best[q] = scores[top], ids[top]
                        if len(top) >= k:
                            least[q] = max(least[q], best[q][0][k - 1])
        n_found = np.array([len(s) for s, _ in best], np.int64)
        if n_found.sum():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.queries, n_found)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "doc_id", "score"]
            )

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, text), (query_id, text) -> query_id, rank, doc_id, score: the k best of each query."""
    spark = docs.sparkSession
    at = fresh_dir(spark, "index")
    build_index(docs).write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/shards")
    shards = spark.read.parquet(f"{at}/shards")
    facts = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    asked = queries.filter("query_id is not null").select(F.col("query_id").cast("long"), F.col("text").cast("string")).mapInArrow(_query_terms, "query_id long, term long, qtf long")
    asked = asked.groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
    wanted = shards.select("terms", "bounds").mapInArrow(_shard_terms, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked.join(wanted, "term").write.parquet(f"{at}/queries")
    asked = spark.read.parquet(f"{at}/queries")
    blocks = max(1, math.ceil(asked.count() / BLOCK_POSTINGS))
    first = F.pmod(F.xxhash64("ids"), F.lit(FIRST_PART)) == 0

    def written(part: DataFrame, block: _Block, known: np.ndarray, name: str) -> DataFrame:
        shared = spark.sparkContext.broadcast((block, known))
        part.mapInArrow(_search_task(shared, k), RESULT).write.parquet(f"{at}/{name}")
        shared.destroy()
        return spark.read.schema(RESULT).parquet(f"{at}/{name}")

    found = None
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()  # about BLOCK_POSTINGS rows
        if not rows.num_rows:
            continue
        block = _Block(rows, facts["n"], max(facts["words"] / facts["n"], 1e-9))
        known = np.zeros(len(block.queries))
        seen = written(shards.filter(first), block, known, f"first-{i}")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
        kth = seen.withColumn("place", place).filter(F.col("place") == k).select("query_id", "score").toArrow()  # at most a row for each query of the block
        by_id = np.argsort(block.queries)
        known[by_id[np.searchsorted(block.queries, kth["query_id"].to_numpy(), sorter=by_id)]] = kth["score"].to_numpy()
        part = seen.unionByName(written(shards.filter(~first), block, known, f"others-{i}"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
