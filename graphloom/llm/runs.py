"""Periodic run detection in texts by probing a harmonic grid of words.

A run with period p and at least 4p words holds three neighbouring grid points jp, (j+1)p, (j+2)p
whose words equal those p further on, so only such points are extended. Over all periods the grid
has n ln n points: for periods up to the root of n one array comparison takes all points of a
period, beyond it one takes the same point of a whole band of periods, so a text costs about
4 sqrt(n) comparisons. A point that is left is extended to both sides by comparing chunks that
double in size. Periods go upwards, and points are skipped where they and the three that follow
lie within a run found before (its period then divides p, so it is the same stretch) or within the
stretch just extended. A stretch that was found with a smaller period is not told again.

One Arrow pass, no shuffle; a task holds a batch of texts, and for one text its words as numbers
and the points left in one band of periods (at most as many as words).

Defined results: a null or empty text has no words and no runs; rows are kept as they are, repeats
and null ids included; runs are ordered by start, then period; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free_name

#: A run repeats its period so many times, and has so many words at least.
TIMES, LEAST = 4, 6
CHUNK = 64
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Found:
    """Runs found so far, and which stretches lie within one of them."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        self.stretches: set[tuple[int, int]] = set()
        self.known = 0

    def covers(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not self.runs:
            return np.zeros(len(first), bool)
        if self.known != len(self.runs):
            at = np.array(self.runs, np.int64)[:, :2]
            at = at[np.argsort(at[:, 0], kind="stable")]
            self.starts, self.ends, self.known = at[:, 0], np.r_[-1, np.maximum.accumulate(at.sum(axis=1))], len(self.runs)
        return self.ends[np.searchsorted(self.starts, first, "right")] > last


def _stretch(w: np.ndarray, p: int, x: int) -> tuple[int, int]:
    """The widest [a, b) around x in which every word equals the one p further on."""
    a, size = x, CHUNK
    while a > 0:
        low = max(0, a - size)
        other = np.flatnonzero(w[low:a] != w[low + p : a + p])
        if len(other):
            a = low + int(other[-1]) + 1
            break
        a, size = low, 2 * size
    b, size, end = x + 1, CHUNK, len(w) - p
    while b < end:
        high = min(end, b + size)
        other = np.flatnonzero(w[b:high] != w[b + p : high + p])
        if len(other):
            b += int(other[0])
            break
        b, size = high, 2 * size
    return a, b


def _extend(w: np.ndarray, p: int, points: np.ndarray, found: _Found) -> None:
    points = points[~found.covers(points, points + 3 * p)]
    i = 0
    while i < len(points):
        a, b = _stretch(w, p, int(points[i]))
        if b - a + p >= max(LEAST, TIMES * p) and (a, b - a + p) not in found.stretches:
            found.stretches.add((a, b - a + p))
            found.runs.append((a, b - a + p, p))
        i = int(np.searchsorted(points, b))


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words ``w`` (equal numbers: equal words)."""
    n, found = len(w), _Found()
    top = n // TIMES
    root = min(isqrt(n), top)
    for p in range(1, root + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        points = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(points):
            _extend(w, p, points * p, found)
    low = root + 1
    while low <= top:
        high, periods, points = min(2 * low - 1, top), [], []
        for j in range(n // low):
            last = min(high, (n - 1) // (j + 3))
            if last < low:
                break
            four = [w[k * low : k * last + 1 : k] if k else w[0] for k in range(j, j + 4)]
            left = np.flatnonzero((four[0] == four[1]) & (four[1] == four[2]) & (four[2] == four[3])) + low
            if len(left):
                periods.append(left)
                points.append(j * left)
        if periods:
            p, x = np.concatenate(periods), np.concatenate(points)
            order = np.lexsort((x, p))
            p, x = p[order], x[order]
            for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
                _extend(w, int(p[part[0]]), x[part], found)
        low = high + 1
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def looped(n: int, h: int) -> np.ndarray | None:
    """Places of the words of a text whose end goes round in a loop, or None: chosen by a hash of the document."""
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _one(text: str | None, h: int | None) -> tuple[int, list[tuple[int, int, int]], str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    places: dict[bytes, int] = {}
    w = np.fromiter((places.setdefault(x, len(places)) for x in words), np.int64, len(words))
    at = None if h is None else looped(len(w), h)
    if at is not None:
        w = w[at]
    runs = find_runs(w)
    if runs or at is not None:
        edges = np.zeros(len(w) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        names = list(places)
        words = [names[i] for i in w[np.cumsum(edges[:-1]) == 0].tolist()]
    return len(w), runs, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, *keep: str, loop: Column | None = None) -> DataFrame:
    """(text) -> the columns ``keep``, n_words, runs, collapsed; one row for each row.

    ``collapsed`` has each run's first period only, words joined by one space. ``loop`` is a whole
    number by which ``looped`` changes the words before they are looked at.
    """
    fields = docs.select(*keep).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_one(t.as_py(), h.as_py()) for t, h in zip(batch.column(0), batch.column(1), strict=True)]
            offsets = np.cumsum([0, *[len(r) for _, r, _ in done]]).astype(np.int32)
            flat = np.array([x for _, r, _ in done for x in r], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([n for n, _, _ in done], pa.int64()), runs, pa.array([c for *_, c in done], pa.string())], names=[*[f.name for f in fields], "n_words", "runs", "collapsed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    h = F.lit(None) if loop is None else loop
    text, of = free_name(docs, "_text"), free_name(docs, "_loop")
    return docs.select(F.col("text").cast("string").alias(text), h.cast("long").alias(of), *keep).mapInArrow(run, ", ".join(filter(None, [schema, SCHEMA])))


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests, for texts whose words go round by ``looped`` of crc32(doc_id)."""
    found = periodic_runs(docs, "doc_id", loop=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.least")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.least) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
