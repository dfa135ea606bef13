"""Removal of long word sequences that a document with a smaller doc_id also holds.

Anchors are hashes of ``ANCHOR`` words, taken only where the word position modulo ``PERIOD`` is
in a difference cover: for any two positions i and j some offset below PERIOD brings both into
the cover, so two equal windows of ``WINDOW`` words share an anchor at the same offset, although
fewer than a fifth of all positions are hashed. Anchors that two documents share mark the places
where a match can be; there the match is extended to whole windows, whose hashes meet in packed
runs dealt out by the window's least inner hash (equal windows have equal ones), and each window
learns the smallest doc_id that holds it.

What many documents share is combined where it is read: anchors that repeat inside a map task are
known to be shared there and go on without meeting again but for one representative, and of equal
windows only the smallest document's goes to the meeting. So a passage that a third of the corpus
holds sends a few rows for each task, not a row for each document. Groups arrive sorted and are
handled as a stream.

Defined results: a null or empty text has no words; windows exist only in texts of WINDOW words
or more; a row without doc_id neither loses words nor takes any from others; rows with equal
doc_id do not take from each other; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import row_key, sorted_groups

WINDOW, PERIOD, ANCHOR = 50, 31, 20
#: A perfect difference set modulo 31: every difference occurs (six of 31 positions).
COVER = (1, 5, 11, 24, 25, 27)
#: Anchors, or windows, that a map task combines at a time.
COMBINE = 1_000_000
_COVERED = np.isin(np.arange(PERIOD), COVER)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of one text's anchors; none below WINDOW words."""
    words = words_of(text)
    n = len(words)
    if n < WINDOW:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    joined = b" ".join(words)
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=begin[1:])
    at = np.nonzero(np.resize(_COVERED, n - ANCHOR + 1))[0]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(joined[a:b]) for a, b in zip(begin[at].tolist(), (begin[at + ANCHOR] - 1).tolist(), strict=True)), np.uint64, len(at))
    return at.astype(np.int32), hashes.view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def window_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(least inner hash, hash) of each window of WINDOW words."""
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x) for x in words), np.uint64, len(words))
    grams = np.zeros(len(w) - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        grams = grams * _ODD + w[k : k + len(grams)]
    grams = _mixed(grams)
    n = len(w) - WINDOW + 1
    least = grams[:n].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, grams[k : k + n], out=least)
    whole = _mixed((grams[:n] * _ODD + grams[ANCHOR : ANCHOR + n]) * _ODD + grams[WINDOW - ANCHOR : WINDOW - ANCHOR + n])
    return least.view(np.int64), whole.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (meet, met, doc_id, pos)."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def combined() -> pa.RecordBatch:
        doc = np.repeat(np.array([d for d, _, _ in held], np.int64), [len(p) for _, p, _ in held])
        pos, hashes = np.concatenate([p for _, p, _ in held]), np.concatenate([h for _, _, h in held])
        order = np.lexsort((doc, hashes))
        doc, pos, hashes = doc[order], pos[order], hashes[order]
        starts = np.nonzero(np.r_[True, hashes[1:] != hashes[:-1]])[0]
        sizes = np.diff(np.r_[starts, len(hashes)])
        shared = np.repeat(doc[starts] != doc[starts + sizes - 1], sizes)
        first = np.zeros(len(doc), bool)
        first[starts] = True
        goes = ~shared | first  # to the meeting; the rest is known to be shared
        told = shared
        meet = np.r_[hashes[goes], hashes[told] ^ (doc[told] * np.int64(0x5851F42D4C957F2D) + pos[told])]
        return pa.RecordBatch.from_arrays(
            [pa.array(meet), pa.array(np.r_[np.zeros(goes.sum(), bool), np.ones(told.sum(), bool)]), pa.array(np.r_[doc[goes], doc[told]]), pa.array(np.r_[pos[goes], pos[told]])],
            names=["meet", "met", "doc_id", "pos"],
        )

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            at, hashes = anchors(text.as_py())
            if len(at):
                held.append((doc.as_py(), at, hashes))
                size += len(at)
            if size >= COMBINE:
                yield combined()
                held, size = [], 0
    if held:
        yield combined()


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (meet, met, doc_id, pos) -> (doc_id, pos) of anchors that two documents share."""
    for starts, stops, (meet, met, doc, pos) in sorted_groups(batches, 1):
        sizes = stops - starts
        rows = slice(starts[0], stops[-1]) if len(starts) else slice(0, 0)
        if not len(starts):
            continue
        doc, pos, met = doc[rows], pos[rows], met[rows].astype(bool)
        first = starts - starts[0]
        low = np.minimum.reduceat(np.where(met, np.iinfo(np.int64).max, doc), first)
        high = np.maximum.reduceat(np.where(met, np.iinfo(np.int64).min, doc), first)
        keep = met | np.repeat(low < high, sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep])], names=["p_id", "pos"])


_WINDOW_ROWS = "meet long, met boolean, doc_id long, doc_key long, start int, n int, hashes binary"


def _combined_windows(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    """Runs (meet, doc, key, start, packed hashes) of one task, cut where it matters.

    A window that a smaller document of this task has too is to be removed whatever the others
    hold: it goes on as told, without its hash and dealt by its place. Only each window's smallest
    document here goes to the meeting.
    """
    meet, doc, key, start = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:4])
    sizes = np.array([len(r[4]) // 8 for r in rows])
    run = np.repeat(np.arange(len(rows)), sizes)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.frombuffer(b"".join(r[4] for r in rows), np.int64)
    order = np.lexsort((doc[run], whole, meet[run]))
    m, w, d = meet[run][order], whole[order], doc[run][order]
    new = np.r_[True, (m[1:] != m[:-1]) | (w[1:] != w[:-1])]
    told = np.empty(len(d), bool)
    told[order] = d > d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    begin = np.nonzero(np.r_[True, (run[1:] != run[:-1]) | (told[1:] != told[:-1])])[0]
    n = np.diff(np.r_[begin, len(run)])
    of, at, met = run[begin], inside[begin], told[begin]
    place = start[of] + at
    spread = _mixed(doc[of].view(np.uint64) * _ODD + place.view(np.uint64)).view(np.int64)
    hashes = [b"" if t else whole[i : i + k].tobytes() for t, i, k in zip(met.tolist(), begin.tolist(), n.tolist(), strict=True)]
    columns = (np.where(met, spread, meet[of]), met, doc[of], key[of], place.astype(np.int32), n.astype(np.int32), hashes)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["meet", "met", "doc_id", "doc_key", "start", "n", "hashes"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc_key, text, places) -> _WINDOW_ROWS."""
    rows: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for doc, key, text, places in zip(*batch.columns, strict=True):
            words = words_of(text.as_py())
            n = len(words) - WINDOW + 1
            if n < 1:
                continue
            at = places.values.to_numpy(zero_copy_only=False)
            marks = np.zeros(n + 1, np.int32)
            np.add.at(marks, np.minimum(np.maximum(at - (PERIOD - 1), 0), n), 1)
            np.add.at(marks, np.minimum(at + 1, n), -1)
            tried = np.nonzero(np.cumsum(marks[:n]) > 0)[0]
            if not len(tried):
                continue
            least, whole = window_hashes(words)
            least, whole = least[tried], whole[tried]
            new = np.r_[True, (np.diff(tried) != 1) | (least[1:] != least[:-1])]
            begin = np.nonzero(new)[0]
            for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(tried)], strict=True):
                rows.append((int(least[s]), doc.as_py(), key.as_py(), int(tried[s]), whole[s:e].tobytes()))
            size += len(tried)
            if size >= COMBINE:
                yield _combined_windows(rows)
                rows, size = [], 0
    if rows:
        yield _combined_windows(rows)


def _runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "doc_key", "start", "n"])


def _removed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted _WINDOW_ROWS -> (doc_id, doc_key, start, n): runs of windows to remove."""
    for starts, stops, columns in sorted_groups(batches, 1):
        if not len(starts):
            continue
        meet, met, doc, key, start, n, hashes = (x[starts[0] : stops[-1]] for x in columns)
        met = met.astype(bool)
        if met.any():
            yield _runs(doc[met], key[met], start[met], n[met])
        meet, doc, key, start, sizes, hashes = (x[~met] for x in (meet, doc, key, start, n, hashes))
        if not len(meet):
            continue
        run = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.frombuffer(b"".join(hashes), np.int64)
        order = np.lexsort((doc[run], whole, meet[run]))
        m, w, d = meet[run][order], whole[order], doc[run][order]
        new = np.r_[True, (m[1:] != m[:-1]) | (w[1:] != w[:-1])]
        gone = np.empty(len(d), bool)
        gone[order] = d > d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
        at = np.nonzero(gone)[0]
        if len(at):
            begin = np.r_[True, (np.diff(at) != 1) | (run[at][1:] != run[at][:-1])]
            of = run[at[begin]]
            yield _runs(doc[of], key[of], start[of] + inside[at[begin]], np.diff(np.r_[np.nonzero(begin)[0], len(at)]))


def kept_words(text: str | None, runs: list[dict] | None) -> tuple[list[bytes], int]:
    """(kept words, number of words) after the removal of runs of windows."""
    words = words_of(text)
    if not runs:
        return words, len(words)
    marks = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        marks[r["start"]] += 1
        marks[min(len(words), r["start"] + r["n"] - 1 + WINDOW)] -= 1
    keep = np.cumsum(marks[:-1]) == 0
    return [words[i] for i in np.nonzero(keep)[0].tolist()], len(words)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, runs in zip(*batch.columns, strict=True):
            kept, n = kept_words(text.as_py(), runs.as_py())
            joined = b" ".join(kept)
            out.append((doc.as_py(), n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(k_id, k_text, k_key) of rows with an id; the joins on k_id share one exchange of it.

    Columns get names of their own, so that both uses have the same form in the plan.
    """
    named = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("k_id"), F.col("text").cast("string").alias("k_text"))
    return named.withColumn("k_key", row_key("k_id", "k_text"))


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, doc_key, start, n): runs of windows that a smaller doc_id has too."""
    keyed = _keyed(docs)
    met = keyed.select("k_id", "k_text").mapInArrow(_anchor_rows, "meet long, met boolean, doc_id long, pos int").repartition("meet").sortWithinPartitions("meet")
    places = met.mapInArrow(_shared_anchors, "p_id long, pos int").groupBy("p_id").agg(F.collect_set("pos").alias("places"))
    tried = keyed.join(places, F.col("k_id") == F.col("p_id")).select("k_id", "k_key", "k_text", "places")
    runs = tried.mapInArrow(_window_rows, _WINDOW_ROWS)
    return runs.repartition("meet").sortWithinPartitions("meet").mapInArrow(_removed_runs, "doc_id long, doc_key long, start int, n int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept: one row for each row.

    ``kept``: the words that stay, joined by one space, as UTF-8.
    """
    runs = removed_windows(docs).groupBy(F.col("doc_id").alias("r_id")).agg(F.collect_list(F.struct("doc_key", "start", "n")).alias("all"))
    own = F.filter("all", lambda r: r["doc_key"] == F.col("k_key"))
    joined = _keyed(docs).join(runs, F.col("k_id") == F.col("r_id"), "left").select(F.col("k_id").alias("doc_id"), F.col("k_text").alias("text"), own.alias("runs"))
    no_id = docs.filter("doc_id is null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast("array<struct<doc_key:long,start:int,n:int>>").alias("runs"))
    return joined.unionByName(no_id).mapInArrow(_finished, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
