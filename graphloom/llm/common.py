"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import cut, fresh_dir, shared_dir

__all__ = ["cut", "fresh_dir", "shared_dir"]

#: A word is a maximal run of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A word is a maximal run of digits, lower-case letters and non-ASCII characters.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and script."""
    return F.translate(text, UPPER, LOWER)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Slots of a prefilter: what is broadcast for it has at most so many rows, whatever the input.
SLOTS = 1 << 20


def slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS))


def slots_of(keys: DataFrame, key: str) -> DataFrame:
    """(slot): the slots that the keys fall into, to be broadcast; at most SLOTS rows."""
    return F.broadcast(keys.select(slot(F.col(key)).alias("_slot")).distinct())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose (doc_id, ``key``) are in ``gone`` (g_id, g_key).

    Only rows whose slot holds a key that goes are shuffled; the texts of the others stay where
    they are. With more keys than slots this becomes a plain anti-join.
    """
    name, keys = free_name(docs, "_key"), gone.select(F.col("g_id").alias(free_name(docs, "g_id")), F.col("g_key").alias(free_name(docs, "g_key")))
    marked = docs.withColumn(name, key)
    slots = slots_of(gone, "g_key").withColumnRenamed("_slot", free_name(docs, "_slot"))
    at = slot(F.col(name)) == F.col(slots.columns[0])
    safe = marked.join(slots, at, "left_anti")
    maybe = marked.join(slots, at, "left_semi")
    rest = maybe.join(keys, F.col("doc_id").eqNullSafe(F.col(keys.columns[0])) & (F.col(name) == F.col(keys.columns[1])), "left_anti")
    return safe.unionByName(rest).select(*docs.columns)


#: A key of so many rows is spread over SALTS tasks.
HOT_ROWS, SALTS = 2000, 16


def spread_join(many: DataFrame, one: DataFrame, key: str, one_key: str, n_rows: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has each ``one_key`` once and how many rows it meets.

    Keys that meet HOT_ROWS rows or more are repeated SALTS times in ``one``, and their rows dealt
    over the copies, so that no task takes a whole hot group. What marks them is the slots of the
    hot keys, a broadcast of at most SLOTS rows. ``many`` must be materialised, since rows are dealt
    by their place. Adds columns _slot and _salt.
    """
    one = cut(one)
    slots = F.broadcast(one.filter(F.col(n_rows) >= HOT_ROWS).select(slot(F.xxhash64(one_key)).alias("_slot")).distinct())
    mark = lambda df, k: df.join(slots, slot(F.xxhash64(k)) == F.col("_slot"), "left")
    spread = F.when(F.col("_slot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = mark(one, one_key).withColumn("_o_salt", F.explode(spread)).drop("_slot", n_rows)
    salt = F.when(F.col("_slot").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).cast("int")
    dealt = mark(many, key).withColumn("_salt", salt)
    return dealt.join(copies, (F.col(key) == F.col(one_key)) & (F.col("_salt") == F.col("_o_salt"))).drop(one_key, "_o_salt")


def row_key(*names: str) -> Column:
    """A 64-bit key for the content of a row, used next to doc_id where doc_id may repeat."""
    return F.xxhash64(*names)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(starts, stops, columns) of whole groups: rows with equal values in the first ``keys`` columns.

    By default all but the last column. Rows come sorted by group; what may go on in the next
    batch is held back.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[: keys or -1]])
        starts = np.nonzero(new)[0]
        held = [c[starts[-1] :] for c in cols]
        yield starts[:-1], starts[1:], cols
    if held is not None and len(held[0]):
        yield np.array([0]), np.array([len(held[0])]), held
