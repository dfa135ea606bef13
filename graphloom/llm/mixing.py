"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue whose documents stand in a shuffled order (MD5 of seed and doc_id).
A document that ends after ``cum`` words of its source has the virtual finish time
``cum / target``; further epochs of the source follow with the source's size added. The mix is
the global order of finish times, cut where the running sum of words reaches the total budget.

Running sums never gather a source in one task: the shuffle hash's leading hex digits deal each
source into buckets of a few thousand rows, bucket sums are pre-aggregated before they are
shuffled, and only the order inside a bucket needs its rows together. Prefix sums over the buckets
are taken in two levels, inside groups of ``GROUP_BUCKETS`` and over the sums of those groups. The
global cut works the same way over ranges of finish time; one row (the first key beyond the
budget) comes back to the driver.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is
a source of its own, last in order; a source of size 0 has target 0; rows that repeat a doc_id
are documents of their own, and so are rows without one (their text stands for the id in the
shuffled order); equal rows are taken one by one; an empty table gives an empty result; other
columns are ignored, and kept by ``mixed_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE_WORD, cut, fresh_dir

#: Rows that one bucket of a running sum should hold; hex digits that deal buckets into groups.
BUCKET_ROWS, GROUP_DIGITS = 4096, 2
GROUP_BUCKETS = 16**GROUP_DIGITS


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target); one row per source in and out.

    Targets share ``share`` of all words by weight; none exceeds ``cap`` times its source, and
    what is above goes to the others by weight. That is one water level L with
    target = min(cap * size, L * weight), found from prefix sums over the capped ratio.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(one) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    up = Window.orderBy("_ratio", "_rank")
    every = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("_before", F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.lit(share) * F.sum("source_size").over(every) - F.col("_before")) / F.col("_open"))
        .withColumn("_found", F.min_by(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank"))).over(every))
    )
    target = F.coalesce(F.least(F.col("_cap"), F.col("_found") * F.col("weight")), F.col("_cap"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def _hex_digits(rows: int) -> int:
    """Leading hex digits that deal ``rows`` into buckets of about BUCKET_ROWS."""
    return max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))) if rows > BUCKET_ROWS else 1


def _ahead(sums: DataFrame, by: list[str], group: Column, order: str, value: str, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows before in ``order``, for each ``by``.

    ``group`` rises with ``order``; no task takes more than a group's rows or one row for each group.
    """
    before = lambda *keys: Window.partitionBy(*by, *keys).rowsBetween(Window.unboundedPreceding, -1)
    grouped = sums.withColumn("_group", group)
    names = [f"_{c}" for c in by]
    totals = grouped.groupBy(*by, "_group").agg(F.sum(value).alias("_total"))
    totals = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before().orderBy("_group")), F.lit(0)))
    totals = totals.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_group").alias("_of"), "_start")
    same = F.col("_group") == F.col("_of")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = grouped.join(totals, same)
    return joined.withColumn(into, F.col("_start") + F.coalesce(F.sum(value).over(before("_group").orderBy(order)), F.lit(0))).drop("_group", "_of", "_start", *names)


def virtual_times(docs: DataFrame, weights: Sequence[int], share: float, cap: float, seed: int, keep: bool = False) -> DataFrame:
    """documents -> (doc_id, source, size, source_size, target, order, tie, cum), written and read again.

    ``cum`` is the running sum of words of the source in shuffled order, this document included.
    With ``keep`` a struct ``row`` of all columns comes along, so that what is decided for a row
    needs no key to find it again.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("string")
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id, F.concat(F.lit("text:"), text), F.lit("")))).alias("order"),
        *([F.xxhash64(*docs.columns).alias("tie"), F.struct(*docs.columns).alias("row")] if keep else [F.lit(0).cast("long").alias("tie")]),
    )
    small = sized.drop("row")
    if not keep:
        sized = small = cut(sized)
    digits = _hex_digits(docs.count())
    bucket = F.substring("order", 1, digits)
    dealt = cut(small.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(dealt.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    targets = targets.withColumnRenamed("source", "t_source")
    starts = _ahead(dealt, ["source"], F.substring("bucket", 1, max(digits - GROUP_DIGITS, 0)), "bucket", "bucket_size", "start")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    running = sized.withColumn("bucket", bucket).join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    at = fresh_dir(docs.sparkSession, "times")
    running.withColumn("cum", F.col("start") + F.sum("size").over(inside)).drop("bucket", "b_source", "b_bucket", "start").write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def _finish(epoch: int) -> Column:
    return (F.lit(epoch) * F.col("source_size") + F.col("cum")) / F.col("target")


def _copies(times: DataFrame, share: float, cap: float) -> Column:
    """How many times the mix takes a row of ``times``."""
    epochs = range(math.ceil(cap))
    wanted = (F.col("size") > 0) & (F.col("target") > 0)
    offers = times.filter(wanted).select(
        "size", "order", "tie", F.explode(F.array(*[F.struct(_finish(e).alias("finish"), F.lit(e).alias("epoch")) for e in epochs])).alias("e")
    ).select("size", "order", "tie", "e.finish", "e.epoch")
    facts = times.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    budget = share * (facts["words"] or 0)
    parts = 16 ** _hex_digits(facts["n"])
    offers = offers.withColumn("range", F.least(F.floor(F.col("finish") * parts), F.lit(2 * parts)).cast("long"))
    dealt = cut(offers.groupBy("range").agg(F.sum("size").alias("words")))
    last = (
        _ahead(dealt, [], F.floor(F.col("range") / GROUP_BUCKETS), "range", "words", "before")
        .filter(F.col("before") + F.col("words") > budget).orderBy("range").limit(1).first()
    )
    if last is None:  # the budget holds every offer
        return F.when(wanted, F.lit(len(epochs))).otherwise(0)
    in_order = Window.orderBy("finish", "order", "tie", "epoch").rowsBetween(Window.unboundedPreceding, 0)  # one range's rows
    first_out = (
        offers.filter(F.col("range") == last["range"])
        .withColumn("upto", F.sum("size").over(in_order) + F.lit(last["before"]))
        .filter(F.col("upto") > budget).orderBy("finish", "order", "tie", "epoch").limit(1).first()
    )
    key = lambda *parts: F.struct(*[p.alias(n) for p, n in zip(parts, "abcd", strict=True)])
    edge = key(*[F.lit(first_out[c]) for c in ("finish", "order", "tie", "epoch")])
    return sum((F.when(wanted & (key(_finish(e), F.col("order"), F.col("tie"), F.lit(e)) < edge), 1).otherwise(0) for e in epochs), F.lit(0))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """documents -> one row per document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` says how many times the mix takes the document (at most ``ceil(cap)``), ``taken``
    how many words that is. Runs over the same rows agree.
    """
    times = virtual_times(docs, weights, share, cap, seed)
    counted = times.withColumn("copies", _copies(times, share, cap).cast("int"))
    return counted.select("doc_id", "source", "size", "source_size", "target", "copies").withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """The documents that the mix takes, with its columns ``copies`` and ``taken`` added.

    Each row is judged by itself, whatever ids it has or shares. Columns of those names are replaced.
    """
    times = virtual_times(docs, weights, share, cap, seed, keep=True)
    copies = _copies(times, share, cap).cast("int")
    rest = [c for c in docs.columns if c not in ("copies", "taken")]
    taken = times.withColumn("copies", copies).filter("copies > 0")
    return taken.select(*[F.col("row")[c].alias(c) for c in rest], "copies", (F.col("copies") * F.col("size")).alias("taken"))
