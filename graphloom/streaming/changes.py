"""Streams of changes: incremental counts over appended quads and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.functions import terms as T
from graphloom.operators.store import SCHEMA


def quad_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Quads of parquet files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def class_counts(quads: DataFrame) -> DataFrame:
    """(cls, n), kept up to date: statements that repeat count once.

    The state is the set of type statements seen, as exact counts of a set need: one row for each.
    """
    types = quads.filter((F.col("p") == T.TYPE) & (F.col("o") != T.NAMED_INDIVIDUAL)).select("s", F.col("o").alias("cls"))
    return types.dropDuplicates(["s", "cls"]).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of events by window; what is later than ``late`` is left out."""
    seen = events.withWatermark("ts", late)
    out = seen.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


class _Members(StatefulProcessor):
    """Per subject: for each class the last event that named it, and what was told of the subject last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "name string", "seq long, there boolean")
        self.told = handle.getValueState("told", "n long, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for cls, seq, op in zip(part["cls"], part["seq"], part["op"], strict=True):
                at, there = (self.last.getValue((cls,)) if self.last.containsKey((cls,)) else (-(1 << 62), False))
                if (seq, op == "remove") >= (at, not there):
                    self.last.updateValue((cls,), (int(seq), op == "add"))
        n = sum(bool(there) for _, (_, there) in self.last.iterator())
        now = (n, n > self.most)
        if not self.told.exists() or tuple(self.told.get()) != now:
            self.told.update(now)
            yield pd.DataFrame({"s": [key[0]], "n": [now[0]], "open": [now[1]]})

    def close(self) -> None:
        pass


def member_conflicts(events: DataFrame, most: int = 12) -> DataFrame:
    """(seq, op, s, cls): type statements added and removed -> (s, n, open), told whenever they change.

    The state holds for each subject and class the event with the largest seq (a removal wins a
    tie), so events may come late, twice and in any order, and may be taken back; ``n`` is how many
    classes a subject has after all events so far, ``open`` whether that is more than ``most``.
    """
    processor = type("Members", (_Members,), {"most": most})()
    keyed = events.filter("s is not null and cls is not null").select("s", "cls", F.col("seq").cast("long").alias("seq"), "op")
    return keyed.groupBy("s").transformWithStateInPandas(processor, "s string, n long, open boolean", "update", "none")


def members_after(events: DataFrame, most: int = 12) -> DataFrame:
    """The same of all events at once, for a table of them: subjects with their last state."""
    last = events.filter("s is not null and cls is not null").groupBy("s", "cls").agg(F.max_by(F.col("op") == "add", F.struct("seq", F.col("op") == "remove")).alias("there"))
    return last.groupBy("s").agg(F.count(F.when(F.col("there"), 1)).alias("n")).select("s", "n", (F.col("n") > most).alias("open"))
