"""The folder that driver and executors share, and cutting lineage in it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder under the warehouse where it is unset.

    A warehouse without a scheme is on this machine's disk, which only a local session shares with
    its tasks: elsewhere the setting is asked for.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if not re.match("[a-z0-9]+:", at) or at.startswith("file:"):
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = at if ":" in at else f"file://{at}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for loops of joins.

    It is computed once, and the next round is planned with the table's real size: a checkpoint keeps
    the size that was guessed for its plan, and guesses for joins multiply from round to round.
    """
    at = fresh_dir(df.sparkSession, "round")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is dealt to tasks and never broadcast.

    A written table's size is that of its compressed files. One of repeating texts is ten times as
    large and more in memory, so Spark would send the driver tables that it cannot hold.
    """
    return df.hint("merge")
