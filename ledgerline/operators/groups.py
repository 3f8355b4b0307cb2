"""Consumer groups: cursors, lag and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cursors(commits: DataFrame) -> DataFrame:
    """The committed offset of each group; it only grows."""
    return commits.groupBy("group").agg(F.max("upto").alias("upto"))


def lag(commits: DataFrame, log: DataFrame) -> DataFrame:
    """Records beyond each group's cursor."""
    head = log.agg((F.max("offset") + 1).alias("head"))
    return cursors(commits).crossJoin(F.broadcast(head)).select("group", "upto", (F.col("head") - F.col("upto") - 1).alias("lag"))


def resume(commits: DataFrame, log: DataFrame, group: str) -> DataFrame:
    """What a group has not read."""
    cursor = commits.where(F.col("group") == group).agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("upto"))
    return log.crossJoin(F.broadcast(cursor)).where("offset > upto").drop("upto")
