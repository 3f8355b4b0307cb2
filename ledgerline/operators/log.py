"""Scans, pages, forks and duplicates of an offset-addressed log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.subjects import matches


def scan_from(log: DataFrame, start: int, filter_: str | None = None) -> DataFrame:
    """Records from an offset on; both conditions reach the scan."""
    out = log.where(F.col("offset") >= start)
    return out.where(matches(F.col("subject"), filter_)) if filter_ else out


def fetch(log: DataFrame, start: int, filter_: str, limit: int, scan: int) -> DataFrame:
    """At most ``limit`` matching records of the next ``scan`` offsets; ``next`` is where the following page begins."""
    seen = log.where((F.col("offset") >= start) & (F.col("offset") < start + scan))
    page = scan_from(seen, start, filter_).orderBy("offset").limit(limit)
    ends = page.agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last")).crossJoin(seen.agg(F.max("offset").alias("scanned")))
    mark = ends.select(F.when(F.col("n") == limit, F.col("last") + 1).otherwise(F.coalesce(F.col("scanned") + 1, F.lit(start))).alias("next"))
    return page.crossJoin(F.broadcast(mark))


def fork(log: DataFrame, at: int, **replaced: Column) -> DataFrame:
    """The log with one record swapped; out of range changes nothing."""
    return log.withColumns({c: F.when(F.col("offset") == at, v).otherwise(F.col(c)) for c, v in replaced.items()})


def dedup_first(log: DataFrame, *key: str) -> DataFrame:
    """The first record of each key."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.min_by(F.struct(*rest), "offset").alias("r")).select(*key, "r.*").select(*log.columns)


def publish(log: DataFrame, key: tuple[str, ...] = ("producer_id", "producer_seq")) -> DataFrame:
    """Each publish's answer: its own offset, or for a repeated key the original's."""
    first = log.groupBy(*key).agg(F.min("offset").alias("original"))
    return log.join(first, list(key)).withColumn("duplicate", F.col("offset") != F.col("original"))


def last_value(log: DataFrame, filter_: str, columns: tuple[str, ...] = ("offset", "producer_id", "body")) -> DataFrame:
    """The newest record of every matching subject: one partial aggregate, no sort."""
    newest = scan_from(log, 0, filter_).groupBy("subject").agg(F.max_by(F.struct(*columns), "offset").alias("r"))
    return newest.select("subject", "r.*")


def last_at_head(log: DataFrame, filter_: str, head: int, asof: bool = False) -> DataFrame:
    """Newest records under a pinned head. A subject that has moved on is left out, or with ``asof`` shown as it was."""
    if asof:
        return last_value(log.where(F.col("offset") < head), filter_)
    return last_value(log, filter_).where(F.col("offset") < head)


def page_after(rows: DataFrame, key: str, after: str, limit: int) -> DataFrame:
    """Keyset paging: the next rows in key order."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def dense_offsets(rows: DataFrame, partition: list[str], order: str) -> DataFrame:
    return rows.withColumn("dense", F.row_number().over(Window.partitionBy(*partition).orderBy(order)) - 1)


def monotone(value: str, partition: list[str], order: str) -> Column:
    """A clock that never goes back."""
    return F.max(value).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def within_budget(rows: DataFrame, partition: list[str], order: str, size: str, budget: int, at_least_one: bool = False) -> DataFrame:
    """The first rows whose sizes together stay within the budget."""
    w = Window.partitionBy(*partition).orderBy(order)
    keep = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= budget
    if at_least_one:
        keep = keep | (F.row_number().over(w) == 1)
    return rows.withColumn("__keep", keep).where("__keep").drop("__keep")


def as_of(probe: DataFrame, table: DataFrame, key: list[str], probe_order: str, table_order: str, value: str) -> DataFrame:
    """For each probe row the newest earlier value of its key: one shuffle of both sides and one running window."""
    a = probe.select("*", F.col(probe_order).alias("__o"), F.lit(None).cast(table.schema[value].dataType).alias("__v"), F.lit(0).alias("__side"))
    b = table.select(*key, F.col(table_order).alias("__o"), F.col(value).alias("__v"), F.lit(1).alias("__side"))
    w = Window.partitionBy(*key).orderBy("__o", "__side").rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b, allowMissingColumns=True)
    found = both.withColumn("found", F.last("__v", ignorenulls=True).over(w)).where("__side = 0")
    return found.drop("__o", "__v", "__side")


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with a dense number from 0 in one order of all of them: sorted by range, each task counts on from the tasks before."""
    from ledgerline.operators.cuts import _ensure_checkpoint_dir

    _ensure_checkpoint_dir(rows.sparkSession)
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a task
    here = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__here", here).join(F.broadcast(before), "__part").withColumn(name, (F.col("__here") + F.col("__before")).cast("long")).drop("__part", "__here", "__before")
