"""Retention: the first matching rule decides a record's class; ages, budgets, readers and floors decide what is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.subjects import matches, validate_filter

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
SIZES = {"": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}


def _literal(text: str, units: dict[str, int]) -> int:
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return int(digits) * units[text[len(digits) :]]


@dataclass(frozen=True)
class Rule:
    kind: str  # prefix, hold or default
    filter: str
    age_ms: int | None = None
    max_bytes: int | None = None
    last: bool = False
    read: str | None = None
    forget: bool = False


def parse_rules(text: str) -> list[Rule]:
    """Lines ``prefix|hold|default [last] [forget] [read=T] [age=] [bytes=] [filter]``; # starts a comment."""
    out = []
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if not words:
            continue
        kind, rest = words[0], words[1:]
        if kind not in ("prefix", "hold", "default"):
            raise ValueError(f"unknown rule: {line!r}")
        named = dict(w.split("=", 1) for w in rest if "=" in w)
        filters = [w for w in rest if w.startswith("/")]
        if kind != "default" and (len(filters) != 1 or validate_filter(filters[0])):
            raise ValueError(f"bad filter: {line!r}")
        out.append(Rule(kind, filters[0] if filters else "/>", _literal(named["age"], UNITS) if "age" in named else None, _literal(named["bytes"], SIZES) if "bytes" in named else None, "last" in rest, named.get("read"), "forget" in rest))
    return out


def rule_of(subject: Column, rules: list[Rule]) -> Column:
    """The number of the first matching rule: one conditional expression, no join."""
    out = F.lit(len(rules))
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(matches(subject, rule.filter), F.lit(i)).otherwise(out)
    return out


def reader_group(subject: Column, template: str) -> Column:
    """``{N}`` in a template is the subject's N-th segment."""
    parts = F.split(subject, "/")
    return F.concat_ws("/", *(F.element_at(parts, int(p[1:-1]) + 1) if p[:1] == "{" and p[-1:] == "}" else F.lit(p) for p in template.split("/")))


def by_bytes(rows: DataFrame, key: str, size: str, budget: Column) -> DataFrame:
    """The newest rows of each class within its budget, and the cut: the oldest kept offset."""
    w = Window.partitionBy(key).orderBy(F.desc("offset")).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("__upto", F.sum(size).over(w)).where(F.col("__upto") <= budget)
    return kept.groupBy(key).agg(F.min("offset").alias("cut"), F.count(F.lit(1)).alias("kept"), F.sum(size).alias("bytes"))


def record_age(rows: DataFrame, stamps: DataFrame, now: int) -> DataFrame:
    """Each record's time: that of the first stamp (head, ms) beyond it, else now. One running window, no range join."""
    both = rows.select("offset", F.lit(None).cast("long").alias("ms"), F.lit(1).alias("side")).union(stamps.select(F.col("head").alias("offset"), "ms", F.lit(0).alias("side")))
    part = F.floor(F.col("offset") / 1_000_000)
    # a chunk's rows look ahead within it; what lies beyond comes from the next chunk's first stamp
    both = both.withColumn("part", part)
    w = Window.partitionBy("part").orderBy(F.desc("offset"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    inner = both.withColumn("found", F.last("ms", ignorenulls=True).over(w))
    firsts = both.where("side = 0").groupBy("part").agg(F.min_by("ms", "offset").alias("first"))
    parts = both.select("part").distinct().join(firsts, "part", "left")
    later = parts.withColumn("next", F.first("first", ignorenulls=True).over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))).select("part", "next")
    return inner.where("side = 1").join(F.broadcast(later), "part").select("offset", F.coalesce("found", "next", F.lit(now)).alias("ms"))


def write_segments(log: DataFrame, path: str, size: int) -> None:
    """The log as segment folders named by their base offset, each of ``size`` offsets."""
    base = (F.floor(F.col("offset") / size) * size).cast("long")
    log.withColumn("segment", base).repartition("segment").write.mode("overwrite").partitionBy("segment").parquet(path)


def unlink_below(spark, path: str, floor: int, size: int) -> None:
    """Removes the segments that lie wholly below an offset; names alone decide, no record is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(hadoop):
        name = status.getPath().getName()
        if name.startswith("segment=") and int(name[8:]) + size <= floor:
            files.delete(status.getPath(), True)


def compact(log: DataFrame, held: DataFrame, cut: int, path: str) -> None:
    """Rewrites the log from a cut: records below it go unless they are in ``held`` (offset). Offsets stay as they were.

    The new log is written whole beside the old one; a reader changes over when the folder's success mark is there.
    """
    kept = log.where(F.col("offset") < cut).join(held.select("offset").distinct(), "offset", "left_semi")
    log.where(F.col("offset") >= cut).unionByName(kept).write.mode("overwrite").parquet(path)
