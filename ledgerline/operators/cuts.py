"""Causal cuts: one frontier offset per stream, and edges from causes to effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def includes(rows: DataFrame, cut: DataFrame, stream: str, offset: str) -> DataFrame:
    """Rows inside the cut; a stream that it doesn't name admits nothing."""
    return rows.join(cut, F.col(stream) == cut["stream"]).where(F.col(offset) <= F.col("upto")).drop("stream", "upto")


def violations(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """Edges whose effect is inside while the cause is not."""
    cause = cut.select(F.col("stream").alias("cause_stream"), F.col("upto").alias("__have"))
    return includes(edges, cut, "effect_stream", "effect_off").join(cause, "cause_stream", "left").where("__have IS NULL OR __have < cause_off").drop("__have")


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("stream").agg(F.max("upto").alias("upto"))


def meet(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("upto", "__b"), "stream").select("stream", F.least("upto", "__b").alias("upto"))


def dominates(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether ``a`` reaches at least as far as ``b`` on every stream of ``b``."""
    short = b.join(a.withColumnRenamed("upto", "__a"), "stream", "left").where("__a IS NULL OR __a < upto")
    return short.agg((F.count(F.lit(1)) == 0).alias("dominates"))


def heal(edges: DataFrame, cut: DataFrame, checkpoint=None) -> DataFrame:
    """The smallest consistent cut that holds this one: causes are let in until none is missing; each round lets some in, so there is an end.

    ``checkpoint`` cuts lineage each round (a written table on a cluster); by default a reliable checkpoint.
    """
    spark = cut.sparkSession
    if checkpoint is None:
        _ensure_checkpoint_dir(spark)
        checkpoint = lambda df: df.checkpoint()
    while True:
        missing = violations(edges, cut).groupBy("cause_stream").agg(F.max("cause_off").alias("upto")).withColumnRenamed("cause_stream", "stream")
        missing = checkpoint(missing)
        if missing.isEmpty():
            return cut
        cut = checkpoint(join(cut, missing))


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode a temporary one where that is unset, as in tests."""
    import re
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_to_remove: dict[str, object] = {}


def temporary_folder(spark, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    import atexit
    import uuid

    path = f"{shared_folder(spark)}/ledgerline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _to_remove:
        atexit.register(_remove_all)
    _to_remove[path] = spark
    return path


def _remove_all() -> None:
    for path, spark in _to_remove.items():
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended before; what is left is only temporary
            return


def _ensure_checkpoint_dir(spark) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
