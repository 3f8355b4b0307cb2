"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the two word rules of this package (regular expression classes).
SPACE = r"\x20\x09-\x0D"
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_to_remove: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/ledgerline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _to_remove:
        atexit.register(_remove_all)
    _to_remove[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not spark.sparkContext.master.startswith("local["):
        for _ in range(2):  # on a cluster the finished job's shuffle files go when the driver forgets them
            spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def many_to_one(rows: DataFrame, key: str, ones: DataFrame, one_key: str, of: DataFrame | None = None, part: int = 50_000) -> DataFrame:
    """Inner join of many ``rows`` with the single row of ``ones`` for their key; a key with more than ``part`` rows is dealt into several.

    ``of``: a cheap table with the same keys as often as in ``rows`` (default: ``rows``, which should then be a written table).
    The heavy keys are broadcast: with the bound rising with the table there are never more than 100,000.
    """
    keys = (rows if of is None else of).select(F.col(key).alias("__heavy"))
    limit = max(part, keys.count() // 100_000)
    heavy = keys.groupBy("__heavy").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    heavy = F.broadcast(heavy.select("__heavy", F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    left = rows.join(heavy, F.col(key) == F.col("__heavy"), "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__parts")).cast("int"))).drop("__heavy", "__parts")
    right = ones.join(heavy, F.col(one_key) == F.col("__heavy"), "left").withColumn("__of", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__heavy", "__parts")
    return left.join(right, (F.col(key) == F.col(one_key)) & (F.col("__part") == F.col("__of"))).drop("__part", "__of")


def _remove_all() -> None:
    for path, spark in _to_remove.items():
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended before; what is left is only temporary
            return


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII text takes the fast built-in; ``lower`` would also change other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, not_word: str) -> Column:
    """The maximal runs of characters outside ``not_word``, as an array; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{not_word}]+")
    return F.array_remove(parts, "")


def whole_row(rows: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in rows.columns))


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and content, so that repeated ids with other texts stay apart and repeated rows agree."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("~")), F.coalesce(F.hex(F.xxhash64(text)), F.lit("~")), F.coalesce(F.octet_length(text).cast("string"), F.lit("~")))
