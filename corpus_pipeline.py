"""A corpus pipeline: quality rules, one of each near-duplicate group, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import written
from ledgerline.llm.decontamination import without_contaminated
from ledgerline.llm.jaccard_join import one_of_each
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.quality_rules import keep_good
from ledgerline.llm.substring_dedup import without_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its 5-word shingles."""
    return one_of_each(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand in two places are taken out; n_chars follows."""
    return without_repeats(docs, window=35).withColumn("n_chars", F.char_length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages, or few for their length."""
    return without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")), end_id=2, limit=4096)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the learned rules; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
