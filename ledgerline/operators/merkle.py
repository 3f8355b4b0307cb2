"""A paged Merkle map whose shape follows from its rows alone: sixteen-way, by the digits of a key's digest.

A page holds its rows while it has at most LEAF_ROWS, else sixteen children by the next digit. Pages are made level by
level with one aggregation each; a group is a page, so it is never large, and the number of levels grows with the
logarithm of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a page holds directly; the mark of pages, and of inner ones and leaves. Fixed values.
LEAF_ROWS, MARK, INNER, LEAF = 32, "4154504731", "01", "02"
DIGITS = "0123456789abcdef"


def _sha(hexed: Column) -> Column:
    return F.sha2(F.unhex(hexed), 256)


def _number(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value.cast("long")), digits, "0"))


def row_hash(key: Column, value: Column) -> Column:
    """Of a key (hex), the value's length as two bytes, and the value (binary)."""
    return _sha(F.concat(key, _number(F.octet_length(value), 4), F.lower(F.hex(value))))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (key: a digest in hex, each once; value: binary) with ``hash`` and ``depth``, the level of the leaf that holds the row."""
    at = rows.select("key", "value", row_hash(F.col("key"), F.col("value")).alias("hash"))
    depth, level = F.lit(0), 0
    while level <= 64:
        # a row goes on while its page has too many; one aggregate a level
        sizes = at.groupBy(F.substring("key", 1, level).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF_ROWS)
        if sizes.isEmpty():
            break
        sizes = sizes.select("prefix", F.lit(level + 1).alias(f"d{level}"))
        at = at.join(sizes, F.substring("key", 1, level) == F.col("prefix"), "left").drop("prefix")
        depth = F.greatest(depth, F.coalesce(F.col(f"d{level}"), F.lit(0)))
        level += 1
    else:
        raise ValueError("a key is there more than once")
    return at.select("key", "value", "hash", depth.cast("int").alias("depth"))


def _leaves(rows: DataFrame) -> DataFrame:
    held = F.transform(F.array_sort(F.collect_list(F.struct("key", "hash"))), lambda r: r["hash"])
    pages = rows.groupBy(F.expr("substring(key, 1, depth)").alias("prefix"), "depth").agg(F.count(F.lit(1)).alias("n"), held.alias("held"))
    return pages.select("prefix", "depth", "n", F.lit("leaf").alias("kind"), _sha(F.concat(F.lit(MARK + LEAF), _number(F.col("n"), 4), F.array_join("held", ""))).alias("hash"))


def pages(rows: DataFrame) -> DataFrame:
    """(prefix, depth, n, kind, hash) of every page; the root's prefix is empty. No rows make one empty leaf."""
    leaves = _leaves(placed(rows))
    deepest = leaves.agg(F.max("depth")).first()[0]
    empty = _sha(F.lit(MARK + LEAF + "0000"))
    if deepest is None:
        return rows.sparkSession.range(1).select(F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n"), F.lit("leaf").alias("kind"), empty.alias("hash"))
    level, made = leaves.where(F.col("depth") == deepest), [leaves]
    for depth in range(deepest - 1, -1, -1):
        children = level.groupBy(F.substring("prefix", 1, depth).alias("parent")).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.substring("prefix", depth + 1, 1), F.struct("hash", "n")))).alias("c"))
        none = F.struct(empty.alias("hash"), F.lit(0).cast("long").alias("n"))
        listed = F.concat(*(F.concat(x["hash"], _number(x["n"], 16)) for d in DIGITS for x in [F.coalesce(F.col("c")[d], none)]))
        inner = children.select(F.col("parent").alias("prefix"), F.lit(depth).alias("depth"), "n", F.lit("inner").alias("kind"), _sha(F.concat(F.lit(MARK + INNER), listed)).alias("hash"))
        made.append(inner)
        level = inner.union(leaves.where(F.col("depth") == depth))
    return reduce(DataFrame.union, made)


def proof(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, depth, n, kind, hash) of the pages on the way from the root to each of some keys, present or not."""
    all_ = pages(rows)
    depths = all_.select("depth").distinct()  # at most as many as levels
    asked = keys.select("key").crossJoin(F.broadcast(depths)).select("key", F.expr("substring(key, 1, depth)").alias("prefix"))
    return asked.join(all_, "prefix").select("key", "depth", "n", "kind", "hash")
