"""K-d tree sharding.

Rows are points in a space of metadata dimensions, weighted by bytes. A node that holds more than the target is split
along its widest dimension at the weighted median, until each leaf has the target bytes. Medians are found by rounds of
histograms: each round is one aggregation over all rows for all nodes of a level and brings a few thousand counts to
the driver, whatever the table's size.

Rows of equal text lie at one point of the space as far as the dimensions come from the text, and next to each other in
each order, so that a group is only cut where a median falls into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._common import written

#: Buckets of a histogram, and bits of an order: value, then text hash. A hot text is then split by row hash.
BUCKETS_LOG2, KEY_BITS = 12, 60
#: A cut may miss the median by this share of a leaf's bytes.
TOLERANCE = 0.0005
#: Rows that are numbered in one task.
NUMBERED = 50_000


def _scaled(value: Column, low: int, high: int) -> Column:
    """``value`` as 20 bits, in proportion."""
    return F.least(F.greatest(F.floor((value - F.lit(low)) / F.lit(max(high - low, 1)) * F.lit((1 << 20) - 1)), F.lit(0)), F.lit((1 << 20) - 1)).cast("long")


def kd_shards(rows: DataFrame, weight: str, group: Column, dimensions: dict[str, Column], leaves: int = 16) -> DataFrame:
    """``rows`` with ``shard`` (0 to leaves - 1; ``leaves`` a power of two), near-equal in the sum of ``weight``.

    ``dimensions``: numeric columns, null taken as 0. ``group``: a long; equal groups stay adjacent. ``rows`` is read once a
    round, so it should be a written table of few columns. Column names that start with ``__`` are reserved.
    """
    levels = leaves.bit_length() - 1
    if leaves != 1 << levels:
        raise ValueError("leaves must be a power of two")
    names = list(dimensions)
    at = rows.select("*", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__d{i}") for i, c in enumerate(dimensions.values())), F.shiftrightunsigned(F.xxhash64(group), 24).alias("__g"), F.lit(0).alias("__node"))
    ranges = at.agg(*(f(f"__d{i}") for i in range(len(names)) for f in (F.min, F.max)), F.sum(weight)).first()
    total = ranges[-1] or 0
    if not total:
        return at.select(*rows.columns, F.lit(0).alias("shard"))
    spans = [(ranges[2 * i], ranges[2 * i + 1]) for i in range(len(names))]
    for i, (low, high) in enumerate(spans):  # one order for each dimension: 20 bits of value, 40 of the text's hash
        at = at.withColumn(f"__k{i}", F.shiftleft(_scaled(F.col(f"__d{i}"), low, high), 40).bitwiseOR(F.col("__g")))
    # rows of one hot text differ only here
    at = written(at.withColumn("__r", F.shiftrightunsigned(F.xxhash64(*rows.columns, F.lit(7)), 64 - KEY_BITS)).drop(*(f"__d{i}" for i in range(len(names)))), "kd-points")
    slack = total / leaves * TOLERANCE
    for _ in range(levels):
        wide = {r[0]: r[1:] for r in at.groupBy("__node").agg(*(f(f"__k{i}") for i in range(len(names)) for f in (F.min, F.max)), F.sum(weight)).collect()}
        best = {n: max(range(len(names)), key=lambda i: (r[2 * i + 1] >> 40) - (r[2 * i] >> 40)) for n, r in wide.items()}
        here = at.withColumn("__key", _key(best))
        first = _medians(here, weight, "__key", {n: (r[2 * best[n]], r[2 * best[n] + 1], r[-1] / 2) for n, r in wide.items()}, slack)
        # a single key that weighs too much to be moved whole is cut by row hash
        hot = {n: (0, (1 << KEY_BITS) - 1, need) for n, (_, need, heavy) in first.items() if heavy}
        second = _medians(here.where(F.col("__key") == _of({n: first[n][0] for n in hot})), weight, "__r", hot, slack) if hot else {}
        value, row = _of({n: c[0] for n, c in first.items()}), _of({n: c[0] for n, c in second.items()})
        left = (F.col("__key") < value) | ((F.col("__key") == value) & (F.col("__r") < F.coalesce(row, F.lit(0))))
        at = written(here.withColumn("__node", (F.col("__node") * 2 + F.when(left, 0).otherwise(1)).cast("int")).drop("__key"), "kd-points")
    return at.select(*rows.columns, F.col("__node").alias("shard"))


def _of(values: dict[int, int]) -> Column:
    """The row's node's value, null where there is none."""
    at = [values.get(n) for n in range(max(values, default=0) + 1)]
    return F.get(F.array(*(F.lit(v).cast("long") for v in at)), F.col("__node"))


def _key(best: dict[int, int]) -> Column:
    """The row's place along its node's widest dimension."""
    dimensions = sorted({*best.values()})
    return F.coalesce(*(F.when(F.col("__node").isin([n for n in best if best[n] == i]), F.col(f"__k{i}")) for i in dimensions))


def _medians(rows: DataFrame, weight: str, key: str, want: dict[int, tuple], slack: float) -> dict[int, tuple]:
    """For each node (low, high, weight wanted on the left): the cut, what is still wanted of that very key, and whether
    that is more than the slack. Rows below the cut weigh the wanted, but for the slack or the cut's own key."""
    done: dict[int, tuple] = {}
    open_ = {n: (int(low), int(high), float(need)) for n, (low, high, need) in want.items()}
    while open_:
        width = {n: max(1, ((high - low) >> BUCKETS_LOG2) + 1) for n, (low, high, _) in open_.items()}
        low, high = _of({n: v[0] for n, v in open_.items()}), _of({n: v[1] for n, v in open_.items()})
        inside = rows.select("__node", F.col(key).alias("__at"), F.col(weight).alias("__w")).where(F.col("__node").isin([*open_]))
        inside = inside.where((F.col("__at") >= low) & (F.col("__at") <= high))
        counts = inside.select("__node", (F.col("__at") - low).alias("__at"), _of(width).alias("__width"), "__w").groupBy("__node", F.expr("__at div __width").alias("__b")).agg(F.sum("__w")).collect()
        by: dict[int, dict[int, int]] = {n: {} for n in open_}
        for n, b, w in counts:
            by[n][b] = w
        for n, (lo, hi, need) in list(open_.items()):
            del open_[n]
            for b in sorted(by[n]):
                w = by[n][b]
                start = lo + b * width[n]
                if need <= min(slack, w / 2):  # before this bucket
                    done[n] = (start, 0, False)
                    break
                if w > need:
                    if w - need <= slack:
                        done[n] = (start + width[n], 0, False)
                    elif width[n] == 1:
                        done[n] = (start, need, need > slack)
                    else:
                        open_[n] = (start, min(hi, start + width[n] - 1), need)
                    break
                need -= w
            else:
                done[n] = (hi + 1, 0, False)
    return done


def with_slots(rows: DataFrame, shard: str, slot: str, key: Column) -> DataFrame:
    """``rows`` with a gapless number from 0 in each shard. A shard is numbered in parts of about NUMBERED rows."""
    from pyspark.sql import Window

    n = rows.count()
    parts = max(1, -(-n // NUMBERED))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(key, F.lit(11)), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(shard).orderBy("__part")) - F.col("__n")).select(F.col(shard).alias("__s"), F.col("__part").alias("__p"), "__before")
    own = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(shard, "__part").orderBy(key)))
    return own.join(before, (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p"))).withColumn(slot, F.col("__row") - 1 + F.col("__before")).drop("__part", "__s", "__p", "__row", "__before")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaves: int = 16) -> DataFrame:
    """Shards near-equal in bytes (text's UTF-8 bytes plus 1; null text: 1): id, size, text_crc32, shard, slot.

    The dimensions come from the text's metadata: bytes, code points a byte (script), share of spaces, lines. Null ids and
    texts are rows like others; repeated rows lie together unless a median falls between them; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    small = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.char_length(text).cast("long").alias("chars"), (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("lines"),
    )
    size = F.col("size").cast("double")
    points = written(small, "shard-metadata")
    found = kd_shards(points, "size", F.col("text_hash"), {"bytes": F.log(size), "script": F.col("chars") / size, "lines": F.col("lines") / size}, leaves)
    return with_slots(written(found, "shards"), "shard", "slot", F.struct("text_hash", "id")).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
