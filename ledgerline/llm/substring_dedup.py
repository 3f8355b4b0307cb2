"""Incremental removal of repeated passages over a log-structured fingerprint index.

Each batch of texts adds one immutable run to the index: the fingerprints of its texts, bucketed and sorted by hash, so
that runs are merge-joined bucket by bucket without a shuffle. There are never more than two runs: a third is made one with the
smaller of the others. A fingerprint is the smallest K-gram hash of a window's
K-grams; equal windows have equal fingerprints, so only windows whose fingerprint stands in two places, in whichever
runs, can repeat. Those windows alone are then verified over all their words, by 96 bits of two hashes of differently hashed words.

A large table comes in as several batches, so that no run is made at once from all of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import _hashing as H
from ledgerline.llm._common import temporary, whole_row, written

#: Words in a fingerprinted gram.
K = 8
#: Batches that a table comes in as, and runs that an index has at most.
BATCHES, RUNS = 4, 2
#: Words of a block in which windows are verified, about.
BLOCK_WORDS = 4_000_000
#: A text has many copies from so many on, or from a hundred-thousandth of all rows.
COPIES, COPIES_SHARE = 1_000, 100_000


def _grams(batch: pa.RecordBatch, text: int, window: int) -> tuple:
    """words, where texts start, word hashes, gram hashes, windows inside one text, each window's fingerprint position."""
    words, starts = H.split_words(batch.column(text))
    h = H.word_hashes(words)
    k = min(K, window)
    grams = H.run_hashes(h, k)
    return words, starts, h, grams, H.inside(starts, window, len(h)), H.first_smallest(grams, window - k + 1)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _fingerprints(window: int):
    """(t1, t2, n_words, the texts' words' digest, fingerprints) of batches (id, t1, t2, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in H.parts(batches, 3):
            words, starts, _, grams, ok, at = _grams(batch, 3, window)
            chosen = np.unique(at[ok]) if len(at) else np.zeros(0, np.int64)
            counts = np.diff(np.searchsorted(chosen, starts))
            raw = words.cast(pa.binary()).to_pylist()
            digests = [hashlib.sha256(b" ".join(raw[a:b])).hexdigest() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(starts), pa.int64()), pa.array(digests, pa.string()), _lists(grams[chosen].view(np.int64), counts, pa.int64())], ["id", "t1", "t2", "n_words", "words_sha256", "prints"])

    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, places) of each batch (prints): a fingerprint that many texts have is one row a batch."""
    for batch in batches:
        prints, places = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(places, pa.int64())], ["print", "places"])


#: Windows of a slice, dealt by hash: of each distinct window its text, place, hashes and weight (2: known to repeat), and the
#: places already known to repeat.
DEALT = "block int, unit binary, at binary, h1 binary, h2 binary, weight binary, done_unit binary, done_at binary"
FLAGGED = "block int, unit binary, at binary"


def _blocks(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by block, and where each block begins in it; a block is a range of the hash's upper half."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    order = np.argsort(block.astype(np.uint32), kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))


def _windows(window: int, blocks: int):
    """The windows with a shared fingerprint, of batches (unit, copies, text, shared), as DEALT.

    Within a slice of texts, equal windows are counted here already, so a window that a third of all texts have goes on
    once a slice.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.parts(batches, 2):
            words, starts, h, grams, ok, at = _grams(batch, 2, window)
            if not ok.any():
                continue
            shared = np.unique(batch.column(3).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            # a fingerprint that another text of this slice shares may let a window through: verification decides
            chosen = np.unique(at[ok])
            hit = np.zeros(len(grams), bool)
            hit[chosen[np.isin(grams[chosen], shared)]] = True
            place = np.flatnonzero(ok & hit[at])
            if not len(place):
                continue
            one = H.run_hashes(h, window)[place]
            order = np.argsort(one)
            one, place = one[order], place[order]
            two = (H.run_hashes(H.word_hashes(words, 1), window, H.FACTORS[1])[place] >> np.uint64(32)).astype("<u4")
            text = np.searchsorted(starts, place, "right") - 1
            unit = batch.column(0).to_numpy(zero_copy_only=False)[text]
            copies = batch.column(1).to_numpy(zero_copy_only=False)[text]
            place = (place - starts[text]).astype("<u4")
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            first = np.flatnonzero(new)
            weight = np.minimum(np.add.reduceat(copies, first), 2).astype(np.uint8)
            known = (weight > 1)[np.cumsum(new) - 1]
            rows = []
            order, ends = _blocks(one[first], blocks)
            done_unit, done_at = unit[known], place[known]
            done, done_ends = _blocks(one[known], blocks)  # with their window, so that no block gets them all
            for b in np.flatnonzero(np.diff(ends)):
                part, own = order[ends[b] : ends[b + 1]], done[done_ends[b] : done_ends[b + 1]]
                at_ = first[part]
                rows.append([int(b), unit[at_].tobytes(), place[at_].tobytes(), one[at_].tobytes(), two[at_].tobytes(), weight[part].tobytes(), done_unit[own].tobytes(), done_at[own].tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 7), strict=True)], ["block", "unit", "at", "h1", "h2", "weight", "done_unit", "done_at"])

    return found


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def _flagged(blocks: int):
    """The places of one block's windows that repeat, dealt by text, as FLAGGED."""

    def found(table: pa.Table) -> pa.Table:
        unit, at, one, two, weight = (_column(table, c, k) for c, k in (("unit", np.int64), ("at", "<u4"), ("h1", np.uint64), ("h2", "<u4"), ("weight", np.uint8)))
        order = np.lexsort((two, one))
        one, two, w = one[order], two[order], weight[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        total = np.add.reduceat(w.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        chosen = order[(total > 1) & (w == 1)]
        unit = np.concatenate([unit[chosen], _column(table, "done_unit", np.int64)])
        at = np.concatenate([at[chosen], _column(table, "done_at", "<u4")])
        order, ends = _blocks(H.mixed(unit.view(np.uint64)), blocks)
        rows = [(int(b), unit[p].tobytes(), at[p].tobytes()) for b in np.flatnonzero(np.diff(ends)) for p in [order[ends[b] : ends[b + 1]]]]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "unit", "at"])

    return found


def _places(table: pa.Table) -> pa.Table:
    """(unit, places) of one block of texts."""
    unit, at = _column(table, "unit", np.int64), _column(table, "at", "<u4")
    order = np.argsort(unit, kind="stable")
    unit, at = unit[order], at[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array(unit[first], pa.int64()), _lists(at, np.diff([*first, len(unit)]), pa.int32())], ["unit", "places"])


def _kept(window: int):
    """(unit, n_removed, kept text) of batches (unit, text, repeated window starts)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.parts(batches, 1):
            words, starts = H.split_words(batch.column(1))
            raw, removed, texts = words.to_pylist(), [], []
            for start, end, places in zip(starts[:-1], starts[1:], batch.column(2), strict=True):
                edge = np.zeros(end - start + 1, np.int64)
                places = np.unique(places.values.to_numpy(zero_copy_only=False))
                np.add.at(edge, places, 1)
                np.add.at(edge, places + window, -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                removed.append(end - start - len(keep))
                texts.append(" ".join([raw[start + i] for i in keep]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["unit", "n_removed", "kept_text"])

    return found


class FingerprintIndex:
    """Runs of (fingerprint, places): one row per fingerprint and run, bucketed and sorted by fingerprint."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 35, buckets: int | None = None):
        self.spark, self.window = spark, window
        self.path = path or temporary(spark, "index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.batches: dict[str, int] = {}  # in each run

    def _write(self, counted: DataFrame, batches: int) -> None:
        name = f"ledgerline_run_{uuid.uuid4().hex[:12]}"
        counted.write.bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.runs.append(name)
        self.batches[name] = batches

    def add(self, prints: DataFrame) -> None:
        """A new run from a batch's fingerprints (column ``prints``, an array per text)."""
        counted = prints.select("prints").mapInArrow(_counted, "print long, places long").repartition(self.buckets, "print")
        self._write(counted.groupBy("print").agg(F.sum("places").alias("places")).sortWithinPartitions("print"), 1)
        while len(self.runs) > RUNS:
            self._merge(sorted(self.runs, key=self.batches.__getitem__)[:2])

    def merged(self, runs: list[str] | None = None) -> DataFrame:
        """Runs (default: all) merge-joined: (print, places)."""
        tables = [self.spark.table(r).withColumnRenamed("places", f"p{i}") for i, r in enumerate(self.runs if runs is None else runs)]
        joined = reduce(lambda a, b: a.join(b.hint("merge"), "print", "full"), tables)
        return joined.select("print", sum((F.coalesce(f"p{i}", F.lit(0)) for i in range(len(tables))), F.lit(0)).alias("places"))

    def _merge(self, runs: list[str]) -> None:
        """Makes one run of some; the old ones go when the new one is complete."""
        self._write(self.merged(runs), sum(self.batches[r] for r in runs))
        for name in runs:
            self.drop(name)

    def compact(self) -> None:
        """Makes one run of all."""
        self._merge([*self.runs])

    def drop(self, name: str) -> None:
        self.runs.remove(name)
        del self.batches[name]
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Removes all runs."""
        for name in [*self.runs]:
            self.drop(name)
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def shared(self) -> DataFrame:
        """Fingerprints that stand in two places or more, over all runs."""
        return self.merged().where("places > 1").select("print")


def in_batches(prints: DataFrame, batches: int) -> list[DataFrame]:
    """The written rows of ``prints`` (with ``unit``, whose upper bits number the task that made them) in ranges of tasks."""
    last = prints.agg(F.max("unit")).first()[0]
    if last is None:
        return [prints]
    tasks = (last >> 33) + 1
    edges = [(tasks * i // batches) << 33 for i in range(batches + 1)]
    return [prints.where((F.col("unit") >= a) & (F.col("unit") < b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def _hashed(of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = of.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), "text")


def _prints(sources: DataFrame, window: int, name: str) -> DataFrame:
    kind = sources.schema["id"].dataType.simpleString()
    found = sources.mapInArrow(_fingerprints(window), f"id {kind}, t1 long, t2 long, n_words long, words_sha256 string, prints array<long>")
    return written(found.withColumn("unit", F.monotonically_increasing_id()), name)


def _groups(prints: DataFrame) -> DataFrame:
    """Distinct texts that have windows: (u1, u2, copies, n_words, unit, uid); the text's first row stands for all."""
    groups = prints.where(F.size("prints") > 0).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("n_words").alias("n_words"), F.min(F.struct("unit", "id")).alias("first"))
    return groups.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "copies", "n_words", F.col("first.unit").alias("unit"), F.col("first.id").alias("uid"))


def _candidates(sources: DataFrame, prints: DataFrame, groups: DataFrame, shared: DataFrame) -> DataFrame:
    """One row for each distinct text with a shared fingerprint: unit, t1, t2, copies, n_words, shared, text."""
    units = prints.where(F.size("prints") > 0).select("unit", F.explode("prints").alias("print")).join(shared, "print").groupBy("unit").agg(F.collect_set("print").alias("shared"))
    units = units.join(groups, "unit")
    return sources.join(units, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("id").eqNullSafe(F.col("uid"))).select("unit", "t1", "t2", "copies", "n_words", "shared", "text")


class Changed(NamedTuple):
    """rows: id, t1, t2, n_words, words_sha256 of all. copied: t1, t2 of texts with many copies, which lose all words. lost: t1, t2, n_removed, kept_text of the other texts that lose some."""

    rows: DataFrame
    copied: DataFrame
    lost: DataFrame


def _changed(docs: DataFrame, id_col: str, text_col: str, window: int, index: FingerprintIndex | None, history: DataFrame | None) -> Changed:
    spark = docs.sparkSession
    if index is not None and index.runs and history is None:
        raise ValueError("an index with runs needs the rows of its batches as history, or what repeats them would stay")
    sources = _hashed(docs, id_col, text_col)
    prints = _prints(sources, window, "fingerprints")
    if index is not None:
        index.add(prints)
        shared = written(index.shared(), "shared-fingerprints")
    else:
        own = FingerprintIndex(spark, window=window)
        for batch in in_batches(prints, BATCHES):
            own.add(batch)
        shared = written(own.shared(), "shared-fingerprints")
        own.close()
    groups = written(_groups(prints), "texts")
    limit = max(COPIES, prints.count() // COPIES_SHARE)
    copied = written(groups.where(F.col("copies") >= limit).select(F.col("u1").alias("t1"), F.col("u2").alias("t2")), "copied")
    found = _candidates(sources, prints, groups, shared).withColumn("old", F.lit(False))
    if history is not None:
        before = _hashed(history, id_col, text_col)
        old = _prints(before, window, "history")
        found = found.unionByName(_candidates(before, old, _groups(old), shared).withColumn("old", F.lit(True)))
    found = written(found.withColumn("unit", F.col("unit") * 2 + F.col("old").cast("long")), "candidates")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(found.agg(F.sum("n_words")).first()[0] or 0) // BLOCK_WORDS))
    dealt = found.select("unit", "copies", "text", "shared").mapInArrow(_windows(window, 2 * blocks), DEALT)
    flagged = dealt.groupBy("block").applyInArrow(_flagged(blocks), FLAGGED)
    places = written(flagged.groupBy("block").applyInArrow(_places, "unit long, places array<int>"), "repeats")
    lost = found.where(~F.col("old")).select("unit", "text").join(places, "unit").mapInArrow(_kept(window), "unit long, n_removed long, kept_text string")
    return Changed(prints.drop("prints", "unit"), copied, lost.join(found.select("unit", "t1", "t2"), "unit").dropDuplicates(["t1", "t2"]).select("t1", "t2", "n_removed", "kept_text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """Removes every word covered by a window of ``window`` words that starts at another place too, in any text.

    Returns per row: id, n_words, n_removed, kept_text (the kept words joined by a space; null where nothing is removed)
    and words_sha256 (all words joined by a space). ``index`` holds the runs of earlier batches and gets one more for this
    batch; ``history`` are those batches' rows (same columns), needed to verify what a batch shares with them: an index with runs and no history is an error.
    Without ``index`` the rows come in as BATCHES batches of an index of their own, which is removed afterwards.

    Null and empty texts have no words. Equal texts of ``window`` words or more are removed wholly; one of them stands
    for all, so that copies never meet. Null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    rows, copied, lost = _changed(docs, id_col, text_col, window, index, history)
    copied = F.broadcast(copied)
    whole = rows.join(copied, ["t1", "t2"], "left_semi").select("id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text"), "words_sha256")
    rest = rows.join(copied, ["t1", "t2"], "left_anti").join(lost, ["t1", "t2"], "left")
    out = rest.select("id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "kept_text", "words_sha256").union(whole)
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``docs``, all columns (of any names), with the words of ``remove_repeats`` taken out; texts that lose none stay as they are."""
    _, copied, lost = _changed(docs, id_col, text_col, window, None, None)
    lost, copied = written(lost.drop("n_removed"), "kept-texts"), F.broadcast(copied)
    text = F.col(text_col).cast("string")
    rows = docs.select(whole_row(docs).alias("row"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    whole = rows.join(copied, ["t1", "t2"], "left_semi").select("row", F.lit("").alias("kept_text"))
    rest = rows.join(copied, ["t1", "t2"], "left_anti").join(lost, ["t1", "t2"], "left").select("row", "kept_text")
    return rest.union(whole).select(*(F.coalesce("kept_text", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
