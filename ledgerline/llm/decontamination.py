"""Benchmark decontamination by winnowing.

Every text's fingerprint is the smallest k-gram hash of each window of w consecutive k-grams. Two texts that share
t = k + w - 1 consecutive words share a window of k-grams, and so a fingerprint: no shared span of t words is missed.
Fingerprints of documents and benchmark items are joined; each hit is then extended word by word along its diagonal.

Items shorter than the span wanted are spans of their own: each such length is one more layer with its own k and w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._common import NOT_WORD, ascii_lower, many_to_one, row_key, whole_row, words, written

#: Benchmark fingerprints are broadcast up to this number (24 bytes each), items up to so many bytes; beyond it they are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def winnow_parameters(span: int) -> tuple[int, int]:
    """k and w with k + w - 1 = span."""
    k = (span + 1) // 2
    return k, span - k + 1


def _hashes(of: Column) -> Column:
    return F.transform(of, lambda w: F.xxhash64(w))


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of the k-grams in turn, from the hashes of the words; none if there are fewer than k words.

    ``hashes`` is a column of its own, mentioned twice: so the optimizer doesn't compute it anew for each gram.
    """
    n = F.size(hashes)
    at = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, k)))


def _fingerprints(grams: Column, w: int) -> Column:
    """The distinct smallest hashes of all windows of w k-grams; with fewer k-grams there is no such window."""
    m = F.size(grams)
    at = F.when(m >= w, F.sequence(F.lit(1), m - w + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(grams, i, w))))


def _tagged(hashes: Column, span: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(span).alias("span"), h.alias("hash")))


def _marks(texts: DataFrame, layers: list[int], *keep: str, per_text: bool = False) -> DataFrame:
    """One row per fingerprint of ``words``: the kept columns, span, hash; ``per_text`` adds a row of span 0 for each text."""
    hashed = texts.select(*keep, _hashes(F.col("words")).alias("hashes"))
    grams = hashed.select(*keep, *(_grams(F.col("hashes"), winnow_parameters(t)[0]).alias(f"grams{t}") for t in layers))
    parts = [_tagged(_fingerprints(F.col(f"grams{t}"), winnow_parameters(t)[1]), t) for t in layers]
    if per_text:
        parts.append(F.array(F.struct(F.lit(0).alias("span"), F.lit(0).cast("long").alias("hash"))))
    return grams.select(*keep, F.explode(F.concat(*parts)).alias("f")).select(*keep, "f.span", "f.hash")


def _runs(offset: Column) -> Column:
    """Structs (start, end) of the maximal stretches of at least ``own`` words that are equal along a diagonal of ``words`` and ``item_words``.

    One pass with the stretch's start at hand; no copy of the words is made.
    """
    low, high = F.greatest(F.lit(0), offset), F.least(F.size("words"), F.size("item_words") + offset)

    def step(acc: Column, i: Column) -> Column:
        ends = (i == high) | (F.get("words", i) != F.get("item_words", i - offset))
        out = F.when(ends & (i - acc["start"] >= F.col("own")), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), i.alias("end"))))).otherwise(acc["out"])
        return F.struct(F.when(ends, i + 1).otherwise(acc["start"]).alias("start"), out.alias("out"))

    return F.aggregate(F.sequence(low, high), F.struct(low.alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step, lambda acc: acc["out"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 13) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit (words inside an occurrence of a window of an item), items (sorted strings), key (names the row by id and text).

    A window is ``span`` consecutive words of an item, or the whole item if it has fewer. Null or empty texts have no
    words, and so no hits; an empty item hits nothing. A null item id counts its hits but isn't listed; items that repeat an id are one in ``items``.
    Repeated rows each give a row; other columns are ignored. An empty benchmark gives rows without hits.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("id", "text", row_key(F.col("id"), F.col("text")).alias("key"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(ascii_lower(F.col(item_text_col).cast("string")), NOT_WORD).alias("item_words")).where(F.size("item_words") > 0).distinct()
    items = written(items.select("item", "item_words", F.xxhash64(F.col("item"), F.col("item_words")).alias("item_key"), F.least(F.size("item_words"), F.lit(span)).alias("span")), "benchmark")
    layers = sorted(r[0] for r in items.select("span").distinct().collect())  # at most ``span`` values
    split = texts.select("id", "key", words(ascii_lower(F.col("text")), NOT_WORD).alias("words")).select("id", "key", "words", F.size("words").alias("n_words"))
    if not layers:
        return split.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), "key")

    index = items.select("item_key", F.col("span").alias("own"), F.col("item_words").alias("words"), F.size("item_words").alias("n_words"))
    index = written(_marks(index, layers, "item_key", "own").where(F.col("own") == F.col("span")).drop("own"), "benchmark-fingerprints")
    known = index.select("span", "hash").distinct().withColumn("known", F.lit(True))
    if index.count() <= BROADCAST_ROWS:
        known, index = F.broadcast(known), F.broadcast(index)

    # every document's words are counted and fingerprinted in one pass; a row of span 0 stands for the document
    probe = _marks(split, layers, "id", "key", "n_words", per_text=True).join(known, ["span", "hash"], "left").where("known OR span = 0")
    probe = written(probe.select("id", "key", "n_words", "span", "hash"), "document-fingerprints")

    # the documents with a hit are read again and each hit is extended along its diagonal
    hits = written(probe.where("span > 0").join(index, ["span", "hash"]).groupBy("key", "item_key").agg(F.collect_set("hash").alias("hashes")), "pairs")
    hit = hits.select("key").distinct()
    if hits.count() <= BROADCAST_ROWS // 4:
        hit = F.broadcast(hit)
    again = texts.select("key", "text").join(hit, "key", "left_semi").dropDuplicates(["key"])
    again = again.select("key", words(ascii_lower(F.col("text")), NOT_WORD).alias("words"))
    pairs = hits.join(again, "key")
    of = items.select(F.col("item_key").alias("item_of"), "item", "item_words", F.col("span").alias("own"))
    if (items.agg(F.sum(F.aggregate("item_words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16))).first()[0] or 0) <= BROADCAST_BYTES:
        pairs = pairs.join(F.broadcast(of), F.col("item_key") == F.col("item_of"))
    else:  # an item that very many documents hold is dealt into several tasks
        pairs = many_to_one(pairs, "item_key", of, "item_of", hits)
    pairs = pairs.select("key", "item", "words", "item_words", "own", "hashes", F.expr(f"element_at(map({', '.join(f'{t}, {winnow_parameters(t)[0]}' for t in layers)}), own)").alias("k"), _hashes(F.col("words")).alias("w_hashes"), _hashes(F.col("item_words")).alias("i_hashes"))

    def places(of: str) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(of) - F.col("k") + 1), lambda i: F.struct(F.xxhash64(F.slice(of, i, F.col("k"))).alias("hash"), i.alias("at")))
        return F.filter(grams, lambda g: F.array_contains("hashes", g["hash"]))

    crossed = pairs.select("key", "item", "words", "item_words", "own", places("w_hashes").alias("here"), places("i_hashes").alias("there"))
    offsets = F.when(F.size("there") > 0, F.array_distinct(F.flatten(F.transform("here", lambda d: F.transform(F.filter("there", lambda b: b["hash"] == d["hash"]), lambda b: d["at"] - b["at"])))))
    diagonals = crossed.select("key", "item", "words", "item_words", "own", offsets.alias("offsets"))
    spans = diagonals.select("key", "item", F.explode(F.flatten(F.transform("offsets", _runs))).alias("s")).select("key", "item", "s.start", "s.end")
    spans = written(spans.distinct(), "hits")

    listed = spans.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ends = spans.groupBy("key", "start").agg(F.max("end").alias("end")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ends"))
    covered = F.aggregate("ends", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).cast("long").alias("n")), lambda a: a["n"])
    found = ends.select("key", covered.alias("n_hit")).join(listed, "key")
    rows = probe.where("span = 0").select("id", "key", "n_words")
    return rows.join(found, "key", "left").select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "key")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: some word is hit and hits are at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns (of any names), that the rule doesn't find contaminated."""
    found = decontaminate(docs, benchmark, id_col, text_col)
    found = written(found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select("key").distinct(), "contaminated")
    rows = docs.select(whole_row(docs).alias("row"), row_key(F.col(id_col), F.col(text_col).cast("string")).alias("key"))
    return rows.join(found, "key", "left_anti").select("row.*")
