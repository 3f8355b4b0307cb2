import re
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.decontamination import contaminated, decontaminate, without_contaminated
from ledgerline.llm.license_scan import expansions, rules, scan_licenses
from ledgerline.llm.quality_rules import SAMPLE, judge_quality, keep_good, learn_rules
from ledgerline.llm.sharding import shard_documents


def test_decontamination(spark, docs, rows, benchmark_items, none):
    bench = spark.createDataFrame(benchmark_items, "item_id long, text string").withColumn("words", F.lit(1))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate(docs, bench).collect())
    assert got == Counter((i, n, h, tuple(x)) for i, t in rows for n, h, x in [brute.contamination(t, benchmark_items)])
    assert sum(h > 0 for _, _, h, _ in got) > 5
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0 OR size(items) > 0").count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)
    left = without_contaminated(docs, bench)
    assert left.columns == docs.columns
    bad = sum(h > 0 and 20 * h >= n for _, t in rows for n, h, _ in [brute.contamination(t, benchmark_items)])
    assert left.count() == len(rows) - bad
    assert contaminated is not None


def test_decontamination_without_broadcasts(spark, docs, rows, benchmark_items, monkeypatch):
    """Beyond the bounds of the broadcasts the result is the same; columns of any name pass."""
    from ledgerline.llm import decontamination as D

    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    bench = spark.createDataFrame(benchmark_items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate(docs, bench).collect())
    assert got == Counter((i, n, h, tuple(x)) for i, t in rows for n, h, x in [brute.contamination(t, benchmark_items)])
    odd = docs.withColumn("__key", F.lit("k")).withColumn("row", F.lit("r")).withColumn("item", F.lit(1))
    left = without_contaminated(odd, bench)
    assert left.columns == odd.columns and left.where("__key = 'k' AND row = 'r'").count() == without_contaminated(docs, bench).count()


def test_decontamination_of_long_texts(spark):
    """One layer of 13 words and texts of 20,000: each gram is hashed from words that are hashed once."""
    import time

    long = " ".join(f"w{i % 900}" for i in range(20000))
    item = " ".join(f"w{i}" for i in range(100, 120))
    began = time.monotonic()
    out = decontaminate(spark.createDataFrame([(i, long) for i in range(8)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.n_hit for r in out} == {20 * 23} and time.monotonic() - began < 60


def test_license_rules():
    table = rules()
    assert len(table) > 200 and [r[3] for r in table] == sorted(r[3] for r in table)


def test_license_scan(spark, docs, rows, none):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = Counter((r.doc_id, r.n_words, tuple(sorted((b.start, b.label) for b in r.base))) for r in scan_licenses(docs).collect())
    want = Counter()
    for i, t in rows:
        w = brute.ascii_words(t)
        want[i, len(w), tuple(sorted((j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()))] += 1
    assert got == want
    assert scan_licenses(none).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", ["apache-2.0"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"]),
        ("GNU Lesser General Public License version 2.1", ["lgpl-2.1"]),
        ("mit license, then the Mozilla Public License 2.0", ["mit", "mpl-2.0"]),
        ("a licence of no kind", []),
    ],
)
def test_license_suppression(spark, text, labels):
    found = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [d.label for d in found.detections] == labels
    assert found.score == max((d.confidence for d in found.detections), default=0)


def _brute_detections(text, table):
    """(start, end, label) of all rules tried on all of a text, less what another of the same or a better priority holds."""
    line = f" {' '.join(brute.ascii_words(text))} "
    spans = sorted({(line[: m.start()].count(" ") - 1, -(line[: m.end()].count(" ")), priority, label) for label, pattern, priority in table for m in pattern.finditer(line)})
    kept = [s for i, s in enumerate(spans) if not any(t[1] <= s[1] and t[2] <= s[2] for t in spans[:i])]
    return sorted((start, -end, label) for start, end, _, label in kept)


def test_license_rules_alone(spark):
    """Each rule is found in a text that holds nothing but its match."""
    texts = set()
    for _, need, pattern, _, _ in rules():
        matches = [x.replace("##", "07") for x in expansions(pattern)]
        assert all(re.fullmatch(pattern, x) and all(set(n) & set(x.split()) for n in need) for x in matches)
        texts |= {*matches[:: max(1, len(matches) // 6)], matches[-1]}
    texts |= {"Released under the Apache 2.0.", "Mozilla Public 2.0", "Creative Commons Attribution 4.0", "SPDX-License-Identifier: CC-BY-4.0", "the FreeBSD license", "zero clause BSD licence", "CC BY-NC 4.0", "mit dem Boot", "released in 2.0"}
    table = [(label, re.compile(f"(?<= )(?:{pattern})(?= )"), priority) for label, _, pattern, priority, _ in rules()]
    got = {r.text: sorted((d.start, d.end, d.label) for d in r.detections) for r in scan_licenses(spark.createDataFrame([(t, t) for t in sorted(texts)], "text string, copy string"), "text", "copy").collect()}
    assert got == {t: _brute_detections(t, table) for t in texts}
    assert sum(not d for d in got.values()) == 2


def test_quality_statistics(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (99999, 0)], "doc_id long, quality int")
    out = judge_quality(docs, labels)
    got = Counter(tuple(r[:7]) for r in out.collect())
    want = Counter()
    for i, t in rows:
        s = brute.statistics(t)
        want[(i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want
    assert out.where("kept AND base_failed").count() == 0
    assert judge_quality(none, labels).count() == 0
    assert judge_quality(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    kept = keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == out.where("NOT base_failed").count()


def test_quality_under_filters(spark):
    """Filters and projections on the result don't repeat the statistics: a long text stays cheap."""
    import time

    long = " ".join(f"w{i % 7000}" for i in range(20000))
    df = spark.createDataFrame([(1, long), (2, "x " * 60), (3, " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string")
    out = judge_quality(df, spark.createDataFrame([], "doc_id long, quality int"))
    began = time.monotonic()
    assert out.where("kept AND base_failed").count() == 0
    assert {r.doc_id for r in out.where("kept").select("doc_id").collect()} == {3}
    assert out.where("n_repeat_words > 0 AND base_failed").select("base_failed").count() == 2
    assert time.monotonic() - began < 60


def test_repeated_windows_with_equal_hashes(spark, docs, rows, monkeypatch):
    """The count doesn't depend on the hash: with three values for all windows it is the same."""
    from ledgerline.llm import quality_rules as Q

    monkeypatch.setattr(Q, "_window_hash", lambda a, b, c: F.pmod(F.xxhash64(a, b, c), F.lit(3)) * 2**50)
    some = docs.where("length(text) < 3000 OR text IS NULL")
    got = Counter((r.doc_id, r.n_repeat_words) for r in Q.text_statistics(some, F.col("doc_id"), text=F.col("text")).collect())
    assert got == Counter((i, brute.statistics(t)[4]) for i, t in rows if t is None or len(t) < 3000)


def test_labelled_sample_of_repeated_ids(spark):
    """A repeated id can't push the sample over its bound, and the order of rows doesn't matter."""
    from ledgerline.llm.quality_rules import labelled_sample

    rows = [(i % 5, " ".join(["a"] * (i % 11 + 1))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    one, two = (labelled_sample(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, "doc_id", "text", "quality", limit=20) for r, n in ((rows, 3), (rows[::-1], 2)))
    assert one == two and len(one) == 20


def test_learned_rules_hold_out():
    import random

    rng = random.Random(1)

    def row():
        bad = rng.random() < 0.3
        junk = rng.random() < 0.5
        base = {f"f_{n}": rng.random() for n in ("n_words", "mean_word", "dup_lines", "distinct_share")}
        return base | {"f_symbols_a_word": 1 + rng.random() if bad and junk else rng.random(), "f_upper_share": 0.7 + rng.random() / 4 if bad and not junk else rng.random() / 2, "f_repeat_share": 0.1, "f_exclaims_a_word": 0.0, "good": int(not bad), "grow": rng.random() < 0.66}

    found = learn_rules([row() for _ in range(600)])
    test = [row() for _ in range(600)]
    right = sum(any(all(c.holds(r) for c in rule) for rule in found) == (not r["good"]) for r in test)
    assert found and right >= 0.97 * len(test), [list(map(str, r)) for r in found]
    assert learn_rules([]) == [] and SAMPLE > 0


def test_shards(spark, docs, rows, none):
    out = shard_documents(docs, leaves=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert shard_documents(none).count() == 0


def test_shards_near_equal(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one hot text " * 9)).otherwise(F.concat(F.repeat(F.lit("ab c"), (F.col("id") % 50).cast("int")), F.col("id").cast("string"))).alias("text"))
    sizes = [r[1] for r in shard_documents(many, leaves=16).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.01 * min(sizes)
