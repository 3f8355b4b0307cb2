"""Quality rules: a learned decision list.

Sequential covering on labelled rows: a rule is a conjunction of thresholds that is grown on one part of the sample until
it covers no good text (by information gain), pruned on the other part, and kept if it is precise there. The list is emitted
as one Spark conditional expression over statistics of the text, and reads like a filter written by hand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._common import SPACE, whole_row, words

#: Labelled rows that a fit uses at most: those with the smallest hash of their id.
SAMPLE = 4000
#: A rule must be so precise on the pruning part; at most so many rules and conditions; candidate thresholds of a statistic.
PRECISION, MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 0.9, 12, 4, 40
#: Statistics that rules may use, as SQL over the columns of ``text_statistics``.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "CAST(n_dup_lines AS DOUBLE)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaims_a_word": "n_exclaims / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.value if self.above else row[self.feature] <= self.value

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:g}"


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def _window_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def _shifted(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def text_statistics(docs: DataFrame, *keep: Column, text: Column) -> DataFrame:
    """The kept columns and, of each text (null: empty): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_exclaims, n_distinct.

    Repeated words are those in a window of three words found twice or more. A text's windows are sorted as numbers: the
    window's hash in the upper bits, its place in the lower. The words of neighbours with equal hashes are compared; a text in
    which they differ anywhere is sorted by its words instead, so the count is exact for texts of any length.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    given = docs.select(*keep, text.alias("__text"))
    names = [c for c in given.columns if c != "__text"]
    given = given.select(*names, "__text", words(F.col("__text"), SPACE).alias("__words"))
    w, n = F.col("__words"), F.size("__words")
    given = given.withColumn("__bits", F.length(F.bin(n.cast("long"))).cast("int"))
    bits = F.col("__bits")
    # the upper bits as they are, the lower ones replaced by the place
    window = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    coded = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: _shifted("shiftleft", _shifted("shiftrightunsigned", _window_hash(*window(i)), bits), bits) + i)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__text", "\n"), lambda s: s.rlike(f"[^{SPACE}]"))
    given = given.select(*names, "__text", "__words", "__bits", F.sort_array(coded).alias("__coded"), lines.alias("__lines"))
    code = F.col("__coded")
    group = lambda c: _shifted("shiftrightunsigned", c, bits)
    place = lambda c: (c - _shifted("shiftleft", group(c), bits)).cast("int")
    again = F.filter(code, lambda c, j: (group(c) == group(F.get(code, j + 1))) | (group(c) == group(F.get(code, j - 1))))
    given = given.select(*names, "__text", "__words", "__bits", "__lines", again.alias("__again"))
    hit = F.col("__again")

    def differ(c: Column, j: Column) -> Column:
        """Whether the window has the hash of the one before it, but other words."""
        before = F.get(hit, j - 1)
        return (group(c) == group(before)) & ~_all(x == y for x, y in zip(window(place(c)), window(place(before)), strict=True))

    by_words = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(*(x.alias(f"w{k}") for k, x in enumerate(window(i))), i.alias("at"))))
    given = given.select(*names, "__text", "__words", "__bits", "__lines", "__again", F.when(F.size(F.filter(hit, differ)) > 0, by_words).alias("__by_words"))
    sorted_ = F.col("__by_words")
    alike = lambda a, b: F.coalesce(_all(a[f"w{k}"] == b[f"w{k}"] for k in range(3)), F.lit(False))
    exact = F.transform(F.filter(sorted_, lambda a, j: alike(a, F.get(sorted_, j + 1)) | alike(a, F.get(sorted_, j - 1))), lambda a: a["at"])
    given = given.select(*names, "__text", "__words", "__lines", F.sort_array(F.coalesce(exact, F.transform(hit, place))).alias("__places"))
    at = F.col("__places")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, j + 1) - p, F.lit(3)).cast("long"))), F.lit(0).cast("long"), lambda a, g: a + g)
    return given.select(
        *names, F.size("__words").cast("long").alias("n_words"), _without(F.col("__text"), f"[{SPACE}]+").cast("long").alias("word_chars"),
        _without(F.col("__text"), "[^#*$%&|<>]+").cast("long").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), _without(F.col("__text"), r"[^\p{Lu}]+").cast("long").alias("n_upper"), _without(F.col("__text"), "[^!]+").cast("long").alias("n_exclaims"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
    )


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def with_features(statistics: DataFrame) -> DataFrame:
    return statistics.selectExpr("*", *(f"CAST({sql} AS DOUBLE) AS f_{name}" for name, sql in FEATURES.items()))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = SAMPLE) -> list[dict]:
    """Features and label (1 good, 0 bad) of at most ``limit`` labelled rows; null labels and ids are left out.

    Labels with the smallest hashes of their ids are looked up; of ids that repeat in ``docs``, the rows that come first by all features
    count, so the sample depends on the rows alone.
    """
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__good")).where("__id IS NOT NULL AND __good IN (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__good").limit(limit)
    picked = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__body")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    rows = with_features(text_statistics(picked, F.col("__id"), F.col("__good"), F.xxhash64("__id", F.lit(5)).alias("__h"), text=F.col("__body")))
    rows = rows.orderBy("__h", "__id", "__good", *(f"f_{n}" for n in FEATURES)).limit(limit)
    return [{k: r[k] for k in r.asDict() if k.startswith("f_")} | {"good": r["__good"], "grow": r["__h"] % 3 != 0} for r in rows.collect()]


def learn_rules(rows: list[dict]) -> list[list[Condition]]:
    """Ordered conjunctions that bad texts meet."""
    if not rows:
        return []
    names = [f"f_{n}" for n in FEATURES]
    values = {n: sorted({r[n] for r in rows}) for n in names}
    cuts = {n: sorted({v[min(len(v) - 1, i * len(v) // THRESHOLDS)] for i in range(THRESHOLDS)}) for n, v in values.items()}
    out: list[list[Condition]] = []
    left = rows
    while len(out) < MAX_RULES:
        grow, prune = [r for r in left if r["grow"]], [r for r in left if not r["grow"]]
        rule = _grown(grow, names, cuts)
        if not rule:
            break
        rule = max((rule[: i + 1] for i in range(len(rule))), key=lambda c: (_worth(c, prune), -len(c)))
        bad, good = _covered(rule, left if not prune else prune)
        if not bad or bad / (bad + good) < PRECISION:
            break
        out.append(rule)
        left = [r for r in left if not all(c.holds(r) for c in rule)]
    return out


def _covered(rule: list[Condition], rows: list[dict]) -> tuple[int, int]:
    hit = [r["good"] for r in rows if all(c.holds(r) for c in rule)]
    return hit.count(0), hit.count(1)


def _worth(rule: list[Condition], rows: list[dict]) -> float:
    bad, good = _covered(rule, rows)
    return (bad - good) / (bad + good) if bad + good else -1.0


def _grown(rows: list[dict], names: list[str], cuts: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    bad, good = (sum(r["good"] == g for r in rows) for g in (0, 1))
    while bad and good and len(rule) < MAX_CONDITIONS:
        base, best = log2(bad / (bad + good)), (0.0, None, 0, 0)
        for n in names:
            ordered = sorted((r[n], r["good"]) for r in rows)
            at, below = 0, [0, 0]
            for v in cuts[n]:
                while at < len(ordered) and ordered[at][0] <= v:
                    below[ordered[at][1]] += 1
                    at += 1
                for above, (p, q) in ((False, below), (True, (bad - below[0], good - below[1]))):
                    if p and (gain := p * (log2(p / (p + q)) - base)) > best[0] + 1e-9:
                        best = (gain, Condition(n, above, v), p, q)
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r)]
        bad, good = best[2], best[3]
    return rule


def verdict(rules: list[list[Condition]]) -> Column:
    """False where a rule covers the row, true where none does."""
    out = None
    for rule in rules:
        whole = rule[0].column()
        for c in rule[1:]:
            whole = whole & c.column()
        out = F.when(whole, F.lit(False)) if out is None else out.when(whole, F.lit(False))
    return out.otherwise(F.lit(True)) if out is not None else F.lit(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id, the statistics, base_failed, kept (false if base_failed, else the learned list's verdict).

    The list is fitted on at most SAMPLE labelled rows; without usable labels it is empty and only the base rule counts.
    Null and empty texts have no words and so fail the base rule. Repeated rows each give a row; null ids stay null; other
    columns are ignored; an empty table gives no rows. Needs no shuffle of texts.
    """
    rules = learn_rules(labelled_sample(docs, labels, id_col, text_col, label_col))
    rows = with_features(_computed_once(text_statistics(docs, F.col(id_col), text=F.col(text_col))))
    found = {c: F.col(c) for c in STATISTICS} | {"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)}
    return rows.select(id_col, *(F.when(F.col("__at") >= 0, c).alias(name) for name, c in found.items()))


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _computed_once(statistics: DataFrame) -> DataFrame:
    """With a row number ``__at``, below which no filter is pushed: pushed into the statistics, it would repeat them at each mention."""
    return statistics.withColumn("__at", F.monotonically_increasing_id())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge_quality`` keeps."""
    learned = learn_rules(labelled_sample(docs, labels, id_col, text_col, label_col))
    given = docs.select(whole_row(docs).alias("__row"), F.col(text_col).alias("__t"))
    rows = text_statistics(given, F.col("__row"), text=F.col("__t"))
    rows = with_features(_computed_once(rows))
    return rows.where((F.col("__at") >= 0) & ~base_failed() & verdict(learned)).select("__row.*")
