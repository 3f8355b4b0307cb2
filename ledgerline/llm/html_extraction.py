"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path and each is paired with the neighbour whose path is more alike. The two pages'
lines are aligned by longest common subsequence; lines that both share are the site's, not the page's, and are deleted.
Markup then has a say: lines inside an article are the page's even if a neighbour has them too, and lines in navigation,
headers, footers, forms, adverts, notices and comments are not the page's even if no neighbour has them. All others are
decided by differencing, whether or not the page has an article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm._common import written

#: Elements whose content is never text: raw characters, to the end of the page if the end tag is missing.
RAW = "script style title textarea xmp noembed noframes".split()
#: Those that count only if they are closed; an open one hides nothing.
SILENT = "noscript template object svg math canvas audio video select datalist".split()
#: Elements that hold no part of an article.
AROUND = "nav footer aside form menu dialog button fieldset".split()
#: Elements that hold the article.
ARTICLE = "article main".split()
#: Elements that don't end a line.
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
#: Elements without content.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words of a class, id or role that mark what stands around an article.
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|overlay|sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|comments?|disqus|replies|reactions|toolbar|skip-link|contentinfo|complementary|search)(?:$|[\s_-])", re.I)
_ATTRIBUTES = r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
#: Comments, raw elements with their content, iframes with theirs up to the next iframe's start, options (which need no end tag) with their text, other tags.
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<(?P<raw>" + "|".join(RAW) + r")" + _ATTRIBUTES + r"(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|$))|<iframe" + _ATTRIBUTES + r"(?:(?<=/>)|(?:[^<]*(?:<(?!/?iframe[\s/>])[^<]*)*</iframe\s*>)?)|<option" + _ATTRIBUTES + r"[^<]*|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*>", re.I | re.S)
#: Whether a page may have elements of SILENT.
HIDES = re.compile(r"<(?:" + "|".join(SILENT) + r")[\s/>]", re.I)
MARKED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Up to so many pages with shared lines, their places are broadcast; beyond, joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Kinds of lines.
LOOSE, OWN, OUTSIDE = 0, 1, 2
_AROUND, _ARTICLE, _INLINE, _VOID, _SILENT = map(frozenset, (AROUND, ARTICLE, INLINE, VOID, SILENT))
SPACES = re.compile(r"\s+")


def _hidden(tags: list[re.Match]) -> dict[int, int]:
    """Where closed elements of SILENT start and end; an end tag closes the last open start of its name."""
    open_: dict[str, list[int]] = {name: [] for name in SILENT}
    out: dict[int, int] = {}
    for tag in tags:
        if tag["name"] and (starts := open_.get(tag["name"].lower())) is not None:
            if not tag["end"]:
                if not tag[0].endswith("/>"):
                    starts.append(tag.start())
            elif starts:
                out[starts.pop()] = tag.end()
    return out


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """The visible lines of a page and the kind of each: OWN inside an article, OUTSIDE in what stands around it, or LOOSE."""
    lines: list[str] = []
    kinds: list[int] = []
    buffer: list[str] = []
    open_: list[tuple[str, str]] = []  # elements that matter, with what they are
    names: Counter[str] = Counter()  # of those
    counts = {"around": 0, "article": 0}

    def end_line() -> None:
        if buffer:
            if text := SPACES.sub(" ", unescape("".join(buffer))).strip():
                lines.append(text)
                kinds.append(OUTSIDE if counts["around"] else OWN if counts["article"] else LOOSE)
            buffer.clear()

    at = 0
    tags = list(TAG.finditer(html))
    hidden = _hidden(tags) if HIDES.search(html) else {}
    for tag in tags:
        if tag.start() < at:
            continue
        if tag.start() > at:
            buffer.append(html[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if not name:
            if tag[0].startswith("<![CDATA["):
                buffer.append(tag[0][9:-3])
            continue
        name = name.lower()
        if name in _SILENT or name == "option":
            at = hidden.get(tag.start(), at)
            continue
        if name in _INLINE and not (tag["rest"] and MARKED.search(tag["rest"])):
            if name not in ("a", "span", "label") or not open_:
                continue
        if name not in _INLINE:
            end_line()
        if name in _VOID:
            continue
        if tag["end"]:
            while names[name]:  # ends what is still open inside it, too
                was, what = open_.pop()
                names[was] -= 1
                if was == name and what != "plain" and name in _INLINE:
                    end_line()
                if what != "plain":
                    counts[what] -= 1
                if was == name:
                    break
            continue
        what = "plain"
        if name in _ARTICLE:
            what = "article"
            if counts["around"] and not counts["article"]:  # an unclosed element before the article ends here
                counts["around"] = 0
                open_[:] = [(n, w) for n, w in open_ if w != "around"]
                names = Counter(n for n, _ in open_)
        elif name in _AROUND or name == "header" and not counts["article"]:
            what = "around"
        elif name not in ("body", "html", "head") and tag["rest"] and any(MARKS.search(next(filter(None, m.groups()), "")) for m in MARKED.finditer(tag["rest"])):
            what = "around"
            if name in _INLINE:
                end_line()
        if what != "plain":
            counts[what] += 1
        if what != "plain" or names[name] or name in ("div", "section"):
            open_.append((name, what))
            names[name] += 1
    if at < len(html):
        buffer.append(html[at:])
    end_line()
    return lines, kinds


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and the first j of ``b``, for each j."""
    best = np.zeros(len(b) + 1, np.int64)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(np.where(b == x, best[:-1] + 1, 0), best[1:]))
    return best


def _common(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """Marks in ``out`` the members of ``a`` in one longest common subsequence; halves ``a``, so memory is linear."""
    while len(a) and len(b) and a[0] == b[0]:
        out[0] = True
        a, b, out = a[1:], b[1:], out[1:]
    while len(a) and len(b) and a[-1] == b[-1]:
        out[len(a) - 1] = True
        a, b = a[:-1], b[:-1]
    if not len(a) or not len(b):
        return
    if len(a) == 1:
        out[0] = bool((b == a[0]).any())
        return
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    _common(a[:half], b[:cut], out[:half])
    _common(a[half:], b[cut:], out[half : len(a)])


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each line of ``a`` (hashes), whether it is in a longest common subsequence with ``b``."""
    out, in_a = np.zeros(len(a), bool), np.flatnonzero(np.isin(a, b))
    found = np.zeros(len(in_a), bool)
    _common(a[in_a], b[np.isin(b, a)], found)
    out[in_a] = found
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, key, lines, kinds) of batches (id, url, key, html)."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            found = [page_lines(h) for h in pc.fill_null(part.column(3), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([k for _, k in found], pa.list_(pa.int8()))], ["id", "url", "key", "lines", "kinds"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, key, line hashes) of batches (id, url, key, html)."""
    for batch in batches:
        hashes = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in page_lines(h or "")[0]] for h in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(hashes, pa.list_(pa.int64()))], ["url", "key", "hashes"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shared lines' places) of batches (key, hashes, other page's hashes)."""
    for batch in batches:
        rows = [np.flatnonzero(shared_lines(np.array(a, np.int64), np.array(b, np.int64))) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["key", "shared"])


def _neighbours(pages: DataFrame) -> DataFrame:
    """(key, other): for each page the page of the same host next to it in the order of paths, the one with more of the path in common.

    Sorted by range, so a host may spread over any number of tasks; the ends of each task's rows meet in a table of two rows a task.
    """
    order = ["host", "path", "key"]
    spread = pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    spread = written(spread, "pages-by-url")
    row = F.struct(*order)
    ends = spread.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    parts = Window.orderBy("part")  # two rows for each task
    ends = ends.select("part", F.lag("high").over(parts).alias("before_part"), F.lead("low").over(parts).alias("after_part"))
    here = Window.partitionBy("part").orderBy(*order)
    near = spread.withColumn("before", F.lag(row).over(here)).withColumn("after", F.lead(row).over(here)).join(F.broadcast(ends), "part")
    near = near.withColumn("before", F.coalesce("before", "before_part")).withColumn("after", F.coalesce("after", "after_part"))

    def alike(other: str):
        """Path segments in common from the start; null if the host differs."""
        mine, theirs = F.split("path", "/"), F.split(F.col(f"{other}.path"), "/")
        first = F.array_position(F.transform(F.arrays_zip(mine.alias("a"), theirs.alias("b")), lambda p: p["a"].eqNullSafe(p["b"])), False)
        return F.when(F.col(f"{other}.host") == F.col("host"), F.when(first == 0, F.lit(1_000_000)).otherwise(first))

    near = near.select("key", "before", "after", alike("before").alias("b"), alike("after").alias("a"))
    return near.select("key", F.when(F.coalesce("b", F.lit(0)) >= F.coalesce("a", F.lit(0)), F.when(F.col("b").isNotNull(), F.col("before.key"))).otherwise(F.col("after.key")).alias("other")).where("other IS NOT NULL")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (the main text's lines joined by a line feed), n_shared (lines that the neighbour has too).

    Null or empty html gives an empty text. A page without a URL, or alone on its host, has no neighbour and only markup speaks; its lines outside any mark stay. A
    neighbour that has all of a page's lines is a copy of it and deletes nothing. Repeated rows are one page for pairing and each
    give a row; null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    given = given.select("id", "url", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("~")), F.hex(F.xxhash64("url", "html"))).alias("key"), "html")
    listed = given.where("url IS NOT NULL").mapInArrow(_hashed, "url string, key string, hashes array<bigint>").select("key", "hashes", F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)).alias("host"), F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"))
    listed = written(listed.where("host <> ''").dropDuplicates(["key"]), "page-hashes")
    pairs = _neighbours(listed.select("host", "path", "key"))
    hashes = listed.select("key", "hashes")
    both = pairs.join(hashes, "key").join(hashes.toDF("other", "theirs"), "other").select("key", "hashes", "theirs")
    shared = both.mapInArrow(_aligned, "key string, shared array<int>")
    shared = written(shared.where(F.size("shared") > 0).select(F.col("key").alias("k"), "shared"), "shared-lines")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    parsed = given.mapInArrow(_parsed, f"id {kind}, url string, key string, lines array<string>, kinds array<tinyint>")
    out = parsed.join(shared, F.col("key") == F.col("k"), "left")
    out = out.withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    out = out.withColumn("gone", F.when(F.size("shared") < F.size("lines"), F.col("shared")).otherwise(F.array().cast("array<int>")))
    kind_of = lambda i: F.get("kinds", i)
    stays = F.filter(F.col("lines"), lambda line, i: (kind_of(i) == OWN) | (kind_of(i) == LOOSE) & ~F.array_contains("gone", i))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(stays, "\n").alias("text"), F.size("shared").cast("long").alias("n_shared"))
