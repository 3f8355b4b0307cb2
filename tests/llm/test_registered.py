"""The ten registered queries on the smallest tables: beside their SQL, or beside plain versions where SQL can't express them."""

import glob
import os
import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import pyarrow.parquet as pq
import pytest

from ledgerline.llm.html_extraction import extract_pages, page_lines
from ledgerline.llm.queries import ORACLE_SQL, QUERIES

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_beside_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = con.sql(ORACLE_SQL[name])
    want = Counter(tuple(zip(sorted(out.columns), (r[out.columns.index(c)] for c in sorted(out.columns)), strict=True)) for r in out.fetchall())
    assert Counter(tuple(sorted(r.items())) for r in rows(spark, name)) == want


def test_licenses(spark):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r["doc_id"]: r for r in rows(spark, "op3_license_scans")}
    for d in table("documents"):
        w, r = brute.ascii_words(d["text"]), got[d["doc_id"]]
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(base) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted({x for x in r["labels"].split(",") if x}))
    assert len(got) == len(table("documents"))


def test_quality(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op4_quality_rules")}
    for d in table("documents"):
        r, s = got[d["doc_id"]], brute.statistics(d["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r["kept"] and r["base_failed"])
    assert len(got) == len(table("documents"))


def test_shards(spark):
    found, docs = rows(spark, "op5_kd_tree_sharding"), {d["doc_id"]: (d["text"] or "").encode() for d in table("documents")}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in found} == {(i, len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + 2 * max(map(len, docs.values()))


def test_tokens(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(tokenizers.path("piece_bpe_32k.model")))
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(spark, "op7_token_counts")}
    assert got == {(d["doc_id"], len((d["text"] or "").encode()), n, n > 4096) for d in table("documents") for n in [len(sp.encode(d["text"] or ""))]}


def test_packing(spark):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(tokenizers.path("word_bpe_49k.json")))
    raw = {d["doc_id"]: np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for d in table("documents")}
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op8_vector_packing"):
        x = raw[r["doc_id"]]
        assert r["doc_tokens"] == len(x) // 4 and r["ids_crc32"] == zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])])
        spans[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, ends in [(p, {len(raw[i]) // 4}) for i, p in spans.items()] + [(p, {4096, *(1 << k for k in range(12))}) for p in sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at in ends
    assert spans.keys() == raw.keys()


def plain_extraction(pages):
    """Text of each page by plain means: nearest neighbour by path, and lines that both have in a longest common order."""
    parts = {}
    for i, url, html in pages:
        host, _, path = (url or "").partition("://")[2].partition("/")
        if host:
            parts[i] = (host.lower(), "/" + path.partition("?")[0].partition("#")[0], f"{i}:")
    order = sorted(parts, key=parts.__getitem__)
    out = {}
    for i, _, html in pages:
        lines, kinds = page_lines(html or "")
        best = None
        for step in (-1, 1):
            j = order.index(i) + step if i in parts else -1
            if 0 <= j < len(order) and parts[order[j]][0] == parts[i][0]:
                a, b = parts[i][1].split("/"), parts[order[j]][1].split("/")
                alike = next((k for k in range(max(len(a), len(b))) if a[k : k + 1] != b[k : k + 1]), 1 << 20)
                best = max(best or (-1, 0, None), (alike, -step, order[j]))
        gone = set()
        if best:
            other = page_lines(next(h for k, _, h in pages if k == best[2]) or "")[0]
            gone = {k for k, x in enumerate(lines) if x in other}  # lines that stand once and in one order: their longest common sequence
        gone = gone if len(gone) < len(lines) else set()
        out[i] = "\n".join(x for k, x in enumerate(lines) if kinds[k] == 1 or kinds[k] == 0 and k not in gone)
    return out


def test_extraction_beside_plain(spark):
    """Unmarked site lines go by differencing alone; without it the text would be another."""
    rng = random.Random(8)
    pages = []
    for i in range(60):
        host = rng.choice(["a.example", "B.example", "c.example"])
        path = "/".join(rng.choice(["x", "y", "news", "z"]) for _ in range(rng.randrange(1, 4)))
        above, below = ([f"<div>{host} line {k}</div>" for k in part if rng.random() < 0.8] for part in (range(3), range(3, 6)))
        own = [f"<p>page {i} text {k}</p>" for k in range(rng.randrange(1, 4))] + ["<div class=ad>buy</div>", f"<nav>{host}</nav>"]
        if i % 4 == 0:
            own.append(f"<article><h1>News</h1><p>main {i}</p></article>")
        pages.append((i, None if i % 13 == 0 else f"http://{host}/{path}" + rng.choice(["", "?q=1", "#top"]), "<body>" + "".join(above + own + below) + "</body>"))
    pages += [(100, "http://twin.example/a", "<p>same</p>"), (101, "http://twin.example/b", "<p>same</p>"), (102, "http://long.example/", "<div>" * 3000 + "deep" + "</div>" * 3000), (103, "http://long.example/x", "<p>t</p>" + " ".join(f"<p>l{k}</p>" for k in range(3000)))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == plain_extraction(pages)
    kept = {i: "\n".join(x for x, k in zip(*page_lines(h), strict=True) if k < 2) for i, _, h in pages}
    assert sum(got[i] != kept[i] for i in got) > 30


def test_extraction(spark):
    found = {r["page_id"]: r for r in rows(spark, "op9_html_extraction")}
    pages = [(p["page_id"], p["url"], p["html"]) for p in table("pages")]
    assert found.keys() == {i for i, *_ in pages}
    for i, url, html in pages:
        text = "\n".join(x for x, k in zip(*page_lines(html or ""), strict=True) if k == 1)
        assert (found[i]["url"], found[i]["text"], found[i]["n_chars"]) == (url, text, len(text))
