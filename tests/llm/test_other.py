import os
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from ledgerline.llm.html_extraction import extract_pages, page_lines, shared_lines
from ledgerline.llm.jaccard_join import one_of_each, similar_components
from ledgerline.llm.packing import Packer, pack_documents
from ledgerline.llm.substring_dedup import FingerprintIndex, remove_repeats, without_repeats
from ledgerline.llm.token_counts import token_counts
from ledgerline.llm.warc_archive import read_archive, record_bytes, write_archive

tokenizers = pytest.importorskip("public_tokenizers")


def test_jaccard_join(docs, rows, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(docs).collect())
    assert got == Counter((i, n, c if n else i) for (i, _), (n, c) in zip(rows, brute.similar_groups(rows), strict=True))
    assert similar_components(none).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns


def test_words_are_hashed_together(monkeypatch):
    """Equal words have equal hashes wherever they stand, others have not, and only very long ones are hashed one by one."""
    import pyarrow as pa

    from ledgerline.llm import _hashing as H

    one_by_one, digest = [], H.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(H.xxhash, "xxh3_64_intdigest", lambda word, seed: one_by_one.append(len(word)) or digest(word, seed))
    unlike = ["a", "a\0", "\0", "\0\0", "é", "ab", "ba", *("x" * n for n in range(2, 130)), *("x" * n + "y" for n in range(1, 130)), *("y" + "x" * n for n in range(2, 130))]
    words = pa.array(["before", *unlike, *reversed(unlike)])[1:]
    for seed in (0, 1):
        h = H.word_hashes(words, seed)
        assert (h == h[::-1]).all() and len(np.unique(h)) == len(unlike)
    assert not (h == H.word_hashes(words)).any()
    assert min(one_by_one) > H.AT_LENGTH
    assert len(H.word_hashes(pa.array([], pa.string()))) == 0


def test_jaccard_sets_of_a_slice():
    """Texts of no, few, many and repeated words, side by side: each set is its own."""
    import pyarrow as pa

    from ledgerline.llm import jaccard_join as J

    texts = [None, "", "a b", "A  b", "a b c d e", "a b c d e", " ", "b c d", "x a b c d e a b c d e a b c d e", "a", "b", "a b c d e f", None]
    tokens, starts = J._sets(pa.record_batch([pa.array(texts)], ["text"]), 0, 5)
    want = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    got = [tokens[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all((np.diff(g.astype(object)) > 0).all() for g in got)
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_jaccard_frequent_tokens(spark, monkeypatch):
    """Long lists, frequent classes and pairs of them, on a hot group whose copies differ from each other more than from their source."""
    import random

    from ledgerline.llm import jaccard_join as J

    rng = random.Random(5)
    rows = []
    for base in range(4):
        words = [f"t{base}x{i}" for i in range(rng.choice([40, 90, 300]))]
        rows.append(" ".join(words))
        for _ in range(45):
            v = list(words)
            for _ in range(rng.randrange(1, 5)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(v))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: g for (i, _), g in zip(rows, brute.similar_groups(rows), strict=True)}
    for limits in ({"FREQUENT": 10, "SHORT": 4}, {"FREQUENT": 10, "SHORT": 4, "OFTEN": 2, "HOT": 12, "COPIES": 2, "HOT_LIST": 8, "TILE": 5, "BLOCK_TOKENS": 500}, {"SHORT": 2, "HOT": 2, "OFTEN": 2, "NAME_BITS": 5}, {"FAR_PAIRS": 0, "FREQUENT": 10, "PER_CLASS": 8}, {"FAR_PAIRS": 0, "FREQUENT": 3, "PER_CLASS": 40, "HOT_LIST": 4}):
        for name, value in limits.items():
            monkeypatch.setattr(J, name, value)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect()} == want


def test_jaccard_rests_of_lists(spark, monkeypatch):
    """Sets put together from the same frequent parts share lists without being similar; what is left of these meets by pairs of keys."""
    import random

    from ledgerline.llm import jaccard_join as J

    rng = random.Random(11)
    parts = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(9)]
    rows = []
    for _ in range(25):
        own = rng.sample(parts, 4)
        for _ in range(5):
            w = " ".join(own).split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    seen, plain = {}, J.written
    monkeypatch.setattr(J, "written", lambda df, name: seen.setdefault(name, plain(df, name)) if name == "heavy-lists" else plain(df, name))
    for name, value in {"FREQUENT": 4, "SHORT": 3, "FAR_PAIRS": 0, "TILE": 20}.items():
        monkeypatch.setattr(J, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect()}
    assert got == {i: g for (i, _), g in zip(rows, brute.similar_groups(rows), strict=True)}
    assert seen["heavy-lists"].count() > 20 and 10 < len({c for _, c in got.values()}) < 60


def test_common_tokens_of_tiles(monkeypatch):
    """Tokens in common, counted by matrix products and pair by pair, a few rows and pairs at a time."""
    from ledgerline.llm import jaccard_join as J

    rng = np.random.default_rng(3)
    frequent = rng.integers(-(2**62), 2**62, 700)
    draw = lambda: np.unique(np.concatenate([rng.choice(frequent, 300), rng.integers(0, 900, rng.integers(1, 60))]))
    xs, ys = [draw() for _ in range(23)], [draw() for _ in range(41)]
    want = [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    for pairs in (1, 100, 10**6):
        monkeypatch.setattr(J, "NEAR_PAIRS", pairs)
        assert np.concatenate([out for _, out in J._in_common(xs, ys)]).tolist() == want


def test_jaccard_near_copies_of_one_text(spark, monkeypatch):
    """Near copies share most of their lists: what is left of these is compared once, in tiles, and no pair becomes a row."""
    import random

    from ledgerline.llm import jaccard_join as J

    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = [" ".join(words)]
    for _ in range(150):
        v = list(words)
        for _ in range(rng.randrange(1, 8)):
            v[rng.randrange(len(v))] = f"n{rng.randrange(12)}"
        rows.append(" ".join(v))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: g for (i, _), g in zip(rows, brute.similar_groups(rows), strict=True)}
    verified, plain, whole = [], J._verified, J.written
    monkeypatch.setattr(J, "_verified", lambda pairs, *a: verified.append(pairs) or plain(pairs, *a))
    seen = {}
    monkeypatch.setattr(J, "written", lambda df, name: seen.setdefault(name, whole(df, name)) if name in ("groups", "near") else whole(df, name))
    for limits in ({"FREQUENT": 20, "SHORT": 4}, {"NEAR_TILE": 20, "NEAR_TOKENS": 2000, "HOT_LIST": 8}):
        seen.clear()
        verified.clear()
        for name, value in limits.items():
            monkeypatch.setattr(J, name, value)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect()} == want
        assert len(verified) == 1  # short lists and centers only
        assert seen["groups"].where("together").count() > 10 and seen["near"].select("group").distinct().count() < seen["groups"].count() / 2
    assert seen["groups"].where("x_tiles > 1 AND y_tiles > x_tiles").count() > 0
    assert 5 < len({c for _, c in want.values()}) < 140


def test_jaccard_hot_copies(spark, docs, rows, monkeypatch):
    """Sets with many copies, hot tokens and names that several sets would share change nothing."""
    from ledgerline.llm import jaccard_join as J

    for name, value in {"OFTEN": 2, "HOT": 3, "COPIES": 2, "NAME_BITS": 4, "BLOCK_TOKENS": 1000}.items():
        monkeypatch.setattr(J, name, value)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(docs).collect())
    assert got == Counter((i, n, c if n else i) for (i, _), (n, c) in zip(rows, brute.similar_groups(rows), strict=True))


def test_one_of_each_keeps_any_columns(spark):
    names = "doc_id long, text string, row string, id string, `__text` string, k string, sig string"
    out = one_of_each(spark.createDataFrame([(2, "a b c d e", "r", "i", "t", "k", "s"), (1, "A b c d e", "r1", "i1", "keep", "k1", "s1")], names))
    assert [tuple(r) for r in out.collect()] == [(1, "A b c d e", "r1", "i1", "keep", "k1", "s1")]


def test_prefix_keys_share():
    from ledgerline.llm.jaccard_join import prefix_keys

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(6, 200))
        base = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        often = np.full(len(base), 1000) if rng.random() < 0.5 else rng.choice([2, 5, 300, 4000], len(base))
        order = np.lexsort((base, often))
        base, often = base[order], often[order]
        lost = int(rng.integers(0, len(base) - -(-85 * len(base) // 100) + 1))
        keep = np.sort(rng.permutation(len(base))[lost:])
        for extra in (0, 1, 2):
            (one, whole), (two, also) = prefix_keys(base, often, len(base), 85, extra=extra), prefix_keys(base[keep], often[keep], len(keep), 85, extra=extra)
            assert np.isin(one, two).sum() >= 1 + extra * (whole and also)
            assert np.isin(prefix_keys(base, often, len(base), 85)[0], one).all()


def test_substring_dedup(docs, rows, none):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.words_sha256 if r.kept_text is None else brute.sha(r.kept_text)) for r in remove_repeats(docs).collect())
    want = Counter((i, n, x, brute.sha(k)) for (i, _), (n, x, k) in zip(rows, brute.without_repeats([t for _, t in rows]), strict=True))
    assert got == want
    assert remove_repeats(none).count() == 0
    left = without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)


def test_incremental_index(spark, docs, rows):
    """Two batches: what the second shares with the first goes from it, as when both are one; compaction changes nothing."""
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = FingerprintIndex(spark, window=35)
    remove_repeats(first, index=index).count()
    assert len(index.runs) == 1
    both = Counter((r.doc_id, r.n_removed) for r in remove_repeats(first.unionByName(second)).collect() if r.doc_id % 2)
    assert Counter((r.doc_id, r.n_removed) for r in remove_repeats(second, index=index, history=first).collect()) == both
    assert len(index.runs) == 2
    before = Counter(map(tuple, index.merged().collect()))
    index.compact()
    assert len(index.runs) == 1 and Counter(map(tuple, index.merged().collect())) == before


def test_index_in_batches(spark, docs, rows, monkeypatch):
    """Runs of several batches are merge-joined without a shuffle, kept to two, and removed; many copies are taken out without a join."""
    from ledgerline.llm import substring_dedup as D

    seen, before = [], {t.name for t in spark.catalog.listTables()}
    shared = FingerprintIndex.shared

    def spied(self):
        plan = self.merged()._jdf.queryExecution().executedPlan().toString()
        seen.append((len(self.runs), sorted(self.batches.values()), "Exchange" in plan, plan.count("SortMergeJoin")))
        return shared(self)

    monkeypatch.setattr(FingerprintIndex, "shared", spied)
    monkeypatch.setattr(D, "COPIES", 2)
    monkeypatch.setattr(D, "BLOCK_WORDS", 500)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.words_sha256 if r.kept_text is None else brute.sha(r.kept_text)) for r in remove_repeats(docs.repartition(6)).collect())
    assert got == Counter((i, n, x, brute.sha(k)) for (i, _), (n, x, k) in zip(rows, brute.without_repeats([t for _, t in rows]), strict=True))
    assert seen == [(2, [2, 2], False, 1)]
    assert {t.name for t in spark.catalog.listTables()} == before
    left = without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)


def test_repeats_with_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    names = "doc_id long, text string, row string, t1 string, t2 string, kept_text string, `__kept` string"
    out = without_repeats(spark.createDataFrame([(1, long, "a", "b", "c", "d", "e"), (2, f"{long} more", "f", "g", "h", "i", "j")], names))
    assert sorted(map(tuple, out.collect())) == [(1, "", "a", "b", "c", "d", "e"), (2, "more", "f", "g", "h", "i", "j")]


def test_index_without_history(spark, docs):
    index = FingerprintIndex(spark, window=35)
    remove_repeats(docs, index=index)
    with pytest.raises(ValueError, match="history"):
        remove_repeats(docs, index=index)
    assert len(index.runs) == 1


def test_token_counts(docs, rows, none):
    import sentencepiece

    path = str(tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = token_counts(docs, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == Counter((i, len((t or "").encode()), n, n > 4096) for i, t in rows for n in [len(sp.encode(t or ""))])
    assert token_counts(none, path).count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = str(tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    want = Counter((i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)
    out = pack_documents(docs, path, 2).collect()
    assert sum(r.length for r in out) == sum(len(x) // 4 * n for (_, x), n in want.items())
    by = {}
    for i, raw in want:
        by.setdefault(i, []).append(raw)
    for r in out:
        assert any(len(x) // 4 == r.doc_tokens and zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in by[r.doc_id])
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    assert pack_documents(none, path, 2).count() == 0


def test_packing_by_spans(spark):
    """Instruction data: loss on answers alone, three limits that bind; ids are those of whole texts."""
    from tokenizers import Tokenizer

    path = str(tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    rows = []
    for i in range(120):
        ask, answer = f"Question number {i}: " + "what is this? " * (i % 7), "It's an ANSWER, part " * (i % 11)
        rows.append((i, ask + answer, [(len(ask), len(ask + answer))] if i % 10 else None if i % 20 else []))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int>>").repartition(2)
    out = pack_documents(df, path, 2, limit=128, max_segments=4, max_loss=40, spans_col="spans").collect()
    sums, bears = defaultdict(lambda: [0, 0, 0]), Counter()
    for r in out:
        for k, v in enumerate((r.length, 1, r.loss_tokens)):
            sums[r.sequence_id][k] += v
        bears[r.doc_id] += r.loss_tokens
    tops = [max(s[k] for s in sums.values()) for k in range(3)]
    assert tops[0] <= 128 and tops[1] == 4 and tops[2] == 40
    for i, text, spans in rows:
        enc = tok.encode(text, add_special_tokens=False)
        want = len(enc.ids) + 1 if spans is None else sum(any(a < e and b > s for s, e in spans) for a, b in enc.offsets) + any(e >= len(text) > s for s, e in spans)
        assert bears[i] == want
        assert {r.doc_tokens for r in out if r.doc_id == i} == {len(enc.ids) + 1}


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    """The shortcuts hold for files that say so alone."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    from ledgerline.llm.packing import WordIds, encodes_by_piece
    from ledgerline.llm.token_counts import counts_by_word, proto_fields

    spec = json.load(open(tokenizers.path("word_bpe_49k.json")))
    assert encodes_by_piece(spec) and not encodes_by_piece(json.load(open(tokenizers.path("byte_bpe_50k.json"))))
    spec["normalizer"]["normalizers"].pop()
    assert not encodes_by_piece(spec)
    path = str(tokenizers.path("byte_bpe_50k.json"))
    tok, texts = Tokenizer.from_file(path), ["Two words", "  It's 1 <|endoftext|>x", ""]
    assert WordIds(path).batch(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=str(tokenizers.path("piece_bpe_32k.model"))).serialized_model_proto()
    assert counts_by_word(model)
    trained, normal = (v for n, v in proto_fields(model) if n in (2, 3))
    assert not counts_by_word(model.replace(normal, normal.replace(b"\x20\x00", b"\x20\x01")))  # trims spaces
    assert not counts_by_word(model.replace(trained, trained.replace(b"\x18\x02", b"\x18\x01", 1)))  # no pair merges


def test_packing_limits():
    """Instruction data: three limits at once, loss on part of the tokens."""
    rng = np.random.default_rng(1)
    rows = []
    packer = Packer(128, 6, 60, 0, rows.append)
    docs = []
    for i in range(400):
        n = int(rng.integers(1, 90))
        loss = rng.random(n) < 0.6
        docs.append(loss)
        packer.add(i, np.arange(n, dtype="<u4").tobytes(), loss=loss)
    packer.finish()
    tokens, segments, loss, covered = Counter(), Counter(), Counter(), defaultdict(list)
    for doc, start, n, _, total, sequence, _, bears, _ in rows:
        tokens[sequence] += n
        segments[sequence] += 1
        loss[sequence] += bears
        covered[doc].append((start, n))
        assert bears == docs[doc][start : start + n].sum() and total == len(docs[doc])
    assert max(tokens.values()) <= 128 and max(segments.values()) <= 6 and max(loss.values()) <= 60
    for i, d in enumerate(docs):
        at = 0
        for start, n in sorted(covered[i]):
            assert start == at
            at += n
        assert at == len(d)


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 120
    rows = [(3, "http://a/1", long), (1, "http://a/2", long), (2, None, long), (4, "u\r\nv", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "ü", "é" * 60), (8, "ü", "é" * 60)]
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    got = read_archive(spark, f"file://{tmp_path}/a")
    assert Counter((r.record_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got.collect()) == Counter([("3", "revisit", "1", long.encode()), ("1", "response", None, long.encode()), ("2", "revisit", "1", long.encode()), ("4", "response", None, b"short"), ("5", "response", None, b"short"), ("6", "response", None, b""), ("7", "response", None, b""), (None, "revisit", "1", long.encode()), ("8", "response", None, ("é" * 60).encode()), ("8", "response", None, ("é" * 60).encode())])
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == 4
    one = record_bytes(got.where("record_id = '1'")).first().record
    head, _, block = bytes(one).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and block == long.encode() + b"\r\n\r\n"
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/b")
    assert read_archive(spark, f"file://{tmp_path}/b").count() == 0


def test_many_to_one(spark):
    """A key with more rows than a part is dealt into several; the result is the plain join's."""
    from ledgerline.llm._common import many_to_one

    rows = [(None if i == 7 else "hot" if i % 3 else f"k{i}", i) for i in range(100)]
    ones = [("hot", "H"), ("k0", "A"), ("k3", "B"), (None, "N"), ("other", "O")]
    left, right = spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame(ones, "o string, x string")
    got = many_to_one(left, "k", right, "o", part=5)
    assert got.columns == ["k", "v", "o", "x"]
    assert sorted(map(tuple, got.collect())) == sorted((k, v, o, x) for k, v in rows for o, x in ones if k is not None and k == o)


def test_warc_detects_damage(spark, tmp_path):
    write_archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    bad = spark.createDataFrame([(r.digest, b"other") for r in spark.read.parquet(f"file://{tmp_path}/a/payloads").collect()], "digest string, payload binary")
    bad.write.mode("overwrite").parquet(f"file://{tmp_path}/a/payloads")
    with pytest.raises(Exception, match="differs"):
        read_archive(spark, f"file://{tmp_path}/a").collect()


def test_shared_lines():
    import random

    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = shared_lines(np.array(a, np.int64), np.array(b, np.int64))
        it = iter(b)
        assert got.sum() == best[-1][-1] and all(any(x == y for y in it) for x, k in zip(a, got, strict=True) if k)


ARTICLE = '<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href="/x">Menu</a></nav><div class="cookie-notice">Cookies?</div><article><h1>A &amp; B</h1><p>one\n two<script>"</p>"</script></p><p><b>three&nbsp;four</p><div class="ad">Buy</div><section id="comments"><p>Nice</p></section><form>Name <input></form></article><aside>Side</aside><footer>&copy;</footer></body></html>'


def test_page_lines():
    lines, kinds = page_lines(ARTICLE)
    assert [t for t, k in zip(lines, kinds, strict=True) if k == 1] == ["A & B", "one two", "three four"]
    assert page_lines("") == ([], []) and page_lines("plain < text")[0] == ["plain < text"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>x</title><body><article><p>Main text.</p></article>", ["Main text."]),
        ("<head class=banner><meta charset=u><style>p{}</style><script>'<p>'</script><p>Body", ["Body"]),
        ("<p>Pick<select><option>a<option selected>b</select><p>Text", ["Pick", "Text"]),
        ("<select><option>a<option>b<p>Text</p>", ["Text"]),
        ("<datalist><option value=a></datalist><option>c<p>Text</option>", ["Text"]),
        *((f"<p>A</p><{x} class=y><p>B</p>", ["A", "B"]) for x in "iframe object svg math canvas video audio select noscript template".split()),
        *((f"<p>A</p><{x}>no<{x}/></{x}><p>B</p>", ["A", "B"]) for x in "object svg video noscript".split()),
        ("<iframe src=a><p>A</p><iframe src=b>no <b>frames</b></iframe><p>B", ["A", "B"]),
        ("<video src=a><p>A</p><video src=b><p>no</p></video><p>B", ["A", "B"]),
        ("<object>no<object>no</object>no</object>B", ["B"]),
        ("<video-list>A</video-list>", ["A"]),
        ("<p>A</p><script>no <p>no", ["A"]),
    ],
)
def test_silent_elements(html, text):
    assert page_lines(html)[0] == text


def test_extraction(spark):
    loose = "<body><div>Site name</div><p>{}</p><div>Legal</div></body>"
    rows = [(1, "http://h/a/1", ARTICLE), (2, "http://h/a/2", ARTICLE.replace("one", "1")), (3, "http://g/x/1", loose.format("first")), (4, "http://g/x/2", loose.format("second")), (5, "http://g/y", loose.format("third")), (6, None, None), (7, "http://only/", "<p>alone</p>"), (3, "http://g/x/1", loose.format("first")), (None, "bad url", "")]
    out = Counter((r.page_id, r.text) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    assert out == Counter([(1, "A & B\none two\nthree four"), (2, "A & B\n1 two\nthree four"), (3, "first"), (3, "first"), (4, "second"), (5, "third"), (6, ""), (7, "alone"), (None, "")])
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lines_outside_the_article(spark):
    """On a page with an article, lines outside it that no neighbour shares stay, shared ones go."""
    page = "<body><div>Site name</div><h1>{0} title</h1><div><p>{0} body</p></div><article>{0} teaser</article><div class=ad>{0} ad</div><div>Legal</div></body>"
    rows = [(i, f"http://h/a/{i}", page.format(f"p{i}")) for i in (1, 2, 3)] + [(4, None, page.format("p4"))]
    out = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"p{i} title\np{i} body\np{i} teaser" for i in (1, 2, 3)} | {4: "Site name\np4 title\np4 body\np4 teaser\nLegal"}


ODD = "doc_id long, text string, `__row` string, `__t` string, `row` string, `key` string, `id` string, `n_words` string, `a.b` string"


@pytest.mark.parametrize("stage", ["quality_rules", "jaccard_join", "substring_dedup", "decontamination"])
def test_stage_edges(spark, stage):
    """Each filtering step on no rows, on nulls alone, and on columns whose names it might use itself."""
    from ledgerline.llm.decontamination import without_contaminated
    from ledgerline.llm.quality_rules import keep_good

    bench = spark.createDataFrame([(1, None), (None, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 0)], "doc_id long, quality int")
    step = {"quality_rules": lambda d: keep_good(d, labels), "jaccard_join": one_of_each, "substring_dedup": without_repeats, "decontamination": lambda d: without_contaminated(d, bench)}[stage]
    odd = [f"x{i}" for i in range(7)]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, *odd), (None, None, *[None] * 7), (2, "", *odd), (2, None, *odd), (3, text + " more", *odd), (1, text, *odd)]
    none = step(spark.createDataFrame([], ODD))
    assert none.count() == 0 and none.columns == [c.strip("`") for c in ODD.replace(" long", "").replace(" string", "").split(", ")]
    assert step(spark.createDataFrame([(None, None, *[None] * 7)] * 3, ODD)).count() == {"quality_rules": 0, "jaccard_join": 1, "substring_dedup": 3, "decontamination": 3}[stage]
    got = sorted((tuple(r) for r in step(spark.createDataFrame(rows, ODD)).collect()), key=str)
    want = {
        "quality_rules": [rows[0], rows[4], rows[5]],
        "jaccard_join": [rows[0], rows[1], rows[2], rows[3]],
        "substring_dedup": [(1, "", *odd), rows[1], rows[2], rows[3], (3, "more", *odd), (1, "", *odd)],
        "decontamination": rows,
    }[stage]
    assert got == sorted(map(tuple, want), key=str)


def test_pipeline(spark, tmp_path, rows, benchmark_items):
    import corpus_pipeline as C

    os.makedirs(tmp_path / "d")
    unique = {i: t for i, t in reversed(rows) if i is not None}
    data = [(i, t, "en", "s", len(t or "")) for i, t in sorted(unique.items())]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/d/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/d/labels.parquet")
    spark.createDataFrame(benchmark_items, "item_id long, text string").write.parquet(f"{tmp_path}/d/benchmark.parquet")
    kept = [(i, t) for i, t, *_ in data if (s := brute.statistics(t))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    kept = [(i, t) for (i, t), (_, c) in zip(kept, brute.similar_groups(kept, size=5, percent=80), strict=True) if c == i]
    kept = [(i, k if x else t) for (i, t), (_, x, k) in zip(kept, brute.without_repeats([t for _, t in kept]), strict=True)]
    kept = [(i, t) for i, t in kept for n, h, _ in [brute.contamination(t, benchmark_items)] if not (h and 20 * h >= n)]
    docs = spark.read.parquet(f"{tmp_path}/d/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, f"{tmp_path}/d")
        assert docs.columns == columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((i, t, len(t)) for i, t in kept)
    out = C.run(spark, f"{tmp_path}/d")
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _ in kept}
