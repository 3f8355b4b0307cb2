import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import hashes
from ledgerline.functions import subjects as S
from ledgerline.functions.summaries import bucket_high, bucket_index, bucket_low, window_start
from ledgerline.operators import cuts, folds, graphs, log, retention, summary
from ledgerline.operators.terminal import Screen, fold_screens
from ledgerline.sources import frames


def matches(filter_, subject):
    return re.match(S.filter_regex(filter_), subject) is not None


def test_filters():
    assert matches("/f/*/c", "/f/b/c") and not matches("/f/*/c", "/f/b/d/c") and matches("/f/>", "/f/a/b") and not matches("/f/>", "/f")
    assert [S.validate_filter(f) for f in ("", "a", "/a//b", "/>/a", "/fo*", "/a\x01", "/a/*/>")] == ["Empty", "MissingLeadingSlash", "EmptySegment", "MultiNotLast", "PartialWildcard", "ControlByte", None]
    with pytest.raises(ValueError, match="PartialWildcard"):
        S.filter_regex("/fo*")


def test_containment_is_sound():
    rng = random.Random(1)
    make = lambda wild: "/" + "/".join([rng.choice(["a", "b", "ab", *(["*"] if wild else [])]) for _ in range(rng.randrange(1, 4))] + ([">"] if wild and rng.random() < 0.3 else []))
    subjects = [make(False) for _ in range(200)]
    held = 0
    for _ in range(500):
        a, b = make(True), make(True)
        if S.contains(a, b):
            held += 1
            assert all(matches(a, s) for s in subjects if matches(b, s)), (a, b)
    assert held


def test_filter_column_agrees(spark):
    rows = spark.createDataFrame([("/f/a",), ("/f/a/b",), ("/g",), (None,)], "subject string")
    for f in ("/f/*", "/f/>", "/*/a", "/f/a", "/>"):
        got = {r[0]: r[1] for r in rows.select("subject", S.matches(F.col("subject"), f)).collect()}
        assert got == {s: None if s is None else matches(f, s) for s in got}


def test_buckets(spark):
    values = sorted({*range(200), *(2**i + d for i in range(5, 62) for d in (-1, 0, 1))})
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("i", bucket_index(F.col("v")))
    for v, i, low, high in rows.select("v", "i", bucket_low(F.col("i")), bucket_high(F.col("i"))).collect():
        shift = max(0, v.bit_length() - 6)
        assert low <= v <= high and high - low == (1 << shift) - 1 and (v < 32 or high - low <= v / 32)
        assert i == (v if v < 32 else (shift + 1) * 32 + (v >> shift) - 32)


def test_quantile_is_near(spark):
    rng = random.Random(3)
    values = sorted(rng.randrange(10**6) for _ in range(2000))
    h = summary.histogram(spark.createDataFrame([("a", v) for v in values], "k string, value long"), "k")
    for ppm in (1, 10_000, 500_000, 999_000, 1_000_000):
        rank = max(1, -(-ppm * len(values) // 10**6))
        got = summary.quantile(h, ppm, "k").first()["value"]
        assert abs(got - values[rank - 1]) <= values[rank - 1] / 32
    assert summary.quantile(h, 1_000_000, "k").first()["value"] == values[-1]


def test_weeks_start_on_monday(spark):
    row = spark.createDataFrame([(0,), (345_600_000,), (1_704_067_200_000,)], "ms long").select(window_start(F.col("ms"), "week")).collect()
    assert [r[0] for r in row] == [None, 345_600_000, 1_704_067_200_000]


def test_fork_and_pages(spark):
    rows = spark.createDataFrame([(i, f"/s/{i % 3}", str(i)) for i in range(20)], "offset long, subject string, body string")
    assert [r.body for r in log.fork(rows, 4, body=F.lit("x")).orderBy("offset").collect()][3:6] == ["3", "x", "5"]
    assert log.fork(rows, 99, body=F.lit("x")).exceptAll(rows).count() == 0
    page = log.fetch(rows, 0, "/s/1", 2, 10).orderBy("offset").collect()
    assert [(r.offset, r.next) for r in page] == [(1, 5), (4, 5)]
    assert log.scan_from(rows, 18).count() == 2


def test_heal_reaches_a_consistent_cut(spark):
    cut = spark.createDataFrame([("a", 5), ("b", 0)], "stream string, upto long")
    edges = spark.createDataFrame([("b", 3, "a", 5), ("c", 2, "b", 3), ("a", 4, "c", 9)], "cause_stream string, cause_off long, effect_stream string, effect_off long")
    healed = cuts.heal(edges, cut)
    assert {r.stream: r.upto for r in healed.collect()} == {"a": 5, "b": 3, "c": 2}
    assert cuts.violations(edges, healed).count() == 0


def test_graph_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    deps = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 2)], "node long, dep long")
    assert {r.node: r.level for r in graphs.levels(nodes, deps).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    with pytest.raises(ValueError, match="cycle"):
        graphs.levels(nodes, deps.union(spark.createDataFrame([(0, 3)], deps.schema)))


def test_record_age(spark):
    stamps = [(100, 7), (2_000_000, 9)]
    rows = [0, 99, 100, 1_500_000, 1_999_999, 2_000_000, 5_000_000]
    got = retention.record_age(spark.createDataFrame([(o,) for o in rows], "offset long"), spark.createDataFrame(stamps, "head long, ms long"), 99)
    assert {r.offset: r.ms for r in got.collect()} == {o: next((ms for h, ms in stamps if h > o), 99) for o in rows}


def test_rules():
    got = retention.parse_rules("prefix age=7d bytes=2MiB /a/>  # one\nhold read=/c/{2} forget /b/*\ndefault age=5m")
    assert [(r.kind, r.filter, r.age_ms, r.max_bytes, r.read, r.forget) for r in got] == [("prefix", "/a/>", 604_800_000, 2 << 20, None, False), ("hold", "/b/*", None, None, "/c/{2}", True), ("default", "/>", 300_000, None, None, False)]
    for bad in ("keep /a", "prefix age=1d", "prefix /a*"):
        with pytest.raises(ValueError, match=".*"):
            retention.parse_rules(bad)


def test_wake_budget():
    b = folds.WakeBudget(2, 100)
    assert [b.admit(t, k) for t, k in [(0, "task"), (10, "note"), (20, "task"), (30, "task"), (40, "control"), (100, "task"), (119, "task"), (120, "task")]] == [("Wake", None), ("SilentNote", None), ("Wake", None), ("Throttled", 70), ("Wake", None), ("Wake", None), ("Throttled", 1), ("Wake", None)]


def test_leases(spark):
    rows = [(1, 0, 7, 0, 100, False), (1, 1, 8, 50, 100, False), (1, 2, 7, 60, 100, False), (1, 3, 8, 160, 100, False), (1, 4, 8, 170, 0, True), (1, 5, 7, 999, 10, False)]
    got = folds.leases(spark.createDataFrame(rows, "node long, at long, worker long, ms long, ttl long, commit boolean"))
    assert [(r.holder, r.granted) for r in got.orderBy("at").collect()] == [(7, True), (7, False), (7, True), (8, True), (8, False), (8, False)]


def test_osc_marks_split_over_records(spark):
    rows = [(1, 0, "\x1b]133;A\x07$ "), (1, 1, "ls\x1b]13"), (1, 2, "3;C\x07out\x1b]633;D;-2\x1b\\"), (1, 3, "\x1b]133;D\x07"), (1, 4, "\x1b]133;\x1b]133;A\x07")]
    got = folds.osc_marks(spark.createDataFrame(rows, "key long, at long, text string")).orderBy("at").collect()
    assert [(r.at, r.kind, r.exit) for r in got] == [(0, "PromptReady", None), (2, "CommandStart", None), (2, "CommandEnd", -2), (3, "CommandEnd", None), (4, "PromptReady", None)]


def test_hash_chain(spark):
    rows = spark.createDataFrame([(k, i, f"{k}{i}") for k in (1, 2) for i in range(30)], "key long, at long, body string")
    got = {(r.key, r.at): r.hash for r in folds.hash_chain(rows).collect()}
    for k in (1, 2):
        h = ""
        for i in range(30):
            h = hashlib.sha256(f"{h}|{k}{i}".encode()).hexdigest()
            assert got[k, i] == h


def test_hashes():
    assert hashes.fnv1a(b"") == 0xCBF29CE484222325 and hashes.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert hashes.crc32c_of(b"123456789") == 0xE3069283
    assert hashes.partition_of(b"k", 0) == 0


def test_frames(spark, tmp_path):
    whole = b"".join(frames.encode(f"p{i}".encode()) for i in range(5))
    assert frames.scan(whole) == ([f"p{i}".encode() for i in range(5)], "Clean")
    assert frames.scan(whole[:-1])[1] == "Torn" and frames.scan(b"") == ([], "Clean")
    broken = bytearray(whole)
    broken[len(frames.encode(b"p0")) + frames.HEAD.size] ^= 1
    assert frames.scan(bytes(broken)) == ([b"p0"], "Fault")
    (tmp_path / "a.log").write_bytes(whole)
    (tmp_path / "b.log").write_bytes(b"LG")
    rows = frames.read_frames(spark, f"file://{tmp_path}").collect()
    assert sorted((r.offset is None, r.offset, r.ending) for r in rows if r.path.endswith("a.log")) == [(False, i, "Clean") for i in range(5)]
    assert [(r.offset, r.ending) for r in rows if r.path.endswith("b.log")] == [(None, "Torn")]


@pytest.mark.parametrize(
    ("text", "lines"),
    [
        ("hello\r\nworld", ["hello", "world"]),
        ("abc\x1b[2J\x1b[Hx", ["x"]),
        ("abcdef\x1b[3D\x1b[K", ["abc"]),
        ("0123456789ab", ["0123456789", "ab"]),
        ("a\r\nb\r\nc\r\nd\r\ne", ["b", "c", "d", "e"]),
        ("abc\rX\x08Y", ["Ybc"]),
        ("漢字x", ["漢字x"]),
        ("é", ["é"]),
        ("main\x1b[?1049halt\x1b[?1049l", ["main"]),
        ("1\r\n2\r\n3\x1b[1;1H\x1b[M", ["2", "3"]),
        ("1\r\n2\x1b[1;1H\x1b[L0", ["0", "1", "2"]),
        ("a\tb", ["a       b"]),
    ],
)
def test_screen(text, lines):
    for cut in range(len(text) + 1):  # however the output is split over records
        s = Screen(10, 4)
        s.feed(text[:cut])
        s.feed(text[cut:])
        assert [x for x in "\n".join(s.text()).rstrip("\n").split("\n")] == lines, cut


def test_fold_screens(spark):
    rows = [(1, 0, "Out", "ab\r\n", 0, 0), (1, 1, "In", "zzz", 0, 0), (1, 2, "Resize", "", 5, 2), (1, 3, "Out", "cd", 0, 0), (2, 0, "Out", "x", 0, 0)]
    got = fold_screens(spark.createDataFrame(rows, "key long, at long, kind string, text string, cols int, rows int"), 10, 4)
    assert {r.key: (r.screen, r.row, r.col) for r in got.collect()} == {1: ("ab\ncd", 1, 2), 2: ("x", 0, 1)}


def test_codes(spark):
    """Codes of the JVM expressions beside plain versions."""
    from pyspark.sql import functions as F

    values = [0, 1, -1, 63, 64, -64, 300, 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v, f"t{v}é") for v in values], "v long, t string")
    v, t = F.col("v"), F.col("t")

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return (out + bytes([n])).hex()

    def mix(seed, n):
        m = (1 << 64) - 1
        z = (seed + n * hashes.MIX_STEP) & m
        z = ((z ^ z >> 30) * hashes.MIX_FACTORS[0]) & m
        z = ((z ^ z >> 27) * hashes.MIX_FACTORS[1]) & m
        return f"{z ^ z >> 31:016x}"

    zig = hashes.zigzag(v)
    rows = df.select("v", "t", hashes.varint_hex(zig).alias("code"), hashes.from_zigzag(hashes.from_varint_hex(hashes.varint_hex(zig))).alias("back"), hashes.hex_of(hashes.split_mix(v, F.lit(3))).alias("mix"), hashes.fnv1a_hex(t).alias("fnv"), hashes.crc32c(t).alias("crc"), hashes.assign_partition(t, 7).alias("part"), hashes.unkeyed_partition(t, t, F.shiftrightunsigned(v, 2), 5).alias("free")).collect()
    for r in rows:
        raw = r.t.encode()
        assert r.code == varint((r.v << 1 ^ r.v >> 63) & (1 << 64) - 1) and r.back == r.v
        assert r.mix == mix(r.v & (1 << 64) - 1, 3)
        assert (r.fnv, r.crc, r.part) == (f"{hashes.fnv1a(raw):016x}", hashes.crc32c_of(raw), hashes.partition_of(raw, 7))
        assert r.free == hashes.partition_of(hashes.unkeyed_key(r.t, r.t, (r.v & (1 << 64) - 1) >> 2), 5)
    import hmac as plain

    keys = ["k", "x" * 64, "y" * 65, "é" * 100, "\x00"]
    tags = spark.createDataFrame([(k, f"message {k}") for k in keys], "k string, m string").select("k", "m", hashes.hmac_sha256_hex(F.col("k"), F.col("m")).alias("t"), hashes.hkdf_hex(F.col("m"), F.col("k"), F.lit("info")).alias("d"))
    for r in tags.collect():
        assert r.t == plain.new(r.k.encode(), r.m.encode(), "sha256").hexdigest()
        assert r.d == plain.new(bytes.fromhex(r.t), b"info\x01", "sha256").hexdigest()
    known = spark.createDataFrame([("",), ("abc",)], "t string").select(hashes.xxhash32("t"), hashes.xxhash64_hex("t")).collect()
    assert [tuple(r) for r in known] == [(0x02CC5D05, "ef46db3751d8e999"), (0x32D153FF, "44bc2cf5ad770999")]


def test_record_batches():
    from ledgerline.sources import batches as B

    rows = [(1000, 7, None), (990, -1, 2**62), (5000, 0, -(2**63))]
    for codec in B.CODECS:
        made = B.encode_batch(40, rows, codec)
        assert B.decode_batch(made) == [(40 + i, *r) for i, r in enumerate(rows)]
        assert B.decode_batch(B.restamped(made, 7)) == [(7 + i, *r) for i, r in enumerate(rows)]
        for i in range(len(made)):
            with pytest.raises(ValueError, match="batch"):
                B.decode_batch(made[:i] + bytes([made[i] ^ 1]) + made[i + 1 :])
        assert B.unpacked(B.packed(b"x" * 100, codec), codec, 99) is None
    with pytest.raises(ValueError, match="cut short"):
        B.take_varint(b"\x80", 0)


def test_screens_resume(spark):
    """At every cut: the snapshot and the rest give the fold of all; frames tell what changed."""
    from pyspark.sql import functions as F

    from ledgerline.operators import terminal

    texts = ["ab\r\ncd", "\x1b[2;3", "Hxy", "\x1b[?1049h other", "", "\x1b[?1049l", "\x1b[31mred $", "中e\u0301"]
    rows = [(k, i, "Out" if i != 4 else "Resize", t * (k or 1), 8, 3) for k in (0, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key long, at long, kind string, text string, cols int, rows int")
    want = sorted(map(tuple, fold_screens(df, 10, 4).collect()))
    for upto in range(-1, len(texts)):
        cut = spark.createDataFrame([(0, upto)], "key long, upto long")
        snapshots = terminal.materialize(df, cut, 10, 4)
        assert sorted(map(tuple, terminal.resume(snapshots, df, 10, 4).collect())) == want
    for k in (0, 1):
        screen, hashes_ = Screen(10, 4), []
        for _, _, kind, text, c, r in (x for x in rows if x[0] == k):
            screen.feed(text) if kind == "Out" else screen.resize(c, r)
            assert Screen.load(screen.dump()).dump() == screen.dump()
            hashes_.append(screen.hash())
        got = [r.hash for r in terminal.frames(df.where(F.col("key") == k), 10, 4).orderBy("at").collect()]
        assert got == hashes_ and got[1] == got[0]
    assert {r.key: r.prompt for r in terminal.settled(df.where("at < 7"), "shell", 10, 4).collect()} == {0: True, 1: True}
    assert not any(r.prompt for r in terminal.settled(df.where("at < 7"), "none", 10, 4).collect())


def test_echoes():
    from ledgerline.operators.folds import EchoQueue, echo_of

    assert echo_of("a\r\x03\x7f\x1b[A\t") == ["a", "\r\n", "^C", "\x08 \x08", "\t"]
    q = EchoQueue()
    q.put(10, "ab")
    q.put(11, "cd")
    assert q.answer("abcd!") == [(10, 0, 2), (11, 2, 4)] and q.newest == 11
    q.put(12, "x\r")
    assert q.answer("x\r") == [(12, 0, 2)] and q.answer("\nok") == [(12, 0, 1)] and not q.waiting
    q.put(13, "\n")
    assert q.answer("\n$") == [(13, 0, 1)]
    q.put(14, "\x7f")
    assert q.answer("^") == [(14, 0, 1)] and q.answer("?") == [(14, 0, 1)]
    q.put(15, "no")
    assert q.answer("other") == [] and len(q.waiting) == 2


def test_rate_bucket(spark):
    from ledgerline.operators.folds import rate_bucket

    rows = [(1, i, ms) for i, ms in enumerate([0, 0, 0, 0, 999, 1000, 1500, 9000, 9000, 9000, 9000])]
    got = rate_bucket(spark.createDataFrame(rows, "key long, at long, ms long"), 1000, 3).orderBy("at").collect()
    assert [r.accepted for r in got] == [True, True, True, False, False, True, False, True, True, True, False]
    assert [r.wait_ms for r in got] == [0, 0, 0, 1000, 1, 0, 500, 0, 0, 0, 1000]


def test_merkle_map(spark):
    """The shape follows from the rows alone: order doesn't matter, a changed value changes its way to the root."""
    import hashlib
    import random

    from ledgerline.operators import merkle

    rng = random.Random(4)
    sha = lambda b: hashlib.sha256(b).digest()

    def page(rows, depth=0):
        mark = bytes.fromhex(merkle.MARK)
        if len(rows) <= merkle.LEAF_ROWS:
            return sha(mark + b"\x02" + len(rows).to_bytes(2, "big") + b"".join(sha(bytes.fromhex(k) + len(v).to_bytes(2, "big") + v) for k, v in sorted(rows)))
        children = [[r for r in rows if r[0][depth] == d] for d in merkle.DIGITS]
        return sha(mark + b"\x01" + b"".join(page(c, depth + 1) + len(c).to_bytes(8, "big") for c in children))

    for n in (0, 1, 32, 33, 700):
        rows = [(sha(str(i).encode()).hex(), f"v{i}".encode()) for i in range(n)]
        rng.shuffle(rows)
        found = merkle.pages(spark.createDataFrame(rows, "key string, value binary")).where("depth = 0").collect()
        assert [r.hash for r in found] == [page(rows).hex()]
    clustered = [("ab" + sha(str(i).encode()).hex()[2:], b"") for i in range(40)]
    df = spark.createDataFrame(clustered, "key string, value binary")
    assert merkle.pages(df).where("depth = 0").first().hash == page(clustered).hex()
    way = merkle.proof(df, df.limit(1)).collect()
    assert {r.depth for r in way} == {0, 1, 2, 3} and all(r.n == 40 for r in way if r.depth < 3)


def test_levels_and_order(spark):
    import random

    from ledgerline.operators import graphs

    rng = random.Random(3)
    for n, pairs in ((40, 30), (25, 0), (60, 5)):
        edges = [(i, rng.randrange(i)) for i in range(1, n) for _ in range(rng.randrange(3))] + ([(i, i - 1) for i in range(1, n)] if n == 60 else [])
        level = {}
        for i in range(n):
            level[i] = max((level[d] + 1 for k, d in edges if k == i), default=0)
        old, graphs.PAIRS = graphs.PAIRS, pairs
        try:
            got = graphs.levels(spark.range(n).toDF("node"), spark.createDataFrame(edges, "node long, dep long"))
            assert {r.node: r.level for r in got.collect()} == level
        finally:
            graphs.PAIRS = old
    for loop in ([(0, 1), (1, 2), (2, 0)], [(0, 0)], [(0, 1), (1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            graphs.levels(spark.range(4).toDF("node"), spark.createDataFrame(loop, "node long, dep long")).count()
    turns = graphs.in_turn(spark.range(1000).selectExpr("(id * 7919) % 1000 AS x", "id"), ["x"], "turn").collect()
    assert all(r.x == r.turn for r in turns) and len(turns) == 1000
    assert graphs.levels(spark.range(0).toDF("node"), spark.createDataFrame([], "node long, dep long")).count() == 0


def test_pasts(spark):
    from ledgerline.operators import graphs

    edges = spark.createDataFrame([("a", 5, "b", 3), ("b", 2, "c", 9), ("b", 4, "c", 20), ("c", 9, "a", 2), ("a", 9, "c", 1)], "actor string, sequence long, parent_actor string, parent_sequence long")
    got = graphs.pasts(edges, spark.createDataFrame([("x", "a", 6), ("y", "c", 8)], "record string, actor string, sequence long"))
    assert {tuple(r) for r in got.select("record", "actor", "sequence").collect()} == {("x", "a", 6), ("x", "b", 3), ("x", "c", 9), ("y", "c", 8)}


@pytest.mark.parametrize("limit", [1000, 0])
def test_heads_and_pending_by_runs(spark, monkeypatch, limit):
    """Runs with gaps, forks, parents on other chains and missing ones; more runs than are broadcast; chains longer than a round."""
    import random

    from ledgerline.operators import graphs

    rng, rows = random.Random(2), []
    for actor in range(12):
        tips = [None]
        for seq in range(1, 60):
            ids = [f"{actor}:{seq}"] + [f"{actor}:{seq}x"] * (rng.random() < 0.05)
            rows += [(actor, seq, i, rng.choice(tips)) for i in ids]
            tips = ids
    rows += [(20, 9, "far", "3:7"), (20, 10, "far2", "far"), (20, 11, "lost", "nowhere"), (21, 4, "root", None), (21, 5, "root2", None)]
    held = [r for r in rows if rng.random() > 0.01 or r[1] < 4]
    ids, previous = {r[2] for r in held}, {r[2]: r[3] for r in held}
    stuck = set()
    for i in ids:
        at = i
        while at in ids and previous[at] is not None:
            at = previous[at]
        if at not in ids:
            stuck.add(i)
    monkeypatch.setattr(graphs, "RUNS", limit)
    if limit:
        monkeypatch.setattr(graphs, "roots", lambda nodes, edges, plain=graphs.roots: plain(nodes, edges) if nodes.count() < len(ids) / 2 else pytest.fail("all headers are gone through"))
    h = spark.createDataFrame(held, "actor long, sequence long, id string, previous string")
    assert sorted(r.id for r in graphs.pending(h).collect()) == sorted(stuck) and 20 < len(stuck) < len(ids)
    assert sorted(r.id for r in graphs.heads(h).collect()) == sorted(ids - stuck - {previous[i] for i in ids - stuck})
    assert graphs.pending(h.limit(0)).count() == graphs.heads(h.limit(0)).count() == 0
