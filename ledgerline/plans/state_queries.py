"""Queries over digests, maps, vectors, segments, screens and ordered state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import hashes as H
from ledgerline.functions import subjects as S
from ledgerline.operators import folds, graphs, merkle, retention, terminal
from ledgerline.operators.cuts import temporary_folder
from ledgerline.plans.domain_queries import sql_bytes, sql_fnv, stepped
from ledgerline.plans.registry import query
from ledgerline.sources import batches
from ledgerline.sources import tables as T

R = "WITH " + T.RECORDS
SL = "WITH " + T.SESSION_LOG

# digests


@query("WITH " + T.HEADERS + f""", e AS (SELECT actor, block, sha256('ledgerline-set'::BLOB || from_hex(id) || from_hex(printf('%02x', block::INT))) AS d, CASE WHEN gone THEN -1 ELSE 1 END AS sign
    FROM (SELECT actor, id, FALSE AS gone FROM headers UNION ALL SELECT actor, id, TRUE FROM headers WHERE sequence % 5 = 0), (SELECT unnest(range({H.SET_LANES // H.SET_BLOCK})) AS block))
    SELECT actor, block::INT AS block, array_to_string([{", ".join(f"((sum(sign * (('0x' || d[{4 * i + 3}:{4 * i + 4}])::BIGINT * 256 + ('0x' || d[{4 * i + 1}:{4 * i + 2}])::BIGINT)) % 65536 + 65536) % 65536)::BIGINT" for i in range(H.SET_BLOCK))}], ',') AS lanes FROM e GROUP BY actor, block""")
def set_hash(spark, sf_dir):
    """A set's hash in 1,024 lanes: all headers come in, every fifth goes out again."""
    h = T.headers(spark, sf_dir)
    e = h.select("actor", "id", F.lit(1).alias("sign")).union(h.where("sequence % 5 = 0").select("actor", "id", F.lit(-1).alias("sign")))
    return H.set_hash(e, "actor", "id", "sign").select("actor", "block", F.array_join("lanes", ",").alias("lanes"))


EFFECT_WORDS = f"""CASE kind WHEN 'Clock' THEN [1::UHUGEINT, v::UHUGEINT] WHEN 'Rand' THEN [2::UHUGEINT, v::UHUGEINT]
    ELSE list_concat(list_concat([3::UHUGEINT, octet_length(encode(path))::UHUGEINT], {sql_bytes('path')}), list_concat([octet_length(encode(body))::UHUGEINT], {sql_bytes('body')})) END"""
EFFECTS = """effects AS (SELECT producer_id AS session, "offset" AS pos, CASE kind WHEN 'click' THEN 'Clock' WHEN 'signup' THEN 'Rand' ELSE 'File' END AS kind, v, subject AS path, body FROM records WHERE kind IN ('click', 'signup', 'error'))"""


def _effects(spark, sf_dir):
    """session, pos, words: what each effect folds into a digest: a tag of its kind, then all its content."""
    r = T.records(spark, sf_dir).where("kind IN ('click', 'signup', 'error')")
    number = lambda tag: F.array(F.lit(tag).cast("long"), F.col("v"))
    longs = lambda c: H.length_first(F.encode(c, "UTF-8")).cast("array<bigint>")
    file = F.concat(F.array(F.lit(3).cast("long")), longs(F.col("subject")), longs(F.col("body")))
    return r.select(F.col("producer_id").alias("session"), F.col("offset").alias("pos"), F.when(F.col("kind") == "click", number(1)).when(F.col("kind") == "signup", number(2)).otherwise(file).alias("words"))


@query(R + ", " + EFFECTS + f""", w AS (SELECT session, flatten(list({EFFECT_WORDS} ORDER BY pos)) AS words FROM effects GROUP BY session) SELECT session, format('{{:016x}}', {sql_fnv('words')}::UBIGINT) AS digest FROM w""")
def effect_digest(spark, sf_dir):
    """Each session's effects in order, by kind and content, as one number."""
    e = _effects(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("e"))
    return e.select("session", H.hex_of(H.fnv_words(F.flatten(F.transform("e", lambda x: x["words"])))).alias("digest"))


@query(R + ", " + EFFECTS + f""", w AS (SELECT session, flatten(list({EFFECT_WORDS} ORDER BY pos)) AS words FROM effects GROUP BY session), d AS (SELECT session, {sql_fnv('words')} AS digest FROM w),
    n AS (SELECT session, list_concat(list_concat([octet_length(encode('s-' || session))::UHUGEINT], {sql_bytes("'s-' || session")}), [digest]) AS words FROM d), a AS (SELECT list_prepend(count(*)::UHUGEINT, flatten(list(words ORDER BY 's-' || session))) AS words FROM n)
    SELECT format('{{:016x}}', {sql_fnv('words')}::UBIGINT) AS digest FROM a""")
def fleet_digest(spark, sf_dir):
    """All sessions' digests in the order of their names: one row a session is gathered, of two numbers and a name."""
    e = _effects(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("e"))
    name = F.concat(F.lit("s-"), F.col("session").cast("string"))
    d = e.select(name.alias("name"), H.fnv_words(F.flatten(F.transform("e", lambda x: x["words"]))).alias("d"))
    d = d.select("name", F.concat(H.length_first(F.encode("name", "UTF-8")).cast("array<bigint>"), F.array("d")).alias("words"))
    all_ = d.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("name", "words"))).alias("e"))
    return all_.select(H.hex_of(H.fnv_words(F.concat(F.array("n"), F.flatten(F.transform("e", lambda x: x["words"]))))).alias("digest"))


# maps and vectors

MAP_KEYS = """k AS (SELECT sha256(subject || ':' || "offset") AS key, encode(body) AS value FROM records)"""


def _map_sql(levels: int = 7) -> str:
    depth = "CASE " + " ".join(f"WHEN count(*) OVER (PARTITION BY substr(key, 1, {d})) <= {merkle.LEAF_ROWS} THEN {d}" for d in range(levels)) + f" ELSE {levels} END"
    empty = f"sha256(from_hex('{merkle.MARK}{merkle.LEAF}0000'))"
    out = MAP_KEYS + f""", r AS (SELECT key, sha256(from_hex(key || printf('%04x', octet_length(value)::INT) || lower(hex(value)))) AS hash FROM k), d AS (SELECT *, {depth} AS depth FROM r),
        leaves AS (SELECT substr(key, 1, depth) AS prefix, depth, count(*) AS n, sha256(from_hex('{merkle.MARK}{merkle.LEAF}' || printf('%04x', count(*)::INT) || string_agg(hash, '' ORDER BY key))) AS hash FROM d GROUP BY 1, 2),
        digits AS (SELECT unnest(string_split('0 1 2 3 4 5 6 7 8 9 a b c d e f', ' ')) AS digit), l{levels} AS (SELECT prefix, n, hash FROM leaves WHERE depth = {levels})"""
    for d in range(levels - 1, -1, -1):
        out += f""", l{d} AS (SELECT p AS prefix, coalesce(sum(n), 0)::BIGINT AS n, sha256(from_hex('{merkle.MARK}{merkle.INNER}' || string_agg(coalesce(hash, {empty}) || printf('%016x', coalesce(n, 0)), '' ORDER BY digit))) AS hash
            FROM (SELECT DISTINCT substr(prefix, 1, {d}) AS p FROM l{d + 1}) CROSS JOIN digits LEFT JOIN l{d + 1} c ON c.prefix = p || digit GROUP BY p UNION ALL SELECT prefix, n, hash FROM leaves WHERE depth = {d})"""
    return out


def _map(spark, sf_dir):
    r = T.records(spark, sf_dir)
    return r.select(F.sha2(F.encode(F.concat("subject", F.lit(":"), F.col("offset").cast("string")), "UTF-8"), 256).alias("key"), F.encode("body", "UTF-8").alias("value"))


@query(R + ", " + _map_sql() + " SELECT prefix, n, hash FROM l0 UNION ALL SELECT prefix, n, hash FROM l1")
def merkle_map_root(spark, sf_dir):
    """The root of a map and its children."""
    return merkle.pages(_map(spark, sf_dir)).where("depth <= 1").select("prefix", "n", "hash")


@query(R + ", " + _map_sql() + """, asked AS (SELECT sha256(subject || ':' || "offset") AS key FROM records WHERE kind = 'signup'), p AS (SELECT *, 0 AS depth FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2)
    SELECT key, depth::INT AS depth, n, hash FROM asked JOIN p ON p.prefix = substr(key, 1, depth) AND length(p.prefix) = depth""")
def merkle_map_proof(spark, sf_dir):
    """The pages on the way to each of some keys, down to the second level."""
    r = T.records(spark, sf_dir).where("kind = 'signup'")
    keys = r.select(F.sha2(F.encode(F.concat("subject", F.lit(":"), F.col("offset").cast("string")), "UTF-8"), 256).alias("key"))
    return merkle.proof(_map(spark, sf_dir), keys).where("depth <= 2").select("key", "depth", "n", "hash")


VECTORS = """va AS (SELECT producer_id % 7 AS vector, producer_id AS actor, max(producer_seq) AS sequence FROM records WHERE kind <> 'error' GROUP BY ALL), vb AS (SELECT producer_id % 7 AS vector, producer_id AS actor, max(producer_seq) AS sequence FROM records WHERE kind <> 'view' AND producer_id % 7 <> 3 GROUP BY ALL)"""


def _vectors(spark, sf_dir):
    r = T.records(spark, sf_dir).withColumn("vector", F.col("producer_id") % 7)
    known = lambda rows: rows.groupBy("vector", F.col("producer_id").alias("actor")).agg(F.max("producer_seq").alias("sequence"))
    return known(r.where("kind <> 'error'")), known(r.where("kind <> 'view' AND vector <> 3"))


@query(R + ", " + VECTORS + " SELECT vector, actor, max(sequence) AS sequence FROM (SELECT * FROM va UNION ALL SELECT * FROM vb) GROUP BY ALL")
def vector_join(spark, sf_dir):
    return graphs.join_vectors(*_vectors(spark, sf_dir))


@query(R + ", " + VECTORS + """, b AS (SELECT vector, coalesce(va.sequence, 0) AS x, coalesce(vb.sequence, 0) AS y FROM va FULL JOIN vb USING (vector, actor))
    SELECT vector, CASE WHEN bool_or(x > y) AND bool_or(x < y) THEN 'Concurrent' WHEN bool_or(x > y) THEN 'After' WHEN bool_or(x < y) THEN 'Before' ELSE 'Equal' END AS verdict FROM b GROUP BY vector""")
def vector_compare(spark, sf_dir):
    return graphs.compare_vectors(*_vectors(spark, sf_dir))


REACH = """c AS (SELECT user_id % 20 AS actor, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS sequence, event_id, event_type FROM events),
    x AS (SELECT e.actor, e.sequence, p.actor AS pa, max(p.sequence) AS ps FROM c e JOIN c p ON p.actor = (e.actor + 7) % 20 AND p.event_id < e.event_id AND p.event_id >= e.event_id - 60 WHERE e.event_type = 'signup' AND e.event_id % 3 = 0 GROUP BY ALL)"""


@query("WITH RECURSIVE " + REACH + """, heads AS (SELECT actor AS record, max(sequence) AS sequence FROM c GROUP BY actor),
    past AS (SELECT record, record AS actor, sequence FROM heads UNION SELECT past.record, x.pa, x.ps FROM past JOIN x ON x.actor = past.actor AND x.sequence <= past.sequence)
    SELECT record, actor, max(sequence) AS sequence FROM past GROUP BY ALL""")
def reaches(spark, sf_dir):
    """How far each actor's newest record reaches on the others' chains."""
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("actor"), "event_id", "event_type")
    c = e.withColumn("sequence", F.row_number().over(Window.partitionBy("actor").orderBy("event_id")).cast("long"))
    asking = c.where("event_type = 'signup' AND event_id % 3 = 0").select("actor", "sequence", "event_id", ((F.col("actor") + 7) % 20).alias("parent_actor"))
    # the newest record of the other chain before, if it is among the last 60 events: a running maximum, not a range join
    told = c.select(F.col("actor").alias("parent_actor"), "event_id", F.struct("event_id", "sequence").alias("at"))
    both = told.select("parent_actor", "event_id", "at", F.lit(None).cast("long").alias("actor"), F.lit(None).cast("long").alias("sequence")).union(asking.select("parent_actor", "event_id", F.lit(None).cast("struct<event_id:bigint,sequence:bigint>"), "actor", "sequence"))
    last = F.max("at").over(Window.partitionBy("parent_actor").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    edges = both.withColumn("last", last).where("actor IS NOT NULL AND last.event_id >= event_id - 60").select("actor", "sequence", "parent_actor", F.col("last.sequence").alias("parent_sequence"))
    heads = c.groupBy("actor").agg(F.max("sequence").alias("sequence")).select(F.col("actor").alias("record"), "actor", "sequence")
    return graphs.pasts(edges, heads)


# the log

HIDDEN = ["/a/bind", "/a/commit", "/a/retire", "/a/will"]


@query(R + f""", h AS (SELECT "offset", CASE "offset" % 6 WHEN 0 THEN '/a/commit' WHEN 1 THEN '/a/will' WHEN 2 THEN '/a/commits' ELSE subject END AS subject FROM records) SELECT "offset", subject FROM h WHERE subject NOT IN ({", ".join(f"'{s}'" for s in HIDDEN)})""")
def hidden_excluded(spark, sf_dir):
    """The broker's own records are never delivered."""
    o = F.col("offset")
    h = T.records(spark, sf_dir).select("offset", F.when(o % 6 == 0, "/a/commit").when(o % 6 == 1, "/a/will").when(o % 6 == 2, "/a/commits").otherwise(F.col("subject")).alias("subject"))
    return h.where(~F.col("subject").isin(*HIDDEN))


FRESH = """tries AS (SELECT "offset" AS pos, producer_id, CASE WHEN "offset" % 13 = 5 THEN greatest(producer_seq - 1, 1) ELSE producer_seq END AS producer_seq, "offset" // 200 AS connection FROM records),
    held AS (SELECT *, row_number() OVER (PARTITION BY producer_id, producer_seq ORDER BY pos) > 1 AS again FROM tries)"""


@query(R + ", " + FRESH + """ SELECT pos, CASE WHEN count(*) FILTER (WHERE again) OVER (PARTITION BY connection, producer_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'Fenced' WHEN again THEN 'Held' ELSE 'Appended' END AS answer FROM held""")
def fresh_publish(spark, sf_dir):
    """Appended only if the key is new; a refusal fences what follows on the producer's connection, until the next one."""
    o = F.col("offset")
    tries = T.records(spark, sf_dir).select(o.alias("pos"), "producer_id", F.when(o % 13 == 5, F.greatest(F.col("producer_seq") - 1, F.lit(1))).otherwise(F.col("producer_seq")).alias("producer_seq"), F.floor(o / 200).alias("connection"))
    again = F.row_number().over(Window.partitionBy("producer_id", "producer_seq").orderBy("pos")) > 1
    before = F.max("again").over(Window.partitionBy("connection", "producer_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return tries.withColumn("again", again).select("pos", F.when(F.coalesce(before, F.lit(False)), "Fenced").when(F.col("again"), "Held").otherwise("Appended").alias("answer"))


@query(R + """ SELECT "offset", subject, "offset" // 100 * 100 AS segment FROM records WHERE "offset" // 100 * 100 + 100 > (SELECT max("offset") // 2 FROM records)""")
def segments_floor(spark, sf_dir):
    """A log in segments; those wholly below the floor are unlinked."""
    r = T.records(spark, sf_dir).select("offset", "subject")
    floor = r.agg(F.max("offset")).first()[0] // 2
    path = temporary_folder(spark, "segments")
    retention.write_segments(r, path, 100)
    retention.unlink_below(spark, path, floor, 100)
    return spark.read.schema("offset long, subject string, segment long").parquet(path)


@query(R + """ SELECT "offset", subject, body FROM records WHERE "offset" >= (SELECT max("offset") // 2 FROM records) OR kind = 'signup'""")
def compact_log(spark, sf_dir):
    """A log rewritten from its middle, with the records that are held."""
    r = T.records(spark, sf_dir)
    path = temporary_folder(spark, "compacted")
    retention.compact(r.select("offset", "subject", "body"), r.where("kind = 'signup'"), r.agg(F.max("offset")).first()[0] // 2, path)
    return spark.read.parquet(path)


@query("WITH " + T.KAFKA + """ SELECT topic, partition, "offset", timestamp, producer_id, producer_seq FROM kafka""")
def record_batches(spark, sf_dir):
    """Records written as batches of 50 with a checksum over each, and read again."""
    k = T.kafka(spark, sf_dir).select("topic", "partition", "offset", "timestamp", "producer_id", "producer_seq")
    return batches.decoded(batches.encoded(k, 50, "gzip"))


@query("WITH " + T.KAFKA + """, n AS (SELECT topic, partition, max("offset") + 1 AS head FROM kafka WHERE "offset" % 2 = 0 GROUP BY ALL) SELECT k.topic, k.partition, head + row_number() OVER (PARTITION BY k.topic, k.partition ORDER BY k."offset") - 1 AS "offset", k."offset" AS was FROM kafka k JOIN n ON n.topic = k.topic AND n.partition = k.partition WHERE k."offset" % 2 = 1""")
def kafka_append(spark, sf_dir):
    """A batch appended to each partition gets the offsets after its head."""
    k = T.kafka(spark, sf_dir)
    head = k.where("offset % 2 = 0").groupBy("topic", "partition").agg((F.max("offset") + 1).alias("head"))
    n = F.row_number().over(Window.partitionBy("topic", "partition").orderBy("was"))
    new = k.where("offset % 2 = 1").select("topic", "partition", F.col("offset").alias("was")).withColumn("n", n)
    return new.join(head, ["topic", "partition"]).select("topic", "partition", (F.col("head") + F.col("n") - 1).cast("long").alias("offset"), "was")


@query("SELECT doc_id, codec, octet_length(encode(text)) <= 4000 AS whole, CASE WHEN octet_length(encode(text)) <= 4000 THEN sha256(text) END AS sha FROM documents, (SELECT unnest(['gzip', 'lz4', 'snappy', 'zstd']) AS codec)")
def compressed_bodies(spark, sf_dir):
    """Texts compressed and read again under a cap of 4,000 bytes; what would be longer is refused."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"), F.explode(F.array(*(F.lit(c) for c in ("gzip", "lz4", "snappy", "zstd")))).alias("codec"))
    packed = d.select("doc_id", "codec", batches.compress("body", "codec").alias("packed"))
    back = packed.select("doc_id", "codec", batches.decompress("packed", "codec", F.lit(4000)).alias("body"))
    return back.select("doc_id", "codec", F.col("body").isNotNull().alias("whole"), F.sha2("body", 256).alias("sha"))


SPLICE = """t AS (SELECT *, CASE WHEN kind = 'ToolResult' THEN row_number() OVER (PARTITION BY session, kind ORDER BY "offset") - 1 END AS nth FROM turns),
    e AS (SELECT session, "offset", 1 AS rank, 0 AS part, kind FROM t UNION ALL SELECT session, "offset", 0, unnest(range(session % 4)), 'Effect' FROM t WHERE nth = session % 3 AND session % 2 = 0)"""


@query("WITH " + T.TURNS + ", " + SPLICE + """ SELECT session, row_number() OVER (PARTITION BY session ORDER BY "offset", rank, part) - 1 AS pos, kind FROM e""")
def tape_splice(spark, sf_dir):
    """A tool's recorded effects put before the result that they led to, on one axis."""
    t = T.turns(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("session", "kind").orderBy("offset")) - 1
    results = t.withColumn("nth", nth).where("kind = 'ToolResult' AND nth = session % 3 AND session % 2 = 0 AND session % 4 > 0")
    effects = results.select("session", "offset", F.lit(0).alias("rank"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("session") % 4 - 1)).alias("part"), F.lit("Effect").alias("kind"))
    all_ = t.select("session", "offset", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("part"), "kind").union(effects)
    pos = F.row_number().over(Window.partitionBy("session").orderBy("offset", "rank", "part")) - 1
    return all_.select("session", pos.cast("long").alias("pos"), "kind")


FED = """fed AS (SELECT 'b' || (session % 3) AS broker, session AS log, "offset", event_type FROM session_log), fcut AS (SELECT broker, log, max("offset") // 2 AS upto FROM fed GROUP BY ALL),
    fedges AS (SELECT broker AS eb, log AS el, "offset" AS eo, 'b' || ((log + 1) % 3) AS cb, log + 1 AS cl, "offset" - 1 AS co FROM fed WHERE event_type = 'error' AND "offset" > 0)"""


@query(SL + ", " + FED + """ SELECT eb AS broker, el AS log, eo AS "offset", cb AS cause_broker, cl AS cause_log, co AS cause FROM fedges JOIN fcut e ON e.broker = eb AND e.log = el AND eo <= e.upto LEFT JOIN fcut c ON c.broker = cb AND c.log = cl WHERE c.upto IS NULL OR c.upto < co""")
def federated_violations(spark, sf_dir):
    """A cut across brokers: its streams are named by broker and log."""
    from ledgerline.operators import cuts

    s = T.session_log(spark, sf_dir)
    name = lambda n: F.concat(F.lit("b"), (n % 3).cast("string"), F.lit("/"), n.cast("string"))
    cut = s.groupBy("session").agg(F.max("offset").alias("m")).select(name(F.col("session")).alias("stream"), F.floor(F.col("m") / 2).alias("upto"))
    edges = s.where("event_type = 'error' AND offset > 0").select(name(F.col("session") + 1).alias("cause_stream"), (F.col("offset") - 1).alias("cause_off"), name(F.col("session")).alias("effect_stream"), F.col("offset").alias("effect_off"))
    part = lambda c, i: F.split_part(F.col(c), F.lit("/"), F.lit(i))
    bad = cuts.violations(edges.withColumn("stream_of", F.col("effect_stream")), cut)
    return bad.select(part("effect_stream", 1).alias("broker"), part("effect_stream", 2).cast("long").alias("log"), F.col("effect_off").alias("offset"), part("cause_stream", 1).alias("cause_broker"), part("cause_stream", 2).cast("long").alias("cause_log"), F.col("cause_off").alias("cause"))


DAG_RUN = """lv AS (SELECT node, 0 AS level FROM p UNION SELECT deps.node, level + 1 FROM lv JOIN deps ON deps.dep = lv.node), l AS (SELECT node, max(level) AS level FROM lv GROUP BY node)"""


@query("WITH RECURSIVE p AS (SELECT p_partkey AS node FROM part), deps AS (SELECT DISTINCT node, dep FROM (SELECT node, unnest([node // 2, node // 3]) AS dep FROM p WHERE node > 0) WHERE dep <> node AND dep IN (SELECT node FROM p)), " + DAG_RUN + """ SELECT node, row_number() OVER (ORDER BY level, node) - 1 AS step FROM l WHERE node % 4 <> 1""")
def dag_resume(spark, sf_dir):
    """The order in which a journal's missing nodes are run: dependencies first, then by number."""
    from ledgerline.plans.domain_queries import _dag

    nodes, deps = _dag(spark, sf_dir)
    return graphs.in_turn(graphs.levels(nodes, deps).where("node % 4 <> 1"), ["level", "node"], "step").select("node", "step")


# ordered state


@query(stepped(
    "x AS (SELECT 1), " + T.RECORDS + """, rows_ AS (SELECT producer_id AS key, "offset" AS "at", bt_ms AS ms FROM records)""", "key",
    "NULL::BIGINT AS full_, FALSE AS accepted, 0::BIGINT AS wait_ms",
    """CASE WHEN greatest(coalesce(f.full_, r.ms), r.ms) + 86400000 - r.ms - 172800000 > 0 THEN f.full_ ELSE greatest(coalesce(f.full_, r.ms), r.ms) + 86400000 END,
        greatest(coalesce(f.full_, r.ms), r.ms) + 86400000 - r.ms - 172800000 <= 0, greatest(0, greatest(coalesce(f.full_, r.ms), r.ms) + 86400000 - r.ms - 172800000)""",
    'key, "at", accepted, wait_ms',
))
def rate_bucket(spark, sf_dir):
    """At most two records at once from a producer, and one a day."""
    r = T.records(spark, sf_dir)
    return folds.rate_bucket(r.select(F.col("producer_id").alias("key"), F.col("offset").alias("at"), F.col("bt_ms").alias("ms")), 86_400_000, 2)


@query(R + """, w AS (SELECT producer_id, "offset", kind IN ('error', 'signup') AS wakes, "offset" % 7 <> 3 AS emitted FROM records), h AS (SELECT producer_id, min("offset") FILTER (WHERE wakes AND NOT emitted) AS held FROM w GROUP BY producer_id)
    SELECT producer_id, max("offset") FILTER (WHERE held IS NULL OR "offset" < held) AS upto, held FROM w JOIN h USING (producer_id) GROUP BY ALL""")
def pump_commits(spark, sf_dir):
    """How far a pump may commit: up to the first wake that is not out yet."""
    r = T.records(spark, sf_dir)
    waits = F.col("kind").isin("error", "signup") & (F.col("offset") % 7 == 3)
    held = r.groupBy("producer_id").agg(F.min(F.when(waits, F.col("offset"))).alias("held"))
    return r.join(held, "producer_id").groupBy("producer_id", "held").agg(F.max(F.when(F.col("held").isNull() | (F.col("offset") < F.col("held")), F.col("offset"))).alias("upto"))


# screens: each output clears the screen first, so the last one is what is shown


def _painted(spark, sf_dir):
    s = T.session_log(spark, sf_dir).where("kind <> 'Resize'")
    return s.select(F.col("session").alias("key"), F.col("offset").alias("at"), "kind", F.concat(F.lit("\x1b[2J\x1b[H"), F.col("text"), F.when(F.col("event_type") == "error", " $").otherwise("")).alias("text"), F.lit(60).alias("cols"), F.lit(5).alias("rows"))


PAINTED = """painted AS (SELECT session AS key, "offset" AS pos, kind, text || CASE WHEN event_type = 'error' THEN ' $' ELSE '' END AS text FROM session_log WHERE kind <> 'Resize'),
    shown AS (SELECT key, pos, coalesce(max_by(CASE WHEN kind = 'Out' THEN text END, CASE WHEN kind = 'Out' THEN pos END) OVER (PARTITION BY key ORDER BY pos), '') AS text FROM painted)"""


@query(SL + ", " + PAINTED + " SELECT key, pos, text, lag(text) OVER (PARTITION BY key ORDER BY pos) IS DISTINCT FROM text AS changed FROM shown")
def frame_changes(spark, sf_dir):
    """The last line of each frame of a session, and whether the frame differs from the one before."""
    shown = terminal.frames(_painted(spark, sf_dir), 60, 5)
    before = F.lag("hash").over(Window.partitionBy("key").orderBy("at"))
    return shown.withColumn("before", before).select("key", F.col("at").alias("pos"), F.col("last_line").alias("text"), (~F.col("before").eqNullSafe(F.col("hash"))).alias("changed"))


@query(SL + ", " + PAINTED + """, c AS (SELECT *, lag(text) OVER (PARTITION BY key ORDER BY pos) IS DISTINCT FROM text AS changed FROM shown) SELECT key, max(pos) AS quiesced, right(max_by(text, pos), 1) IN ('$', '%', '#') AS prompt FROM c WHERE changed GROUP BY key""")
def screen_settled(spark, sf_dir):
    """Where each session's screen came to rest, and whether it shows a shell's prompt."""
    return terminal.settled(_painted(spark, sf_dir), "shell", 60, 5)


HALF = """half AS (SELECT key, max(pos) // 2 AS upto FROM painted GROUP BY key)"""


@query(SL + ", " + PAINTED + ", " + HALF + """ SELECT key, max(pos) AS folded_through, max_by(text, pos) AS screen FROM shown JOIN half USING (key) WHERE pos <= upto GROUP BY key""")
def materialize_cut(spark, sf_dir):
    """Each session's screen at a cut, with the offset that it was folded through."""
    p = _painted(spark, sf_dir)
    cut = p.groupBy("key").agg(F.max("at").alias("m")).select("key", F.floor(F.col("m") / 2).alias("upto"))
    return terminal.materialize(p, cut, 60, 5).select("key", "folded_through", "screen")


@query(SL + ", " + PAINTED + " SELECT key, max_by(text, pos) AS screen FROM shown GROUP BY key")
def resume_screens(spark, sf_dir):
    """Screens folded from snapshots at a cut on; equal to the fold of all."""
    p = _painted(spark, sf_dir)
    cut = p.groupBy("key").agg(F.max("at").alias("m")).select("key", F.floor(F.col("m") / 2).alias("upto"))
    return terminal.resume(terminal.materialize(p, cut, 60, 5), p, 60, 5).select("key", "screen")


@query(SL + ", " + PAINTED + " SELECT key, max(pos) AS folded_through, max_by(text, pos) AS screen FROM shown WHERE pos <= 20 GROUP BY key")
def frame_at(spark, sf_dir):
    """Each session's screen after the record at offset 20."""
    p = _painted(spark, sf_dir)
    return terminal.materialize(p.where("at <= 20"), None, 60, 5).select("key", "folded_through", "screen")


# echoes: each session's next output begins with what its last input shows

ECHO = """io AS (SELECT session AS key, "offset" AS pos, kind, CASE kind WHEN 'In' THEN 'k' || ("offset" % 10) ELSE '' END AS typed, "offset" % 4 <> 1 AS echoes FROM session_log WHERE kind <> 'Resize'),
    q AS (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY pos) AS before, lag(pos) OVER (PARTITION BY key ORDER BY pos) AS input FROM io)"""


def _typed(spark, sf_dir, always: bool = False):
    s = T.session_log(spark, sf_dir).where("kind <> 'Resize'").select(F.col("session").alias("key"), F.col("offset").alias("at"), "kind")
    w = Window.partitionBy("key").orderBy("at")
    # an input is echoed by the output that follows it; an input after an input is dropped here
    s = s.withColumn("after", F.lead("kind").over(w)).withColumn("before", F.lag("kind").over(w)).withColumn("input", F.lag("at").over(w)).where("NOT (kind = 'In' AND after <=> 'In')")
    echo = F.when((F.col("before") == "In") & (F.lit(always) | (F.col("at") % 4 != 1)), F.concat(F.lit("k"), (F.col("input") % 10).cast("string"), F.lit(" done"))).otherwise("other")
    return s.select("key", "at", "kind", F.when(F.col("kind") == "In", F.concat(F.lit("k"), (F.col("at") % 10).cast("string"))).otherwise(echo).alias("text"))


@query(SL + ", " + ECHO + """ SELECT key, input, pos AS "at", CASE WHEN echoes THEN 'Right' ELSE 'Wrong' END AS verdict FROM q WHERE kind = 'Out' AND before = 'In'""")
def predicted_echoes(spark, sf_dir):
    """Verdicts on echoes that were shown before the output came."""
    return folds.predict(_typed(spark, sf_dir))


@query(SL + ", " + ECHO + """ SELECT key, pos AS "at", input, 0::INT AS "begin", 2::INT AS "end", input AS newest FROM q WHERE kind = 'Out' AND before = 'In'""")
def echo_attribution(spark, sf_dir):
    """Parts of outputs that echo inputs, by the input; each input is echoed by the next output, which goes on otherwise."""
    return folds.attribute_echoes(_typed(spark, sf_dir, always=True))


@query(R + f""" SELECT "offset", ({sql_fnv("list_concat(list_concat(list_concat(list_transform(range(8), lambda i: (octet_length(encode(kind))::UHUGEINT // (1::UHUGEINT << (8 * i)::UHUGEINT)) % 256), " + sql_bytes("kind") + "), list_concat(list_transform(range(8), lambda i: (octet_length(encode(subject))::UHUGEINT // (1::UHUGEINT << (8 * i)::UHUGEINT)) % 256), " + sql_bytes("subject") + ")), list_transform(range(8), lambda i: ((bt_ms // 2000)::UHUGEINT // (1::UHUGEINT << (8 * i)::UHUGEINT)) % 256))")} % 16)::INT AS partition FROM records""")
def partition_unkeyed(spark, sf_dir):
    """Partitions of durable records without a key: they stay together for two seconds."""
    return T.records(spark, sf_dir).select("offset", H.unkeyed_partition(F.col("kind"), F.col("subject"), F.col("bt_ms"), 16).alias("partition"))


@query(R + """ SELECT DISTINCT subject, array_to_string(string_split(subject, '/')[2:], ' ') AS segments, len(string_split(subject, '/')) - 1 AS depth, CASE WHEN subject LIKE '/f/alpha/%' THEN 'alpha' ELSE 'beta' END AS owner FROM records""")
def subject_segments(spark, sf_dir):
    """A subject's segments, depth and owner."""
    parts = F.split("subject", "/")
    found = T.records(spark, sf_dir).select("subject").distinct()
    return found.select("subject", F.array_join(F.slice(parts, 2, F.size(parts) - 1), " ").alias("segments"), (F.size(parts) - 1).cast("long").alias("depth"), F.when(S.matches(F.col("subject"), "/f/alpha/>"), "alpha").otherwise("beta").alias("owner"))


# chains and admissions

def _le_sql(value: str) -> str:
    return f"array_to_string(list_transform(range(8), lambda i: printf('%02x', (({value}) // (1::BIGINT << (8 * i)::INT) % 256)::INT)), '')"


CHAIN_ROWS = """rows_ AS (SELECT session AS key, "offset" AS "at", ts_logical AS ts, CASE kind WHEN 'In' THEN 1 WHEN 'Out' THEN 2 ELSE 3 END AS tag, text FROM session_log)"""


@query(stepped(
    "x AS (SELECT 1), " + T.SESSION_LOG + ", " + CHAIN_ROWS, "key", "'' AS hash",
    f"sha256('ledgerline-node'::BLOB || from_hex({_le_sql('r.at_')} || {_le_sql('r.ts')} || CASE WHEN f.hash = '' THEN '00' ELSE '01' || f.hash END || printf('%02x', r.tag) || {_le_sql('octet_length(encode(r.text))')}) || encode(r.text))".replace("r.at_", 'r."at"'),
    'key, "at", hash',
))
def commit_chain(spark, sf_dir):
    """Each record's commit: a digest over its place, logical time, parent and content, every part after its length or tag."""
    s = T.session_log(spark, sf_dir)
    tag = F.when(F.col("kind") == "In", 1).when(F.col("kind") == "Out", 2).otherwise(3)
    return folds.commit_chain(s.select(F.col("session").alias("key"), F.col("offset").alias("at"), F.col("ts_logical").alias("ts"), tag.alias("tag"), "text"))


@query(SL + """, n AS (SELECT session AS key, count(*) AS n FROM session_log GROUP BY session) SELECT key, CASE WHEN key % 4 = 1 AND n > 3 THEN 3 WHEN key % 4 = 2 AND n > 2 THEN 2 WHEN key % 4 = 3 AND n > 5 THEN 4 END::BIGINT AS "at",
    CASE WHEN key % 4 = 1 AND n > 3 THEN 'HashMismatch' WHEN key % 4 = 2 AND n > 2 THEN 'BrokenParentLink' WHEN key % 4 = 3 AND n > 5 THEN 'NonDenseOffset' ELSE 'Verified' END AS verdict FROM n""")
def chain_verify(spark, sf_dir):
    """Chains of which some have a changed text, another parent or a missing record: the first fault of each."""
    s = T.session_log(spark, sf_dir)
    tag = F.when(F.col("kind") == "In", 1).when(F.col("kind") == "Out", 2).otherwise(3)
    rows = s.select(F.col("session").alias("key"), F.col("offset").alias("at"), F.col("ts_logical").alias("ts"), tag.alias("tag"), "text")
    made = folds.commit_chain(rows).withColumnRenamed("key", "k").withColumnRenamed("at", "a")
    parent = F.lag("hash").over(Window.partitionBy("key").orderBy("at"))
    whole = rows.join(made, (F.col("key") == F.col("k")) & (F.col("at") == F.col("a"))).drop("k", "a").withColumn("parent", parent)
    bad = whole.withColumn("text", F.when((F.col("key") % 4 == 1) & (F.col("at") == 3), "other").otherwise(F.col("text")))
    bad = bad.withColumn("parent", F.when((F.col("key") % 4 == 2) & (F.col("at") == 2), F.sha2(F.lit("x"), 256)).otherwise(F.col("parent"))).where("NOT (key % 4 = 3 AND at = 4)")
    # a record missing at the end leaves a dense chain
    found = folds.verify_chain(bad)
    return found.select("key", "at", "verdict")


@query(R + """, o AS (SELECT "offset" AS pos, producer_id % 11 AS idx, 'h' || ("offset" // 3) || '-' || (producer_id % 11) AS id, v % 2 AS content, CASE WHEN "offset" % 50 = 7 THEN 0 ELSE producer_seq END AS sequence FROM records),
    f AS (SELECT *, row_number() OVER (PARTITION BY idx, id ORDER BY pos) = 1 AS new, first_value(content) OVER (PARTITION BY idx, id ORDER BY pos) AS held FROM o WHERE sequence > 0),
    b AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY idx ORDER BY pos) AS taken FROM f)
    SELECT pos, CASE WHEN sequence = 0 THEN 'Shape' END AS answer FROM o WHERE sequence = 0
    UNION ALL SELECT pos, CASE WHEN new AND taken * 100 > 6000 THEN 'Budget' WHEN new THEN 'Admitted' WHEN taken_first * 100 > 6000 THEN 'Budget' WHEN content <> held THEN 'DigestCollision' ELSE 'Duplicate' END FROM (SELECT *, first_value(taken) OVER (PARTITION BY idx, id ORDER BY pos) AS taken_first FROM b)""")
def sync_admit(spark, sf_dir):
    """What an index of 6,000 bytes answers to each offered header of 100: malformed, new, held already, another under a held id, or no room."""
    r = T.records(spark, sf_dir)
    o = F.col("offset")
    offers = r.select(o.alias("pos"), (F.col("producer_id") % 11).alias("idx"), F.concat(F.lit("h"), F.floor(o / 3).cast("string"), F.lit("-"), (F.col("producer_id") % 11).cast("string")).alias("id"), (F.col("v") % 2).alias("content"), F.when(o % 50 == 7, 0).otherwise(F.col("producer_seq")).alias("sequence"), F.lit(100).alias("bytes"))
    return graphs.admissions(offers, 6000).select("pos", "answer")
