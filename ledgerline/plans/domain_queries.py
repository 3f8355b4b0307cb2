"""Queries over sync headers, retention, policy, replay, workflow, receipts and wakes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import hashes
from ledgerline.functions import subjects as S
from ledgerline.operators import folds, graphs, log, retention
from ledgerline.plans.registry import query
from ledgerline.sources import tables as T

H = "WITH " + T.HEADERS
R = "WITH " + T.RECORDS

# sync


@query(H + " SELECT actor, max(sequence) AS sequence FROM headers GROUP BY actor")
def actor_frontier(spark, sf_dir):
    return graphs.frontier(T.headers(spark, sf_dir))


@query(H + ", s AS (SELECT DISTINCT actor, sequence FROM headers WHERE sequence % 37 <> 20), n AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY sequence) AS n FROM s) SELECT actor, max(sequence) AS upto FROM n WHERE sequence = n GROUP BY actor")
def actor_prefix(spark, sf_dir):
    return graphs.prefix(T.headers(spark, sf_dir).where("sequence % 37 <> 20"))


@query(H + """, c AS (SELECT actor, sequence, id AS claimed, id AS source FROM headers UNION ALL SELECT actor, sequence - 1, previous, id FROM headers WHERE previous IS NOT NULL),
    p AS (SELECT a.actor, min([a.source, b.source]) AS w FROM c a JOIN c b ON a.actor = b.actor AND a.sequence = b.sequence AND a.claimed <> b.claimed AND a.source < b.source GROUP BY a.actor)
    SELECT actor, w[1] AS first, w[2] AS second FROM p""")
def actor_forks(spark, sf_dir):
    return graphs.forks(T.headers(spark, sf_dir))


@query("WITH RECURSIVE " + T.HEADERS + ", up AS (SELECT id AS node, previous, 0 AS depth FROM headers WHERE actor = 7 AND sequence = 30 UNION ALL SELECT h.id, h.previous, depth + 1 FROM up JOIN headers h ON h.id = up.previous) SELECT node, depth FROM up")
def ancestors(spark, sf_dir):
    h = T.headers(spark, sf_dir)
    edges = h.where("previous IS NOT NULL").select(F.col("id").alias("node"), F.col("previous").alias("parent"))
    return graphs.reach(edges, h.where("actor = 7 AND sequence = 30").select(F.col("id").alias("node")))


PART = ", held AS (SELECT * FROM headers WHERE NOT (actor % 5 = 2 AND sequence = 10))"


def _held(spark, sf_dir):
    return T.headers(spark, sf_dir).where("NOT (actor % 5 = 2 AND sequence = 10)")


STUCK = "WITH RECURSIVE " + T.HEADERS + PART + """, stuck AS (SELECT id FROM held WHERE previous IS NOT NULL AND previous NOT IN (SELECT id FROM held) UNION SELECT h.id FROM held h JOIN stuck s ON h.previous = s.id)"""


@query(STUCK + ", ok AS (SELECT * FROM held WHERE id NOT IN (SELECT id FROM stuck)) SELECT id FROM ok WHERE id NOT IN (SELECT previous FROM ok WHERE previous IS NOT NULL)")
def sync_heads(spark, sf_dir):
    """Discharged headers without a discharged child."""
    return graphs.heads(_held(spark, sf_dir))


@query(STUCK + " SELECT id FROM stuck")
def sync_pending(spark, sf_dir):
    """Headers that wait for a missing ancestor."""
    return graphs.pending(_held(spark, sf_dir))


@query(H + ", torn AS (SELECT actor, min(sequence) AS since FROM (SELECT actor, sequence FROM headers GROUP BY actor, sequence HAVING count(DISTINCT id) > 1) GROUP BY actor) SELECT actor, count(*) AS n FROM headers JOIN torn USING (actor) WHERE sequence >= since GROUP BY actor")
def sync_quarantined(spark, sf_dir):
    """Headers of forked actors from the fork on."""
    h = T.headers(spark, sf_dir)
    torn = h.groupBy("actor", "sequence").agg(F.count_distinct("id").alias("n")).where("n > 1").groupBy("actor").agg(F.min("sequence").alias("since"))
    return h.join(torn, "actor").where("sequence >= since").groupBy("actor").agg(F.count(F.lit(1)).alias("n"))


@query(H + ", u AS (SELECT id FROM headers WHERE sequence % 3 <> 0 UNION SELECT id FROM headers WHERE sequence % 3 <> 1) SELECT count(*) AS n, min(id) AS low, max(id) AS high FROM u")
def inventory_union(spark, sf_dir):
    h = T.headers(spark, sf_dir)
    return h.where("sequence % 3 <> 0").union(h.where("sequence % 3 <> 1")).dropDuplicates(["id"]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query(H + " SELECT substr(id, 1, 1) AS prefix, count(*) AS n, sum(('0x' || substr(id, 1, 8))::BIGINT)::BIGINT AS limb0, sum(('0x' || substr(id, 57, 8))::BIGINT)::BIGINT AS limb7 FROM headers GROUP BY prefix")
def range_fingerprint(spark, sf_dir):
    """Counts and sums of id limbs by prefix; limbs of 32 bits add up without overflow."""
    limb = lambda i: F.sum(F.conv(F.substring("id", 8 * i + 1, 8), 16, 10).cast("long"))
    return T.headers(spark, sf_dir).groupBy(F.substring("id", 1, 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), limb(0).alias("limb0"), limb(7).alias("limb7"))


@query(H + " SELECT id, 'mine' AS side FROM headers WHERE sequence % 50 = 1 AND sequence % 100 <> 1 UNION ALL SELECT id, 'theirs' FROM headers WHERE sequence % 100 = 1")
def rbsr_diff(spark, sf_dir):
    """Ids that only one side has, looked for only in ranges whose fingerprints differ."""
    h = T.headers(spark, sf_dir).withColumn("prefix", F.substring("id", 1, 2))
    mine, theirs = h.where("sequence % 100 <> 1"), h.where("sequence % 50 <> 1 OR sequence % 100 = 1")
    mark = lambda d, n: d.groupBy("prefix").agg(F.count(F.lit(1)).alias(f"{n}n"), F.bit_xor(F.xxhash64("id")).alias(f"{n}x"))
    differ = mark(mine, "a").join(mark(theirs, "b"), "prefix", "full").where("NOT (an <=> bn AND ax <=> bx)").select("prefix")
    a, b = mine.join(differ, "prefix", "left_semi").select("id"), theirs.join(differ, "prefix", "left_semi").select("id")
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("mine")).union(b.join(a, "id", "left_anti").withColumn("side", F.lit("theirs")))


@query(H + ", m AS (SELECT *, max(sequence) OVER (PARTITION BY actor) * 2 // 3 AS upto FROM headers) SELECT actor, max(sequence) AS sequence FROM m WHERE sequence <= upto GROUP BY actor")
def shared_prefixes(spark, sf_dir):
    """How far two inventories agree on each actor, of which one has two thirds of every chain."""
    h = T.headers(spark, sf_dir)
    upto = h.groupBy("actor").agg(F.floor(F.max("sequence") * 2 / 3).alias("upto"))
    theirs = h.join(upto, "actor").where("sequence <= upto").select("actor", "sequence", "id")
    both = h.select("actor", "sequence", "id").intersect(theirs)
    return both.groupBy("actor").agg(F.max("sequence").alias("sequence"))


REPLICA = R + """, replica AS (SELECT "offset", CASE WHEN "offset" >= (SELECT count(*) // 2 FROM events) THEN body || '!' ELSE body END AS body FROM records WHERE "offset" < (SELECT count(*) - 5 FROM events))"""


def _replica(spark, sf_dir):
    r = T.records(spark, sf_dir)
    n = T.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    return r.crossJoin(F.broadcast(n)).where("offset < n - 5").select("offset", F.when(F.col("offset") >= F.floor(F.col("n") / 2), F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"))


@query(REPLICA + """ SELECT min(coalesce(r."offset", p."offset")) FILTER (WHERE r.body IS DISTINCT FROM p.body) AS first_mismatch, count(*) FILTER (WHERE p.body IS NULL) AS behind, count(*) FILTER (WHERE r.body IS NULL) AS ahead FROM records r FULL JOIN replica p USING ("offset")""")
def replica_diff(spark, sf_dir):
    r = T.records(spark, sf_dir).select("offset", "body")
    both = r.join(_replica(spark, sf_dir).withColumnRenamed("body", "theirs"), "offset", "full")
    return both.agg(F.min(F.when(~F.col("body").eqNullSafe(F.col("theirs")), F.col("offset"))).alias("first_mismatch"), F.count_if(F.col("theirs").isNull()).alias("behind"), F.count_if(F.col("body").isNull()).alias("ahead"))


@query(REPLICA + """ SELECT min("offset") - 1 AS common, count(*) AS differing FROM records JOIN replica p USING ("offset") WHERE records.body <> p.body""")
def chain_lca(spark, sf_dir):
    """The last offset before two logs part."""
    both = T.records(spark, sf_dir).select("offset", "body").join(_replica(spark, sf_dir).withColumnRenamed("body", "theirs"), "offset")
    return both.where("body <> theirs").agg((F.min("offset") - 1).alias("common"), F.count(F.lit(1)).alias("differing"))


@query(REPLICA + """, l AS (SELECT (SELECT min(r."offset") FROM records r JOIN replica p USING ("offset") WHERE r.body <> p.body) AS since) SELECT 'left' AS side, "offset" FROM records, l WHERE "offset" >= since UNION ALL SELECT 'right', "offset" FROM replica, l WHERE "offset" >= since""")
def chain_diff(spark, sf_dir):
    r, p = T.records(spark, sf_dir).select("offset", "body"), _replica(spark, sf_dir)
    at = r.join(p.withColumnRenamed("body", "theirs"), "offset").where("body <> theirs").agg(F.min("offset").alias("at"))
    one = lambda d, s: d.crossJoin(F.broadcast(at)).where("offset >= at").select(F.lit(s).alias("side"), "offset")
    return one(r, "left").union(one(p, "right"))


SL = "WITH " + T.SESSION_LOG


@query(SL + """, t AS (SELECT client_id, client_seq, min(ts_logical) AS ts FROM session_log WHERE kind = 'In' GROUP BY ALL) SELECT client_id, client_seq, ts, row_number() OVER (ORDER BY ts, client_id, client_seq) - 1 AS "offset" FROM t""")
def merge_inputs(spark, sf_dir):
    """Two branches' inputs, each once, in their one order."""
    s = T.session_log(spark, sf_dir).where("kind = 'In'")
    both = s.where("session < 4").union(s.where("session >= 2"))
    once = both.groupBy("client_id", "client_seq").agg(F.min("ts_logical").alias("ts"))
    return log.numbered(once, "offset", "ts", "client_id", "client_seq")


# replay

TU = "WITH " + T.TURNS
DECIDED = ", decided AS (SELECT *, CASE WHEN kind = 'Completion' THEN CASE WHEN stop = 'EndTurn' THEN 'Finish' ELSE 'CallTool' END WHEN is_error THEN 'Speak' ELSE 'Finish' END AS action FROM turns), stops AS (SELECT session, min(\"offset\") AS stop_at FROM decided WHERE action = 'Finish' GROUP BY session)"


def _decided(spark, sf_dir):
    t = T.turns(spark, sf_dir)
    done = F.when(F.col("kind") == "Completion", F.when(F.col("stop") == "EndTurn", "Finish").otherwise("CallTool"))
    return t.withColumn("action", done.otherwise(F.when(F.col("is_error"), "Speak").otherwise("Finish")))


def _reached(d):
    stop = F.min(F.when(F.col("action") == "Finish", F.col("offset"))).over(Window.partitionBy("session"))
    return d.withColumn("stop_at", stop).where("stop_at IS NULL OR offset <= stop_at")


@query(TU + DECIDED + """ SELECT session, "offset", action FROM decided LEFT JOIN stops USING (session) WHERE stop_at IS NULL OR "offset" <= stop_at""")
def turn_decisions(spark, sf_dir):
    return _reached(_decided(spark, sf_dir)).select("session", "offset", "action")


@query(TU + DECIDED + """ SELECT session, count(*) AS events, count(*) FILTER (WHERE kind = 'ToolResult') AS inputs, stop_at FROM decided LEFT JOIN stops USING (session) WHERE stop_at IS NULL OR "offset" <= stop_at GROUP BY session, stop_at""")
def replay_session_counts(spark, sf_dir):
    return _reached(_decided(spark, sf_dir)).groupBy("session", "stop_at").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "ToolResult").alias("inputs"))


@query(TU + DECIDED + """ SELECT session, count(*) AS events, max("offset") AS upto FROM decided WHERE "offset" <= session % 5 GROUP BY session""")
def fleet_cut_replay(spark, sf_dir):
    """Each session replayed to its frontier."""
    return _decided(spark, sf_dir).where("offset <= session % 5").groupBy("session").agg(F.count(F.lit(1)).alias("events"), F.max("offset").alias("upto"))


@query("WITH RECURSIVE " + T.EDGES + """, d AS (SELECT effect_stream || ':' || effect_off AS node, cause_stream || ':' || cause_off AS dep FROM edges),
    n AS (SELECT node FROM d UNION SELECT dep FROM d), lv AS (SELECT node, 0 AS level FROM n UNION SELECT d.node, level + 1 FROM lv JOIN d ON d.dep = lv.node) SELECT node, max(level) AS level FROM lv GROUP BY node""")
def fleet_causal_order(spark, sf_dir):
    """Causes before effects: the level at which each event can run."""
    e = T.edges(spark, sf_dir)
    name = lambda s, o: F.concat(F.col(s), F.lit(":"), F.col(o).cast("string"))
    d = e.select(name("effect_stream", "effect_off").alias("node"), name("cause_stream", "cause_off").alias("dep"))
    return graphs.levels(d.select("node").union(d.select("dep")), d)


EX = R + """, ex AS (SELECT kind AS door, v % 20 AS request, "offset" AS reply, "offset" AS pos FROM records)"""


@query(EX + """ SELECT p."offset" AS at, p.kind AS door, p.v % 20 AS request, e.reply FROM records p ASOF LEFT JOIN ex e ON e.door = p.kind AND e.request = p.v % 20 AND p."offset" > e.pos""")
def keyed_asof(spark, sf_dir):
    """The latest earlier exchange with the same door and request."""
    r = T.records(spark, sf_dir).select(F.col("offset").alias("at"), F.col("kind").alias("door"), (F.col("v") % 20).alias("request"))
    table = r.select("door", "request", F.col("at").alias("pos"), F.col("at").alias("reply_at"))
    return log.as_of(r, table, ["door", "request"], "at", "pos", "reply_at").withColumnRenamed("found", "reply")


@query(SL + """, i AS (SELECT session, "offset", client_id = 0 AS human FROM session_log WHERE kind = 'In'), t AS (SELECT session, "offset" FROM session_log WHERE event_type = 'purchase'),
    n AS (SELECT i.session, i."offset", human, (SELECT min(t."offset") FROM t WHERE t.session = i.session AND t."offset" > i."offset") AS turn FROM i)
    SELECT t.session, t."offset" AS turn, coalesce(max(n."offset") FILTER (WHERE human), max(n."offset")) AS input FROM t LEFT JOIN n ON n.session = t.session AND n.turn = t."offset" GROUP BY ALL""")
def turn_attribution(spark, sf_dir):
    """Each turn is by the newest human input since the turn before, else the newest input, else nobody."""
    s = T.session_log(spark, sf_dir)
    turn = F.first(F.when(F.col("event_type") == "purchase", F.col("offset")), ignorenulls=True).over(Window.partitionBy("session").orderBy("offset").rowsBetween(1, Window.unboundedFollowing))
    inputs = s.withColumn("turn", turn).where("kind = 'In' AND turn IS NOT NULL").groupBy("session", "turn").agg(F.max(F.struct((F.col("client_id") == 0).alias("human"), F.col("offset").alias("input"))).alias("i"))
    turns = s.where("event_type = 'purchase'").select("session", F.col("offset").alias("turn"))
    return turns.join(inputs, ["session", "turn"], "left").select("session", "turn", F.col("i.input").alias("input"))


@query(R + """ SELECT producer_id, count(*) FILTER (WHERE v % 7 = 0) AS differs, count(*) FILTER (WHERE v % 7 <> 0) AS same, count(*) FILTER (WHERE tainted) AS tainted FROM (SELECT producer_id, v, coalesce(bool_or(v % 7 = 0) OVER (PARTITION BY producer_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tainted FROM records) GROUP BY producer_id""")
def shadow_ledger(spark, sf_dir):
    """Re-decisions that differ, and rows after the first such one."""
    before = Window.partitionBy("producer_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    r = T.records(spark, sf_dir).withColumn("d", F.col("v") % 7 == 0)
    r = r.withColumn("tainted", F.coalesce(F.bool_or("d").over(before), F.lit(False)))
    return r.groupBy("producer_id").agg(F.count_if("d").alias("differs"), F.count_if(~F.col("d")).alias("same"), F.count_if("tainted").alias("tainted"))


@query(R + """, live AS (SELECT producer_id, producer_seq AS pos, kind FROM records), tape AS (SELECT producer_id, producer_seq AS pos, CASE WHEN producer_seq % 17 = 16 THEN 'other' ELSE kind END AS kind FROM records WHERE producer_seq <> 40)
    SELECT producer_id, min(pos) AS divergence FROM live FULL JOIN tape USING (producer_id, pos) WHERE live.kind IS DISTINCT FROM tape.kind GROUP BY producer_id""")
def tape_divergence(spark, sf_dir):
    r = T.records(spark, sf_dir).select("producer_id", F.col("producer_seq").alias("pos"), "kind")
    tape = r.where("pos <> 40").select("producer_id", "pos", F.when(F.col("pos") % 17 == 16, "other").otherwise(F.col("kind")).alias("taped"))
    return r.join(tape, ["producer_id", "pos"], "full").where("NOT (kind <=> taped)").groupBy("producer_id").agg(F.min("pos").alias("divergence"))


@query("""SELECT conv_id AS session, turn, pos AS "offset", kind, CASE WHEN kind = 'Completion' THEN length(text) END AS n FROM (SELECT conv_id, turn, text, unnest([0, 1, 2]) AS pos, unnest(['Ask', 'Completion', 'Stop']) AS kind FROM conversations WHERE role = 'assistant')""")
def unified_from_capture(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select(F.col("conv_id").alias("session"), "turn", "text", F.posexplode(F.array(*map(F.lit, ("Ask", "Completion", "Stop")))).alias("offset", "kind")).select("session", "turn", "offset", "kind", F.when(F.col("kind") == "Completion", F.length("text")).alias("n"))


# workflow


def stepped(rows: str, key: str, start: str, step: str, out: str) -> str:
    """SQL of an ordered fold: ``rows`` (with ``key``, ``at``) are numbered; ``start`` and ``step`` give the state before them and after each."""
    return f"""WITH RECURSIVE {rows}, r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY "at") AS rn FROM rows_),
        f AS (SELECT DISTINCT {key}, 0::BIGINT AS rn, NULL::BIGINT AS "at", {start} FROM r UNION ALL SELECT r.{key}, r.rn, r."at", {step} FROM f JOIN r ON r.{key} = f.{key} AND r.rn = f.rn + 1)
        SELECT {out} FROM f WHERE rn > 0"""


DAG = "p AS (SELECT p_partkey AS node FROM part), deps AS (SELECT DISTINCT node, dep FROM (SELECT node, unnest([node // 2, node // 3]) AS dep FROM p WHERE node > 0) WHERE dep <> node AND dep IN (SELECT node FROM p))"


def _dag(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    d = p.where("node > 0").select("node", F.explode(F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3))).alias("dep")).where("dep <> node").distinct()
    return p, d.join(p.select(F.col("node").alias("dep")), "dep", "left_semi").select("node", "dep")


@query("WITH RECURSIVE " + DAG + ", lv AS (SELECT node, 0 AS level FROM p UNION SELECT deps.node, level + 1 FROM lv JOIN deps ON deps.dep = lv.node) SELECT node, max(level) AS level FROM lv GROUP BY node")
def dag_topo(spark, sf_dir):
    return graphs.levels(*_dag(spark, sf_dir))


@query("WITH " + DAG + ", done AS (SELECT node FROM p WHERE node % 4 <> 3) SELECT node FROM p WHERE node NOT IN (SELECT node FROM done) AND NOT EXISTS (SELECT 1 FROM deps d WHERE d.node = p.node AND d.dep NOT IN (SELECT node FROM done))")
def dag_ready(spark, sf_dir):
    """Nodes that are not done and whose dependencies are."""
    p, d = _dag(spark, sf_dir)
    done = p.where("node % 4 <> 3")
    unmet = d.join(done.select(F.col("node").alias("dep")), "dep", "left_anti")
    return p.join(done, "node", "left_anti").join(unmet, "node", "left_anti")


@query("SELECT event_id % 50 AS node, min(event_id) AS winner, arg_min(user_id % 4, event_id) AS worker FROM events WHERE event_type = 'purchase' GROUP BY node")
def dag_winner(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.groupBy((F.col("event_id") % 50).alias("node")).agg(F.min("event_id").alias("winner"), F.min_by(F.col("user_id") % 4, "event_id").alias("worker"))


@query(stepped(
    "rows_ AS (SELECT event_id % 50 AS node, event_id AS \"at\", user_id % 4 AS worker, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AND event_id > 900 AS commit_ FROM events)", "node",
    "NULL::BIGINT AS holder, NULL::BIGINT AS expiry, FALSE AS done, FALSE AS granted",
    """CASE WHEN f.done THEN f.holder WHEN r.commit_ THEN coalesce(f.holder, r.worker) WHEN f.holder IS NULL OR f.holder = r.worker OR f.expiry <= r.ms THEN r.worker ELSE f.holder END,
        CASE WHEN f.done OR r.commit_ THEN f.expiry WHEN f.holder = r.worker THEN greatest(coalesce(f.expiry, 0), r.ms + 600000) WHEN f.holder IS NULL OR f.expiry <= r.ms THEN r.ms + 600000 ELSE f.expiry END,
        f.done OR r.commit_, NOT f.done AND NOT r.commit_ AND (f.holder IS NULL OR f.holder = r.worker OR f.expiry <= r.ms)""",
    'node, "at", holder, granted',
))
def lease_holder(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    rows = e.select((F.col("event_id") % 50).alias("node"), F.col("event_id").alias("at"), (F.col("user_id") % 4).alias("worker"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.lit(600_000).cast("long").alias("ttl"), ((F.col("event_type") == "purchase") & (F.col("event_id") > 900)).alias("commit"))
    return folds.leases(rows)


@query(stepped(
    "x AS (SELECT 1), " + T.RECORDS + """, rows_ AS (SELECT producer_id % 11 AS key, "offset" AS "at", v % 3 = 0 AS claims, v % 4 AS by_, v % 5 AS to_ FROM records)""", "key",
    "NULL::BIGINT AS holder", "CASE WHEN r.claims THEN r.by_ WHEN f.holder = r.by_ THEN r.to_ ELSE f.holder END", 'key, "at", holder',
))
def control_holder(spark, sf_dir):
    r = T.records(spark, sf_dir)
    return folds.control_token(r.select((F.col("producer_id") % 11).alias("key"), F.col("offset").alias("at"), F.when(F.col("v") % 3 == 0, "claim").otherwise("grant").alias("verb"), (F.col("v") % 4).alias("by"), (F.col("v") % 5).alias("to")))


@query(stepped(
    "x AS (SELECT 1), " + T.RECORDS + """, rows_ AS (SELECT producer_id AS producer, "offset" AS "at", producer_seq AS seq, CASE WHEN v % 9 = 0 THEN 'refuse' WHEN v % 5 = 0 THEN 'commit' ELSE 'publish' END AS verb FROM records)""", "producer",
    "NULL::BIGINT AS fence, FALSE AS accepted",
    """CASE WHEN r.verb = 'refuse' THEN least(coalesce(f.fence, r.seq), r.seq) WHEN r.verb = 'commit' AND r.seq <= f.fence THEN NULL ELSE f.fence END,
        r.verb <> 'refuse' AND (f.fence IS NULL OR r.seq <= f.fence)""",
    'producer, "at", accepted',
))
def sticky_fence(spark, sf_dir):
    r = T.records(spark, sf_dir)
    return folds.sticky_fence(r.select(F.col("producer_id").alias("producer"), F.col("offset").alias("at"), F.col("producer_seq").alias("seq"), F.when(F.col("v") % 9 == 0, "refuse").when(F.col("v") % 5 == 0, "commit").otherwise("publish").alias("verb")))


@query(stepped("x AS (SELECT 1), " + T.RECORDS + """, rows_ AS (SELECT producer_id AS key, "offset" AS "at", body FROM records)""", "key", "'' AS hash", "sha256(f.hash || '|' || r.body)", 'key, "at", hash'))
def hash_chain(spark, sf_dir):
    r = T.records(spark, sf_dir)
    return folds.hash_chain(r.select(F.col("producer_id").alias("key"), F.col("offset").alias("at"), "body"))


@query("WITH " + T.SESSION_LOG + """, m AS (SELECT session AS key, "offset" AS "at", event_type, "offset" % 3 AS code, lag(event_type) OVER (PARTITION BY session ORDER BY "offset") AS before FROM session_log WHERE event_type IN ('error', 'view'))
    SELECT key, "at", 'CommandEnd' AS kind, code::INT AS exit FROM m WHERE event_type = 'error' UNION ALL SELECT key, "at", 'CommandStart', NULL FROM m WHERE event_type = 'view' UNION ALL SELECT key, "at", 'PromptReady', NULL FROM m WHERE event_type = 'view' AND before = 'error'""")
def osc_marks(spark, sf_dir):
    s = T.session_log(spark, sf_dir).where("event_type IN ('error', 'view')")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("\x1b]133;D;"), (F.col("offset") % 3).cast("string"), F.lit("\x07\x1b]133;A"))).otherwise(F.lit("\x07$ \x1b]633;C\x1b\\"))
    return folds.osc_marks(s.select(F.col("session").alias("key"), F.col("offset").alias("at"), text.alias("text")))


@query(stepped(
    "x AS (SELECT 1), " + T.RECORDS + """, rows_ AS (SELECT producer_id % 7 AS key, "offset" AS "at", bt_ms AS ms, CASE kind WHEN 'signup' THEN 'control' WHEN 'error' THEN 'note' ELSE 'task' END AS what FROM records)""", "key",
    "[]::BIGINT[] AS stamps, '' AS decision, NULL::BIGINT AS retry_ms",
    """CASE WHEN r.what = 'task' AND len(list_filter(f.stamps, lambda s: r.ms - s < 600000)) < 2 THEN list_append(list_filter(f.stamps, lambda s: r.ms - s < 600000), r.ms) ELSE list_filter(f.stamps, lambda s: r.ms - s < 600000) END,
        CASE WHEN r.what = 'note' THEN 'SilentNote' WHEN r.what = 'task' AND len(list_filter(f.stamps, lambda s: r.ms - s < 600000)) >= 2 THEN 'Throttled' ELSE 'Wake' END,
        CASE WHEN r.what = 'task' AND len(list_filter(f.stamps, lambda s: r.ms - s < 600000)) >= 2 THEN 600000 - (r.ms - list_filter(f.stamps, lambda s: r.ms - s < 600000)[1]) END""",
    'key, "at", decision, retry_ms',
))
def wake_budget(spark, sf_dir):
    r = T.records(spark, sf_dir)
    kind = F.when(F.col("kind") == "signup", "control").when(F.col("kind") == "error", "note").otherwise("task")
    return folds.wake_budget(r.select((F.col("producer_id") % 7).alias("key"), F.col("offset").alias("at"), F.col("bt_ms").alias("ms"), kind.alias("kind")), 2, 600_000)


# wakes, receipts, policy

CLASS = "CASE WHEN v % 10 = 0 THEN 'note' WHEN kind = 'click' AND v % 3 = 0 THEN 'note' WHEN kind IN ('purchase', 'signup') AND producer_id % 2 = 1 THEN 'note' WHEN kind = 'click' THEN 'answer' WHEN kind = 'purchase' THEN 'task' WHEN kind = 'signup' THEN 'control' ELSE 'report' END"
RANK = "CASE class WHEN 'control' THEN 8 WHEN 'task' THEN 6 WHEN 'answer' THEN 5 WHEN 'report' THEN 4 ELSE 0 END"


def _classes(spark, sf_dir):
    """Relayed rows, stray replies, and orders of senders that aren't listed only count as notes."""
    r = T.records(spark, sf_dir)
    relayed, stray, unlisted = F.col("v") % 10 == 0, F.col("v") % 3 == 0, F.col("producer_id") % 2 == 1
    order = F.col("kind").isin("purchase", "signup")
    kind = F.when(relayed | (F.col("kind") == "click") & stray | order & unlisted, "note").when(F.col("kind") == "click", "answer").when(F.col("kind") == "purchase", "task").when(F.col("kind") == "signup", "control").otherwise("report")
    return r.withColumn("class", kind)


@query(R + f""" SELECT "offset", {CLASS} AS class FROM records""")
def wake_classify(spark, sf_dir):
    return _classes(spark, sf_dir).select("offset", "class")


@query(R + f""" SELECT producer_id, bt_ms // 3600000 AS batch, max({RANK})::INT AS rank FROM (SELECT *, {CLASS} AS class FROM records) GROUP BY ALL""")
def wake_coalesce(spark, sf_dir):
    rank = F.coalesce(*(F.when(F.col("class") == k, v) for k, v in folds.RANKS.items()))
    return _classes(spark, sf_dir).groupBy("producer_id", F.floor(F.col("bt_ms") / 3_600_000).alias("batch")).agg(F.max(rank).alias("rank"))


@query(R + """ SELECT "offset", CASE kind WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'finished' WHEN 'signup' THEN 'prompt' END AS wake FROM records WHERE kind IN ('error', 'purchase', 'signup')""")
def semantic_wake(spark, sf_dir):
    r = T.records(spark, sf_dir).where("kind IN ('error', 'purchase', 'signup')")
    return r.select("offset", F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "purchase", "finished").otherwise("prompt").alias("wake"))


@query(R + """ SELECT "offset", 'wake ' || subject || ' @' || "offset" AS line, "offset" AS parsed FROM records WHERE kind = 'error'""")
def wake_line(spark, sf_dir):
    line = F.format_string("wake %s @%d", "subject", "offset")
    return T.records(spark, sf_dir).where("kind = 'error'").select("offset", line.alias("line"), F.regexp_extract(line, "@([0-9]+)$", 1).cast("long").alias("parsed"))


ASK = "asks AS (SELECT o_orderkey AS ask, CASE o_orderstatus WHEN 'F' THEN 'handled' WHEN 'O' THEN 'deferred' ELSE 'refused' END AS verdict FROM orders), receipts AS (SELECT ask AS re, verdict FROM asks WHERE ask % 3 <> 0)"


def _receipts(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "handled").when(F.col("o_orderstatus") == "O", "deferred").otherwise("refused")
    body = F.concat(F.lit("v=1 t=5 re="), F.col("o_orderkey").cast("string"), F.lit(" verdict="), verdict)
    return o.where("o_orderkey % 3 <> 0").select(body.alias("body"))


def _parsed(receipts):
    """The fields of a receipt's first line; null unless it is version 1, with a number to refer to and a known verdict."""
    fields = F.str_to_map(F.element_at(F.split("body", "\n"), 1), F.lit(" "), F.lit("="))
    got = receipts.select(fields.alias("f"))
    ok = (F.col("f")["v"] == "1") & F.col("f")["re"].rlike("^[0-9]+$") & F.coalesce(F.col("f")["verdict"].isin("handled", "deferred", "refused"), F.lit(True))
    return got.select(F.when(ok, F.col("f")["re"].cast("long")).alias("re"), F.when(ok, F.col("f")["verdict"]).alias("verdict"))


@query("WITH " + ASK + " SELECT re, verdict FROM receipts")
def receipt_parse(spark, sf_dir):
    return _parsed(_receipts(spark, sf_dir))


@query("WITH " + ASK + " SELECT ask, r.verdict FROM asks LEFT JOIN receipts r ON r.re = ask")
def ask_answer_join(spark, sf_dir):
    asks = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask"))
    return asks.join(_parsed(_receipts(spark, sf_dir)).withColumnRenamed("re", "ask"), "ask", "left")


@query("WITH " + ASK + " SELECT ask FROM asks WHERE ask NOT IN (SELECT re FROM receipts)")
def unanswered_asks(spark, sf_dir):
    asks = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask"))
    return asks.join(_parsed(_receipts(spark, sf_dir)).withColumnRenamed("re", "ask"), "ask", "left_anti")


RULES = retention.parse_rules("""
prefix age=7d bytes=4KiB /f/alpha/pub/*/*/error
prefix last /f/*/pub/*/*/signup
hold read=/f/alpha/cur/{4} age=7d bytes=8KiB /f/alpha/pub/n-2/>
default age=7d bytes=16KiB
""")
CLASSED = R + """, classed AS (SELECT *, CASE WHEN regexp_matches(subject, '^/f/alpha/pub/[^/]+/[^/]+/error$') THEN 0 WHEN regexp_matches(subject, '^/f/[^/]+/pub/[^/]+/[^/]+/signup$') THEN 1 WHEN regexp_matches(subject, '^/f/alpha/pub/n-2/.+$') THEN 2 ELSE 3 END AS rule, length(body) + 40 AS size FROM records)"""
BUDGETS = {0: 4096, 2: 8192, 3: 16384}


def _classed(spark, sf_dir):
    return T.records(spark, sf_dir).withColumn("rule", retention.rule_of(F.col("subject"), RULES)).withColumn("size", F.length("body") + 40)


@query(CLASSED + ' SELECT "offset", rule FROM classed')
def rule_first_match(spark, sf_dir):
    return _classed(spark, sf_dir).select("offset", "rule")


@query(CLASSED + """, w AS (SELECT *, sum(size) OVER (PARTITION BY rule ORDER BY "offset" DESC) AS upto, CASE rule WHEN 0 THEN 4096 WHEN 2 THEN 8192 ELSE 16384 END AS budget FROM classed WHERE rule <> 1) SELECT rule, min("offset") AS cut, count(*) AS kept, sum(size)::BIGINT AS bytes FROM w WHERE upto <= budget GROUP BY rule""")
def retain_bytes(spark, sf_dir):
    budget = F.coalesce(*(F.when(F.col("rule") == k, v) for k, v in BUDGETS.items()))
    return retention.by_bytes(_classed(spark, sf_dir).where("rule <> 1"), "rule", "size", budget)


@query(CLASSED + """ SELECT rule, max("offset") FILTER (WHERE bt_ms < (SELECT max(bt_ms) - 604800000 FROM records)) + 1 AS cut, count(*) FILTER (WHERE bt_ms < (SELECT max(bt_ms) - 604800000 FROM records)) AS aged FROM classed WHERE rule IN (0, 3) GROUP BY rule""")
def retain_plan_cut(spark, sf_dir):
    """The natural cut by age of each prefix class."""
    r = _classed(spark, sf_dir)
    old = r.crossJoin(F.broadcast(r.agg((F.max("bt_ms") - RULES[0].age_ms).alias("since")))).where("rule IN (0, 3)").withColumn("old", F.col("bt_ms") < F.col("since"))
    return old.groupBy("rule").agg((F.max(F.when(F.col("old"), F.col("offset"))) + 1).alias("cut"), F.count_if("old").alias("aged"))


HELD = """, upto AS (SELECT "group", max(upto) AS upto FROM commits GROUP BY "group"), held AS (SELECT c.*, u.upto FROM classed c LEFT JOIN upto u ON u."group" = '/f/alpha/cur/' || split_part(subject, '/', 5) WHERE rule = 2)"""


def _held_rows(spark, sf_dir):
    r = _classed(spark, sf_dir).where("rule = 2").withColumn("group", retention.reader_group(F.col("subject"), RULES[2].read))
    return r.join(T.commits(spark, sf_dir).groupBy("group").agg(F.max("upto").alias("upto")), "group", "left")


@query(CLASSED + ", " + T.COMMITS + HELD + """ SELECT "offset", upto IS NULL OR "offset" > upto AS held FROM held""")
def held_until_read(spark, sf_dir):
    return _held_rows(spark, sf_dir).select("offset", (F.col("upto").isNull() | (F.col("offset") > F.col("upto"))).alias("held"))


@query(CLASSED + ", " + T.COMMITS + HELD + """ SELECT "offset" FROM held WHERE "offset" < (SELECT count(*) * 9 // 10 FROM events) AND (upto IS NULL OR "offset" > upto)""")
def retain_carry(spark, sf_dir):
    """Rows below the cut that a reader still needs."""
    n = T.table(spark, sf_dir, "events").agg(F.floor(F.count(F.lit(1)) * 9 / 10).alias("cut"))
    return _held_rows(spark, sf_dir).crossJoin(F.broadcast(n)).where("offset < cut AND (upto IS NULL OR offset > upto)").select("offset")


@query(CLASSED + """ SELECT subject, max("offset") + 1 AS floor FROM classed WHERE "offset" < (SELECT count(*) * 9 // 10 FROM events) AND rule <> 1 GROUP BY subject""")
def retain_floors(spark, sf_dir):
    """From where on each subject is complete once everything below the cut is gone."""
    n = T.table(spark, sf_dir, "events").agg(F.floor(F.count(F.lit(1)) * 9 / 10).alias("cut"))
    return _classed(spark, sf_dir).crossJoin(F.broadcast(n)).where("offset < cut AND rule <> 1").groupBy("subject").agg((F.max("offset") + 1).alias("floor"))


@query(CLASSED + """ SELECT max("offset") + 1 AS oldest FROM classed WHERE "offset" < (SELECT count(*) * 9 // 10 FROM events) AND rule <> 1 AND regexp_matches(subject, '^/f/beta/.+$')""")
def filter_oldest(spark, sf_dir):
    """From where on every subject of a filter is complete."""
    return retain_floors(spark, sf_dir).where(S.matches(F.col("subject"), "/f/beta/>")).agg(F.max("floor").alias("oldest"))


@query(R + """, stamps AS (SELECT "offset" + 1 AS head, bt_ms AS ms FROM records WHERE "offset" % 100 = 99) SELECT r."offset", coalesce(s.ms, 9999999999999) AS ms FROM records r ASOF LEFT JOIN stamps s ON r."offset" < s.head""")
def record_age(spark, sf_dir):
    """When each record was written at the latest, by stamps at every hundredth."""
    r = T.records(spark, sf_dir)
    return retention.record_age(r, r.where("offset % 100 = 99").select((F.col("offset") + 1).alias("head"), F.col("bt_ms").alias("ms")), 9_999_999_999_999)


@query(R + """ SELECT "offset", NOT EXISTS (SELECT 1 FROM records n WHERE n.subject = r.subject AND n."offset" > r."offset") AS retired FROM records r""")
def retire_cas(spark, sf_dir):
    """A retirement holds only if the subject's newest record is still the one meant."""
    r = T.records(spark, sf_dir)
    last = r.groupBy("subject").agg(F.max("offset").alias("last"))
    return r.join(last, "subject").select("offset", (F.col("last") == F.col("offset")).alias("retired"))


@query(R + """ SELECT producer_id, min(producer_seq) AS will_seq, max(producer_seq) <= 60 AS fires FROM records WHERE producer_seq >= 30 GROUP BY producer_id""")
def will_fire(spark, sf_dir):
    """A last will filed at sequence 60 fires unless a higher sequence landed."""
    return T.records(spark, sf_dir).where("producer_seq >= 30").groupBy("producer_id").agg(F.min("producer_seq").alias("will_seq"), (F.max("producer_seq") <= 60).alias("fires"))


@query(R + """ SELECT subject, '/r/' || split_part(subject, '/', 5) || '/' || split_part(subject, '/', 3) AS reader FROM (SELECT DISTINCT subject FROM records)""")
def reader_template(spark, sf_dir):
    return T.records(spark, sf_dir).select("subject").distinct().select("subject", retention.reader_group(F.col("subject"), "/r/{4}/{2}").alias("reader"))


GRANTS = [("p0", "rw", "/f/alpha/>", None), ("p1", "ro", "/f/>", None), ("p2", "rw", "/f/beta/pub/n-1/>", 1704500000000), ("p3", "rw", "/f/*/pub/n-2/*/click", None), ("p4", "ro", "/f/alpha/pub/>", 1)]


@query(R + """ SELECT 'p0' AS principal, count(*) AS n FROM records WHERE regexp_matches(subject, '^/f/alpha/.+$') UNION ALL SELECT 'p2', count(*) FROM records WHERE regexp_matches(subject, '^/f/beta/pub/n-1/.+$') AND bt_ms < 1704500000000 HAVING count(*) > 0 UNION ALL SELECT 'p3', count(*) FROM records WHERE regexp_matches(subject, '^/f/[^/]+/pub/n-2/[^/]+/click$')""")
def grant_check(spark, sf_dir):
    """Records that each principal may publish: a writing grant that is not expired and matches."""
    r, out = T.records(spark, sf_dir), []
    for who, mode, filter_, expiry in GRANTS:
        if mode == "rw":
            ok = S.matches(F.col("subject"), filter_)
            out.append(F.when(ok & (F.col("bt_ms") < expiry) if expiry else ok, F.lit(who)))
    allowed = r.select(F.explode(F.filter(F.array(*out), lambda p: p.isNotNull())).alias("principal"))
    return allowed.groupBy("principal").agg(F.count(F.lit(1)).alias("n"))


CEILING = ["/f/alpha/>", "/f/*/pub/n-2/>"]


@query("WITH g AS (SELECT * FROM (VALUES " + ", ".join(f"('{g[0]}', string_split('{g[2]}', '/')[2:])" for g in GRANTS) + ") AS t(principal, f)), c AS (SELECT * FROM (VALUES " + ", ".join(f"(string_split('{c}', '/')[2:])" for c in CEILING) + """) AS t(c)),
    p AS (SELECT principal, f, c, len(list_filter(range(1, len(c) + 1), lambda i: c[i] = '>' OR c[i] = f[i] OR c[i] = '*' AND f[i] <> '>')) = len(c) AND (c[-1] = '>' AND len(f) >= len(c) OR c[-1] <> '>' AND len(f) = len(c)) AS holds FROM g, c)
    SELECT principal, bool_or(coalesce(holds, FALSE)) AS within FROM p GROUP BY principal""")
def grant_ceiling(spark, sf_dir):
    return spark.createDataFrame([(g[0], any(S.contains(c, g[2]) for c in CEILING)) for g in GRANTS], "principal string, within boolean")


TEXTS = [f"{m}{',p=' + w if w != 'p1' else ''}{',exp=' + str(e) if e else ''}:{f}" for w, m, f, e in GRANTS]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{g[1]}', {'NULL' if g[0] == 'p1' else repr(g[0])}, {g[3] or 'NULL'}::BIGINT, '{g[2]}')" for t, g in zip(TEXTS, GRANTS, strict=True)) + ") AS t(grant_text, mode, principal, exp, filter)")
def grant_parse(spark, sf_dir):
    g = spark.createDataFrame([(t,) for t in TEXTS], "grant_text string")
    pick = lambda p: F.nullif(F.regexp_extract("grant_text", p, 1), F.lit(""))
    return g.select("grant_text", pick("^(rw|ro)[,:]").alias("mode"), pick("^[^:]*,p=([^,:]+)").alias("principal"), pick("^[^:]*,exp=([0-9]+)").cast("long").alias("exp"), pick("^[^:]*:(.*)$").alias("filter"))


@query(R + """ SELECT "offset", regexp_matches(subject, '^/f/alpha/pub/[^/]+/[^/]+/error$') OR (producer_id > 0 AND starts_with('user-' || producer_id, 'user-1')) AS escalated FROM records""")
def escalation_match(spark, sf_dir):
    who = F.concat(F.lit("user-"), F.col("producer_id").cast("string"))
    hit = S.matches(F.col("subject"), "/f/alpha/pub/*/*/error") | ((F.col("producer_id") > 0) & who.startswith("user-1"))
    return T.records(spark, sf_dir).select("offset", hit.alias("escalated"))


@query("SELECT n_nationkey AS node, r.generation, r.head FROM (SELECT max({'generation': n_regionkey, 'head': n_nationkey * 7 % 11, 'low': -n_nationkey}) AS r FROM nation WHERE n_nationkey % 6 <> 0), nation WHERE -n_nationkey = r.low")
def elect_candidate(spark, sf_dir):
    """The best of a quorum: generation, then head, then the smallest node. Diverged nodes don't stand."""
    n = T.table(spark, sf_dir, "nation").withColumn("diverged", F.col("n_nationkey") % 6 == 0)
    best = F.max(F.when(~F.col("diverged"), F.struct(F.col("n_regionkey").alias("generation"), (F.col("n_nationkey") * 7 % 11).alias("head"), (-F.col("n_nationkey")).alias("low"))))
    won = n.agg(best.alias("r"), F.count(F.lit(1)).alias("size"), F.count_if(~F.col("diverged")).alias("standing")).where("standing * 2 > size")
    return won.select((-F.col("r.low")).alias("node"), "r.generation", "r.head")


@query("SELECT * FROM (VALUES (1, 5::BIGINT), (2, 30::BIGINT), (3, 30::BIGINT), (4, NULL), (5, NULL)) AS t(earlier, upto)")
def lineage_resume(spark, sf_dir):
    """Up to which offset a cursor of an earlier generation is valid in generation 4; null: all of it, or never."""
    steps = spark.createDataFrame([(2, 5), (3, 40), (4, 30)], "generation int, common long")
    asked = spark.createDataFrame([(i,) for i in range(1, 6)], "earlier int")
    pairs = asked.join(F.broadcast(steps), (F.col("generation") > F.col("earlier")) & (F.col("generation") <= 4), "left")
    return pairs.groupBy("earlier").agg(F.min("common").alias("upto"))


@query(R + ", " + T.COMMITS + """ SELECT "group", max(upto) + 1 AS from_offset, greatest(max(upto) + 1, 800) AS joins_at, max(upto) + 1 < 800 AS reads_held FROM commits GROUP BY "group" """)
def refill_lanes(spark, sf_dir):
    """Where each lane joins the shared scan: behind the oldest retained offset it reads held rows first."""
    c = T.commits(spark, sf_dir).groupBy("group").agg((F.max("upto") + 1).alias("from_offset"))
    return c.select("group", "from_offset", F.greatest("from_offset", F.lit(800)).alias("joins_at"), (F.col("from_offset") < 800).alias("reads_held"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM s)
    SELECT user_id, epoch_us(min(ts)) AS begins_us, count(*) AS n FROM g GROUP BY user_id, burst""")
def session_bursts(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("session_window.start").alias("begins_us"), "n")


@query(SL + """, c AS (SELECT session, "offset", length(text) % 3 AS h, lag(length(text) % 3) OVER (PARTITION BY session ORDER BY "offset") AS before FROM session_log) SELECT session, max("offset") AS quiesced_at FROM c WHERE before IS DISTINCT FROM h GROUP BY session""")
def quiesced_at(spark, sf_dir):
    """The last row at which a session's state changed."""
    s = T.session_log(spark, sf_dir).withColumn("h", F.length("text") % 3)
    before = F.lag("h").over(Window.partitionBy("session").orderBy("offset"))
    return s.withColumn("before", before).where("NOT (before <=> h)").groupBy("session").agg(F.max("offset").alias("quiesced_at"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row FROM documents)"


@query("WITH " + LINES + ", f AS (SELECT doc_id, row, row - row_number() OVER (PARTITION BY doc_id ORDER BY row) AS island FROM lines WHERE trim(line) <> '') SELECT doc_id, min(row) AS top, max(row) AS bottom FROM f GROUP BY doc_id, island")
def text_blocks(spark, sf_dir):
    """Runs of non-empty lines."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line")).where("trim(line) <> ''")
    island = F.col("row") - F.row_number().over(Window.partitionBy("doc_id").orderBy("row"))
    return rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("row").cast("long").alias("top"), F.max("row").cast("long").alias("bottom")).drop("island")


@query("WITH " + LINES + ", h AS (SELECT doc_id, row, string_split(line, 'license') AS p FROM lines WHERE contains(line, 'license')) SELECT doc_id, row, unnest(list_transform(range(1, len(p)), lambda i: length(array_to_string(p[1:i], 'license')))) AS col FROM h")
def text_search(spark, sf_dir):
    """Places of a word in each line: columns of hits that don't overlap."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line")).where(F.contains(F.col("line"), F.lit("license")))
    parts = rows.select("doc_id", F.col("row").cast("long").alias("row"), F.split("line", "license").alias("p"))
    at = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.length(F.array_join(F.slice("p", 1, i), "license")).cast("long"))
    return parts.select("doc_id", "row", F.explode(at).alias("col"))


@query(R + """, a AS (SELECT "offset" // 50 AS page, bit_xor(hash_) AS digest, count(*) AS n FROM (SELECT "offset", v AS hash_ FROM records) GROUP BY page), b AS (SELECT "offset" // 50 AS page, bit_xor(CASE WHEN "offset" % 333 = 0 THEN v + 1 ELSE v END) AS digest FROM records GROUP BY "offset" // 50) SELECT a.page, n FROM a JOIN b USING (page) WHERE a.digest <> b.digest""")
def map_diff(spark, sf_dir):
    """Pages of a map whose digest changed."""
    page = F.floor(F.col("offset") / 50).alias("page")
    r = T.records(spark, sf_dir)
    a = r.groupBy(page).agg(F.bit_xor("v").alias("a"), F.count(F.lit(1)).alias("n"))
    b = r.groupBy(page).agg(F.bit_xor(F.when(F.col("offset") % 333 == 0, F.col("v") + 1).otherwise(F.col("v"))).alias("b"))
    return a.join(b, "page").where("a <> b").select("page", "n")


# hashes


def sql_bytes(text: str) -> str:
    """A text's bytes as a list of wide numbers, in SQL."""
    return f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UHUGEINT)"


def sql_fnv(words: str) -> str:
    return f"list_reduce(list_prepend({hashes.FNV_OFFSET}::UHUGEINT, {words}), lambda h, b: (xor(h, b) * {hashes.FNV_PRIME}::UHUGEINT) % {1 << 64}::UHUGEINT)"


def sql_crc(text: str) -> str:
    """A reflected CRC-32; ``crc_table`` must be in the query."""
    return f"xor({0xFFFFFFFF}::UHUGEINT, list_reduce(list_prepend({0xFFFFFFFF}::UHUGEINT, {sql_bytes(text)}), lambda c, b: xor(crc_table[((xor(c, b) % 256)::BIGINT) + 1], c >> 8)))::BIGINT"


def sql_crc_table(polynomial: int) -> str:
    return f"crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc_table FROM (SELECT i, list_reduce(list_prepend(i::UHUGEINT, [0::UHUGEINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN {polynomial}::UHUGEINT ELSE 0::UHUGEINT END)) AS v FROM range(256) r(i)))"



@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_of(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))


@query(R + " SELECT subject, format('{:016x}', (" + sql_fnv(sql_bytes("subject")) + ")::UBIGINT) AS hash FROM (SELECT DISTINCT subject FROM records)")
def fnv1a(spark, sf_dir):
    return T.records(spark, sf_dir).select("subject").distinct().select("subject", hashes.fnv1a_hex(F.col("subject")).alias("hash"))


@query(R + ' SELECT "offset", ((' + sql_fnv(sql_bytes("producer_id::VARCHAR")) + ") % 16)::INT AS partition FROM records")
def partition_assign(spark, sf_dir):
    return T.records(spark, sf_dir).select("offset", hashes.assign_partition(F.col("producer_id"), 16).alias("partition"))


@query(R + ", " + sql_crc_table(hashes.CRC32C_POLYNOMIAL) + ' SELECT "offset", ' + sql_crc("body") + " AS crc FROM records, crcs")
def crc32c(spark, sf_dir):
    return T.records(spark, sf_dir).select("offset", hashes.crc32c(F.col("body")).alias("crc"))


# joins that the above rely on



def _oc(spark, sf_dir):
    return T.table(spark, sf_dir, "orders"), T.table(spark, sf_dir, "customer").where("c_acctbal >= 0")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0")
def join_inner(spark, sf_dir):
    o, c = _oc(spark, sf_dir)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    o, c = _oc(spark, sf_dir)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def join_semi(spark, sf_dir):
    o, c = _oc(spark, sf_dir)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def join_anti(spark, sf_dir):
    o, c = _oc(spark, sf_dir)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def join_range(spark, sf_dir):
    """Interval join by two-hour buckets: an equi-join on the bucket and the next one, then the exact condition."""
    e = T.table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("bucket", F.floor(F.col("us") / 7_200_000_000))
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("us").alias("au"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("us").alias("bu"), "bucket")
    return a.join(b, ["user_id", "bucket"]).where("bu > au AND bu <= au + 7200000000").select("a", "b")


@query("SELECT p.event_id, t.event_id AS found FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') t ON p.user_id = t.user_id AND p.event_id > t.event_id")
def join_asof(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("event_id").alias("found_id"))
    return log.as_of(e.where("event_type = 'purchase'").select("user_id", "event_id"), clicks, ["user_id"], "event_id", "click", "found_id").select("event_id", "found")


@query()
def screen_fold(spark, sf_dir):
    """Each session's terminal screen after all its output."""
    from ledgerline.operators.terminal import fold_screens

    s = T.session_log(spark, sf_dir)
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("\x1b[2J\x1b[H"), F.col("text"), F.lit("\r\n"))).otherwise(F.concat(F.col("event_type"), F.lit("\x1b[K\r\n")))
    return fold_screens(s.select(F.col("session").alias("key"), F.col("offset").alias("at"), "kind", text.alias("text"), (F.lit(40) + F.col("offset") % 3).cast("int").alias("cols"), F.lit(10).alias("rows")), 40, 10)


@query("SELECT user_id, event_type, count(*) AS n, grouping_id(user_id, event_type)::INT AS level FROM (SELECT user_id % 5 AS user_id, event_type FROM events) GROUP BY CUBE (user_id, event_type)")
def group_cube(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("user_id"), "event_type")
    return e.cube("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
