"""Queries over relays, payload formats, predicates and small scalar operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import subjects as S
from ledgerline.operators import summary
from ledgerline.plans.domain_queries import sql_crc, sql_crc_table
from ledgerline.plans.registry import query
from ledgerline.sources import tables as T

R = "WITH " + T.RECORDS
SL = "WITH " + T.SESSION_LOG
CONV = "conversations"


@query(R + """ SELECT producer_id, CASE WHEN count(*) = 0 THEN 10000 ELSE count(*) FILTER (WHERE v % 4 <> 0) * 10000 // count(*) END AS rate FROM records GROUP BY producer_id""")
def hit_rate(spark, sf_dir):
    """Hits in ten-thousandths; all when there was nothing to hit."""
    n, hits = F.count(F.lit(1)), F.count_if(F.col("v") % 4 != 0)
    return T.records(spark, sf_dir).groupBy("producer_id").agg(F.when(n == 0, F.lit(10000)).otherwise(F.floor(hits * 10000 / n)).cast("long").alias("rate"))


@query(SL + """ SELECT session, "offset", kind IN ('Out', 'Resize') AS paints FROM session_log""")
def paint_predicate(spark, sf_dir):
    return T.session_log(spark, sf_dir).select("session", "offset", F.col("kind").isin("Out", "Resize").alias("paints"))


@query(R + """ SELECT "offset", bt_ms - v % 100000 * 60000 + 86400000 <= bt_ms AS elapsed FROM records""")
def deadline_elapsed(spark, sf_dir):
    return T.records(spark, sf_dir).select("offset", (F.col("bt_ms") - F.col("v") % 100000 * 60000 + 86_400_000 <= F.col("bt_ms")).alias("elapsed"))


@query(R + """ SELECT a."offset" AS ack, a."offset" > b.barrier AS valid FROM records a JOIN (SELECT producer_id, min("offset") AS barrier FROM records WHERE kind = 'signup' GROUP BY producer_id) b USING (producer_id) WHERE a.kind = 'click'""")
def barrier_acks(spark, sf_dir):
    """An acknowledgement counts only if it was recorded after the barrier."""
    r = T.records(spark, sf_dir)
    barrier = r.where("kind = 'signup'").groupBy("producer_id").agg(F.min("offset").alias("barrier"))
    return r.where("kind = 'click'").join(barrier, "producer_id").select(F.col("offset").alias("ack"), (F.col("offset") > F.col("barrier")).alias("valid"))


@query(R + """ SELECT subject, "offset", producer_seq, producer_seq <= coalesce(max(producer_seq) OVER (PARTITION BY producer_id, subject ORDER BY rank, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS duplicate FROM (SELECT *, ("offset" * 7919) % 10007 AS rank FROM records)""")
def relay_floor(spark, sf_dir):
    """Relayed records in arrival order: a sequence at or below its origin's and subject's floor is a duplicate."""
    r = T.records(spark, sf_dir).withColumn("rank", F.col("offset") * 7919 % 10007)
    floor = F.max("producer_seq").over(Window.partitionBy("producer_id", "subject").orderBy("rank", "offset").rowsBetween(Window.unboundedPreceding, -1))
    return r.select("subject", "offset", "producer_seq", (F.col("producer_seq") <= F.coalesce(floor, F.lit(0))).alias("duplicate"))


@query(R + ", " + T.COMMITS + """ SELECT "offset", '/mirror' || substr(subject, 3) AS subject, body FROM records WHERE starts_with(subject, '/f/alpha/') AND "offset" > (SELECT max(upto) // 2 FROM commits)""")
def federate(spark, sf_dir):
    """A subtree beyond a bridge's cursor, under its new name."""
    cursor = T.commits(spark, sf_dir).agg(F.floor(F.max("upto") / 2).alias("cursor"))
    r = T.records(spark, sf_dir).where(S.matches(F.col("subject"), "/f/alpha/>"))
    return r.crossJoin(F.broadcast(cursor)).where("offset > cursor").select("offset", S.rewrite(F.col("subject"), F.lit(0), 3, strip="/f", add="/mirror").alias("subject"), "body")


@query(R + """, f AS (SELECT "offset", body FROM records WHERE "offset" % 97 <> 5), n AS (SELECT min(r."offset") AS gap FROM records r LEFT JOIN f USING ("offset") WHERE f.body IS NULL) SELECT count(*) AS accepted, min(gap) AS first_refused FROM f, n WHERE "offset" < gap""")
def replicate(spark, sf_dir):
    """A follower takes records as long as none is missing."""
    r = T.records(spark, sf_dir).select("offset", "body")
    f = r.where("offset % 97 <> 5")
    gap = r.join(f, "offset", "left_anti").agg(F.min("offset").alias("gap"))
    return f.crossJoin(F.broadcast(gap)).where("offset < gap").agg(F.count(F.lit(1)).alias("accepted"), F.min("gap").alias("first_refused"))


@query(R + """ SELECT min("offset") AS oldest, max("offset") + 1 AS head, count(DISTINCT producer_id) AS producers, count(DISTINCT subject) AS subjects, sum(length(body))::BIGINT AS bytes FROM records""")
def wire_stats(spark, sf_dir):
    return T.records(spark, sf_dir).agg(F.min("offset").alias("oldest"), (F.max("offset") + 1).alias("head"), F.count_distinct("producer_id").alias("producers"), F.count_distinct("subject").alias("subjects"), F.sum(F.length("body")).alias("bytes"))


@query("WITH " + T.SAMPLES + """ SELECT window_start, CASE WHEN window_start + 86400000 <= 1704672000000 THEN 'Expired' ELSE 'Taken' END AS answer, count(*) AS n FROM (SELECT at_ms - at_ms % 86400000 AS window_start FROM samples) GROUP BY ALL""")
def rollup_horizon(spark, sf_dir):
    """Summaries of windows that end at or before the horizon are refused."""
    s = summary.windowed(T.samples(spark, sf_dir), "day")
    answer = F.when(F.col("window_start") + 86_400_000 <= 1_704_672_000_000, "Expired").otherwise("Taken")
    return s.groupBy("window_start", answer.alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query(R + """ SELECT subject, version FROM (SELECT subject, max("offset") AS version FROM records WHERE kind = 'view' GROUP BY subject) WHERE version > 700 AND starts_with(subject, '/f/beta/') ORDER BY version LIMIT 30""")
def signal_read(spark, sf_dir):
    """Changes after a version, oldest first, one page."""
    newest = T.records(spark, sf_dir).where("kind = 'view'").groupBy("subject").agg(F.max("offset").alias("version"))
    return newest.where(S.matches(F.col("subject"), "/f/beta/>") & (F.col("version") > 700)).orderBy("version").limit(30)


@query(f"""SELECT conv_id, turn, 'tool_use' AS stop, length(text) AS n FROM {CONV} WHERE role = 'assistant'""")
def completion_parse(spark, sf_dir):
    """The text and stop reason of completion documents."""
    c = T.table(spark, sf_dir, CONV).where("role = 'assistant'")
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"), F.lit("tool_use").alias("stop_reason")))
    got = F.from_json(doc, "content array<struct<type:string,text:string,id:string,name:string,input:string>>, stop_reason string")
    return c.select("conv_id", "turn", got.alias("g")).select("conv_id", "turn", F.col("g.stop_reason").alias("stop"), F.length(F.array_join(F.transform(F.filter("g.content", lambda x: x["type"] == "text"), lambda x: x["text"]), "")).cast("long").alias("n"))


@query(f"""SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS whole, count(*) AS parts FROM {CONV} GROUP BY conv_id""")
def sse_assemble(spark, sf_dir):
    """Deltas of a stream put together in order."""
    c = T.table(spark, sf_dir, CONV).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return c.select("conv_id", F.sha2(F.encode(F.array_join(F.transform("p", lambda x: x["text"]), ""), "UTF-8"), 256).alias("whole"), F.size("p").cast("long").alias("parts"))


@query(R + """ SELECT producer_id, "offset", v > coalesce(max(v) OVER (PARTITION BY producer_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS admitted FROM records WHERE kind = 'view'""")
def drive_gate(spark, sf_dir):
    """Only a position beyond all driven before is admitted."""
    before = F.max("v").over(Window.partitionBy("producer_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    return T.records(spark, sf_dir).where("kind = 'view'").select("producer_id", "offset", (F.col("v") > F.coalesce(before, F.lit(-1))).alias("admitted"))


@query("SELECT node, step FROM (SELECT unnest(range(50)) AS node), (SELECT unnest(range(20)) AS step) WHERE (node, step) NOT IN (SELECT event_id % 50, user_id % 20 FROM events WHERE event_type = 'purchase')")
def journal_missing(spark, sf_dir):
    """Steps of a workflow that no journal entry has."""
    done = T.table(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("event_id") % 50).alias("node"), (F.col("user_id") % 20).alias("step"))
    steps = spark.range(50).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("step"))
    return steps.join(done, ["node", "step"], "left_anti")


@query(SL + """, f AS (SELECT session, "offset", length(text) % 3 AS h, lag(length(text) % 3) OVER (PARTITION BY session ORDER BY "offset") AS before FROM session_log) SELECT session, "offset", before IS DISTINCT FROM h AS changed FROM f""")
def animation_frames(spark, sf_dir):
    s = T.session_log(spark, sf_dir).withColumn("h", F.length("text") % 3)
    before = F.lag("h").over(Window.partitionBy("session").orderBy("offset"))
    return s.withColumn("before", before).select("session", "offset", (~F.col("before").eqNullSafe(F.col("h"))).alias("changed"))


@query("WITH " + T.HEADERS + " SELECT actor, " + ", ".join(f"(sum(('0x' || substr(id, {4 * i + 1}, 4))::BIGINT) % 65536)::BIGINT AS lane{i}" for i in range(4)) + " FROM headers GROUP BY actor")
def set_hash_lanes(spark, sf_dir):
    """A set's hash as lane sums modulo 2**16: sets add up, members can be taken out."""
    lane = lambda i: (F.sum(F.conv(F.substring("id", 4 * i + 1, 4), 16, 10).cast("long")) % 65536).alias(f"lane{i}")
    return T.headers(spark, sf_dir).groupBy("actor").agg(*(lane(i) for i in range(4)))


@query("SELECT doc_id, base64(encode(lang)) AS b64, lower(hex(encode(source))) AS hexed FROM documents")
def base64_hex(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.base64(F.encode("lang", "UTF-8")).alias("b64"), F.lower(F.hex(F.encode("source", "UTF-8"))).alias("hexed"))


@query("WITH " + sql_crc_table(0xEDB88320) + " SELECT doc_id, " + sql_crc("text") + " AS crc FROM documents, crcs")
def crc32_of(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


HOPS = [("k1", 0, 1000), ("k1", 1, 800), ("k1", 2, None), ("k2", 0, 90), ("k3", 0, None)]


@query("SELECT * FROM (VALUES ('k1', 800::BIGINT), ('k2', 0), ('k3', NULL)) AS t(grant_id, expiry)")
def chain_expiry(spark, sf_dir):
    """A delegation expires with its earliest hop; one that has expired by now (100) has none left."""
    hops = spark.createDataFrame(HOPS, "grant_id string, hop int, exp long").groupBy("grant_id").agg(F.min("exp").alias("e"))
    return hops.select("grant_id", F.when(F.col("e") <= 100, F.lit(0).cast("long")).otherwise(F.col("e")).alias("expiry"))


@query(R + """, s AS (SELECT "offset", producer_id, bt_ms AS start, bt_ms + 3600000 AS expiry FROM records WHERE kind = 'signup') SELECT c."offset" AS claim, max(s."offset") AS lease FROM records c JOIN s ON s.producer_id = c.producer_id AND c.bt_ms BETWEEN s.start AND s.expiry AND c."offset" > s."offset" WHERE c.kind <> 'signup' GROUP BY c."offset" """)
def lease_intervals(spark, sf_dir):
    """Claims inside a lease: an equi-join on the hour and the next, then the exact interval."""
    r = T.records(spark, sf_dir).withColumn("hour", F.floor(F.col("bt_ms") / 3_600_000))
    leases = r.where("kind = 'signup'").select("producer_id", F.col("offset").alias("lease"), F.col("bt_ms").alias("start"), F.explode(F.array("hour", F.col("hour") + 1)).alias("hour"))
    claims = r.where("kind <> 'signup'").join(leases, ["producer_id", "hour"]).where("bt_ms BETWEEN start AND start + 3600000 AND offset > lease")
    return claims.groupBy(F.col("offset").alias("claim")).agg(F.max("lease").alias("lease"))
