"""The log data model as views over the test tables: each a DataFrame, with the same relation as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log offset, producer_id, producer_seq, subject, body, bt_ms, v, kind."""
    e = table(spark, sf_dir, "events")
    subject = F.concat(F.lit("/f/"), F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta"), F.lit("/pub/n-"), (F.col("user_id") % 7).cast("string"), F.lit("/s-"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(F.col("event_id").alias("offset"), F.col("user_id").alias("producer_id"), seq.alias("producer_seq"), subject.alias("subject"), F.col("props").alias("body"), F.unix_millis(F.col("ts").cast("timestamp")).alias("bt_ms"), F.round(F.col("value") * 100).cast("long").alias("v"), F.col("event_type").alias("kind"))


RECORDS = """records AS (SELECT event_id AS "offset", user_id AS producer_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS producer_seq,
    '/f/' || CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END || '/pub/n-' || (user_id % 7) || '/s-' || user_id || '/' || event_type AS subject,
    props AS body, epoch_us(ts) // 1000 AS bt_ms, CAST(round(value * 100) AS BIGINT) AS v, event_type AS kind FROM events)"""


def records_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records and a tenth of them published again later."""
    r = records(spark, sf_dir)
    n = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    again = r.where("offset % 10 = 0").crossJoin(F.broadcast(n)).withColumn("offset", F.col("offset") + F.col("n")).drop("n")
    return r.unionByName(again)


RECORDS_DUP = RECORDS + """, records_dup AS (SELECT * FROM records UNION ALL SELECT * REPLACE ("offset" + (SELECT count(*) FROM events) AS "offset") FROM records WHERE "offset" % 10 = 0)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log offset, group, upto: what consumer groups have read."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("offset"), F.concat(F.lit("/f/alpha/cur/n-"), (F.col("user_id") % 7).cast("string")).alias("group"), F.col("event_id").alias("upto"))


COMMITS = """commits AS (SELECT event_id AS "offset", '/f/alpha/cur/n-' || (user_id % 7) AS "group", event_id AS upto FROM events WHERE event_type = 'purchase')"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, metric, value, at_ms, revision."""
    r = records(spark, sf_dir)
    return r.select(F.concat(F.lit("n-"), (F.col("producer_id") % 7).cast("string")).alias("origin"), F.col("kind").alias("metric"), F.col("v").alias("value"), F.col("bt_ms").alias("at_ms"), F.col("offset").alias("revision"))


SAMPLES = RECORDS + """, samples AS (SELECT 'n-' || (producer_id % 7) AS origin, kind AS metric, v AS value, bt_ms AS at_ms, "offset" AS revision FROM records)"""


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, offset, kind (In, Out, Resize), client_id, client_seq, ts_logical, text."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    kind = F.when(F.col("event_type") == "click", "In").when(F.col("event_type") == "signup", "Resize").otherwise("Out")
    return e.select(F.col("user_id").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("offset"), kind.alias("kind"), (F.col("user_id") % 3).alias("client_id"), F.row_number().over(w).cast("long").alias("client_seq"), F.col("event_id").alias("ts_logical"), F.col("event_type"), F.col("props").alias("text"))


SESSION_LOG = """session_log AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS "offset",
    CASE event_type WHEN 'click' THEN 'In' WHEN 'signup' THEN 'Resize' ELSE 'Out' END AS kind, user_id % 3 AS client_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS client_seq, event_id AS ts_logical, event_type, props AS text FROM events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cause_stream, cause_off, effect_stream, effect_off, pos (input order)."""
    s = session_log(spark, sf_dir).where("event_type = 'error' AND offset > 0")
    n = table(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("n"))
    name = lambda c: F.concat(F.lit("s-"), c.cast("string"))
    return s.crossJoin(F.broadcast(n)).select(name((F.col("session") + 1) % F.col("n")).alias("cause_stream"), (F.col("offset") - 1).alias("cause_off"), name(F.col("session")).alias("effect_stream"), F.col("offset").alias("effect_off"), F.col("ts_logical").alias("pos"))


EDGES = SESSION_LOG + """, edges AS (SELECT 's-' || ((session + 1) % (SELECT max(user_id) + 1 FROM events)) AS cause_stream, "offset" - 1 AS cause_off,
    's-' || session AS effect_stream, "offset" AS effect_off, ts_logical AS pos FROM session_log WHERE event_type = 'error' AND "offset" > 0)"""


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, upto."""
    s = session_log(spark, sf_dir).groupBy("session").agg(F.max("offset").alias("m"))
    return s.select(F.concat(F.lit("s-"), F.col("session").cast("string")).alias("stream"), F.floor(F.col("m") / 2).alias("upto"))


CUT = """cut AS (SELECT 's-' || session AS stream, max("offset") // 2 AS upto FROM session_log GROUP BY session)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actor, sequence, id, previous: chains by actor, one of them forked."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy(F.col("user_id") % 20).orderBy("event_id")).cast("long")
    h = e.select((F.col("user_id") % 20).alias("actor"), seq.alias("sequence"))
    name = lambda s, x="": F.sha2(F.concat(F.col("actor").cast("string"), F.lit(":"), s.cast("string"), F.lit(x)), 256)
    h = h.select("actor", "sequence", name(F.col("sequence")).alias("id"), F.when(F.col("sequence") > 1, name(F.col("sequence") - 1)).alias("previous"))
    fork = h.where("actor = 3 AND sequence = 5").select("actor", "sequence", name(F.col("sequence"), "x").alias("id"), "previous")
    return h.unionByName(fork)


HEADERS = """h0 AS (SELECT user_id % 20 AS actor, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS sequence FROM events),
    h1 AS (SELECT actor, sequence, sha256(actor || ':' || sequence) AS id, CASE WHEN sequence > 1 THEN sha256(actor || ':' || (sequence - 1)) END AS previous FROM h0),
    headers AS (SELECT * FROM h1 UNION ALL SELECT actor, sequence, sha256(actor || ':' || sequence || 'x'), previous FROM h1 WHERE actor = 3 AND sequence = 5)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, offset, kind (Completion, ToolResult), stop, is_error, text."""
    c = table(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    c = c.withColumn("last", last)
    said = F.col("role") == "assistant"
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("offset"), F.when(said, "Completion").otherwise("ToolResult").alias("kind"), F.when(said, F.when(F.col("turn") == F.col("last"), "EndTurn").otherwise("ToolUse")).alias("stop"), (~said & (F.col("turn") % 3 == 0)).alias("is_error"), "text")


TURNS = """turns AS (SELECT conv_id AS session, turn AS "offset", CASE WHEN role = 'assistant' THEN 'Completion' ELSE 'ToolResult' END AS kind,
    CASE WHEN role = 'assistant' THEN CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'EndTurn' ELSE 'ToolUse' END END AS stop,
    role <> 'assistant' AND turn % 3 = 0 AS is_error, text FROM conversations)"""


def kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, partition, offset, timestamp, bytes, producer_id, producer_seq."""
    r = records(spark, sf_dir)
    part = (F.col("producer_id") % 4).cast("int")
    off = F.row_number().over(Window.partitionBy("kind", part).orderBy("offset")) - 1
    return r.select(F.col("kind").alias("topic"), part.alias("partition"), off.cast("long").alias("offset"), F.col("bt_ms").alias("timestamp"), (F.length("body") + 40).cast("long").alias("bytes"), "producer_id", "producer_seq")


KAFKA = RECORDS + """, kafka AS (SELECT kind AS topic, (producer_id % 4)::INT AS partition, row_number() OVER (PARTITION BY kind, producer_id % 4 ORDER BY "offset") - 1 AS "offset",
    bt_ms AS timestamp, length(body) + 40 AS bytes, producer_id, producer_seq FROM records)"""
