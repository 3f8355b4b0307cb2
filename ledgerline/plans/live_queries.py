"""Queries that run streams to their end, and over payloads that come in parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import hashes as H
from ledgerline.functions import lines as L
from ledgerline.functions import subjects as S
from ledgerline.functions.summaries import bucket_index
from ledgerline.operators.cuts import temporary_folder
from ledgerline.plans.registry import query
from ledgerline.sources import frames
from ledgerline.sources import tables as T
from ledgerline.streaming import live

R = "WITH " + T.RECORDS
SL = "WITH " + T.SESSION_LOG


def _events(spark, sf_dir):
    return live.as_records(live.read_events(spark, sf_dir, 1, "events.parquet"))


def _run(stream, schema: str, mode: str = "append"):
    """The rows that a stream adds until its input ends, written to the shared folder."""
    spark = stream.sparkSession
    path = temporary_folder(spark, "stream")

    def write(batch, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/batch-{batch_id}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", True).parquet(f"{path}/rows")


@query(R + """ SELECT "offset", subject FROM records WHERE "offset" >= 100 AND subject LIKE '/f/alpha/%/error'""")
def stream_subscribe(spark, sf_dir):
    """History and what arrives, for one filter."""
    rows = live.subscribe(_events(spark, sf_dir), "/f/alpha/*/*/*/error", 100).select("offset", "subject")
    return _run(rows, "offset long, subject string").drop("batch")


@query(R + """ SELECT bt_ms - bt_ms % 86400000 AS day, count(*) AS n, sum(v)::BIGINT AS total FROM records GROUP BY 1 HAVING day + 86400000 <= (SELECT max(bt_ms) FROM records)""")
def stream_windows(spark, sf_dir):
    """Daily counts; a day is told once the watermark has passed it."""
    rows = live.tumbling(_events(spark, sf_dir), "day", "0 seconds").select(F.unix_millis("window.start").alias("day"), "n", "total")
    return _run(rows, "day long, n long, total long").drop("batch")


@query(R + """, g AS (SELECT producer_id, bt_ms, CASE WHEN bt_ms - lag(bt_ms) OVER (PARTITION BY producer_id ORDER BY bt_ms) < 21600000 THEN 0 ELSE 1 END AS new FROM records), b AS (SELECT producer_id, bt_ms, sum(new) OVER (PARTITION BY producer_id ORDER BY bt_ms) AS burst FROM g)
    SELECT producer_id, min(bt_ms) AS begins, count(*) AS n FROM b GROUP BY producer_id, burst HAVING max(bt_ms) + 21600000 <= (SELECT max(bt_ms) FROM records)""")
def stream_bursts(spark, sf_dir):
    """Producers' bursts of activity, each told when it is over."""
    rows = live.bursts(_events(spark, sf_dir), "6 hours", "0 seconds").select("producer_id", F.unix_millis("session_window.start").alias("begins"), "n")
    return _run(rows, "producer_id long, begins long, n long").drop("batch")


@query(R + """ SELECT subject, max("offset") AS "offset", arg_max(body, "offset") AS body FROM records GROUP BY subject""")
def stream_signals(spark, sf_dir):
    """The value that each subject's subscriber was told last."""
    told = _run(live.signals(_events(spark, sf_dir)), "subject string, offset long, body string", "update")
    return told.groupBy("subject").agg(F.max_by(F.struct("offset", "body"), F.struct("batch", "offset")).alias("r")).select("subject", "r.offset", "r.body")


@query(R + """ SELECT producer_id, count(DISTINCT "offset" // 2) AS keys FROM records GROUP BY producer_id""")
def stream_exactly_once(spark, sf_dir):
    """Records whose key repeats, written by a stream, and its first batch again after it: each key once."""
    path = temporary_folder(spark, "sink")
    rows = _events(spark, sf_dir).withColumn("key", F.floor(F.col("offset") / 2))
    write = live.exactly_once(path, ["producer_id", "key"], "q")
    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", temporary_folder(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    first = live.as_records(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("key", F.floor(F.col("offset") / 2))
    live.exactly_once(path, ["producer_id", "key"], "again")(first, 0)
    return spark.read.parquet(path).groupBy("producer_id").agg(F.count("key").alias("keys"))


CLASSIFIED = """s AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, epoch_us(ts) // 1000 AS ms, event_type, props FROM events),
    p AS (SELECT *, event_type || props || CASE WHEN event_type = 'error' THEN ' $' ELSE '' END AS line, lead(ms) OVER (PARTITION BY session ORDER BY pos) AS next_ms FROM s),
    c AS (SELECT *, max(CASE WHEN line IS DISTINCT FROM before THEN pos END) OVER (PARTITION BY session ORDER BY pos) AS changed FROM (SELECT *, lag(line) OVER (PARTITION BY session ORDER BY pos) AS before FROM p)),
    m AS (SELECT *, bool_or(event_type = 'signup') OVER (PARTITION BY session ORDER BY pos) AS marked FROM c),
    q AS (SELECT * FROM m WHERE next_ms - ms >= 43200000 OR next_ms IS NULL AND ms + 43200000 <= (SELECT max(ms) FROM s))"""


@query("WITH " + CLASSIFIED + """ SELECT session, pos AS "offset", 'CommandEnd' AS kind, (pos % 5)::INT AS exit FROM s WHERE event_type = 'signup' UNION ALL SELECT session, changed, 'Quiesced', NULL FROM q UNION ALL SELECT session, changed, 'PromptReady', NULL FROM q WHERE NOT marked AND event_type = 'error'""")
def stream_classify(spark, sf_dir):
    """Marks and idle runs of twelve hours in sessions whose screen is cleared by each output."""
    e = live.read_events(spark, sf_dir, 1, "events.parquet")
    pos = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("offset"))
    e = e.join(pos, "event_id")
    text = F.concat(F.lit("\x1b[2J\x1b[H"), F.col("event_type"), F.col("props"), F.when(F.col("event_type") == "error", " $").otherwise(""), F.when(F.col("event_type") == "signup", F.concat(F.lit("\x1b]133;D;"), (F.col("offset") % 5).cast("string"), F.lit("\x07"))).otherwise(""))
    rows = e.select(F.col("user_id").alias("session"), "offset", F.col("ts").cast("timestamp").alias("at"), F.lit("Out").alias("kind"), text.alias("text"), F.lit(80).alias("cols"), F.lit(3).alias("rows"))
    return _run(live.classify(rows, 43_200_000, "shell", rows=3), "session long, offset long, kind string, exit int").drop("batch")


@query(R + """, g AS (SELECT producer_id, "offset", bt_ms, lead(bt_ms) OVER (PARTITION BY producer_id ORDER BY "offset") AS next FROM records) SELECT producer_id AS session, "offset", bt_ms + 86400000 AS fired_ms FROM g WHERE next - bt_ms >= 86400000 OR next IS NULL AND bt_ms + 86400000 <= (SELECT max(bt_ms) FROM records)""")
def stream_wills(spark, sf_dir):
    """Wills of sessions that have been silent for a day."""
    rows = _events(spark, sf_dir).select(F.col("producer_id").alias("session"), "offset", "at")
    return _run(live.wills(rows, 86_400_000), "session long, offset long, fired_ms long").drop("batch")


@query(R + """, g AS (SELECT producer_id, bt_ms, lead(bt_ms) OVER (PARTITION BY producer_id ORDER BY "offset") AS next FROM records) SELECT producer_id, bt_ms + 43200000 AS at_ms FROM g WHERE next - bt_ms >= 43200000 OR next IS NULL AND bt_ms + 43200000 <= (SELECT max(bt_ms) FROM records)""")
def stall_wakes(spark, sf_dir):
    """A producer that is idle for half a day is reported once for each idle run."""
    r = T.records(spark, sf_dir)
    now = r.agg(F.max("bt_ms").alias("now"))
    following = F.lead("bt_ms").over(Window.partitionBy("producer_id").orderBy("offset"))
    idle = r.select("producer_id", "bt_ms", following.alias("next")).crossJoin(F.broadcast(now)).where("coalesce(next, now) - bt_ms >= 43200000")
    return idle.select("producer_id", (F.col("bt_ms") + 43_200_000).alias("at_ms"))


# payloads in parts

SSE = """d AS (SELECT conv_id, turn, text, unnest(range(0, greatest(length(text), 1), 7)) AS at_ FROM conversations WHERE role = 'assistant')"""


@query("SELECT conv_id, turn, sha256(text) AS whole, CASE WHEN turn % 3 = 0 THEN 'tool_use' ELSE 'end_turn' END AS stop, CASE WHEN turn % 3 = 0 THEN '{\"q\":' || conv_id || '}' END AS input FROM conversations WHERE role = 'assistant'")
def sse_completion(spark, sf_dir):
    """Completions put together from event streams that come in chunks of 50 characters, cut anywhere."""
    c = T.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    event = lambda name, data: F.concat(F.lit(f"event: {name}\ndata: "), data, F.lit("\n\n"))
    at = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(7))
    delta = F.transform(at, lambda i: event("content_block_delta", F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), F.substr("text", i + 1, F.lit(7)).alias("text")).alias("delta")))))
    part = lambda t: event("content_block_delta", F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(1).alias("index"), F.struct(F.lit("input_json_delta").alias("type"), t.alias("partial_json")).alias("delta"))))
    tool = F.when(F.col("turn") % 3 == 0, F.concat(part(F.lit('{"q":')), F.lit(": a comment\n\n"), part(F.concat(F.col("conv_id").cast("string"), F.lit("}"))))).otherwise("")
    stop = event("message_delta", F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(F.when(F.col("turn") % 3 == 0, "tool_use").otherwise("end_turn").alias("stop_reason")).alias("delta"))))
    whole = c.select("conv_id", "turn", F.concat(F.array_join(delta, ""), tool, stop).alias("body"))
    cut = F.sequence(F.lit(0), F.floor((F.length("body") - 1) / 50).cast("int"))
    chunks = whole.select("conv_id", "turn", F.explode(cut).alias("n"), "body").select("conv_id", "turn", "n", F.substr("body", F.col("n") * 50 + 1, F.lit(50)).alias("chunk"))
    return L.assembled(chunks, ["conv_id", "turn"], "n", "chunk").select("conv_id", "turn", F.sha2(F.encode("text", "UTF-8"), 256).alias("whole"), "stop", "input")


COMPLETIONS = """c AS (SELECT "offset", CASE "offset" % 5 WHEN 0 THEN '{"content":[{"type":"text","text":"' || kind || '"},{"type":"tool_use","id":"t' || "offset" || '","name":"run","input":{"k":' || v || '}},{"type":"text","text":"!"}],"stop_reason":"tool_use"}'
    WHEN 1 THEN '{"content":[{"type":"text","text":"' || kind || '"}],"stop_reason":"end_turn"}' WHEN 2 THEN '{"content":[],"stop_reason":"max_tokens"}' WHEN 3 THEN '{"content":[{"type":"text","text":"cut' ELSE '[' || v || ']' END AS doc FROM records)"""


@query(R + ", " + COMPLETIONS + """ SELECT "offset", CASE "offset" % 5 WHEN 0 THEN kind || '!' WHEN 1 THEN kind WHEN 2 THEN '' END AS text, CASE WHEN "offset" % 5 = 0 THEN 'run' END AS tool, CASE WHEN "offset" % 5 = 0 THEN '{"k":' || v || '}' END AS input, CASE "offset" % 5 WHEN 0 THEN 'tool_use' WHEN 1 THEN 'end_turn' WHEN 2 THEN 'max_tokens' END AS stop FROM records""")
def completion_documents(spark, sf_dir):
    """Text, tool call and stop reason of completion documents; cut or other documents are refused."""
    o, kind, v = F.col("offset"), F.col("kind"), F.col("v").cast("string")
    doc = (
        F.when(o % 5 == 0, F.concat(F.lit('{"content":[{"type":"text","text":"'), kind, F.lit('"},{"type":"tool_use","id":"t'), o.cast("string"), F.lit('","name":"run","input":{"k":'), v, F.lit('}},{"type":"text","text":"!"}],"stop_reason":"tool_use"}')))
        .when(o % 5 == 1, F.concat(F.lit('{"content":[{"type":"text","text":"'), kind, F.lit('"}],"stop_reason":"end_turn"}')))
        .when(o % 5 == 2, F.lit('{"content":[],"stop_reason":"max_tokens"}')).when(o % 5 == 3, F.lit('{"content":[{"type":"text","text":"cut')).otherwise(F.concat(F.lit("["), v, F.lit("]")))
    )
    return T.records(spark, sf_dir).select("offset", L.completion(doc).alias("c")).select("offset", "c.text", "c.tool", "c.input", "c.stop")


@query(R + """, n AS (SELECT producer_id, count(*) AS n FROM records GROUP BY producer_id) SELECT r.producer_id, producer_seq - 1 AS pos, CASE producer_id % 3 WHEN 0 THEN 'Clean' WHEN 1 THEN 'Torn' ELSE CASE WHEN n // 2 < n - 1 THEN 'Fault' ELSE 'Torn' END END AS ending, body FROM records r JOIN n USING (producer_id) WHERE producer_id % 3 = 0 OR producer_id % 3 = 1 AND producer_seq < n OR producer_id % 3 = 2 AND producer_seq <= n // 2
    UNION ALL SELECT producer_id, NULL, 'Torn', NULL FROM n WHERE n = 1 AND producer_id % 3 > 0""")
def frame_recovery(spark, sf_dir):
    """Framed logs of producers, whole, cut short or damaged in the middle: what can be read, and how each ends."""

    def log_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = [frames.encode(b.encode()) for b in rows.sort_values("offset")["body"]]
        if key[0] % 3 == 1:
            made[-1] = made[-1][:-3]
        elif key[0] % 3 == 2:
            bad = made[len(made) // 2]
            made[len(made) // 2] = bad[:-1] + bytes([bad[-1] ^ 1])
        return pd.DataFrame({"path": [str(key[0])], "content": [b"".join(made)]})

    logs = T.records(spark, sf_dir).select("producer_id", "offset", "body").groupBy("producer_id").applyInPandas(log_of, "path string, content binary")
    return frames.scan_frames(logs).select(F.col("path").cast("long").alias("producer_id"), F.col("offset").alias("pos"), "ending", F.decode("payload", "UTF-8").alias("body"))


@query(R + """, b AS (SELECT kind, CASE WHEN v < 32 THEN v ELSE (floor(log2(v)) - 4)::BIGINT * 32 + (v >> (floor(log2(v)) - 5)::INT) - 32 END AS i, count(*) AS n FROM records WHERE v >= 0 GROUP BY ALL),
    d AS (SELECT kind, i, n, i - coalesce(lag(i) OVER (PARTITION BY kind ORDER BY i) + 1, 0) AS step FROM b), s AS (SELECT kind, min(v) AS low, max(v) AS high, sum(v)::BIGINT AS total FROM records WHERE v >= 0 GROUP BY kind),
    w AS (SELECT kind, list_concat(list_concat([count(*)], flatten(list([step, n] ORDER BY i))), [any_value(low), any_value(high), any_value(total)]) AS words FROM d JOIN s USING (kind) GROUP BY kind)
    SELECT kind, '5301' || array_to_string(list_transform(words, lambda x: array_to_string(list_transform(range(greatest(1, len(list_filter(range(9), lambda j: x // (1::BIGINT << (7 * j)) > 0)))), lambda j: printf('%02x', ((x // (1::BIGINT << (7 * j))) % 128 + CASE WHEN x // (1::BIGINT << (7 * j)) >= 128 THEN 128 ELSE 0 END)::INT)), '')), '') AS code FROM w""")
def summary_codes(spark, sf_dir):
    """Summaries in their canonical bytes: buckets by their distance, counts, then minimum, maximum and sum, all as varints."""
    r = T.records(spark, sf_dir).where("v >= 0")
    buckets = r.groupBy("kind", bucket_index(F.col("v")).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    listed = buckets.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "n"))).alias("b"))  # a layout has at most some thousand buckets
    step = F.transform("b", lambda x, k: F.array(x["i"] - F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get("b", k - 1)["i"] + 1), x["n"]))
    whole = listed.join(r.groupBy("kind").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total")), "kind")
    words = F.concat(F.array(F.size("b").cast("long")), F.flatten(step), F.array("low", "high", "total"))
    return whole.select("kind", F.concat(F.lit("5301"), F.array_join(F.transform(words, H.varint_hex), "")).alias("code"))


@query(R + """, x AS (SELECT producer_id, "offset", CASE WHEN regexp_matches(subject, '^/f/alpha/.+$') THEN 'keep' WHEN kind = 'error' THEN 'drop' END AS old, CASE WHEN regexp_matches(subject, '^/f/[^/]+/pub/n-2/.+$') THEN 'keep' WHEN kind IN ('error', 'signup') THEN 'drop' END AS new FROM records),
    t AS (SELECT *, old IS NOT NULL AND new IS NOT NULL AND old <> new AS differs, coalesce(bool_or(old IS NOT NULL AND new IS NOT NULL AND old <> new) OVER (PARTITION BY producer_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS tainted FROM x)
    SELECT producer_id, count(*) FILTER (WHERE differs) AS differs, count(*) FILTER (WHERE old = new) AS same, count(*) FILTER (WHERE old IS NULL OR new IS NULL) AS unknown, count(*) FILTER (WHERE tainted) AS tainted FROM t GROUP BY producer_id""")
def shadow_decisions(spark, sf_dir):
    """What two sets of rules decide about each record: same, different or unknown, and how many rows follow a difference."""
    s, kind = F.col("subject"), F.col("kind")
    old = F.when(S.matches(s, "/f/alpha/>"), "keep").when(kind == "error", "drop")
    new = F.when(S.matches(s, "/f/*/pub/n-2/>"), "keep").when(kind.isin("error", "signup"), "drop")
    r = T.records(spark, sf_dir).select("producer_id", "offset", old.alias("old"), new.alias("new")).withColumn("differs", F.coalesce(F.col("old") != F.col("new"), F.lit(False)))
    before = F.bool_or("differs").over(Window.partitionBy("producer_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("tainted", F.coalesce(before, F.lit(False)))
    return r.groupBy("producer_id").agg(F.count_if("differs").alias("differs"), F.count_if(F.col("old") == F.col("new")).alias("same"), F.count_if(F.col("old").isNull() | F.col("new").isNull()).alias("unknown"), F.count_if("tainted").alias("tainted"))


LAGGING = """classed AS (SELECT * FROM records WHERE regexp_matches(subject, '^/f/alpha/pub/n-2/.+$')), read_ AS (SELECT max("offset") AS upto FROM records WHERE kind = 'purchase' AND producer_id % 7 = 2 AND "offset" < (SELECT count(*) // 2 FROM events))"""


@query(R + ", " + LAGGING + """ SELECT "offset" FROM classed, read_ WHERE "offset" > upto AND "offset" < (SELECT count(*) * 9 // 10 FROM events)""")
def retain_carry_lagging(spark, sf_dir):
    """Rows below the cut that a reader who has read half of the log still needs."""
    r = T.records(spark, sf_dir)
    n = T.table(spark, sf_dir, "events").count()
    upto = r.where((F.col("kind") == "purchase") & (F.col("producer_id") % 7 == 2) & (F.col("offset") < n // 2)).agg(F.max("offset").alias("upto"))
    return r.where(S.matches(F.col("subject"), "/f/alpha/pub/n-2/>") & (F.col("offset") < n * 9 // 10)).crossJoin(F.broadcast(upto)).where("offset > upto").select("offset")
