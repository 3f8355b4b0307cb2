"""Queries over the record log, consumer groups, summaries and cuts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import subjects as S
from ledgerline.functions.summaries import bucket_high, bucket_index, bucket_low, time_bucket
from ledgerline.operators import cuts, groups, log, summary
from ledgerline.plans.registry import query
from ledgerline.sources import tables as T

FILTER = "/f/*/pub/*/*/error"
REGEX = "^/f/[^/]+/pub/[^/]+/[^/]+/error$"
R = "WITH " + T.RECORDS
COLUMNS = ("offset", "producer_id", "producer_seq", "subject")
SQLCOLS = '"offset", producer_id, producer_seq, subject'


@query(R + f""" SELECT subject, max("offset") AS "offset", arg_max(producer_id, "offset") AS producer_id, arg_max(body, "offset") AS body FROM records WHERE regexp_matches(subject, '{REGEX}') GROUP BY subject""")
def last_value(spark, sf_dir):
    return log.last_value(T.records(spark, sf_dir), FILTER)


@query(R + f' SELECT {SQLCOLS} FROM records WHERE "offset" >= 500')
def log_scan_from(spark, sf_dir):
    return log.scan_from(T.records(spark, sf_dir), 500).select(*COLUMNS)


@query(R + f""", p AS (SELECT {SQLCOLS} FROM records WHERE "offset" >= 100 AND "offset" < 400 AND regexp_matches(subject, '{REGEX}') ORDER BY "offset" LIMIT 20)
    SELECT *, CASE WHEN (SELECT count(*) FROM p) = 20 THEN (SELECT max("offset") + 1 FROM p) ELSE (SELECT max("offset") + 1 FROM records WHERE "offset" < 400) END AS next FROM p""")
def fetch_page(spark, sf_dir):
    return log.fetch(T.records(spark, sf_dir), 100, FILTER, 20, 300).select(*COLUMNS, "next")


@query(R + """ SELECT "offset", subject, 'gap' AS mark, 0::BIGINT AS gap_from, 100::BIGINT AS gap_to FROM records WHERE "offset" >= 50 AND "offset" < 100 AND "offset" % 3 = 0
    UNION ALL SELECT "offset", subject, 'live', NULL, NULL FROM records WHERE "offset" >= 100 AND "offset" < 200""")
def fetch_told(spark, sf_dir):
    """Below the oldest retained record only held ones are left, and the reader is told."""
    r = T.records(spark, sf_dir)
    held = r.where("offset < 100 AND offset % 3 = 0").where("offset >= 50")
    told = held.select("offset", "subject", F.lit("gap").alias("mark"), F.lit(0).cast("long").alias("gap_from"), F.lit(100).cast("long").alias("gap_to"))
    return told.unionByName(r.where("offset >= 100 AND offset < 200").select("offset", "subject", F.lit("live").alias("mark")), allowMissingColumns=True)


@query(R + f' SELECT {SQLCOLS}, bt_ms FROM records WHERE "offset" BETWEEN 10 AND 60')
def fetch_stamped(spark, sf_dir):
    return log.scan_from(T.records(spark, sf_dir), 10).where("offset <= 60").select(*COLUMNS, "bt_ms")


@query(R + f""" SELECT {SQLCOLS} FROM records WHERE "offset" >= 50 AND regexp_matches(subject, '^/f/alpha/.+$')""")
def subscribe_replay(spark, sf_dir):
    return log.scan_from(T.records(spark, sf_dir), 50, "/f/alpha/>").select(*COLUMNS)


@query(R + ", " + T.COMMITS + f""" SELECT {SQLCOLS} FROM records WHERE "offset" > (SELECT max(upto) FROM commits WHERE "group" = '/f/alpha/cur/n-2')""")
def group_resume(spark, sf_dir):
    return groups.resume(T.commits(spark, sf_dir), T.records(spark, sf_dir), "/f/alpha/cur/n-2").select(*COLUMNS)


@query(R + """ SELECT "offset", subject, body FROM (SELECT "offset", CASE WHEN "offset" = 77 THEN '/f/alpha/pub/n-0/s-0/error' ELSE subject END AS subject, CASE WHEN "offset" = 77 THEN 'swapped' ELSE body END AS body FROM records)
    WHERE regexp_matches(subject, '^/f/alpha/.+$')""")
def fork_subscribe(spark, sf_dir):
    forked = log.fork(T.records(spark, sf_dir), 77, subject=F.lit("/f/alpha/pub/n-0/s-0/error"), body=F.lit("swapped"))
    return log.scan_from(forked, 0, "/f/alpha/>").select("offset", "subject", "body")


@query("WITH " + T.SESSION_LOG + """ SELECT session, "offset", CASE WHEN session = 3 AND "offset" = 5 THEN 'replaced' ELSE text END AS text FROM session_log""")
def fork_swap(spark, sf_dir):
    s = T.session_log(spark, sf_dir)
    return s.select("session", "offset", F.when((F.col("session") == 3) & (F.col("offset") == 5), "replaced").otherwise(F.col("text")).alias("text"))


@query(R + """ SELECT subject, max("offset") AS version, arg_max(body, "offset") AS body FROM records WHERE kind = 'view' GROUP BY subject""")
def signal_current(spark, sf_dir):
    return log.last_value(T.records(spark, sf_dir).where("kind = 'view'"), "/>", ("offset", "body")).withColumnRenamed("offset", "version")


@query(R + """ SELECT (producer_id % 4)::INT AS shard, row_number() OVER (PARTITION BY producer_id % 4 ORDER BY "offset") - 1 AS shard_offset, subject FROM records""")
def sharded_fanin(spark, sf_dir):
    r = T.records(spark, sf_dir).withColumn("shard", (F.col("producer_id") % 4).cast("int"))
    return log.dense_offsets(r, ["shard"], "offset").select("shard", F.col("dense").cast("long").alias("shard_offset"), "subject")


K = "WITH " + T.KAFKA


@query(K + """, w AS (SELECT *, sum(bytes) OVER (PARTITION BY topic, partition ORDER BY "offset") AS upto, row_number() OVER (PARTITION BY topic, partition ORDER BY "offset") AS i FROM kafka WHERE "offset" >= 5)
    SELECT topic, partition, "offset", bytes FROM w WHERE upto <= 1000 OR i = 1""")
def kafka_fetch_budget(spark, sf_dir):
    k = T.kafka(spark, sf_dir).where("offset >= 5")
    return log.within_budget(k, ["topic", "partition"], "offset", "bytes", 1000, at_least_one=True).select("topic", "partition", "offset", "bytes")


@query(K + """ SELECT topic, partition, min("offset") AS earliest, max("offset") + 1 AS high_watermark, min("offset") FILTER (WHERE timestamp >= (SELECT min(timestamp) + 86400000 FROM kafka)) AS at_time FROM kafka GROUP BY topic, partition""")
def list_offset(spark, sf_dir):
    k = T.kafka(spark, sf_dir)
    since = k.agg((F.min("timestamp") + 86_400_000).alias("since"))
    return k.crossJoin(F.broadcast(since)).groupBy("topic", "partition").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("high_watermark"), F.min(F.when(F.col("timestamp") >= F.col("since"), F.col("offset"))).alias("at_time"))


@query(K + """ SELECT topic, partition, count(*) AS n, count(*) FILTER (WHERE bad) AS out_of_sequence FROM (SELECT topic, partition, producer_seq <= lag(producer_seq, 1, 0::BIGINT) OVER (PARTITION BY topic, partition, producer_id ORDER BY "offset") AS bad FROM kafka) GROUP BY topic, partition""")
def kafka_seq_check(spark, sf_dir):
    w = Window.partitionBy("topic", "partition", "producer_id").orderBy("offset")
    k = T.kafka(spark, sf_dir).withColumn("bad", F.col("producer_seq") <= F.lag("producer_seq", 1, 0).over(w))
    return k.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("out_of_sequence"))


@query(R + f""" SELECT subject, regexp_matches(subject, '{REGEX}') AS by_kind, regexp_matches(subject, '^/f/beta/.+$') AS by_tail, subject = '/f/beta/pub/n-1/s-1/view' AS exact FROM (SELECT DISTINCT subject FROM records)""")
def filter_match(spark, sf_dir):
    s = T.records(spark, sf_dir).select("subject").distinct()
    return s.select("subject", S.matches(F.col("subject"), FILTER).alias("by_kind"), S.matches(F.col("subject"), "/f/beta/>").alias("by_tail"), S.matches(F.col("subject"), "/f/beta/pub/n-1/s-1/view").alias("exact"))


PAIRS = [("/f/>", "/f/a"), ("/f/>", "/f"), ("/f/*", "/f/a"), ("/f/*", "/f/>"), ("/f/*/c", "/f/b/c"), ("/f/a", "/f/*"), ("/f/a", "/f/a"), ("/*/>", "/f/*/>"), ("/f/*", "/f/a/b"), ("/>", "/*")]
CONTAINED = [True, False, True, False, True, False, True, True, False, True]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for (a, b), c in zip(PAIRS, CONTAINED, strict=True)) + ") AS t(outer_filter, inner_filter, contained)")
def filter_contains(spark, sf_dir):
    return spark.createDataFrame([(a, b, S.contains(a, b)) for a, b in PAIRS], "outer_filter string, inner_filter string, contained boolean")


SUBJECTS = [("/a/b", None), ("", "Empty"), ("a/b", "MissingLeadingSlash"), ("/a//b", "EmptySegment"), ("/a/*", "ContainsWildcard"), ("/a>b/", "ContainsWildcard"), ("/", "EmptySegment"), ("/a b", None), ("//*", "EmptySegment"), ("/*//", "ContainsWildcard")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in SUBJECTS) + ") AS t(subject, error)")
def subject_validate(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in SUBJECTS], "subject string").select("subject", S.subject_error(F.col("subject")).alias("error"))


@query(R + """ SELECT subject, CASE WHEN hops >= 3 OR subject = '/f/beta/pub/n-1' OR starts_with(subject, '/f/beta/pub/n-1/') OR starts_with(subject, '/x/y/') OR NOT starts_with(subject, '/f/') THEN NULL ELSE '/x/y' || substr(subject, 3) END AS renamed
    FROM (SELECT subject, min(producer_id % 5) AS hops FROM records GROUP BY subject)""")
def subject_rewrite(spark, sf_dir):
    s = T.records(spark, sf_dir).groupBy("subject").agg(F.min(F.col("producer_id") % 5).alias("hops"))
    return s.select("subject", S.rewrite(F.col("subject"), F.col("hops"), 3, strip="/f", add="/x/y", exclude=("/f/beta/pub/n-1",)).alias("renamed"))


D = "WITH " + T.RECORDS_DUP


@query(D + """ SELECT producer_id, producer_seq, min("offset") AS "offset" FROM records_dup GROUP BY ALL""")
def dedup_first(spark, sf_dir):
    return log.dedup_first(T.records_dup(spark, sf_dir).select("producer_id", "producer_seq", "offset"), "producer_id", "producer_seq")


@query(D + """ SELECT "offset", min("offset") OVER (PARTITION BY producer_id, producer_seq) AS original, "offset" <> min("offset") OVER (PARTITION BY producer_id, producer_seq) AS duplicate FROM records_dup""")
def publish_idempotent(spark, sf_dir):
    return log.publish(T.records_dup(spark, sf_dir)).select("offset", "original", "duplicate")


@query(D + """ SELECT "offset" FROM records_dup d WHERE "offset" >= (SELECT count(*) FROM events) AND NOT EXISTS (SELECT 1 FROM records r WHERE r."offset" < (SELECT count(*) // 2 FROM events) AND r.producer_id = d.producer_id AND r.producer_seq = d.producer_seq)""")
def dedup_lookup(spark, sf_dir):
    """Late publishes whose key an index of the log's first half doesn't have."""
    r = T.records(spark, sf_dir)
    n = T.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    late = T.records_dup(spark, sf_dir).crossJoin(F.broadcast(n)).where("offset >= n")
    index = r.crossJoin(F.broadcast(n)).where("offset < floor(n / 2)").select("producer_id", "producer_seq")
    return late.join(index, ["producer_id", "producer_seq"], "left_anti").select("offset")


C = "WITH " + T.COMMITS


@query(C + """ SELECT "group", max(upto) AS upto FROM commits GROUP BY "group" """)
def group_cursor(spark, sf_dir):
    return groups.cursors(T.commits(spark, sf_dir))


@query(R + ", " + T.COMMITS + """ SELECT "group", max(upto) AS upto, (SELECT max("offset") FROM records) - max(upto) AS lag FROM commits GROUP BY "group" """)
def group_lag(spark, sf_dir):
    return groups.lag(T.commits(spark, sf_dir), T.records(spark, sf_dir))


@query(C + """ SELECT "offset" AS cause_off, "group" AS cause_stream, upto AS effect_upto FROM commits""")
def commit_edges(spark, sf_dir):
    return T.commits(spark, sf_dir).select(F.col("offset").alias("cause_off"), F.col("group").alias("cause_stream"), F.col("upto").alias("effect_upto"))


@query(C + """ SELECT "offset", lower(to_hex((9223372036854775808::HUGEINT + "offset")::UBIGINT)) AS ack_key FROM commits""")
def ack_keys(spark, sf_dir):
    """2**63 | offset, as text: it exceeds a signed long."""
    return T.commits(spark, sf_dir).select("offset", F.lower(F.hex(F.expr("shiftleft(1L, 63)").bitwiseOR(F.col("offset")))).alias("ack_key"))


@query(R + """ SELECT subject, max("offset") AS "offset" FROM records WHERE subject > '/f/alpha/pub/n-3' GROUP BY subject ORDER BY subject LIMIT 25""")
def last_page(spark, sf_dir):
    return log.page_after(log.last_value(T.records(spark, sf_dir), "/>", ("offset",)), "subject", "/f/alpha/pub/n-3", 25)


@query(R + """ SELECT subject, max("offset") AS "offset" FROM records GROUP BY subject HAVING max("offset") < (SELECT count(*) * 9 // 10 FROM events)""")
def last_at_head(spark, sf_dir):
    """At a head of nine tenths of the log."""
    head = T.table(spark, sf_dir, "events").count() * 9 // 10
    return log.last_at_head(T.records(spark, sf_dir), "/>", head).select("subject", "offset")


@query(R + """ SELECT subject, max("offset") AS "offset" FROM records WHERE "offset" < (SELECT count(*) * 9 // 10 FROM events) GROUP BY subject""")
def last_as_of_head(spark, sf_dir):
    head = T.table(spark, sf_dir, "events").count() * 9 // 10
    return log.last_at_head(T.records(spark, sf_dir), "/>", head, asof=True).select("subject", "offset")


@query(R + f' SELECT {SQLCOLS} FROM records WHERE "offset" >= 40 ORDER BY "offset" LIMIT 30')
def drain_page(spark, sf_dir):
    return log.scan_from(T.records(spark, sf_dir), 40).orderBy("offset").limit(30).select(*COLUMNS)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS dense FROM events")
def dense_offset(spark, sf_dir):
    return log.dense_offsets(T.table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id").withColumn("dense", F.col("dense").cast("long"))


@query(D + """ SELECT producer_id, "offset", producer_seq - lag(producer_seq) OVER (PARTITION BY producer_id ORDER BY "offset") AS step FROM records_dup WHERE producer_seq % 5 <> 0 QUALIFY step <> 1""")
def sequence_gaps(spark, sf_dir):
    r = T.records_dup(spark, sf_dir).where("producer_seq % 5 <> 0")
    step = F.col("producer_seq") - F.lag("producer_seq").over(Window.partitionBy("producer_id").orderBy("offset"))
    return r.select("producer_id", "offset", step.alias("step")).where("step <> 1")


@query(R + """ SELECT producer_id, "offset", max(bt_ms - v % 1000 * 60000) OVER (PARTITION BY producer_id ORDER BY "offset") AS bt FROM records""")
def monotone_bt(spark, sf_dir):
    r = T.records(spark, sf_dir).withColumn("wall", F.col("bt_ms") - F.col("v") % 1000 * 60000)
    return r.select("producer_id", "offset", log.monotone("wall", ["producer_id"], "offset").alias("bt"))


@query("WITH " + T.SESSION_LOG + """, s AS (SELECT *, (client_seq * 7) % 11 AS s FROM session_log WHERE kind = 'In')
    SELECT session, "offset", s AS client_seq, s > coalesce(max(s) OVER (PARTITION BY session, client_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM s""")
def input_dedup(spark, sf_dir):
    s = T.session_log(spark, sf_dir).where("kind = 'In'").withColumn("client_seq", F.col("client_seq") * 7 % 11)
    seen = F.max("client_seq").over(Window.partitionBy("session", "client_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    return s.select("session", "offset", "client_seq", (F.col("client_seq") > F.coalesce(seen, F.lit(-1))).alias("accepted"))


@query("WITH " + T.SESSION_LOG + " SELECT session, client_id, max(client_seq) AS high_water FROM session_log WHERE kind = 'In' GROUP BY ALL")
def client_high_water(spark, sf_dir):
    return T.session_log(spark, sf_dir).where("kind = 'In'").groupBy("session", "client_id").agg(F.max("client_seq").alias("high_water"))


@query(R + """ SELECT split_part(subject, '/', 3) AS face, count(*) AS n, sum(length(body))::BIGINT AS bytes FROM records GROUP BY face""")
def face_stats(spark, sf_dir):
    return T.records(spark, sf_dir).groupBy(F.element_at(F.split("subject", "/"), 3).alias("face")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("bytes"))


@query(R + """ SELECT producer_id, count(*) AS subjects FROM (SELECT subject, arg_min(producer_id, "offset") AS producer_id FROM records GROUP BY subject) GROUP BY producer_id""")
def subject_budget(spark, sf_dir):
    first = T.records(spark, sf_dir).groupBy("subject").agg(F.min_by("producer_id", "offset").alias("producer_id"))
    return first.groupBy("producer_id").agg(F.count(F.lit(1)).alias("subjects"))


@query(R + """ SELECT count(*) AS n, min("offset") AS first_offset, max("offset") AS last_offset FROM records WHERE "offset" >= (SELECT count(*) // 10 FROM events) AND "offset" < (SELECT count(*) * 9 // 10 FROM events) AND regexp_matches(subject, '^/f/beta/.+$')""")
def gap_count(spark, sf_dir):
    n = T.table(spark, sf_dir, "events").count()
    given_up = log.scan_from(T.records(spark, sf_dir), n // 10, "/f/beta/>").where(F.col("offset") < n * 9 // 10)
    return given_up.agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query(R + """ SELECT producer_id, min("offset") AS gap_from, max("offset") AS gap_to, CASE WHEN count(*) = count(n) THEN sum(n)::BIGINT END AS records FROM (SELECT producer_id, "offset", CASE WHEN v % 50 <> 0 THEN v % 7 END AS n FROM records) GROUP BY producer_id""")
def gap_merge(spark, sf_dir):
    g = T.records(spark, sf_dir).select("producer_id", "offset", F.when(F.col("v") % 50 != 0, F.col("v") % 7).alias("n"))
    return g.groupBy("producer_id").agg(F.min("offset").alias("gap_from"), F.max("offset").alias("gap_to"), F.when(F.count(F.lit(1)) == F.count("n"), F.sum("n")).alias("records"))


# summaries

BUCKET = "CASE WHEN {v} < 32 THEN {v} ELSE (length(bin({v})) - 5) * 32 + ({v} >> (length(bin({v})) - 6)) - 32 END"
LOW = "CASE WHEN bucket < 32 THEN bucket ELSE (32 + bucket % 32) << (bucket // 32 - 1) END"
HIGH = "CASE WHEN bucket < 32 THEN bucket ELSE ((33 + bucket % 32) << (bucket // 32 - 1)) - 1 END"
M = "WITH " + T.SAMPLES
HIST = f", hist AS (SELECT origin, metric, ({BUCKET.format(v='value')})::INT AS bucket, count(*) AS n, sum(value)::BIGINT AS total, min(value) AS low, max(value) AS high FROM samples GROUP BY ALL)"


@query(f"WITH t AS (SELECT DISTINCT v FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders UNION ALL SELECT o_orderkey FROM orders)), b AS (SELECT v, ({BUCKET.format(v='v')})::INT AS bucket FROM t) SELECT v, bucket, ({LOW})::BIGINT AS low, ({HIGH})::BIGINT AS high FROM b")
def bucket_index_bounds(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    v = o.select(F.round(F.col("o_totalprice") * 100).cast("long").alias("v")).union(o.select("o_orderkey")).distinct()
    b = v.withColumn("bucket", bucket_index(F.col("v")))
    return b.select("v", "bucket", bucket_low(F.col("bucket")).alias("low"), bucket_high(F.col("bucket")).alias("high"))


@query(M + HIST + " SELECT * FROM hist")
def summary_build(spark, sf_dir):
    return summary.histogram(T.samples(spark, sf_dir), "origin", "metric")


@query(M + HIST + " SELECT metric, bucket, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total, min(low) AS low, max(high) AS high FROM hist GROUP BY ALL")
def summary_merge(spark, sf_dir):
    return summary.merge(summary.histogram(T.samples(spark, sf_dir), "origin", "metric"), "metric")


def _quantile_sql(ppm: int) -> str:
    return M + HIST + f""", w AS (SELECT metric, bucket, sum(n)::BIGINT AS n, min(low) AS low, max(high) AS high FROM hist GROUP BY ALL),
    t AS (SELECT metric, sum(n)::BIGINT AS total, min(low) AS vmin, max(high) AS vmax, greatest(1, (({ppm}::HUGEINT * sum(n) + 999999) // 1000000))::BIGINT AS rank FROM w GROUP BY metric),
    c AS (SELECT metric, bucket, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS upto FROM w),
    f AS (SELECT metric, min(bucket) AS bucket FROM c JOIN t USING (metric) WHERE upto >= rank GROUP BY metric),
    b AS (SELECT metric, {LOW} AS lo, {HIGH} AS hi FROM f)
    SELECT metric, (CASE WHEN rank >= total THEN vmax WHEN rank = 1 THEN vmin ELSE least(greatest(lo + (hi - lo) // 2, vmin), vmax) END)::BIGINT AS value FROM b JOIN t USING (metric)"""


@query(_quantile_sql(990_000))
def summary_quantile(spark, sf_dir):
    h = summary.merge(summary.histogram(T.samples(spark, sf_dir), "origin", "metric"), "metric")
    return summary.quantile(h, 990_000, "metric")


@query(_quantile_sql(500_000))
def summary_median(spark, sf_dir):
    h = summary.merge(summary.histogram(T.samples(spark, sf_dir), "origin", "metric"), "metric")
    return summary.quantile(h, 500_000, "metric")


DAYS = ", days AS (SELECT origin, metric, at_ms - at_ms % 86400000 AS window_start, max(revision) AS revision, count(*) AS n, sum(value)::BIGINT AS total FROM samples GROUP BY ALL), offers AS (SELECT * FROM days UNION ALL SELECT origin, metric, window_start, revision - 1, n - 1, total - 5 FROM days)"


def _offers(spark, sf_dir):
    s = summary.windowed(T.samples(spark, sf_dir), "day")
    d = s.groupBy("origin", "metric", "window_start").agg(F.max("revision").alias("revision"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.unionByName(d.select("origin", "metric", "window_start", (F.col("revision") - 1).alias("revision"), (F.col("n") - 1).alias("n"), (F.col("total") - 5).alias("total")))


@query(M + DAYS + " SELECT origin, metric, window_start, r.revision, r.n, r.total FROM (SELECT origin, metric, window_start, max({'revision': revision, 'n': n, 'total': total}) AS r FROM offers GROUP BY ALL)")
def rollup_offer(spark, sf_dir):
    return summary.offer(_offers(spark, sf_dir), "origin", "metric", "window_start")


SPAN = "window_start >= 1704240000000 AND window_start < 1705190400000"


@query(M + DAYS + f", best AS (SELECT origin, metric, window_start, max({{'revision': revision, 'n': n, 'total': total}}) AS r FROM offers GROUP BY ALL) SELECT metric, sum(r.n)::BIGINT AS n, sum(r.total)::BIGINT AS total FROM best WHERE {SPAN} GROUP BY metric")
def rollup_summarize(spark, sf_dir):
    """Newest revisions first, then merged: merging is not idempotent."""
    best = summary.offer(_offers(spark, sf_dir), "origin", "metric", "window_start").where(SPAN)
    return best.groupBy("metric").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(M + DAYS + f", best AS (SELECT origin, metric, window_start, max({{'revision': revision, 'n': n, 'total': total}}) AS r FROM offers GROUP BY ALL) SELECT origin, sum(r.n)::BIGINT AS n, sum(r.total)::BIGINT AS total FROM best WHERE {SPAN} GROUP BY origin")
def rollup_per_origin(spark, sf_dir):
    best = summary.offer(_offers(spark, sf_dir), "origin", "metric", "window_start").where(SPAN)
    return best.groupBy("origin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(M + " SELECT metric, 345600000 + (at_ms - 345600000) // 604800000 * 604800000 AS window_start, count(*) AS n, sum(value)::BIGINT AS total FROM samples GROUP BY ALL")
def window_coarsen(spark, sf_dir):
    """Hours first, then weeks from the hours: the same as weeks at once."""
    hours = summary.windowed(T.samples(spark, sf_dir), "hour").groupBy("metric", F.col("window_start").alias("at_ms")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return summary.windowed(hours, "week").groupBy("metric", "window_start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(M + " SELECT origin, at_ms - at_ms % 60000 AS minute, at_ms - at_ms % 3600000 AS hour, at_ms // 2000 AS bucket, count(*) AS n FROM samples GROUP BY ALL")
def window_aligned(spark, sf_dir):
    s = T.samples(spark, sf_dir)
    minute, hour = summary.window_start(F.col("at_ms"), "minute"), summary.window_start(F.col("at_ms"), "hour")
    return s.groupBy("origin", minute.alias("minute"), hour.alias("hour"), time_bucket(F.col("at_ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(M + " SELECT metric, sum(value)::BIGINT AS total FROM (SELECT metric, origin, max(value) AS value FROM samples GROUP BY ALL) GROUP BY metric")
def counter_total(spark, sf_dir):
    return summary.counter_total(T.samples(spark, sf_dir))


@query(M + " SELECT origin, r.at_ms, r.value FROM (SELECT origin, max({'at_ms': at_ms, 'value': value}) AS r FROM samples GROUP BY origin)")
def gauge_latest(spark, sf_dir):
    return summary.gauge_latest(T.samples(spark, sf_dir))


# cuts

E = "WITH " + T.EDGES + ", " + T.CUT
BAD = """, bad AS (SELECT e.* FROM edges e JOIN cut x ON x.stream = e.effect_stream AND e.effect_off <= x.upto LEFT JOIN cut c ON c.stream = e.cause_stream WHERE c.upto IS NULL OR c.upto < e.cause_off)"""


@query(E + """ SELECT session, "offset" FROM session_log JOIN cut ON stream = 's-' || session WHERE "offset" <= upto""")
def cut_includes(spark, sf_dir):
    s = T.session_log(spark, sf_dir).withColumn("name", F.concat(F.lit("s-"), F.col("session").cast("string")))
    return cuts.includes(s, T.cut(spark, sf_dir), "name", "offset").select("session", "offset")


@query(E + BAD + " SELECT cause_stream, cause_off, effect_stream, effect_off, pos FROM bad ORDER BY pos LIMIT 1")
def cut_first_violation(spark, sf_dir):
    return cuts.violations(T.edges(spark, sf_dir), T.cut(spark, sf_dir)).orderBy("pos").limit(1).select("cause_stream", "cause_off", "effect_stream", "effect_off", "pos")


@query(E + BAD + " SELECT count(*) = 0 AS consistent, count(*) AS n FROM bad")
def cut_consistent(spark, sf_dir):
    return cuts.violations(T.edges(spark, sf_dir), T.cut(spark, sf_dir)).agg((F.count(F.lit(1)) == 0).alias("consistent"), F.count(F.lit(1)).alias("n"))


OTHER = ", other AS (SELECT stream, 40::BIGINT AS upto FROM cut WHERE upto % 3 <> 0)"


def _other(spark, sf_dir):
    return T.cut(spark, sf_dir).where("upto % 3 <> 0").select("stream", F.lit(40).cast("long").alias("upto"))


@query(E + OTHER + " SELECT stream, max(upto)::BIGINT AS upto FROM (SELECT stream, upto FROM cut UNION ALL SELECT * FROM other) GROUP BY stream")
def cut_join(spark, sf_dir):
    return cuts.join(T.cut(spark, sf_dir), _other(spark, sf_dir))


@query(E + OTHER + " SELECT stream, least(c.upto, o.upto)::BIGINT AS upto FROM cut c JOIN other o USING (stream)")
def cut_meet(spark, sf_dir):
    return cuts.meet(T.cut(spark, sf_dir), _other(spark, sf_dir))


@query(E + OTHER + ", j AS (SELECT stream, least(c.upto, o.upto) AS upto FROM cut c JOIN other o USING (stream)) SELECT NOT EXISTS (SELECT 1 FROM j LEFT JOIN cut c USING (stream) WHERE c.upto IS NULL OR c.upto < j.upto) AS dominates")
def cut_dominates(spark, sf_dir):
    c = T.cut(spark, sf_dir)
    return cuts.dominates(c, cuts.meet(c, _other(spark, sf_dir)))


@query("WITH RECURSIVE " + T.EDGES + ", " + T.CUT + """, grow AS (SELECT stream, upto FROM cut UNION SELECT e.cause_stream, e.cause_off FROM grow g JOIN edges e ON e.effect_stream = g.stream AND e.effect_off <= g.upto) SELECT stream, max(upto)::BIGINT AS upto FROM grow GROUP BY stream""")
def cut_heal(spark, sf_dir):
    return cuts.heal(T.edges(spark, sf_dir), T.cut(spark, sf_dir))


@query(E + " SELECT cause_stream, effect_stream, count(*) AS n, min(effect_off) AS first_effect FROM edges WHERE cause_stream <> effect_stream GROUP BY ALL")
def cross_edges(spark, sf_dir):
    return T.edges(spark, sf_dir).where("cause_stream <> effect_stream").groupBy("cause_stream", "effect_stream").agg(F.count(F.lit(1)).alias("n"), F.min("effect_off").alias("first_effect"))
