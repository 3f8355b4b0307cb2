"""Queries over names, lines, codes and payload formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import hashes as H
from ledgerline.functions import lines as L
from ledgerline.plans.registry import query
from ledgerline.sources import tables as T

R = "WITH " + T.RECORDS
U64 = str(1 << 64)


def _values(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(said, r))})" for r in rows)


NAMES = """n AS (SELECT "offset", CASE "offset" % 5 WHEN 0 THEN 'n-' || producer_id WHEN 1 THEN subject WHEN 2 THEN '' WHEN 3 THEN repeat('x', 60 + ("offset" % 9)::INT) ELSE 'é' || producer_id END AS name FROM records)"""


@query(R + ", " + NAMES + f""" SELECT "offset", CASE WHEN name = '' THEN 'Empty' WHEN octet_length(encode(name)) > 64 THEN 'TooLong' WHEN regexp_extract(name, '[^{L.NAME_BYTES}]') <> '' THEN 'Byte ' || lower(hex(encode(regexp_extract(name, '[^{L.NAME_BYTES}]'))))[:2] ELSE 'Ok' END AS verdict FROM n""")
def name_check(spark, sf_dir):
    """Whether a string is a name, and why not."""
    o = F.col("offset")
    name = F.when(o % 5 == 0, F.concat(F.lit("n-"), F.col("producer_id").cast("string"))).when(o % 5 == 1, F.col("subject")).when(o % 5 == 2, F.lit("")).when(o % 5 == 3, F.repeat(F.lit("x"), (F.lit(60) + o % 9).cast("int"))).otherwise(F.concat(F.lit("é"), F.col("producer_id").cast("string")))
    return T.records(spark, sf_dir).select("offset", L.name_verdict(name).alias("verdict"))


@query(R + """, e AS (SELECT "offset", replace(replace('u=' || producer_id || ',' || kind, '=', '=3D'), ',', '=2C') || CASE "offset" % 3 WHEN 0 THEN '' WHEN 1 THEN '=3d' ELSE '=' END AS escaped FROM records)
    SELECT "offset", escaped, CASE WHEN "offset" % 3 <> 2 THEN 'u=' || split_part(split_part(escaped, '=3D', 2), '=2C', 1) || ',' || regexp_replace(split_part(escaped, '=2C', 2), '=3d$', '=') END AS plain FROM e""")
def user_escapes(spark, sf_dir):
    """Names escaped, and unescaped again; a bare equals sign is refused."""
    o = F.col("offset")
    name = L.escape_user(F.concat(F.lit("u="), F.col("producer_id").cast("string"), F.lit(","), F.col("kind")))
    escaped = F.concat(name, F.when(o % 3 == 0, "").when(o % 3 == 1, "=3d").otherwise("="))
    return T.records(spark, sf_dir).select("offset", escaped.alias("escaped"), L.unescape_user(escaped).alias("plain"))


@query(R + f""" SELECT kind, translate(kind || '~_`', '{L.DRAWN_FOR}', '{L.DRAWN}') AS shown, count(*) AS n FROM records GROUP BY ALL""")
def drawn_lines(spark, sf_dir):
    return T.records(spark, sf_dir).groupBy("kind", L.drawn(F.concat(F.col("kind"), F.lit("~_`"))).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT i::INT AS n, CASE WHEN i < 16 THEN [""" + ", ".join(f"'{c}'" for c in L.NAMED) + f"""][i + 1]
    WHEN i < 232 THEN printf('%02x%02x%02x', {list(L.CUBE)}[(i - 16) // 36 + 1], {list(L.CUBE)}[(i - 16) // 6 % 6 + 1], {list(L.CUBE)}[(i - 16) % 6 + 1])
    ELSE printf('%02x%02x%02x', (i - 232) * 10 + 8, (i - 232) * 10 + 8, (i - 232) * 10 + 8) END AS rgb FROM range(256) r(i)""")
def palette_colours(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("n"), L.colour(F.col("id")).alias("rgb"))


TURN_LINES = """t AS (SELECT conv_id, turn, max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS cause, role FROM conversations),
    l AS (SELECT conv_id, turn, cause, CASE (conv_id + turn) % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'agent' WHEN 2 THEN 'harness' ELSE 'local' END AS kind FROM t WHERE role = 'assistant'),
    w AS (SELECT *, 'EVENT turn seq=' || (turn + 1) || ' off=' || turn || ' cause=' || coalesce(cause::VARCHAR, '-') || ' by=' || CASE WHEN cause IS NULL THEN 'none' ELSE kind || ':c-' || conv_id END AS line FROM l)"""


@query("WITH " + TURN_LINES + """ SELECT conv_id, turn, line || CASE conv_id % 4 WHEN 1 THEN ' seq=9' WHEN 2 THEN ' x' ELSE '' END AS line, CASE WHEN conv_id % 4 NOT IN (1, 2) THEN turn + 1 END AS seq, CASE WHEN conv_id % 4 NOT IN (1, 2) THEN cause END AS cause,
    CASE WHEN conv_id % 4 NOT IN (1, 2) AND cause IS NOT NULL THEN 'c-' || conv_id END AS who FROM w""")
def turn_lines(spark, sf_dir):
    """Turn lines written and read again; a repeated or unknown field spoils one."""
    from pyspark.sql import Window

    c = T.table(spark, sf_dir, "conversations")
    cause = F.max(F.when(F.col("role") != "assistant", F.col("turn"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("cause", cause).where("role = 'assistant'")
    n = F.col("conv_id") + F.col("turn")
    kind = F.when(F.col("cause").isNotNull(), F.when(n % 4 == 0, "human").when(n % 4 == 1, "agent").when(n % 4 == 2, "harness").otherwise("local"))
    line = F.concat(L.turn_line(F.col("turn") + 1, F.col("turn"), F.col("cause"), kind, F.concat(F.lit("c-"), F.col("conv_id").cast("string"))), F.when(F.col("conv_id") % 4 == 1, " seq=9").when(F.col("conv_id") % 4 == 2, " x").otherwise(""))
    return c.select("conv_id", "turn", line.alias("line")).withColumn("p", L.parse_turn_line(F.col("line"))).select("conv_id", "turn", "line", "p.seq", "p.cause", "p.who")


@query(R + """ SELECT "offset", 'GAP from=' || "offset" || ' to=' || ("offset" + v % 50) || ' records=' || CASE WHEN v % 3 = 0 THEN 'unknown' ELSE (v % 50)::VARCHAR END AS line FROM records WHERE kind = 'error'""")
def gap_lines(spark, sf_dir):
    r = T.records(spark, sf_dir).where("kind = 'error'")
    return r.select("offset", L.gap_line(F.col("offset"), F.col("offset") + F.col("v") % 50, F.when(F.col("v") % 3 != 0, F.col("v") % 50)).alias("line"))


@query(R + """ SELECT DISTINCT '/a/stream/term/' || producer_id || '/out' AS output, '/a/stream/tasks/' || kind AS tasks FROM records""")
def subject_builders(spark, sf_dir):
    return T.records(spark, sf_dir).select(L.out_subject(F.col("producer_id")).alias("output"), L.task_subject(F.col("kind")).alias("tasks")).distinct()


ESCALATIONS = [(1, "# who is told"), (2, ""), (3, "subject /f/*/pub/>"), (4, "  principal  p-"), (5, "group /f/alpha/cur/*"), (6, "horizon=100ms"), (7, "horizon=x"), (8, "subject"), (9, "subject a b"), (10, "other a")]


@query("SELECT * FROM (VALUES (1, NULL, NULL, NULL), (2, NULL, NULL, NULL), (3, 'subject', '/f/*/pub/>', NULL), (4, 'principal', 'p-', NULL), (5, 'group', '/f/alpha/cur/*', NULL), (6, 'horizon', '100', NULL), (7, NULL, NULL, 'horizon'), (8, NULL, NULL, 'argument'), (9, NULL, NULL, 'words'), (10, NULL, NULL, 'rule')) AS t(n, kind, arg, error)")
def escalation_parse(spark, sf_dir):
    rows = _values(spark, ESCALATIONS, "n int, line string")
    return rows.withColumn("r", L.escalation_rule(F.col("line"))).select("n", "r.kind", "r.arg", "r.error")


BUDGETS = [("6/min", 6, 60000), ("6/m", 6, 60000), ("10/60s", 10, 60000), ("12/2min", 12, 120000), ("5/1000ms", 5, 1000), ("3/sec", 3, 1000), ("3/2sec", None, None), ("0/min", None, None), ("65/min", None, None), ("6/0s", None, None), ("6min", None, None), ("/min", None, None), ("6/", None, None)]


@query(f"SELECT * FROM (VALUES {_sql_values(BUDGETS)}) AS t(spec, most, window_ms)")
def budget_specs(spark, sf_dir):
    rows = _values(spark, [(s,) for s, *_ in BUDGETS], "spec string").withColumn("b", L.budget(F.col("spec")))
    return rows.select("spec", F.col("b.most").cast("int").alias("most"), F.col("b.window_ms").cast("int").alias("window_ms"))


@query(R + """, t AS (SELECT "offset", md5(subject) AS id, CASE "offset" % 4 WHEN 0 THEN md5(subject) || '.' || "offset" WHEN 1 THEN md5(subject) || '.0' || "offset" WHEN 2 THEN upper(md5(subject)) || '.1' ELSE md5(subject) END AS text FROM records)
    SELECT "offset", CASE WHEN "offset" % 4 < 2 THEN id END AS id, CASE WHEN "offset" % 4 < 2 THEN "offset" END AS generation FROM t WHERE "offset" % 4 <> 2 OR id <> upper(id)""")
def log_identities(spark, sf_dir):
    o, id_ = F.col("offset"), F.md5(F.encode("subject", "UTF-8"))
    text = F.when(o % 4 == 0, F.concat(id_, F.lit("."), o.cast("string"))).when(o % 4 == 1, F.concat(id_, F.lit(".0"), o.cast("string"))).when(o % 4 == 2, F.concat(F.upper(id_), F.lit(".1"))).otherwise(id_)
    return T.records(spark, sf_dir).select("offset", L.log_identity(text).alias("l")).select("offset", "l.id", "l.generation")


@query(R + """, d AS (SELECT DISTINCT subject, sha256('ledgerline-producer'::BLOB || from_hex('00') || encode(subject)) AS h FROM records)
    SELECT subject, CASE WHEN n >= 9223372036854775808 THEN n - 18446744073709551616 ELSE n END::BIGINT AS id FROM (SELECT subject, list_reduce(list_transform(range(7, -1, -1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::HUGEINT), lambda a, b: a * 256 + b) AS n FROM d)""")
def producer_ids(spark, sf_dir):
    return T.records(spark, sf_dir).select("subject").distinct().select("subject", L.producer_id(F.col("subject")).alias("id"))


ZIGZAG = """z AS (SELECT "offset", CASE WHEN "offset" % 2 = 0 THEN v * "offset" ELSE -v * "offset" - 1 END AS value FROM records), u AS (SELECT *, CASE WHEN value < 0 THEN -2 * value::HUGEINT - 1 ELSE 2 * value::HUGEINT END AS code FROM z)"""


@query(R + ", " + ZIGZAG + """ SELECT "offset", value, array_to_string(list_transform(range(n), lambda i: printf('%02x', ((code // (1::HUGEINT << (7 * i)::INT)) % 128 + CASE WHEN i < n - 1 THEN 128 ELSE 0 END)::INT)), '') AS code, value AS back
    FROM (SELECT *, greatest(1, len(list_filter(range(10), lambda i: code // (1::HUGEINT << (7 * i)::INT) > 0))) AS n FROM u)""")
def varint_codes(spark, sf_dir):
    """Signed numbers as zig-zag varints, and back."""
    o, v = F.col("offset"), F.col("v")
    rows = T.records(spark, sf_dir).select("offset", F.when(o % 2 == 0, v * o).otherwise(-v * o - 1).alias("value"))
    rows = rows.withColumn("code", H.varint_hex(H.zigzag(F.col("value"))))
    return rows.withColumn("back", H.from_zigzag(H.from_varint_hex(F.col("code"))))


def _mix_sql(z: str, shift: int, factor: int) -> str:
    return f"(xor({z}, {z} // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {U64}::UHUGEINT"


@query(R + f""", a AS (SELECT "offset", row_number() OVER (PARTITION BY producer_id ORDER BY "offset") AS tick, (producer_id::UHUGEINT + row_number() OVER (PARTITION BY producer_id ORDER BY "offset")::UHUGEINT * {H.MIX_STEP}::UHUGEINT) % {U64}::UHUGEINT AS z FROM records),
    b AS (SELECT *, {_mix_sql('z', 30, H.MIX_FACTORS[0])} AS y FROM a), c AS (SELECT *, {_mix_sql('y', 27, H.MIX_FACTORS[1])} AS x FROM b)
    SELECT "offset", tick, format('{{:016x}}', xor(x, x // {1 << 31}::UHUGEINT)::UBIGINT) AS drawn FROM c""")
def seeded_numbers(spark, sf_dir):
    """A logical clock for each producer, and the number that a generator seeded by the producer gives at each tick."""
    r = T.records(spark, sf_dir)
    return r.select("offset", F.col("producer_seq").alias("tick"), H.hex_of(H.split_mix(F.col("producer_id"), F.col("producer_seq"))).alias("drawn"))


@query()
def xxhashes(spark, sf_dir):
    """With seed 0, as compressed frames have them."""
    r = T.records(spark, sf_dir).select("subject").distinct()
    return r.select("subject", H.xxhash32("subject").alias("x32"), H.xxhash64_hex("subject").alias("x64"))


@query(R + """ SELECT "offset", sha256(body) = sha256(CASE WHEN v % 4 = 0 THEN body || '.' ELSE body END) AS genuine FROM records""")
def tag_equal(spark, sf_dir):
    """A digest compared in whole."""
    tag = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return T.records(spark, sf_dir).select("offset", (tag(F.col("body")) == tag(F.when(F.col("v") % 4 == 0, F.concat(F.col("body"), F.lit("."))).otherwise(F.col("body")))).alias("genuine"))


DOCS = """d AS (SELECT "offset", CASE "offset" % 6 WHEN 0 THEN body WHEN 1 THEN body || 'x' WHEN 2 THEN '{"a": 01}' WHEN 3 THEN '{"a": [1, {"b": "q\\u00e9"}], "z": null}' WHEN 4 THEN '[1 2]' ELSE '"' || kind || '"' END AS doc FROM records)"""


@query(R + ", " + DOCS + """ SELECT "offset", json_valid(doc) AS valid, CASE WHEN json_valid(doc) THEN json(doc)::VARCHAR END AS rendered, CASE WHEN json_valid(doc) THEN json_extract_string(doc, '$.a[1].b') END AS b FROM d""")
def json_documents(spark, sf_dir):
    """Strictly read documents, rendered again, and a member of a member."""
    o = F.col("offset")
    doc = F.when(o % 6 == 0, F.col("body")).when(o % 6 == 1, F.concat(F.col("body"), F.lit("x"))).when(o % 6 == 2, F.lit('{"a": 01}')).when(o % 6 == 3, F.lit('{"a": [1, {"b": "q\\u00e9"}], "z": null}')).when(o % 6 == 4, F.lit("[1 2]")).otherwise(F.concat(F.lit('"'), F.col("kind"), F.lit('"')))
    rows = T.records(spark, sf_dir).select("offset", L.strict_json(doc).alias("v"))
    return rows.select("offset", F.col("v").isNotNull().alias("valid"), F.to_json("v").alias("rendered"), F.try_variant_get("v", "$.a[1].b", "string").alias("b"))


HEALTH = """h AS (SELECT producer_id, 'health 1' || chr(10) || 'pid=' || producer_id || chr(10) || 'head=' || max("offset") || chr(10) || 'records=' || count(*) || chr(10) || 'poisoned=' || CASE WHEN producer_id % 5 = 0 THEN 'yes' || chr(10) || 'reason=disk' ELSE 'no' END || chr(10) AS text FROM records GROUP BY producer_id)"""


@query(R + ", " + HEALTH + r""" SELECT producer_id, regexp_extract(text, '\nhead=([0-9]+)', 1)::BIGINT AS head, regexp_extract(text, '\nrecords=([0-9]+)', 1)::BIGINT AS records, contains(text, 'poisoned=yes') AS poisoned, nullif(regexp_extract(text, '\nreason=(\w+)', 1), '') AS reason FROM h""")
def health_parse(spark, sf_dir):
    """Health files written and read."""
    r = T.records(spark, sf_dir).groupBy("producer_id").agg(F.max("offset").alias("head"), F.count(F.lit(1)).alias("n"))
    said = lambda k, v: F.concat(F.lit(f"{k}="), v.cast("string"), F.lit("\n"))
    text = F.concat(F.lit("health 1\n"), said("pid", F.col("producer_id")), said("head", F.col("head")), said("records", F.col("n")), F.when(F.col("producer_id") % 5 == 0, "poisoned=yes\nreason=disk\n").otherwise("poisoned=no\n"))
    h = r.select("producer_id", L.health(text).alias("h"))
    return h.select("producer_id", F.col("h")["head"].cast("long").alias("head"), F.col("h")["records"].cast("long").alias("records"), (F.col("h")["poisoned"] == "yes").alias("poisoned"), F.col("h")["reason"].alias("reason"))


def _payload_sql(first: str) -> str:
    return f"""'{{{first},"wake_seq":' || producer_seq || ',"boffset":' || "offset" || ',"subject":"' || subject || '","wake":"' || line || '"}}' || chr(10)"""


@query(R + f""", w AS (SELECT *, 'WAKE ' || kind || ' n=' || v AS line FROM records WHERE kind IN ('error', 'signup')) SELECT "offset", form, CASE form WHEN 'line' THEN line || chr(10) WHEN 'notification' THEN {_payload_sql('"hook_event_name":"Notification"')} WHEN 'stop' THEN {_payload_sql('"hook_event_name":"Stop"')} ELSE {_payload_sql('"type":"turn.wake"')} END AS payload
    FROM w, (SELECT unnest(['line', 'notification', 'stop', 'turn']) AS form)""")
def hook_payloads(spark, sf_dir):
    """A wake in each of the four formats that hooks read."""
    w = T.records(spark, sf_dir).where("kind IN ('error', 'signup')").withColumn("line", F.concat(F.lit("WAKE "), F.col("kind"), F.lit(" n="), F.col("v").cast("string")))
    rest = [F.col("producer_seq").alias("wake_seq"), F.col("offset").alias("boffset"), "subject", F.col("line").alias("wake")]
    json = lambda first, name: F.to_json(F.struct(F.lit(first).alias(name), *rest))
    forms = F.map_from_arrays(F.array(*(F.lit(x) for x in ("line", "notification", "stop", "turn"))), F.array(F.col("line"), json("Notification", "hook_event_name"), json("Stop", "hook_event_name"), json("turn.wake", "type")))
    return w.select("offset", F.explode(forms).alias("form", "payload")).withColumn("payload", F.concat("payload", F.lit("\n")))


def _hmac_sql(key: str, message: str) -> str:
    """Over hex strings; the key has 64 bytes at most."""
    pad = lambda by: f"array_to_string(list_transform(range({H.BLOCK}), lambda i: printf('%02x', xor(('0x' || substr(rpad({key}, {2 * H.BLOCK}, '0'), 2 * i + 1, 2))::INT, {by}))), '')"
    return f"sha256(from_hex({pad(H.OUTSIDE)} || sha256(from_hex({pad(H.INSIDE)} || {message}))))"


@query(R + f""", k AS (SELECT "offset", lower(hex(encode(kind))) AS key, lower(hex(encode(body))) AS message, lower(hex(encode(subject))) AS info FROM records), t AS (SELECT *, {_hmac_sql('key', 'message')} AS tag FROM k)
    SELECT "offset", tag, {_hmac_sql('tag', "info || '01'")} AS derived FROM t""")
def hmac_tags(spark, sf_dir):
    """Each body's tag under a key, and a key derived from the body for its subject."""
    r = T.records(spark, sf_dir)
    return r.select("offset", H.hmac_sha256_hex(F.col("kind"), F.col("body")).alias("tag"), H.hkdf_hex(F.col("body"), F.col("kind"), F.col("subject")).alias("derived"))


@query(R + """ SELECT "offset", CASE WHEN "offset" % 3 <> 1 THEN body END AS from_base64, CASE WHEN "offset" % 3 <> 2 THEN kind END AS from_hex FROM records""")
def decoded_texts(spark, sf_dir):
    """Base64 and hex read again; damaged ones are refused."""
    o = F.col("offset")
    base64 = F.concat(F.base64(F.encode("body", "UTF-8")), F.when(o % 3 == 1, "?").otherwise(""))
    hexed = F.concat(F.lower(F.hex(F.encode("kind", "UTF-8"))), F.when(o % 3 == 2, "xy").otherwise(""))
    text = lambda c, form: F.decode(F.try_to_binary(c, F.lit(form)), "UTF-8")
    return T.records(spark, sf_dir).select("offset", text(base64, "base64").alias("from_base64"), text(hexed, "hex").alias("from_hex"))


@query(R + """ SELECT "offset", greatest(1000, least(v, 20000)) AS clamped, max(v) OVER (PARTITION BY producer_id ORDER BY "offset") AS advanced, v > coalesce(max(v) OVER (PARTITION BY producer_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS moved FROM records""")
def clamp_advance(spark, sf_dir):
    """Values held within bounds, and marks that only go forward."""
    from pyspark.sql import Window

    w = Window.partitionBy("producer_id").orderBy("offset")
    before = F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return T.records(spark, sf_dir).select("offset", F.greatest(F.lit(1000), F.least("v", F.lit(20000))).alias("clamped"), F.max("v").over(w).alias("advanced"), (F.col("v") > F.coalesce(before, F.lit(-1))).alias("moved"))


@query("""WITH j AS (SELECT event_id % 50 AS node, user_id % 20 AS step, min(event_id) AS output FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT n.node, s.step, coalesce(output, n.node * 1000 + s.step) AS output, output IS NULL AS ran FROM (SELECT unnest(range(50)) AS node) n, (SELECT unnest(range(20)) AS step) s LEFT JOIN j ON j.node = n.node AND j.step = s.step""")
def journal_run(spark, sf_dir):
    """A workflow run over its journal: outputs that are there are taken, missing steps are run."""
    e = T.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    journal = e.groupBy((F.col("event_id") % 50).alias("node"), (F.col("user_id") % 20).alias("step")).agg(F.min("event_id").alias("output"))
    steps = spark.range(50).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("step"))
    return steps.join(journal, ["node", "step"], "left").select("node", "step", F.coalesce("output", F.col("node") * 1000 + F.col("step")).alias("output"), F.col("output").isNull().alias("ran"))
