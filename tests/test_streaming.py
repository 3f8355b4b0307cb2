import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import log, summary
from ledgerline.streaming import live

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The events in four files, in order."""
    where = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        e.where(F.floor(F.col("event_id") / 250) == i).coalesce(1).write.mode("append").parquet(f"file://{where}")
    return f"file://{where}"


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def batch(spark):
    return live.as_records(spark.read.parquet(f"{SF}/events.parquet"))


def test_subscribe(spark, source, tmp_path):
    got = run(live.subscribe(live.as_records(live.read_events(spark, source)), "/f/*/pub/*/*/error", 100), "sub", "append", tmp_path)
    want = log.scan_from(batch(spark), 100, "/f/*/pub/*/*/error")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_tumbling_weeks(spark, source, tmp_path):
    got = run(live.tumbling(live.as_records(live.read_events(spark, source)), "week"), "weeks", "complete", tmp_path)
    rows = {(int(r.window.start.timestamp() * 1000), r.n, r.total) for r in got.collect()}
    want = summary.windowed(batch(spark).withColumn("at_ms", F.unix_millis("at")), "week").groupBy("window_start").agg(F.count(F.lit(1)), F.sum("v"))
    assert rows == {tuple(r) for r in want.collect()}


def test_signals(spark, source, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    got = run(live.signals(live.as_records(live.read_events(spark, source))), "sig", "update", tmp_path)
    newest = {}
    for r in got.orderBy("offset").collect():
        newest[r.subject] = r.offset
    assert newest == {r.subject: r.offset for r in log.last_value(batch(spark), "/>", ("offset",)).collect()}


def test_exactly_once(spark, source, tmp_path):
    """Two queries over the same input, and a batch that is repeated, add each key once."""
    sink = f"file://{tmp_path}/sink"
    rows = live.as_records(live.read_events(spark, source)).withColumn("seq", F.floor(F.col("offset") / 2))
    for name in ("one", "two"):
        q = rows.writeStream.foreachBatch(live.exactly_once(sink, ["producer_id", "seq"], name)).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    whole = batch(spark).withColumn("seq", F.floor(F.col("offset") / 2))
    live.exactly_once(sink, ["producer_id", "seq"], "one")(whole.where("offset < 250"), 0)
    want = whole.select("producer_id", "seq").distinct()
    got = spark.read.parquet(sink).select("producer_id", "seq")
    assert got.count() == want.count() == got.distinct().count()


def test_classify(spark, tmp_path):
    """Marks over records' borders as they come; idle sessions tell once where they came to rest; the batch form agrees."""
    import datetime

    from ledgerline.operators import folds, terminal

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    begin = datetime.datetime(2024, 1, 1)
    rows = [
        (1, 0, 0, "ls\x1b]133"), (2, 0, 0, "busy"), (1, 1, 1, ";C\x07out"), (1, 2, 2, "\x1b]133;D;3\x07"), (2, 1, 2, "\r\n>>>"), (2, 2, 3, ""),
        (3, 0, 60, "later"), (2, 3, 61, "\r\n>>> x"), (3, 1, 200, " $"), (4, 0, 400, "end"),
    ]
    schema = "session long, offset long, at timestamp, kind string, text string, cols int, rows int"
    source = tmp_path / "in"
    for i, part in enumerate((rows[:3], rows[3:6], rows[6:8], rows[8:9], rows[9:])):
        full = [(k, o, begin + datetime.timedelta(seconds=s), "Out", t, 80, 24) for k, o, s, t in part]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(str(source / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = live.classify(stream, 10_000, "repl").writeStream.option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("classified").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = Counter((r.session, r.offset, r.kind, r.exit) for r in spark.table("classified").collect())
    query.stop()
    assert {k: n for k, n in got.items() if k[2].startswith("Command")} == {(1, 1, "CommandStart", None): 1, (1, 2, "CommandEnd", 3): 1}
    assert got[2, 1, "Quiesced", None] == 1 and got[2, 1, "PromptReady", None] == 1 and got[1, 1, "Quiesced", None] == 1 and got[2, 3, "Quiesced", None] == 1
    assert not any(k[0] == 1 and k[2] == "PromptReady" or k[:2] == (2, 3) and k[2] == "PromptReady" for k in got)
    batch = spark.createDataFrame([(k, o, "Out", t, 80, 24) for k, o, _, t in rows], "key long, at long, kind string, text string, cols int, rows int")
    assert Counter((r.key, r.at, r.kind, r.exit) for r in folds.osc_marks(batch).collect()) == {k: n for k, n in got.items() if k[2].startswith("Command")}
    assert {(r.key, r.quiesced) for r in terminal.settled(batch, "repl").collect()} >= {(1, 1), (2, 3)}


def test_fan_out(spark, tmp_path):
    records = live.as_records(live.read_events(spark, SF, 1, "events.parquet"))
    queries = live.fan_out(records, {"all": ("/f/>", 0), "alpha": ("/f/alpha/>", 100)}, str(tmp_path / "out"), str(tmp_path / "c"))
    for q in queries.values():
        q.awaitTermination(120)
        assert q.exception() is None
    every = spark.read.parquet(str(tmp_path / "out/all"))
    assert every.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "out/alpha")).count() == every.where("offset >= 100 AND subject LIKE '/f/alpha/%'").count()
