"""The keyed job machine against the batch fold, with a restart and with timers; the bucketed upsert and repeated batches."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bidlattice.operators import lifecycle as lc
from bidlattice.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"
TABLE = {("new", "view"): "seen", ("seen", "click"): "active", ("active", "purchase"): "bought", ("bought", "error"): "failed", ("failed", "view"): "seen", ("seen", "error"): "failed"}


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(*[jobs.STATE_STORE[0], None])
    spark.conf.set(*jobs.STATE_STORE)
    yield spark
    if before is None:
        spark.conf.unset(jobs.STATE_STORE[0])
    else:
        spark.conf.set(jobs.STATE_STORE[0], before)


def run(spark, src, rules, tmp_path, out):
    """Drain what is there; the last row of each job, as stored by a foreachBatch sink."""

    def keep(batch, batch_id):
        out.extend((batch_id, r) for r in batch.collect())

    machine = jobs.job_machine(src, "user_id", "ts", ["ts", "event_id"], "event_type", rules)
    q = machine.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_equals_batch_over_a_restart(rocks, tmp_path):
    spark = rocks
    events = spark.read.parquet(EVENTS).select("event_id", "ts", "user_id", "event_type")
    cut = events.approxQuantile("event_id", [0.5], 0)[0]
    middle = events.where(F.col("event_id") <= cut).agg(F.max("ts")).first()[0]
    rules, out = jobs.Rules(TABLE, start="new"), []
    events.where(F.col("ts") <= middle).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(spark, src, rules, tmp_path, out)
    events.where(F.col("ts") > middle).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, src, rules, tmp_path, out)  # a new query from the same checkpoint
    got = {}
    for _, r in sorted(out, key=lambda x: x[0]):
        got[r.user_id] = (r.state, r.attempts, r.refused, r.events)
    want = lc.fold_states(events, "user_id", ["ts", "event_id"], "event_type", "new", TABLE).collect()
    assert got == {r.user_id: (r.state, r.attempts, r.refused, r.events) for r in want} and len({b for b, _ in out}) >= 2


def test_heartbeats_and_attempts(rocks, tmp_path):
    spark = rocks
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    schema = "event_id long, s int, user_id long, event_type string"
    rows = [(1, 0, 1, "claim"), (2, 0, 2, "claim"), (3, 500, 2, "finish"), (4, 0, 3, "claim"), (5, 100, 3, "fail"), (6, 200, 3, "claim"), (7, 300, 3, "fail"), (8, 400, 3, "claim"), (9, 0, 4, "finish")]
    late = [(10, 5000, 9, "claim"), (11, 9000, 9, "finish")]
    timed = lambda r: spark.createDataFrame(r, schema).select("event_id", at(0).alias("ts") + F.make_interval(secs=F.col("s")), "user_id", "event_type").toDF("event_id", "ts", "user_id", "event_type")
    first = timed(rows)
    rules, out = jobs.Rules(lc.JOB, max_attempts=2, heartbeat_s=600), []
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    run(spark, src, rules, tmp_path, out)
    for r in late:  # the watermark passes the heartbeat of job 1
        timed([r]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, src, rules, tmp_path, out)
    got = {}
    for _, r in sorted(out, key=lambda x: x[0]):
        got[r.user_id] = (r.state, r.attempts, r.refused, r.why)
    assert got[1] == ("retryable", 1, 0, "heartbeat") and got[2][:3] == ("succeeded", 1, 0) and got[3][:3] == ("failed", 2, 1) and got[4][:3] == ("pending", 0, 1)
    # job 9 was claimed and finished 4000 s later: its heartbeat had stopped, so the end is refused
    assert got[9][:3] == ("retryable", 1, 1)


def test_rules():
    r = jobs.Rules(lc.JOB, max_attempts=1, heartbeat_s=10)
    job = r.after(jobs.Job("pending"), "claim", 5_000_000)
    assert job == jobs.Job("running", 1, 0, 1, 5_000_000) and not r.overdue(job, 15_000_000) and r.overdue(job, 15_000_001)
    assert r.after(job, "finish", 16_000_000).state == "failed" and r.expired(job).state == "failed"


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "k long, at int, v string"
    sink = jobs.bucketed_upsert(path, ["k"], "at", buckets=16)
    make = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda: {r.k: (r.at, r.v) for r in jobs.stored_rows(spark, path, schema).collect()}
    sink(make([(k, 1, "a") for k in range(200)]), 0)
    whole = files(path)
    sink(make([(5, 2, "b"), (5, 1, "z")]), 1)
    assert rows() == {k: (1, "a") for k in range(200)} | {5: (2, "b")}
    assert len(files(path) - whole) == 1  # one bucket was written
    again = rows()
    sink(make([(5, 2, "b"), (5, 1, "z")]), 1)  # the same batch once more
    assert rows() == again and jobs.stored_rows(spark, path, schema).count() == 200
    sink(make([(5, 0, "old"), (1000, 1, "new")]), 2)
    assert rows() == again | {1000: (1, "new")}
    sink(make([(7, 9, "x")]), 1)  # a batch that a later one already holds
    assert rows() == again | {1000: (1, "new")}
    sink(make([(5, 3, "c")]), 3)
    assert rows()[5] == (3, "c") and len(rows()) == 201
    assert len(files(path)) < len(whole) + 5  # replaced folders are gone


def test_upsert_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select("event_id", "ts", "user_id", "event_type")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = jobs.bucketed_upsert(str(tmp_path / "t"), ["user_id"], "ts", 8)
    src.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.user_id: r.ts for r in jobs.stored_rows(spark, str(tmp_path / "t"), events.schema).collect()}
    assert got == {r.user_id: r.m for r in events.groupBy("user_id").agg(F.max("ts").alias("m")).collect()}
