"""Keyed streams: a job's state machine with heartbeat timers, and an upsert sink that rewrites touched buckets only."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Transitions with timers need state that is kept per key: the session's state store must be this one.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Job(NamedTuple):
    """A job's state, how often it was claimed, how many events its state forbade, how many it had, its last event (µs)."""

    state: str
    attempts: int = 0
    refused: int = 0
    events: int = 0
    last: int = 0


class Rules(NamedTuple):
    """Transitions, the first state, the claims after which a failure is final, and the heartbeat in seconds (0: none)."""

    table: Mapping[tuple[str, str], str]
    start: str = "pending"
    max_attempts: int = 0
    heartbeat_s: int = 0
    running: str = "running"
    retry: str = "retryable"
    failed: str = "failed"
    claim: str = "claim"
    stale: str = "stale"

    def moved(self, job: Job, event: str) -> str | None:
        to = self.table.get((job.state, event))
        return self.failed if to == self.retry and 0 < self.max_attempts <= job.attempts else to

    def overdue(self, job: Job, at: int) -> bool:
        return bool(self.heartbeat_s) and job.state == self.running and at - job.last > self.heartbeat_s * 1_000_000

    def expired(self, job: Job) -> Job:
        """The job after its heartbeat stopped."""
        return job._replace(state=self.moved(job, self.stale) or job.state)

    def after(self, job: Job, event: str, at: int) -> Job:
        """The job after an event; a heartbeat that stopped before it counts first, whether or not a timer told of it."""
        if self.overdue(job, at):
            job = self.expired(job)
        to = self.moved(job, event)
        return Job(to or job.state, job.attempts + (event == self.claim and to is not None), job.refused + (to is None), job.events + 1, max(job.last, at))


class _Machine(StatefulProcessor):
    def __init__(self, key: str, ts: str, order: Sequence[str], event: str, rules: Rules):
        self.key, self.ts, self.order, self.event, self.rules = key, ts, list(order), event, rules

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempts int, refused int, events int, last long")

    def _told(self, key, job: Job, why: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "state": [job.state], "attempts": [job.attempts], "refused": [job.refused], "events": [job.events], "why": [why]}).astype(
            {"attempts": "int32", "refused": "int32", "events": "int32"}
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = Job(*self.job.get()) if self.job.exists() else Job(self.rules.start)
        batch = pd.concat(list(rows)).sort_values(self.order)  # the events of one job in one trigger
        for event, at in zip(batch[self.event], batch[self.ts].dt.as_unit("us").astype("int64"), strict=True):
            job = self.rules.after(job, event, int(at))
        self.job.update(tuple(job))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.rules.heartbeat_s and job.state == self.rules.running:
            self.handle.registerTimer(job.last // 1000 + self.rules.heartbeat_s * 1000 + 1)
        yield self._told(key, job, "event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = Job(*self.job.get()) if self.job.exists() else Job(self.rules.start)
        if job.state == self.rules.running:
            job = self.rules.expired(job)
            self.job.update(tuple(job))
            yield self._told(key, job, "heartbeat")

    def close(self) -> None:
        pass


def job_machine(events: DataFrame, key: str, ts: str, order: Sequence[str], event: str, rules: Rules, watermark: str = "1 minute") -> DataFrame:
    """L2, L3: a stream of job states: (key, state, attempts, refused, events, why), a row for each job that a trigger
    touches and for each whose heartbeat stopped as the watermark tells (`why`: event or heartbeat). Update mode.

    Events of a job are folded in order within a trigger; a forbidden one changes nothing but `refused`. A running job
    without an event for heartbeat_s goes the way of `stale`, and a failure after max_attempts claims is final. State is one
    small row a job, so a restart goes on where the last trigger ended. Needs STATE_STORE in the session.
    """
    kind = dict(events.dtypes)[key]
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Machine(key, ts, order, event, rules), outputStructType=f"{key} {kind}, state string, attempts int, refused int, events int, why string", outputMode="Update", timeMode="EventTime"
    )


def _manifest(spark: SparkSession, path: str, batch_id: int):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{batch_id}.json")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _read_manifest(spark: SparkSession, path: str, batch_id: int) -> dict[int, str]:
    """{bucket: folder} after a batch; empty before the first."""
    fs, file = _manifest(spark, path, batch_id)
    if batch_id < 0 or not fs.exists(file):
        return {}
    return {int(k): v for k, v in json.loads("".join(r.value for r in spark.read.text(file.toString()).collect())).items()}


def latest_manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    fs, file = _manifest(spark, path, 0)
    if not fs.exists(file.getParent()):
        return -1, {}
    ids = [int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(file.getParent()) if s.getPath().getName().endswith(".json")]
    last = max(ids, default=-1)
    return last, _read_manifest(spark, path, last)


def stored_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the newest manifest."""
    folders = sorted(latest_manifest(spark, path)[1].values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def bucketed_upsert(path: str, keys: Sequence[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key, by `order`, in `buckets` folders by a key's hash.

    A batch reads and rewrites only the buckets that its keys fall into; a manifest of each batch names the folder of every
    bucket, and is written last. A batch that runs again starts from the manifest before it, so it leaves nothing twice; one
    that a later manifest already holds does nothing. The folders that a batch replaces go with the next batch, when no
    manifest that a restart may need names them. Of equal `order` the row that is greatest by its other columns stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, _ = latest_manifest(spark, path)
        if last > batch_id:
            return
        before = _read_manifest(spark, path, batch_id - 1) if batch_id else {}
        rest = [c for c in batch.columns if c not in keys]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.withColumn("bucket_", bucket).persist()
        try:
            touched = [r.bucket_ for r in rows.select("bucket_").distinct().collect()]  # at most `buckets` numbers
            old = [before[b] for b in touched if b in before]
            if old:
                kept = spark.read.schema(batch.schema).parquet(*old)
                rows_all = rows.unionByName(kept.withColumn("bucket_", bucket))
            else:
                rows_all = rows
            newest = rows_all.groupBy("bucket_", *keys).agg(F.max(F.struct(F.col(order).alias("o_"), F.struct(*rest).alias("r_"))).alias("m")).select("bucket_", *keys, "m.r_.*")
            folder = f"{path}/data/batch={batch_id}"
            newest.repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(folder)
        finally:
            rows.unpersist()
        now = before | {b: f"{folder}/bucket_={b}" for b in touched}
        fs, file = _manifest(spark, path, batch_id)
        out = fs.create(file, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        two_ago = _read_manifest(spark, path, batch_id - 2) if batch_id > 1 else {}
        for gone in set(two_ago.values()) - set(before.values()) - set(now.values()):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(gone), True)

    return write
