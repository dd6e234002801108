"""Structured Streaming forms of the incremental operators; the same functions serve batches where state allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Windows of whole days and ISO weeks in UTC+8: Spark aligns windows to the epoch in UTC.
DAY_START, WEEK_START = "16 hours", "88 hours"


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """L1: Parquet files as a stream, a few a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Events whose time is an instant: a time without a zone is taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def flag_late(events: DataFrame, ts: str, seen: str, slack: str = "1 day") -> DataFrame:
    """Whether an event came later than the slack after its own time; flagged before any state, so nothing is lost unseen."""
    return events.withColumn("late", F.col(seen) > F.col(ts) + F.expr(f"INTERVAL {slack}"))


def tumbling_days(events: DataFrame, ts: str, by: Column, watermark: str = "2 days") -> DataFrame:
    """Counts and sums of each local day."""
    return (
        _timed(events, ts).withWatermark(ts, watermark).groupBy(F.window(ts, "1 day", "1 day", DAY_START).alias("w"), by.alias("k"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "k", "n", "total")
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """L9, an extra: runs of a key's events without a longer gap."""
    return _timed(events, ts).withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_only(events: DataFrame, keys: list[str], ts: str, watermark: str = "2 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return _timed(events, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def limited(events: DataFrame, key: str, ts: str, min_gap_s: int = 30) -> DataFrame:
    """Events with whether they keep the gap to the key's last allowed one, which is the state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values([ts])
            ok = []
            for t in (pdf[ts].astype("int64") // 10**6 if pdf[ts].dtype.kind != "M" else pdf[ts].dt.as_unit("us").astype("int64")):
                good = last is None or t - last >= min_gap_s * 1_000_000
                ok.append(good)
                last = t if good else last
            yield pd.DataFrame({key: pdf[key].to_numpy(), ts: pdf[ts].to_numpy(), "allowed": ok})
        state.update((int(last),) if last is not None else (0,))

    schema = events.schema
    kind = schema[key].dataType.simpleString()
    return _timed(events, ts).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, allowed boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def routed_jobs(handlers: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that hands each kind of job to its handler; other kinds are left alone."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for kind, handle in handlers.items():
            handle(batch.where(F.col("kind") == kind))

    return run


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and return its result (tests and replays)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def not_seen(batch: DataFrame, stored: DataFrame, fingerprint: str) -> DataFrame:
    """Rows whose fingerprint is not stored yet."""
    return batch.join(stored.select(fingerprint), fingerprint, "left_anti")
