"""Validity at an instant, current versions, deadlines and day buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def covers(start: Column, end: Column, at: Column) -> Column:
    """[start, end], both included, open where null, holds the instant."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def as_of(df: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_until", status: Sequence[str] = ("active",)) -> DataFrame:
    """Verified rows of a live status whose validity holds the instant, compared by day."""
    return df.where(F.col("status").isin(*status) & F.col("verified_at").isNotNull() & covers(F.to_date(start), F.to_date(end), F.to_date(at)))


def ineligible_reason(start: Column, end: Column, verified: Column, at: Column) -> Column:
    """Why a record takes no part: unverified, else expired, else not yet valid; null if it does."""
    return F.when(verified.isNull(), "unverified").when(end < at, "expired").when(start > at, "not_yet_valid")


def validity_state(start: Column, end: Column, at: Column, given: Column | None = None) -> Column:
    """Blocked where a given bound can't be read as a date, failed outside the bounds, else passed."""
    out = F.when(given, "blocked") if given is not None else F.when(F.lit(False), "")
    return out.when((end < at) | (start > at), "failed").otherwise("passed")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: int = 1) -> DataFrame:
    """The row of each key that comes at this place by the order; ties need a last unique column there."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") == rank).drop("__n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """As latest_by for rank 1, by an aggregate that combines on the map side: fit for keys with very many rows."""
    packed = F.struct(*columns)
    return df.groupBy(*keys).agg(F.min_by(packed, order).alias("__r")).select(*keys, "__r.*")


def overdue(precise: Column, day: Column, now: Column) -> Column:
    """Past a precise instant, or a bare day that is over."""
    return F.when(precise.isNotNull(), now >= precise).otherwise(day < F.to_date(now))


def admission_state(signup: Column, bid: Column, now: Column, gate: Column, pushed: Column) -> Column:
    """gate_rejected, pushed, missing_deadline, participable or expired, in this order."""
    return (
        F.when(~F.coalesce(gate, F.lit("")).isin("passed", ""), "gate_rejected").when(pushed, "pushed")
        .when(signup.isNull() & bid.isNull(), "missing_deadline")
        .when(F.coalesce(signup >= now, F.lit(False)) | F.coalesce(bid >= now, F.lit(False)), "participable").otherwise("expired")
    )


def day_bucket(ts: Column, start: Column, end: Column) -> Column:
    """Missing, late, future or day; late rows are named, so that nothing later drops them unseen."""
    return F.when(ts.isNull(), "missing").when(ts < start, "late").when(ts >= end, "future").otherwise("day")


def window_or_unknown(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Rows in the window with those of unknown date, told apart by `pending`."""
    return df.where(F.col(column).isNull() | F.col(column).between(start, end)).withColumn("pending", F.col(column).isNull())


def expires_soon(end: Column, today: Column, days: int = 90) -> Column:
    """C11: after today, within so many days."""
    return (end > today) & (end <= F.date_add(today, days))


def next_version(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Content-hash versions: the stored version where a key's digest is known, else one more than its largest."""
    known = stored.groupBy(key, digest).agg(F.max("version").alias("known"))
    top = stored.groupBy(key).agg(F.max("version").alias("top"))
    joined = incoming.join(known, [key, digest], "left").join(top, key, "left")
    return joined.withColumn("version", F.coalesce("known", F.coalesce("top", F.lit(0)) + 1)).drop("known", "top")
