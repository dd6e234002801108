"""Writing: content-addressed objects, deliveries, exports with masks, audit rows, rendered lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def store_objects(files: DataFrame, root: str) -> DataFrame:
    """B2: write each distinct content once, in the folder of its digest; returns (path, sha256) of all files."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    once = hashed.groupBy("sha256").agg(F.first("content").alias("content"))
    once.withColumn("shard", F.left("sha256", F.lit(2))).write.mode("append").partitionBy("shard").parquet(root)
    return hashed.select("path", "sha256")


def new_deliveries(issues: DataFrame, channels: DataFrame, stored: DataFrame) -> DataFrame:
    """One record for each issue and channel that has none; channels are few."""
    every = channels.agg(F.collect_set("channel").alias("__c"))  # one row
    return issues.select("issue_id").crossJoin(every).select("issue_id", F.explode("__c").alias("channel")).join(stored, ["issue_id", "channel"], "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and every field quoted."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_snapshot(tables: Mapping[str, DataFrame], root: str, masks: Mapping[str, Mapping[str, Column]]) -> None:
    """Each table as Parquet, with the columns that its masks name replaced."""
    for name, df in tables.items():
        df.withColumns(dict(masks.get(name, {}))).write.mode("overwrite").parquet(f"{root}/{name}")


def append_audit(df: DataFrame, path: str, actor: str, action: str) -> None:
    """Append-only audit rows for the objects of df (object_ref)."""
    df.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), "object_ref", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def rendered(items: DataFrame, group: Sequence[str], order: str, line: Column) -> DataFrame:
    """One text a group: its lines in order. A group is one issue or list that people read."""
    return items.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
