"""Publishing and reporting: admission, duplicates, sections, daily issues, funnels, lineage, profiles, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, values

SECTIONS = ("urgent", "deadline", "new", "change", "result")


def primary_of(events: DataFrame, group: str, order: Sequence[Column], key: str) -> DataFrame:
    """each group's first row by the order and the group's size: one aggregate state, however many rows a group has."""
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id")))
    return events.groupBy(group).agg(first.alias("first"), F.count("*").cast("int").alias("group_size")).select(group, F.col("first.id").alias(key), "group_size")


def primary_links(events: DataFrame, group: str, order: Sequence[Column], key: str) -> DataFrame:
    """F2 in rows: every row's key with the key of its group's first row. A group of any size stays in rows; its join may be
    split. Rows without a group are a group of their own kind: null meets null."""
    best = primary_of(events, group, order, key).select(F.col(group).alias("__g"), F.col(key).alias("primary"), "group_size")
    return events.select(group, key).join(best, F.col(group).eqNullSafe(F.col("__g"))).select(key, "primary", "group_size", F.col("primary").eqNullSafe(F.col(key)).alias("is_primary"))


def pick_primary(events: DataFrame, group: str, order: Sequence[Column], key: str) -> DataFrame:
    """each group's first row by the order, with the ids of the others, in order, and the group's size.

    The order's columns travel in one struct, so a group is one aggregate state and not a sorted partition; a group
    is as wide as it has sources. Where groups may be large, primary_links gives the same in rows.
    """
    ranked = events.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id")))).alias("all"))
    ids = F.transform("all", lambda x: x["id"])
    return ranked.select(group, F.element_at(ids, 1).alias(key), F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))).alias("backups"), F.size(ids).alias("group_size"))


def supersede(pool: DataFrame, key: str, seen: str, candidate: str, status: str, automatic: Sequence[str]) -> DataFrame:
    """An automatic row of a project gives way to the next one seen; rows that a person has decided stay as they are."""
    nxt = F.lead(candidate).over(W.partitionBy(key).orderBy(seen, candidate))
    auto = F.col(status).isin(*automatic)
    return pool.withColumn("replaced_by", F.when(auto, nxt)).withColumn(status, F.when(F.col("replaced_by").isNotNull(), "superseded").otherwise(F.col(status)))


def dedupe_by_project(items: DataFrame, title: str = "title", source: str = "source_id", key: str = "candidate_id") -> DataFrame:
    """one row a project: the type of highest priority, all its sources, and how many stages were seen."""
    typed = items.withColumn("project_key", classify.project_key(F.col(title))).withColumn("announcement_type", classify.title_type(F.col(title)))
    order = F.struct(values.lookup_order(F.col("announcement_type"), classify.TYPE_PRIORITY).alias("p"), F.col(key).alias("k"))
    return typed.groupBy("project_key").agg(
        F.min_by(key, order).alias(key), F.min_by("announcement_type", order).alias("announcement_type"),
        F.sort_array(F.collect_set(source)).alias("source_group"), F.count("*").alias("stage_count"),
        F.sort_array(F.collect_set("announcement_type")).alias("stage_labels"),
    )


def daily_items(events: DataFrame, issue: str, section: str, order: Sequence[Column], item: Column) -> DataFrame:
    """Items of each issue with their place and id, by section, then the order.

    An issue is one day's selection; numbering is by issue, so each is a group of its own.
    """
    place = F.row_number().over(W.partitionBy(issue).orderBy(values.mapped(F.col(section), SECTIONS), *order))
    return events.withColumn("display_order", place).withColumn("item_id", F.concat(F.col(issue).cast("string"), F.lit("-I"), F.lpad(F.col("display_order").cast("string"), 3, "0")))


def daily_issue(events: DataFrame, pushed: DataFrame, now: Column, group: str, order: Sequence[Column]) -> DataFrame:
    """today's admitted events: participable, not sent before, one a duplicate group, with urgency and section.

    events needs event_id, title_type, signup, bid, gate, and the group; pushed needs event_id.
    """
    from .temporal import admission_state

    sent = events.join(pushed.select("event_id").distinct().withColumn("sent", F.lit(True)), "event_id", "left")
    state = admission_state(F.col("signup"), F.col("bid"), now, F.col("gate"), F.coalesce("sent", F.lit(False)))
    fit = sent.withColumn("state", state).where("state = 'participable'").drop("sent")
    best = primary_of(fit, group, order, "event_id").select("event_id", "group_size")
    judged = fit.join(best, "event_id").withColumn("u", classify.urgency(F.col("signup"), F.col("bid"), now))
    return judged.select("*", "u.urgency", "u.basis", classify.section(F.col("title_type"), F.col("u.urgency"), F.col("u.basis"), ["change"], ["win"]).alias("section")).drop("u")


def funnel(runs: DataFrame, delivered: Column | None = None) -> DataFrame:
    """E5: one row of funnel counts over source runs, with the share of successful runs in percent."""
    return runs.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_items"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_events"),
        F.coalesce(F.sum(F.col("valid") - F.col("duplicates")), F.lit(0)).alias("deduplicated_events"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late_events"),
        F.greatest(F.lit(0), F.coalesce(F.sum(F.col("duplicates") - F.col("late")), F.lit(0))).alias("excluded_others"),
        F.coalesce(F.bround(100 * F.try_divide(F.count_if(F.col("status") == "success"), F.count("*")), 1), F.lit(0.0)).alias("success_rate"),
        F.count("*").alias("run_count"),
    )


def source_stats(runs: DataFrame) -> DataFrame:
    """Counts, sums and last times of each source, and its overall status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy("source_id").agg(
        F.count("*").alias("runs"), n("success").alias("success"), n("partial").alias("partial"), n("failed").alias("failed"),
        F.sum("raw").alias("raw_items"), F.sum("valid").alias("valid_events"), F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success_at"),
        F.max("finished_at").alias("last_run_at"),
    ).withColumn(
        "status",
        F.when((F.col("failed") > 0) & (F.col("success") == 0) & (F.col("partial") == 0), "failed")
        .when((F.col("success") > 0) & (F.col("failed") == 0) & (F.col("partial") == 0), "success").otherwise("partial"),
    )


def lineage(items: DataFrame, events: DataFrame, discovered: Column) -> DataFrame:
    """Items with their events, and events of the period that no item has but that were late, pending or excluded."""
    shown = items.join(events, "event_id").select("event_id", "issue_date", "delivery_status")
    rest = events.where(discovered & F.col("delivery_status").isin("late_discovered", "pending_review", "excluded")).join(items.select("event_id"), "event_id", "left_anti")
    return shown.unionByName(rest.select("event_id", F.lit(None).cast(shown.schema["issue_date"].dataType).alias("issue_date"), "delivery_status"))


def reconcile(claimed: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Claimed and counted numbers of each key side by side, with whether they balance."""
    j = claimed.join(actual, key, "full_outer").fillna(0, ["claimed", "counted"])
    return j.select(key, "claimed", "counted", (F.col("claimed") == F.col("counted")).alias("balanced"))


def coverage(states: DataFrame, state: str = "status") -> DataFrame:
    """Counts of decided and open rows with the decided share to three places, null without rows."""
    done = F.count_if(F.col(state).isin("approved", "revised", "rejected", "not_applicable"))
    return states.agg(F.count("*").alias("total"), done.alias("decided"), F.count_if(F.col(state) == "pending").alias("pending"), F.bround(F.try_divide(done, F.count("*")), 3).alias("ratio"))


def preview_samples(df: DataFrame, state: str, key: str, last: int, order: Sequence[Column], samples: int = 3) -> DataFrame:
    """Over the last rows by the order, how many are in each state, with the first few keys of each."""
    recent = df.orderBy(*order).limit(last)
    return recent.groupBy(state).agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_list(F.col(key))), 1, samples), ",").alias("samples"))


def metrics_of_hits(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Recall at k over all wanted items, and the mean reciprocal of the first hit over queries with one.

    hits (query, rank) holds the ranks of wanted items only, wanted (query, wanted) how many there are.
    """
    of_query = hits.groupBy("query").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("found"))
    return wanted.join(of_query, "query", "left").agg(
        F.count("*").alias("queries"), F.try_divide(F.sum(F.coalesce("found", F.lit(0))), F.sum("wanted")).alias("recall"), F.avg(1 / F.col("first")).alias("mrr"),
    )


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """metrics_of_hits for ranked (query, item, rank) against listed gold (query, item)."""
    return metrics_of_hits(gold.join(ranked, ["query", "item"]).select("query", "rank"), gold.groupBy("query").agg(F.count("*").alias("wanted")), k)


def rate_limit(requests: DataFrame, domain: str, ts: str, min_gap_s: int = 30, hourly: int = 1000) -> DataFrame:
    """Whether each request keeps the gap to the domain's last one and the number of the past hour.

    A busy domain is dealt by the hour: a row counts among those of its own hour and of the one before, and the first of an
    hour finds its predecessor in a small table of each hour's last request.
    """
    ids = [c for c in requests.columns if c.endswith("_id")]
    at = requests.withColumn("__at", F.unix_timestamp(ts)).withColumn("__h", F.floor(F.col("__at") / 3600))
    ends = at.groupBy(domain, "__h").agg(F.max("__at").alias("__end"))
    ends = ends.select(F.col(domain).alias("__d"), F.col("__h").alias("__b"), F.lag("__end").over(W.partitionBy(domain).orderBy("__h")).alias("__before"))
    dealt = at.withColumn("__b", F.explode(F.array("__h", F.col("__h") + 1)))
    by = W.partitionBy(domain, "__b").orderBy("__at")
    dealt = dealt.withColumns({"past_hour": F.count("*").over(by.rangeBetween(-3600, 0)), "__last": F.lag("__at").over(W.partitionBy(domain, "__b").orderBy("__at", *ids))})
    own = dealt.where(F.col("__b") == F.col("__h"))
    out = own.join(ends.withColumnRenamed("__b", "__hour"), (F.col(domain).eqNullSafe(F.col("__d"))) & (F.col("__h") == F.col("__hour")), "left")
    out = out.withColumn("since_last", F.col("__at") - F.coalesce("__last", "__before"))
    out = out.withColumn("allowed", (F.coalesce("since_last", F.lit(min_gap_s)) >= min_gap_s) & (F.col("past_hour") <= hourly))
    return out.select(*requests.columns, "since_last", "past_hour", "allowed")


def gap_groups(gaps: DataFrame, key: str, seq: str) -> DataFrame:
    """Gaps merged by key: the first by order stands for all. What each group refers to is gap_members."""
    return gaps.groupBy(key).agg(F.min(seq).alias("first_seq"), F.count("*").alias("gaps"))


def gap_members(gaps: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, first_seq): the requirements of each merged gap, one a row, however many there are."""
    return gaps.select(key, seq).distinct().join(gap_groups(gaps, key, seq).select(key, "first_seq"), key)


def stage_plan(actions: DataFrame) -> DataFrame:
    """Actions by stage: how many and whether all are done."""
    done = F.col("status").isin("ready", "completed")
    return actions.groupBy("stage").agg(F.count("*").alias("n"), F.bool_and(done).alias("ready"))


def staged_actions(actions: DataFrame) -> DataFrame:
    """Actions with whether their whole stage is done; page by (stage, action_id) to list a stage in order."""
    return actions.join(stage_plan(actions).select("stage", "ready"), "stage")


def issue_changes(stored: DataFrame, items: DataFrame, issue: str, item: str, place: str, forced: Column) -> DataFrame:
    """(issue, item, version, old_place, place, change) of each issue that is generated again.

    stored (issue, item, place, version) holds the newest snapshot of each issue, items a new selection. An issue that is
    not stored gets version 1, all its items `added`. A stored one stays as it is unless the condition `forced` on the issue
    holds: then it gets version + 1, and items are `added`, `removed` (place null), `moved` or `same`. One full join on
    (issue, item); versions meet their issue by a row each.
    """
    old = stored.select(F.col(issue).alias("__i"), F.col(item).alias("__k"), F.col(place).alias("old_place"))
    versions = stored.groupBy(F.col(issue).alias("__v")).agg(F.max("version").alias("was"))
    both = items.select(issue, item, place).join(old, (F.col(issue) == F.col("__i")) & (F.col(item) == F.col("__k")), "full")
    both = both.select(F.coalesce(issue, "__i").alias(issue), F.coalesce(item, "__k").alias(item), "old_place", place)
    seen = both.join(versions, F.col(issue) == F.col("__v"), "left").where(F.col("was").isNull() | forced)
    change = F.when(F.col("old_place").isNull(), "added").when(F.col(place).isNull(), "removed").when(F.col("old_place") != F.col(place), "moved").otherwise("same")
    return seen.select(issue, item, (F.coalesce("was", F.lit(0)) + 1).alias("version"), "old_place", place, change.alias("change"))


def next_snapshot(stored: DataFrame, changes: DataFrame, issue: str, item: str, place: str) -> DataFrame:
    """The newest snapshot of each issue after issue_changes: rows of changed issues, and the stored rows of the others."""
    fresh = changes.where(F.col("change") != "removed").select(issue, item, place, "version")
    return stored.select(issue, item, place, "version").join(changes.select(issue).distinct(), issue, "left_anti").unionByName(fresh)
