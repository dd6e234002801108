"""States and their changes: jobs, pools, reviews, approvals, tasks, readiness; and upkeep of stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values

#: Transitions (state, event) -> next state of jobs, pool rows, reviews and approvals.
JOB = {("pending", "claim"): "running", ("retryable", "claim"): "running", ("running", "finish"): "succeeded", ("running", "fail"): "retryable", ("running", "stale"): "retryable", ("running", "reset"): "pending", ("retryable", "reset"): "pending", ("running", "abort"): "failed"}
POOL = {("pending", "select"): "deep_dive", ("recommended", "select"): "deep_dive", ("pending", "dismiss"): "dismissed", ("recommended", "dismiss"): "dismissed", ("deep_dive", "dismiss"): "dismissed", ("excluded_by_llm", "restore"): "pending", ("dismissed", "restore"): "pending"}
REVIEW = {("pending", "approve"): "approved", ("pending", "revise"): "revised", ("pending", "reject"): "rejected", ("missing", "not_applicable"): "not_applicable", ("missing", "revise"): "revised", ("rejected", "reopen"): "pending"}
APPROVAL = {("draft", "submit"): "pending", ("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("blocked", "waive"): "pending", ("pending", "waiver_expired"): "blocked", ("approved", "waiver_expired"): "blocked"}


def next_state(state: Column, event: Column, table: Mapping[tuple[str, str], str]) -> Column:
    """The state after an event; null where the table does not allow it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for (s, e), t in table.items() for x in (f"{s}>{e}", t)]), F.concat_ws(">", state, event))


def fold_states(events: DataFrame, key: str, order: Sequence[str], event: str, start: str, table: Mapping[tuple[str, str], str], max_attempts: int | None = None) -> DataFrame:
    """The state of each key after its events in order; events that the table forbids change nothing.

    One key's events are folded in one aggregate; max_attempts turns the failure after so many claims into `failed`.
    """
    moves = F.create_map(*[F.lit(x) for (s, e), t in table.items() for x in (f"{s}>{e}", t)])
    listed = events.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(event).alias("e")))), lambda x: x["e"]).alias("events"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("refused"))

    def step(a, e):
        to = F.try_element_at(moves, F.concat_ws(">", a["state"], e))
        tries = a["attempts"] + ((e == "claim") & to.isNotNull()).cast("int")
        if max_attempts is not None:
            to = F.when((to == "retryable") & (a["attempts"] >= max_attempts), "failed").otherwise(to)
        return F.struct(F.coalesce(to, a["state"]).alias("state"), tries.alias("attempts"), (a["refused"] + to.isNull().cast("int")).alias("refused"))

    return listed.select(key, F.aggregate("events", zero, step).alias("s"), F.size("events").alias("events")).select(key, "s.*", "events")


def stale_runners(heartbeats: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """L4: last heartbeat of each runner and whether it is too old."""
    last = heartbeats.groupBy("runner_id").agg(F.max("ts").alias("last"))
    return last.withColumn("stale", F.unix_timestamp(now) - F.unix_timestamp("last") > seconds)


def claimable(jobs: DataFrame, now: Column, limit: int, stale_s: int = 600) -> DataFrame:
    """L2: the oldest jobs that may be claimed: pending, retryable, or running without a heartbeat for too long."""
    open_ = F.col("status").isin("pending", "retryable") | ((F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > stale_s))
    return jobs.where(open_).orderBy("created_at", "job_id").limit(limit)


def review(candidates: DataFrame, decisions: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates with the new status of their decision, or the reason why it is refused.

    A rejection needs a reason, a revision its text, `not_applicable` a note; the decision must name the version it saw.
    """
    j = candidates.join(decisions.select(key, "event", "note", "revised", F.col("version").alias("seen")), key, "left")
    to = next_state(F.when(F.col("missing"), "missing").otherwise(F.col("status")), F.col("event"), REVIEW)
    error = (
        F.when(F.col("event").isNull(), None).when(F.col("seen") != F.col("version"), "version_conflict").when(to.isNull(), "not_allowed")
        .when(F.col("event").isin("reject", "not_applicable") & (F.coalesce("note", F.lit("")) == ""), "note_missing").when((F.col("event") == "revise") & (F.coalesce("revised", F.lit("")) == ""), "revision_missing")
    )
    return j.withColumn("error", error).withColumn("new_status", F.when(F.col("event").isNotNull() & error.isNull(), to).otherwise(F.col("status")))


def auto_confirmable(confidence: Column, missing: Column, parameters_known: Column) -> Column:
    """Candidates that need no person: found, with parameters, and sure."""
    return ~missing & parameters_known & (confidence >= 0.9)


def rule_set_delta(previous: DataFrame, delta: DataFrame, key: str = "requirement_id") -> DataFrame:
    """The next rule set: rows of the delta, and those of the previous set whose id, without its -rN suffix, the delta has not."""
    bare = F.regexp_replace(key, r"-r\d+$", "")
    return delta.unionByName(previous.withColumn("__b", bare).join(delta.select(bare.alias("__b")), "__b", "left_anti").drop("__b"), allowMissingColumns=True)


def task_sync(existing: DataFrame, current: DataFrame, key: str = "fingerprint") -> DataFrame:
    """What becomes of each task: create, reopen, touch or close, by full outer join of fingerprints."""
    j = existing.select(key, F.col("state").alias("was")).join(current.select(key, F.lit(True).alias("now")), key, "full_outer")
    live = F.col("was").isin("open", "in_progress", "submitted", "reopened")
    return j.withColumn("action", F.when(F.col("was").isNull(), "create").when(F.col("now") & live, "touch").when(F.col("now"), "reopen").when(live, "close").otherwise("keep"))


def expire(records: DataFrame, today: Column, until: Sequence[str] = ("valid_until", "cert_valid_until")) -> DataFrame:
    """Active records past the first validity column that they have become expired."""
    end = F.coalesce(*[F.to_date(c) for c in until if c in records.columns])
    return records.withColumn("status", F.when((F.col("status") == "active") & (end < today), "expired").otherwise(F.col("status")))


def waivers_expired(approvals: DataFrame, waivers: DataFrame, today: Column) -> DataFrame:
    """Approvals that stand on a waiver which is over go back to blocked."""
    over = waivers.groupBy("approval_id").agg(F.max("valid_until").alias("__u")).where(F.col("__u") < today).select("approval_id", F.lit("waiver_expired").alias("__e"))
    return approvals.join(over, "approval_id", "left").withColumn("state", F.coalesce(next_state(F.col("state"), F.col("__e"), APPROVAL), F.col("state"))).drop("__e")


def gate_reason(identity: Column, overdue: Column, expired: Column, test: Column) -> Column:
    """C20: the first reason why a project may not be matched; null if it may."""
    return F.when(identity == "conflict", "identity_conflict").when(identity.isNull(), "identity_missing").when(test, None).when(overdue, "deadline_passed").when(expired, "archived")


def readiness(projects: DataFrame, now: Column) -> DataFrame:
    """Precision of the deadline, time left, ordered blocking reasons and what may be done.

    projects (project_id, identity_status, deadline_at, deadline_day, requirements_n, run_n, open_exceptions).
    """
    blocking = F.array_compact(F.array(
        F.when(F.col("identity_status") == "conflict", "identity_conflict"), F.when(F.coalesce("requirements_n", F.lit(0)) == 0, "no_requirements"),
        F.when(F.coalesce(F.when(F.col("deadline_at").isNotNull(), now >= F.col("deadline_at")).otherwise(F.col("deadline_day") < F.to_date(now)), F.lit(False)), "deadline_passed"),
        F.when(F.coalesce("open_exceptions", F.lit(0)) > 0, "exceptions_open"),
    ))
    out = projects.withColumns({
        "precision": F.when(F.col("deadline_at").isNotNull(), "datetime").when(F.col("deadline_day").isNotNull(), "date").otherwise("missing"),
        "days_left": F.datediff(F.coalesce(F.to_date("deadline_at"), F.col("deadline_day")), F.to_date(now)), "blocking": blocking,
    })
    hard = F.filter("blocking", lambda b: b != "exceptions_open")
    return out.withColumns({"can_match": F.size(hard) == 0, "can_recalculate": (F.size(hard) == 0) & (F.coalesce("run_n", F.lit(0)) > 0), "can_approve": (F.size("blocking") == 0) & (F.coalesce("run_n", F.lit(0)) > 0)})


def pipeline_gates(status: DataFrame, gates: Sequence[str] = ("G0", "G1", "G2", "G3", "G4", "G5", "G6")) -> DataFrame:
    """For each item the first gate that has not passed; later gates count as not reached. status (item_id, gate, passed)."""
    order = values.mapped(F.col("gate"), gates)
    stop = status.groupBy("item_id").agg(F.min(F.when(~F.col("passed"), order)).alias("stop"), F.count("*").alias("seen"))
    return stop.select("item_id", F.when(F.col("stop").isNotNull(), F.element_at(F.array(*[F.lit(g) for g in gates]), F.col("stop"))).alias("blocked_at"), (F.col("stop").isNull() & (F.col("seen") == len(gates))).alias("through"))


def rescreen(pool: DataFrame, verdict: Column, automatic: Sequence[str], demoting: Sequence[str]) -> DataFrame:
    """Rows that no person has touched take a new verdict, but only one that demotes them."""
    return pool.withColumn("__v", verdict).withColumn("status", F.when(F.col("status").isin(*automatic) & F.col("__v").isin(*demoting), F.col("__v")).otherwise(F.col("status"))).drop("__v")


def ledger_row(ref: Column) -> Column:
    """The ledger row that a reference or name names as `rowN`."""
    return F.nullif(F.regexp_extract(ref, r"row(\d+)", 1), F.lit("")).cast("int")


def onsite_repair(people: DataFrame, sheet: DataFrame) -> DataFrame:
    """People whose ledger row says they are off site lose the project that they still hold."""
    j = people.withColumn("row_no", ledger_row(F.col("ref"))).join(sheet.select("row_no", "on_site"), "row_no", "left")
    return j.withColumn("repaired", (F.col("on_site") == "no") & F.col("project").isNotNull()).withColumn("project", F.when(F.col("repaired"), None).otherwise(F.col("project")))


def reconcile_tables(source: DataFrame, target: DataFrame, key: Column) -> DataFrame:
    """Rows on each side, keys on one side only, and rows that folded keys explain."""
    a, b = source.groupBy(key.alias("k")).agg(F.count("*").alias("s")), target.groupBy(key.alias("k")).agg(F.count("*").alias("t"))
    return a.join(b, "k", "full_outer").agg(
        F.sum(F.coalesce("s", F.lit(0))).alias("source_rows"), F.sum(F.coalesce("t", F.lit(0))).alias("target_rows"), F.count_if(F.col("t").isNull()).alias("missing_keys"),
        F.count_if(F.col("s").isNull()).alias("extra_keys"), F.sum(F.when(F.col("t").isNotNull(), F.greatest(F.col("s") - F.col("t"), F.lit(0))).otherwise(0)).alias("folded_rows"),
    )


def restored_projects(references: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects that candidates name but the table lacks, with a deadline where it can be read."""
    return references.groupBy("project_id").agg(F.max(F.to_date(values.parse_instant(F.col("deadline")))).alias("bid_deadline")).join(projects.select("project_id"), "project_id", "left_anti")


def backfill(rows: DataFrame, key: str, version: str, fresh: Column, column: str) -> DataFrame:
    """P5: the newest version of each row with a column computed anew where it is missing."""
    top = rows.groupBy(key).agg(F.max(version).alias(version))
    return rows.join(top, [key, version], "left_semi").withColumn(column, F.coalesce(F.col(column), fresh))


def needs_ocr_review(confidence: Column, routed: Column, limit: float = 0.6) -> Column:
    """Recognised text that a person must look at."""
    return F.coalesce(routed, F.lit(False)) | F.coalesce(confidence < limit, F.lit(True))


def per_lot(requirements: DataFrame, lots: DataFrame) -> DataFrame:
    """One copy of the common requirements for each lot, and each lot's own; lots (lot_id) are few."""
    every = lots.agg(F.collect_set("lot_id").alias("__lots"))  # one row
    common = requirements.where("lot_id is null").drop("lot_id").crossJoin(every).withColumn("lot_id", F.explode("__lots")).drop("__lots")
    return common.unionByName(requirements.where("lot_id is not null"))


def submission_step(materials: Column) -> Column:
    """struct(required, stage) of the first rule that a text about submissions fits."""
    rules = [
        ("保证金|保函", True, "submission_ready"), ("CA|数字证书", True, "preparation"), ("踏勘|现场", False, "preparation"), ("答疑|质疑", False, "preparation"),
        ("报名|文件获取", True, "preparation"), ("递交|投标文件", True, "submission_ready"), ("开标", True, "opened"), ("承诺|声明", True, "submission_ready"),
    ]
    put = lambda a, b: F.struct(F.lit(a).alias("required"), F.lit(b).alias("stage"))
    out = None
    for p, a, b in rules:
        out = F.when(materials.rlike(p), put(a, b)) if out is None else out.when(materials.rlike(p), put(a, b))
    return out.otherwise(F.struct(F.lit(None).cast("boolean").alias("required"), F.lit("approval_ready").alias("stage")))
