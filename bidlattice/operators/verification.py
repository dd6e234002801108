"""Evidence constraints, merges of runs, and what is shown of a project (inventory D16, D21, E19, O6, O14, N17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values


def amount_check(raw: Column, least: Column) -> Column:
    """blocked where the amount can't be read, else passed or failed."""
    got = values.normalise_amount(raw)
    return F.when(least.isNull(), "passed").when(got.isNull(), "blocked").when(got >= least, "passed").otherwise("failed")


def level_check(raw: Column, least: Column) -> Column:
    """blocked where either level is unknown."""
    ok = text.level_at_least(text.normalise_level(raw), least)
    return F.when(least.isNull(), "passed").when(ok.isNull(), "blocked").when(ok, "passed").otherwise("failed")


def hash_check(actual: Column, expected: Column) -> Column:
    """A missing or other digest fails."""
    return F.when(F.coalesce(actual == expected, F.lit(False)), "passed").otherwise("failed")


def verified(candidates: DataFrame, checks: dict[str, Column], key: str = "material_id") -> DataFrame:
    """Each candidate with its verdict over all checks: blocked if one is blocked, else failed if one fails.

    The names of blocked and failed checks come along, in the order given.
    """
    named = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("state")) for n, c in checks.items()])
    out = candidates.withColumn("__c", named)
    of = lambda s: F.transform(F.filter("__c", lambda x: x["state"] == s), lambda x: x["check"])
    out = out.withColumns({"blocked": of("blocked"), "failed": of("failed")}).drop("__c")
    return out.withColumn("verdict", F.when(F.size("blocked") > 0, "blocked").when(F.size("failed") > 0, "failed").otherwise("passed"))


def without_blocked(evidence: DataFrame, judged: DataFrame, key: str = "material_id") -> DataFrame:
    """Evidence of materials that no verdict has blocked."""
    return evidence.join(judged.where("verdict = 'blocked'").select(key), key, "left_anti")


def gate_merge(matrix: DataFrame, run: str = "run_id", position: str = "position") -> DataFrame:
    """The whole matrix with whether a run that stops at its first hard failure gets to each row."""
    hard = (F.col("req_type") == "hard_requirement") & (F.col("decision_scope") == "admission") & (F.col("match_result") == "not_satisfied")
    stop = matrix.where(hard).groupBy(run).agg(F.min(position).alias("__stop"))
    return matrix.join(stop, run, "left").withColumn("gate_executed", F.col("__stop").isNull() | (F.col(position) <= F.col("__stop"))).drop("__stop")


def queues(matrix: DataFrame, limit: int | None = None) -> DataFrame:
    """Open rows of the admission scope by queue, hard failures first, with their place in it.

    With a limit a queue shows so many rows; `hidden` says how many more it has.
    """
    m = F.col("match_result")
    queue = F.when(m == "not_satisfied", "blocked").when(m == "unverifiable", "pending").when(m.isin("manual_review", "not_calculable"), "review")
    rows = matrix.where((F.col("decision_scope") == "admission") & (F.col("req_type") != "action_requirement")).withColumn("queue", queue).where("queue is not null")
    from .relational import top_per_group

    shown = top_per_group(rows, ["run_id", "queue"], [F.col("position"), F.col("requirement_id")], limit or (1 << 31) - 1)
    if limit is None:
        return shown.withColumn("hidden", F.lit(0).cast("long"))
    sizes = rows.groupBy("run_id", "queue").agg(F.greatest(F.lit(0), F.count("*") - limit).alias("hidden"))
    return shown.join(sizes, ["run_id", "queue"])


def filled(fields: DataFrame, proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields whose value is missing take an accepted proposal (reject_reason null); a refused one is noted.

    proposals has the keys, value and reject_reason, at most one row for each key.
    """
    p = proposals.select(*keys, F.col("value").alias("__v"), F.col("reject_reason").alias("__r"), F.lit(True).alias("__p"))
    j = fields.join(p, list(keys), "left")
    take = F.col("value").isNull() & F.col("__p").isNotNull() & F.col("__r").isNull()
    review = F.when(F.col("value").isNull() & F.col("__r").isNotNull(), "llm_failed").when(take, "llm_filled")
    return j.select(*keys, F.when(take, F.col("__v")).otherwise(F.col("value")).alias("value"), review.alias("review"))


def prescreen(projects: DataFrame, materials: DataFrame, admissions: DataFrame) -> DataFrame:
    """One row a project with lists of facts, lacks and points to review.

    projects (project_id, identity_status, bid_deadline), materials (project_id), admissions (project_id, missing_data, manual_review).
    """
    n = materials.groupBy("project_id").agg(F.count("*").alias("materials_n"))
    j = projects.join(n, "project_id", "left").join(admissions, "project_id", "left").fillna(0, ["materials_n", "missing_data", "manual_review"])
    pick = lambda *cs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cs]))
    return j.select(
        "project_id",
        pick(("identity_confirmed", F.col("identity_status") == "confirmed"), ("deadline_known", F.col("bid_deadline").isNotNull()), ("materials_present", F.col("materials_n") > 0)).alias("facts"),
        pick(("deadline", F.col("bid_deadline").isNull()), ("materials", F.col("materials_n") == 0), ("evidence", F.col("missing_data") > 0)).alias("missing"),
        pick(("identity", F.coalesce(F.col("identity_status") != "confirmed", F.lit(True))), ("requirements", F.col("manual_review") > 0)).alias("review"),
    )


def linked_by_prefix(rows: DataFrame, names: DataFrame, key: str, title: str, name: str, size: int = 8) -> DataFrame:
    """Each row with the shortest name that holds the first `size` characters of its title anywhere, as file names do
    that begin with a number; ties go to the smaller name. null where no name does.

    Names are dealt to all their pieces of that length, so this is a plain join; titles shorter than that meet the pieces of
    their own length.
    """
    heads = rows.select(F.left(title, F.lit(size)).alias("__h")).where(F.col("__h") != "").distinct()
    spans = names.select(F.col(name).alias("linked")).where(F.col(name) != "").distinct().select("linked", F.explode(F.sequence(F.lit(1), F.least(F.lit(size), F.length("linked")))).alias("__n"))
    spans = spans.select("linked", F.explode(F.transform(F.sequence(F.lit(1), F.length("linked") - F.col("__n") + 1), lambda i: F.substr("linked", i, F.col("__n")))).alias("__h"))
    best = spans.join(heads, "__h", "left_semi").groupBy("__h").agg(F.min_by("linked", F.struct(F.length("linked"), "linked")).alias("linked"))
    return rows.withColumn("__h", F.left(title, F.lit(size))).join(best, "__h", "left").drop("__h")


def profile(records: DataFrame, bucket: Column, today: Column) -> DataFrame:
    """Counts of a ledger by bucket: all, verified, expiring within 90 days, expired, and with evidence."""
    from .temporal import expires_soon

    end = F.to_date("valid_until")
    return records.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("total"), F.count_if(F.col("verified_at").isNotNull()).alias("verified"), F.count_if(expires_soon(end, today)).alias("expiring"),
        F.count_if(end < today).alias("expired"), F.bround(F.try_divide(F.count_if(F.size("refs") > 0), F.count("*")), 3).alias("evidence_ratio"),
    )


def performance_profile(records: DataFrame, today: Column, years: int = 5, top: int = 8) -> DataFrame:
    """One row: all performances, those completed within so many years, their sum of contracts, and the most frequent
    types with their counts. records (project_type, completed_at, contract_amount)."""
    recent = F.col("completed_at") >= F.add_months(today, -12 * years)
    types = records.where("project_type is not null").groupBy("project_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project_type").limit(top)
    listed = types.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "project_type", "n"))), lambda x: F.concat_ws(":", x["project_type"], x["n"])), ",").alias("top_types"))
    return records.agg(
        F.count("*").alias("total"), F.count_if(recent).alias("recent"), F.sum(F.when(recent, F.col("contract_amount"))).alias("recent_amount"), F.sum("contract_amount").alias("amount"),
    ).crossJoin(listed)


def manager_profile(records: DataFrame, today: Column) -> DataFrame:
    """One row: managers, those free, those with a second certificate, and conflicts between what a row says of them:
    free but with active projects, or active with an expired certificate. records (availability, active_n, b_cert, cert_valid_until)."""
    free, busy = F.col("availability") == "free", F.coalesce("active_n", F.lit(0)) > 0
    over = F.coalesce(F.col("cert_valid_until") < today, F.lit(False))
    return records.agg(
        F.count("*").alias("total"), F.count_if(free).alias("free"), F.count_if(F.coalesce("b_cert", F.lit("")) != "").alias("with_b_cert"),
        F.count_if(free & busy).alias("free_but_busy"), F.count_if(busy & over).alias("busy_but_expired"),
    )


def evidence_profile(records: DataFrame, limit: float = 0.9) -> DataFrame:
    """By kind: files, those whose recognised text is below the limit, and those without a confidence."""
    return records.groupBy("kind").agg(
        F.count("*").alias("total"), F.count_if(F.col("ocr_confidence") < limit).alias("low_confidence"), F.count_if(F.col("ocr_confidence").isNull()).alias("unread"), F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence"),
    )
