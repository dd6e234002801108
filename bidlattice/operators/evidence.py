"""Rule evaluation: requirements against verified evidence at an instant, with three-valued, explained results.

Requirements are flat rows: run_id, requirement_id, position, req_type (hard_requirement, scored_requirement,
action_requirement), rule_type, decision_scope, lot_id, and the rule's parameters (nullable columns named in PARAMS).
Evidence is one long table of all kinds: run_id is absent, kind, record_id, status, verified_at, valid_from,
valid_until, refs and the superset of attributes in FIELDS.

All kinds are judged in one pass: a requirement meets the records of the kinds it asks for by equality on the kind,
record-level checks become flags, one aggregate that combines on the map side brings them back to the requirement, and
an ordered `when` names the result. Missing values stay null throughout: unknown is not false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .relational import union_kinds
from .temporal import as_of, ineligible_reason

PARAMS = {
    "category": "string", "level": "string", "days": "int", "max_amount": "decimal(18,2)", "years": "array<int>", "allowed": "boolean",
    "amount": "decimal(18,2)", "form": "string", "require_c_cert": "boolean", "need_count": "int", "specialties": "array<string>",
    "subject": "string", "continuous_months": "int", "since": "date", "min_area": "double", "min_amount": "decimal(18,2)",
    "project_type": "string", "max_score": "double", "score_nature": "string", "formula": "string", "review_status": "string", "requires_quote": "boolean",
}
#: Parameters that are compared with records.
COMPARED = ("category", "level", "max_amount", "years", "amount", "form", "require_c_cert", "specialties", "subject", "continuous_months", "since", "min_area", "min_amount", "project_type")
FIELDS = {
    "category": "string", "level": "string", "year": "int", "negative": "boolean", "amount": "decimal(18,2)", "form": "string", "type": "string",
    "cert_type": "string", "specialty": "string", "subject": "string", "continuous_months": "int", "completed_at": "date", "area": "double",
    "contract_amount": "decimal(18,2)", "project_type": "string", "entered_by": "string",
}
#: The kinds of evidence that each type of rule looks at.
WANTED = {
    "qualification": ("qualification_record",), "safety_license": ("safety_license",), "business_license": ("business_license",),
    "bid_validity": ("response_document",), "response": ("response_document",), "ceiling_price": ("bid_price_input",), "quote_cap": ("bid_price_input",),
    "financial": ("financial_report", "bank_credit"), "credit": ("credit_check_report",), "consortium": ("consortium_declaration",),
    "bid_bond": ("bid_bond",), "safety_officer": ("safety_officer_cert",), "technical_team": ("technical_team_member",), "tech_team": ("technical_team_member",),
    "social_security": ("social_security_proof",), "similar_performance": ("similar_performance",),
}


def build_evidence(qualifications: DataFrame, performances: DataFrame, managers: DataFrame, personnel: DataFrame) -> DataFrame:
    """The four ledgers as one table of evidence kinds; personnel records keep their references."""
    safe = F.col("category").contains("安全生产")
    officer = F.coalesce(F.col("cert_level").startswith("C"), F.lit(False))
    return union_kinds({
        "safety_license": qualifications.where(safe), "qualification_record": qualifications.where(~safe | F.col("category").isNull()),
        "similar_performance": performances, "manager_profile": managers,
        "safety_officer_cert": personnel.where(officer).withColumn("cert_type", F.lit("C")), "technical_team_member": personnel.where(~officer),
    })


def ledger_context(evidence: DataFrame, at: Column) -> DataFrame:
    """For each kind the number of records and why records take no part."""
    why = ineligible_reason(F.to_date("valid_from"), F.to_date("valid_until"), F.col("verified_at"), at)
    n = lambda s: F.count_if(why == s)
    return evidence.groupBy("kind").agg(F.count("*").alias("ledger_n"), n("unverified").alias("unverified_n"), n("expired").alias("expired_n"), n("not_yet_valid").alias("early_n"))


def type_matches(wanted: Column, got: Column) -> Column:
    """Project types agree if one holds the other, as they are or without the suffix for works."""
    core = lambda c: F.regexp_replace(c, "基础工程|工程", "")
    return text.mutual_containment(wanted, got) | ((core(wanted) != "") & (core(got) != "") & text.mutual_containment(core(wanted), core(got)))


def _flags(at: Column) -> dict[str, Column]:
    """Checks of one record against one requirement, for each type of rule."""
    r, e = (lambda c: F.col(f"r_{c}")), (lambda c: F.col(f"e_{c}"))
    done = e("completed_at")
    category_ok = r("category").isNull() | F.coalesce(text.mutual_containment(r("category"), e("category")), F.lit(False))
    level_ok = text.rule_level_rank(e("level")) >= text.rule_level_rank(r("level"))
    quote = e("type") == "quoted_price"
    return {
        "qualification": category_ok & level_ok,
        "safety_license": F.lit(True), "business_license": F.lit(True), "bid_validity": F.lit(True), "response": F.lit(True), "consortium": F.lit(True),
        "ceiling_price": quote & (e("amount") <= r("max_amount")), "quote_cap": quote & (e("amount") <= r("max_amount")),
        "financial": F.array_contains(r("years"), e("year")) | ((F.size(r("years")) == 0) & (e("kind") == "bank_credit")),
        "credit": ~F.coalesce(e("negative"), F.lit(False)),
        "bid_bond": (e("amount") == r("amount")) & (r("form").isNull() | (e("form") == r("form"))),
        "safety_officer": ~F.coalesce(r("require_c_cert"), F.lit(False)) | (e("cert_type") == "C"),
        "technical_team": F.array_contains(r("specialties"), e("specialty")), "tech_team": F.array_contains(r("specialties"), e("specialty")),
        "social_security": (e("subject") == F.coalesce(r("subject"), F.lit("project_manager"))) & (F.coalesce(e("continuous_months"), F.lit(0)) >= F.coalesce(r("continuous_months"), F.lit(1))),
        "similar_performance": (e("subject") == F.coalesce(r("subject"), F.lit("bidder"))) & done.isNotNull() & (r("since").isNull() | (done >= r("since"))) & (done <= at)
        & (e("area").isNull() | (e("area") >= F.coalesce(r("min_area"), F.lit(0.0)))) & (r("min_amount").isNull() | F.coalesce(e("contract_amount") >= r("min_amount"), F.lit(False)))
        & (r("project_type").isNull() | F.coalesce(type_matches(r("project_type"), e("project_type")), F.lit(False))),
    }


def _result(state: str, code: str | None = None) -> Column:
    return F.struct(F.lit(state).alias("match_result"), F.lit(code).cast("string").alias("reason_code"))


def _no_evidence() -> Column:
    """Why there is no valid record: expired is a fact, unverified waits, otherwise it is missing."""
    return (
        F.when(F.col("expired_n") > 0, _result("not_satisfied", "certificate_expired"))
        .when(F.col("unverified_n") > 0, _result("unverifiable", "evidence_pending_verification"))
        .when(F.col("early_n") > 0, _result("unverifiable", "evidence_missing"))
        .when(F.col("ledger_n") == 0, _result("unverifiable", "enterprise_record_missing"))
        .otherwise(_result("unverifiable", "evidence_pending_verification"))
    )


def _hard_result() -> Column:
    """The result of each type of rule from the requirement's aggregates."""
    r, t = (lambda c: F.col(f"r_{c}")), F.col("rule_type")
    ok, n = F.col("ok_n") > 0, F.col("valid_n")
    unstructured = _result("manual_review", "rule_unstructured")
    satisfied, short = _result("satisfied"), _result("not_satisfied", "grade_below_requirement")
    not_asked = _result("not_applicable", "not_applicable")
    missing = _result("unverifiable", "evidence_missing")
    pool = F.greatest(n + F.col("unverified_n") + F.col("expired_n") + F.col("early_n"), n + F.col("ledger_n"))
    nothing = r("since").isNull() & r("min_area").isNull() & r("min_amount").isNull() & r("project_type").isNull()
    qualification = (
        F.when(n == 0, _no_evidence()).when(r("category").isNull() & r("level").isNull(), unstructured).when(ok, satisfied)
        .when((F.col("category_n") == n) & r("level").isNotNull(), short).otherwise(_result("not_satisfied", "profession_mismatch"))
    )
    officer = (
        F.when(r("need_count").isNull(), F.when(F.col("ok_n") == 0, _no_evidence()).otherwise(unstructured))
        .when(F.col("ok_n") >= r("need_count"), satisfied).when(pool == 0, _result("unverifiable", "enterprise_record_missing"))
        .when(r("need_count") <= pool, _result("unverifiable", "evidence_pending_verification")).otherwise(_result("not_satisfied", "verified_quantity_insufficient"))
    )
    team = (
        F.when(F.coalesce(F.size("r_specialties"), F.lit(0)) <= 0, unstructured).when(F.size(F.array_except("r_specialties", F.coalesce("covered", F.array().cast("array<string>")))) == 0, satisfied)
        .when(n == 0, _no_evidence()).otherwise(missing)
    )
    return (
        F.when(t == "submission_package", not_asked)
        .when(t == "qualification", qualification)
        .when(t.isin("safety_license", "business_license"), F.when(n > 0, satisfied).otherwise(_no_evidence()))
        .when(t == "bid_validity", F.when(r("days").isNull(), unstructured).when(n > 0, satisfied).otherwise(not_asked))
        .when(t == "ceiling_price", F.when(r("max_amount").isNull(), unstructured).when(F.col("quote_n") == 0, not_asked).when(ok | (F.col("priced_n") == 0), satisfied).otherwise(short))
        .when(t == "quote_cap", F.when(F.col("quote_n") == 0, _result("unverifiable", "authorized_input_missing")).when(F.col("priced_n") == 0, _result("unverifiable", "validity_date_missing"))
              .when(r("max_amount").isNull(), unstructured).when(ok, satisfied).otherwise(short))
        .when(t == "financial", F.when(ok, satisfied).when(F.col("expired_n") > 0, missing).otherwise(_no_evidence()))
        .when(t == "credit", F.when(n == 0, not_asked).when(F.col("bad_n") > 0, _result("not_satisfied", "profession_mismatch")).otherwise(satisfied))
        .when(t == "consortium", F.when(r("allowed").isNull(), unstructured).otherwise(satisfied))
        .when(t == "bid_bond", F.when(n == 0, not_asked).when(r("amount").isNull(), unstructured).when(ok, satisfied).otherwise(short))
        .when(t == "response", F.when(n > 0, satisfied).otherwise(missing))
        .when(t == "safety_officer", officer)
        .when(t.isin("technical_team", "tech_team"), team)
        .when(t == "social_security", F.when(n == 0, _no_evidence()).when(ok, satisfied).otherwise(missing))
        .when(t == "similar_performance", F.when(nothing, unstructured).when(n == 0, _no_evidence()).when(ok, satisfied).otherwise(missing))
        .otherwise(unstructured)
    )


def score_class(r: str = "") -> Column:
    """I32: the five classes of scored requirements."""
    c = lambda x: F.col(f"r_{x}")
    return (
        F.when(c("score_nature") == "subjective", "subjective_review")
        .when((F.col("rule_type") == "methodology") | (c("formula") == "methodology"), "methodology_only")
        .when(F.coalesce(c("requires_quote"), F.lit(False)) | F.col("rule_type").isin("quote_cap", "ceiling_price", "price_score"), "price_formula")
        .when((c("formula") == "fixed_max") | (F.col("rule_type") == "similar_performance"), "objective_calculable").otherwise("unstructured")
    )


def _scored_result(hard: Column) -> Column:
    """A scored requirement's result; its score is null unless it is satisfied."""
    k, c = F.col("score_class"), (lambda x: F.col(f"r_{x}"))
    state = hard["match_result"]
    return (
        F.when(k == "methodology_only", _result("not_applicable", "not_applicable"))
        .when(k == "subjective_review", F.when(c("review_status") == "passed", _result("satisfied")).otherwise(_result("manual_review", "professional_judgement_required")))
        .when(k == "price_formula", F.when(F.col("entered_n") == 0, _result("not_calculable", "authorized_input_missing"))
              .when(~F.coalesce(c("formula").isin("fixed_max", "price_deviation"), F.lit(False)), _result("not_calculable", "formula_missing")).otherwise(_result("satisfied")))
        .when(F.col("rule_type") == "similar_performance", F.when(state == "unverifiable", _result("not_calculable", "scoring_evidence_missing")).otherwise(hard))
        .when(F.col("valid_n") == 0, _result("not_calculable", "scoring_evidence_missing"))
        .when(c("formula") == "fixed_max", _result("satisfied")).otherwise(_result("not_calculable", "formula_missing"))
    )


def match_matrix(requirements: DataFrame, evidence: DataFrame, at: Column, exempt: Column | None = None) -> DataFrame:
    """One row per requirement: result, reason_code, score and evidence references.

    A hard or scored requirement that is satisfied without any reference goes to manual review unless the condition
    `exempt` holds for its rule. Evidence of a lot is seen by requirements of the same lot only.
    """
    kinds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(k) for k in x]) for kv in WANTED.items() for x in kv])
    reqs = requirements.select("run_id", "requirement_id", "position", "req_type", "rule_type", "decision_scope", "lot_id", *[F.col(c).alias(f"r_{c}") for c in PARAMS])
    asked = reqs.withColumn("kind", F.explode_outer(F.try_element_at(kinds, F.col("rule_type"))))
    live = as_of(evidence, at, status=("active", "valid")).select("kind", "record_id", "refs", F.col("lot_id").alias("e_lot"), F.col("kind").alias("e_kind"), *[F.col(c).alias(f"e_{c}") for c in FIELDS])
    # requirements that ask the same are one question, put to the records of a kind and lot; records of no lot are asked once for all lots
    question = F.struct("rule_type", *[F.col(f"r_{c}") for c in COMPARED])
    seen_lots = F.array_distinct(F.array(F.col("lot_id").cast("string"), F.lit(None).cast("string")))
    asks = asked.withColumn("__lot", F.explode(seen_lots)).select("run_id", "requirement_id", F.struct(F.col("kind"), F.col("__lot").alias("lot"), question.alias("question")).alias("ask"))
    each = asks.select("ask").distinct().select("ask", F.struct("ask.kind", "ask.lot").alias("at_"), "ask.question.*")
    met = live.withColumn("at_", F.struct("kind", F.col("e_lot").alias("lot"))).drop("kind").join(each, "at_")  # the questions may be broadcast
    flags = _flags(at)
    ok = F.lit(False)
    for kind, flag in flags.items():
        ok = F.when(F.col("rule_type") == kind, F.coalesce(flag, F.lit(False))).otherwise(ok)
    there = F.lit(True)
    quote = F.coalesce(F.col("e_type") == "quoted_price", F.lit(False))
    category_ok = F.col("r_category").isNull() | F.coalesce(text.mutual_containment(F.col("r_category"), F.col("e_category")), F.lit(False))
    heard = met.withColumn("ok", ok).groupBy("ask").agg(
        F.count_if(there).alias("valid_n"), F.count_if("ok").alias("ok_n"), F.count_if(there & category_ok).alias("category_n"),
        F.count_if(quote).alias("quote_n"), F.count_if(quote & F.col("e_amount").isNotNull()).alias("priced_n"), F.count_if(quote & F.col("e_entered_by").isNotNull()).alias("entered_n"),
        F.count_if(there & F.coalesce(F.col("e_negative"), F.lit(False))).alias("bad_n"),
        F.collect_set(F.when(there, F.col("e_specialty"))).alias("covered"),
        F.min(F.when(F.col("ok"), F.col("record_id"))).alias("first_id"), F.min_by("refs", F.when(F.col("ok"), F.col("record_id"))).alias("first_refs"), F.count_if(F.col("ok") & (F.size("refs") > 0)).alias("with_refs"),
    )
    counts = ("valid_n", "ok_n", "category_n", "quote_n", "priced_n", "entered_n", "bad_n", "with_refs")
    seen = asks.join(heard, "ask").groupBy("run_id", "requirement_id").agg(
        *[F.sum(c).alias(c) for c in counts], F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.min_by("first_refs", "first_id").alias("first_refs"),
    )
    context = asked.select("run_id", "requirement_id", "kind").join(ledger_context(evidence, at), "kind", "left").groupBy("run_id", "requirement_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ledger_n", "unverified_n", "expired_n", "early_n")]
    )
    rows = reqs.join(seen, ["run_id", "requirement_id"], "left").join(context, ["run_id", "requirement_id"], "left")
    rows = rows.fillna(0, list(counts))  # no record of the kind, or only of other lots
    rows = rows.withColumn("score_class", F.when(F.col("req_type") == "scored_requirement", score_class()))
    rows = rows.withColumn("hard", _hard_result())
    rows = rows.withColumn(
        "res",
        F.when(F.col("req_type") == "action_requirement", _result("not_started")).when(F.col("req_type") == "scored_requirement", _scored_result(F.col("hard"))).otherwise(F.col("hard")),
    )
    free = F.coalesce(exempt, F.lit(False)) if exempt is not None else (F.col("rule_type") == "consortium")
    down = (F.col("res.match_result") == "satisfied") & (F.coalesce("with_refs", F.lit(0)) == 0) & ~free & (F.col("req_type") != "action_requirement")
    final = F.when(down, _result("manual_review", "evidence_refs_missing")).otherwise(F.col("res"))
    return rows.withColumn("res", final).select(
        "run_id", "requirement_id", "position", "req_type", "rule_type", F.coalesce("decision_scope", F.lit("admission")).alias("decision_scope"), "lot_id",
        "res.match_result", "res.reason_code", "score_class", F.col("r_max_score").alias("max_score"),
        F.when((F.col("req_type") == "scored_requirement") & (F.col("res.match_result") == "satisfied"), F.col("r_max_score")).alias("score"),
        F.when(F.col("res.match_result") == "satisfied", F.col("first_refs")).alias("evidence_refs"),
    )


def admission(matrix: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """One row a run: counts, results by domain, scores and the conclusion.

    The conclusion follows the order: hard failure, pending evidence, open parse exceptions, approval actions, review or
    incomplete scores, full score. exceptions (run_id, open_n) is optional. Sums without a calculable row are null.
    """
    hard = (F.col("req_type") == "hard_requirement") & (F.col("decision_scope") == "admission")
    scored = (F.col("req_type") == "scored_requirement") & (F.col("score_class") != "methodology_only")
    action = F.col("req_type") == "action_requirement"
    m = F.col("match_result")
    n = lambda c: F.count_if(c)
    out = matrix.groupBy("run_id").agg(
        n(hard & (m == "satisfied")).alias("satisfied"), n(hard & (m == "not_satisfied")).alias("not_satisfied"), n(hard & (m == "unverifiable")).alias("missing_data"),
        n(hard & (m == "manual_review")).alias("manual_review"), n(hard).alias("hard_total"), n(scored).alias("scored_total"),
        n(scored & (m != "satisfied")).alias("scored_open"), n(action).alias("action_total"), n(action & m.isin("ready", "completed")).alias("action_done"),
        n(hard & (m != "satisfied")).alias("hard_open"),
        F.sum(F.when(F.col("score_class") == "objective_calculable", F.col("score"))).alias("score"),
        F.sum(F.when(F.col("score_class") == "objective_calculable", F.col("max_score"))).alias("max_score"),
        F.array_join(F.sort_array(F.collect_set(F.when(hard & (m != "satisfied"), F.col("reason_code")))), ",").alias("gaps"),
    )
    if exceptions is not None:
        out = out.join(exceptions, "run_id", "left").fillna(0, ["open_n"])
    else:
        out = out.withColumn("open_n", F.lit(0))
    out = out.withColumns({
        "qualification_result": F.when(F.col("not_satisfied") > 0, "failed").when(F.col("missing_data") + F.col("manual_review") > 0, "pending").otherwise("passed"),
        "scoring_result": F.when(F.col("scored_open") > 0, "not_full").otherwise("full"),
        "eligible": (F.col("hard_open") == 0) & (F.col("scored_open") == 0) & (F.col("action_done") == F.col("action_total")),
    })
    return out.withColumn(
        "conclusion",
        F.when(F.col("qualification_result") == "failed", "hard_requirement_failed").when(F.col("missing_data") > 0, "evidence_pending")
        .when(F.col("open_n") > 0, "parse_exceptions_open").when(F.col("action_done") < F.col("action_total"), "approval_actions_open")
        .when((F.col("manual_review") > 0) | (F.col("scored_open") > 0), "review_required").otherwise("full_score"),
    )


def person_plans(people: DataFrame, rules: DataFrame) -> DataFrame:
    """For each role and person which of the role's rules hold, whether the plan is complete, and the primary plan.

    people (person_id, role, specialty, cert_level, b_cert, busy, refs), rules (role, rule_id, specialty, level, need_b,
    need_free). Every person meets only the rules of its role, which are few. Among complete plans the one with the
    most references comes first, then the highest certificate, then the larger id.
    """
    pair = people.join(rules.select("role", "rule_id", F.col("specialty").alias("w_specialty"), F.col("level").alias("w_level"), "need_b", "need_free"), "role")
    fail = (
        F.when(F.col("w_specialty").isNotNull() & ~F.arrays_overlap(text.specialty_tokens(F.col("w_specialty")), text.specialty_tokens(F.col("specialty"))), "specialty_mismatch")
        .when(F.col("w_level").isNotNull() & (text.rule_level_rank(F.col("cert_level")) < text.rule_level_rank(F.col("w_level"))), "grade_below_requirement")
        .when(F.col("need_b") & F.coalesce(F.col("b_cert") == "", F.lit(True)), "b_cert_missing").when(F.col("need_free") & F.col("busy"), "active_project")
    )
    plans = pair.withColumn("fail", fail).groupBy("role", "person_id").agg(
        F.bool_and(F.col("fail").isNull()).alias("complete"), F.count_if(F.col("fail").isNull()).alias("met"), F.count("*").alias("rules"),
        F.array_join(F.sort_array(F.collect_set("fail")), ",").alias("gaps"), F.max(F.size("refs")).alias("refs"), F.max(text.rule_level_rank(F.col("cert_level"))).alias("rank"),
    )
    best = plans.where("complete").groupBy("role").agg(F.max_by("person_id", F.struct("refs", "rank", "person_id")).alias("primary_id"))
    return plans.join(best, "role", "left").withColumn("primary", F.coalesce(F.col("person_id") == F.col("primary_id"), F.lit(False))).drop("primary_id", "refs", "rank")


def identity_check(pairs: DataFrame, codes: Sequence[str], names: Sequence[str], budget: str = "budget_amount", deadline: str = "bid_deadline", of_zeros: float = 0.0) -> DataFrame:
    """Expected against actual identity fields of each project: conflicts, warnings and a status.

    Columns are named e_<field> and a_<field>. Only fields known on both sides count: codes must agree; names agree from
    a Dice of 0.60 and conflict below 0.35; budgets may differ by 5 in 100; nothing comparable is a warning.
    of_zeros is what two budgets of 0 count as: no difference, unless a caller wants them looked at.
    """
    known = lambda f: (F.coalesce(F.col(f"e_{f}").cast("string"), F.lit("")) != "") & (F.coalesce(F.col(f"a_{f}").cast("string"), F.lit("")) != "")
    conflicts, warnings, compared = [], [], F.lit(False)
    # the normalised names become columns first: a Python function can't stand inside the similarity's lambdas
    pairs = pairs.withColumns({f"__{s}_{f}": text.normalise_project_name(F.col(f"{s}_{f}")) for f in names for s in "ea"})
    for f in codes:
        compared = compared | known(f)
        conflicts.append(F.when(known(f) & (text.normalise_code(F.col(f"e_{f}")) != text.normalise_code(F.col(f"a_{f}"))), f))
    for f in names:
        compared = compared | known(f)
        alike = text.dice(F.col(f"__e_{f}"), F.col(f"__a_{f}"))
        conflicts.append(F.when(known(f) & (alike < 0.35), f))
        warnings.append(F.when(known(f) & alike.between(0.35, 0.5999), f))
    from ..functions.values import relative_gap

    warnings.append(F.when(known(budget) & (relative_gap(F.col(f"e_{budget}"), F.col(f"a_{budget}"), of_zeros) > 0.05), budget))
    warnings.append(F.when(known(deadline) & (F.to_date(f"e_{deadline}") != F.to_date(f"a_{deadline}")), deadline))
    warnings.append(F.when(~(compared | known(budget) | known(deadline)), "nothing_comparable"))
    out = pairs.withColumns({"conflicts": F.array_compact(F.array(*conflicts)), "warnings": F.array_compact(F.array(*warnings))})
    out = out.drop(*[f"__{s}_{f}" for f in names for s in "ea"])
    return out.withColumn("identity_status", F.when(F.size("conflicts") > 0, "conflict").when(F.size("warnings") > 0, "warning").otherwise("confirmed"))
