"""Operators on small rows: evidence, chunks, sources, sinks, streams."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from bidlattice.operators import evidence as ev
from bidlattice.operators import extraction as ex
from bidlattice.operators import lifecycle as lc
from bidlattice.operators import relational as rel
from bidlattice.operators import retrieval as ret
from bidlattice.sources import readers, sinks
from bidlattice.streaming import streams


def at():
    return F.lit("2026-08-17").cast("date")


def requirement(spark, rule_type, **params):
    cols = {"run_id": ("long", 1), "requirement_id": ("string", "r"), "position": ("int", 1), "req_type": ("string", params.pop("req_type", "hard_requirement")), "rule_type": ("string", rule_type), "decision_scope": ("string", "admission"), "lot_id": ("string", params.pop("lot_id", None))}
    cols |= {k: (t, params.get(k)) for k, t in ev.PARAMS.items()}
    return spark.createDataFrame([tuple(v for _, v in cols.values())], ", ".join(f"{k} {t}" for k, (t, _) in cols.items()))


def records(spark, *rows):
    kinds = {"kind": "string", "record_id": "string", "status": "string", "verified_at": "date", "valid_from": "date", "valid_until": "date", "lot_id": "string", "refs": "array<string>"} | ev.FIELDS
    base = {"status": "active", "verified_at": date(2026, 1, 1), "refs": ["file:1"]}
    return spark.createDataFrame([tuple((base | r).get(k) for k in kinds) for r in rows], ", ".join(f"{k} {t}" for k, t in kinds.items()))


def verdict(spark, req, recs):
    r = ev.match_matrix(req, recs, at()).first()
    return r.match_result, r.reason_code


QUAL = {"kind": "qualification_record", "record_id": "q1", "category": "建筑工程施工总承包", "level": "二级"}


@pytest.mark.parametrize(
    "rows, level, want",
    [
        ([QUAL], "二级", ("satisfied", None)),
        ([QUAL], "一级", ("not_satisfied", "grade_below_requirement")),
        ([QUAL | {"category": "公路"}], "二级", ("not_satisfied", "profession_mismatch")),
        ([QUAL | {"valid_until": date(2020, 1, 1)}], "二级", ("not_satisfied", "certificate_expired")),
        ([QUAL | {"verified_at": None}], "二级", ("unverifiable", "evidence_pending_verification")),
        ([QUAL | {"valid_from": date(2027, 1, 1)}], "二级", ("unverifiable", "evidence_missing")),
        ([], "二级", ("unverifiable", "enterprise_record_missing")),
        ([QUAL | {"refs": []}], "二级", ("manual_review", "evidence_refs_missing")),
    ],
)
def test_qualification(spark, rows, level, want):
    assert verdict(spark, requirement(spark, "qualification", category="建筑工程", level=level), records(spark, *rows)) == want


def test_expired_record_never_satisfies(spark):
    req = requirement(spark, "qualification", category="建筑工程", level="二级")
    bad = QUAL | {"valid_until": date(2020, 1, 1), "record_id": "q2"}
    assert verdict(spark, req, records(spark, bad))[0] != "satisfied"
    assert verdict(spark, req, records(spark, bad, QUAL))[0] == "satisfied"


@pytest.mark.parametrize(
    "kind, params, rows, want",
    [
        ("consortium", {"allowed": None}, [], "manual_review"), ("consortium", {"allowed": False}, [], "satisfied"),
        ("bid_bond", {"amount": 5}, [], "not_applicable"), ("bid_bond", {"amount": 5}, [{"kind": "bid_bond", "record_id": "b", "amount": 4}], "not_satisfied"),
        ("credit", {}, [{"kind": "credit_check_report", "record_id": "c", "negative": True}], "not_satisfied"),
        ("ceiling_price", {"max_amount": 10}, [{"kind": "bid_price_input", "record_id": "p", "type": "quoted_price", "amount": 11}], "not_satisfied"),
        ("quote_cap", {"max_amount": 10}, [], "unverifiable"), ("technical_team", {"specialties": ["水", "电"]}, [{"kind": "technical_team_member", "record_id": "t", "specialty": "水"}], "unverifiable"),
        ("social_security", {"continuous_months": 6}, [{"kind": "social_security_proof", "record_id": "s", "subject": "project_manager", "continuous_months": 7}], "satisfied"),
        ("similar_performance", {}, [], "manual_review"), ("submission_package", {}, [], "not_applicable"), ("prequalification", {}, [], "manual_review"),
    ],
)
def test_rule_kinds(spark, kind, params, rows, want):
    from decimal import Decimal

    fix = lambda d: {k: Decimal(v) if k in ("amount", "max_amount") and v is not None else v for k, v in d.items()}
    assert verdict(spark, requirement(spark, kind, **fix(params)), records(spark, *map(fix, rows)))[0] == want


def test_unknown_area_passes_and_unknown_amount_fails(spark):
    from decimal import Decimal

    rec = {"kind": "similar_performance", "record_id": "p", "subject": "bidder", "completed_at": date(2025, 1, 1)}
    assert verdict(spark, requirement(spark, "similar_performance", min_area=100.0), records(spark, rec))[0] == "satisfied"
    assert verdict(spark, requirement(spark, "similar_performance", min_amount=Decimal(1)), records(spark, rec))[0] == "unverifiable"


def test_lots_are_apart(spark):
    from decimal import Decimal

    bond = records(spark, {"kind": "bid_bond", "record_id": "b", "amount": Decimal(5), "lot_id": "5"})
    assert verdict(spark, requirement(spark, "bid_bond", amount=Decimal(5), lot_id="5"), bond)[0] == "satisfied"
    assert verdict(spark, requirement(spark, "bid_bond", amount=Decimal(5), lot_id="3"), bond)[0] == "not_applicable"


def test_scored_without_rows_is_null(spark):
    m = ev.match_matrix(requirement(spark, "similar_performance", req_type="scored_requirement", since=date(2020, 1, 1), max_score=5.0), records(spark), at())
    row = ev.admission(m).first()
    assert m.first().match_result == "not_calculable" and row.score is None and row.max_score == 5.0


def test_chunks_cover_the_text(spark):
    body = "甲" * 700 + "abc" * 300 + "\n\n短段"
    got = ex.chunks(spark.createDataFrame([(1, body), (2, "  \n"), (3, None)], "doc_id long, text string")).orderBy("chunk_seq").collect()
    assert {r.doc_id for r in got} == {1} and got[-1].chunk == "短段"
    assert all(ex._pieces(body.split("\n")[0], 600, 0)[i] in body for i in range(2)) and "".join(ex._pieces(body.split("\n")[0], 600, 0)) == body.split("\n")[0]


def test_overlap_suppression(spark):
    new = spark.createDataFrame([("d", "一二三四五六七八九十一二三四五六七八"), ("d", "完全不同的一段文字没有任何重叠之处了")], "doc_id string, quote string")
    old = spark.createDataFrame([("d", "前缀一二三四五六七八九十一二三四五六七八后缀")], "doc_id string, quote string")
    assert [r.quote for r in ex.not_overlapping(new, old).collect()] == ["完全不同的一段文字没有任何重叠之处了"]


def test_label_lines(spark):
    d = spark.createDataFrame([(1, "intro\n名称：路\n续行\n地点: 市")], "doc_id long, text string")
    assert {(r.label, r.value) for r in ex.label_lines(d).collect()} == {("名称", "路 续行"), ("地点", "市")}


def test_rerank_degrades(spark):
    pool = spark.createDataFrame([(1, 0.5), (2, 0.4)], "chunk_id long, rrf double")
    bad = lambda df: df.select("chunk_id", F.lit(float("nan")).alias("rerank"))
    good = lambda df: df.select("chunk_id", F.col("chunk_id").cast("double").alias("rerank"))
    assert ret.reranked(pool, bad, "chunk_id", 2)[1] == "rerank_degraded"
    out, how = ret.reranked(pool, good, "chunk_id", 1)
    assert how == "reranked" and out.first().chunk_id == 2


def test_ledger(spark, tmp_path):
    (tmp_path / "q.csv").write_text("资质类别,等级,有效期至,证据引用,别的\n建筑,二级,2030-01-01,a.pdf；b.pdf,x\n", encoding="utf-8")
    r = readers.ledger(spark, str(tmp_path / "q.csv"), "qualifications").first()
    assert (r.category, r.level, r.issuer, r.evidence_refs) == ("建筑", "二级", None, ["a.pdf", "b.pdf", "ledger:csv:row2"])
    assert spark.range(1).select(readers.material_refs(F.array(*[F.lit(x) for x in r.evidence_refs])).alias("m")).first().m == ["a.pdf", "b.pdf"]


def test_frontmatter_and_routes(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntype: event\ntitle: 'x'\n---\nbody\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("---\ntype: issue\n---\n", encoding="utf-8")
    r = readers.frontmatter(spark, str(tmp_path), "event").collect()
    assert len(r) == 1 and r[0].fields["title"] == "x" and r[0].body.strip() == "body"
    files = spark.createDataFrame([("x", bytearray(b"%PDF-1.4")), ("y", bytearray("文".encode())), ("z.docx", bytearray(b"PK\x03\x04")), ("w", bytearray(b"\x00\x01\xff"))], "path string, content binary")
    assert {x.path: x.kind for x in readers.routed(files).collect()} == {"x": "pdf", "y": "text", "z.docx": "docx", "w": "unknown"}
    stored = sinks.store_objects(files, str(tmp_path / "objects"))
    assert readers.altered_objects(files, stored).count() == 0
    assert readers.altered_objects(files.where("path <> 'x'"), stored).first().fault == "missing"


def test_deliveries_are_idempotent(spark):
    issues, channels = spark.createDataFrame([("a",)], "issue_id string"), spark.createDataFrame([("mail",), ("web",)], "channel string")
    none = spark.createDataFrame([], "issue_id string, channel string")
    first = sinks.new_deliveries(issues, channels, none)
    assert first.count() == 2 and sinks.new_deliveries(issues, channels, first).count() == 0


def test_state_fold_and_transitions(spark):
    e = spark.createDataFrame([("j", 1, "claim"), ("j", 2, "fail"), ("j", 3, "claim"), ("j", 4, "finish"), ("k", 1, "finish")], "job string, n int, e string")
    got = {r.job: (r.state, r.attempts, r.refused) for r in lc.fold_states(e, "job", ["n"], "e", "pending", lc.JOB, 3).collect()}
    assert got == {"j": ("succeeded", 2, 0), "k": ("pending", 0, 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "who long, what string")
    assert rel.divides(none, none.select("what"), "who", "what").count() == 0
    assert rel.zero_filled_counts(none.select(F.col("what").alias("s")), "s", ["a", "b"]).count() == 2


def test_streams_equal_their_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("event_id", "ts", "user_id", "event_type", "value").repartition(3).write.parquet(str(tmp_path / "in"))
    src = streams.replay(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    day = streams.drain(streams.tumbling_days(src, "ts", F.col("event_type"), "400 days"), "days", "complete", str(tmp_path / "c1"))
    want = streams.tumbling_days(events, "ts", F.col("event_type"))
    key = lambda df: {(r.start, r.k): r.n for r in df.collect()}
    assert key(day) == key(want)
    out = streams.drain(streams.limited(src, "user_id", "ts", 3600), "limited", "append", str(tmp_path / "c2"))
    assert out.count() == events.count() and 0 < out.where("allowed").count() < events.count()


def test_late_events_are_flagged(spark):
    d = spark.sql("select timestamp'2026-01-01' a, timestamp'2026-01-03' b union all select timestamp'2026-01-01', timestamp'2026-01-01 05:00:00'")
    assert sorted(r.late for r in streams.flag_late(d, "a", "b").collect()) == [False, True]


def test_fill_only_what_is_missing(spark):
    from bidlattice.operators import verification as vf

    f = spark.createDataFrame([("a", None), ("b", "x"), ("c", None), ("d", None)], "field string, value string")
    p = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", None, "quote_not_found")], "field string, value string, reject_reason string")
    assert {r.field: (r.value, r.review) for r in vf.filled(f, p, ["field"]).collect()} == {"a": ("1", "llm_filled"), "b": ("x", None), "c": (None, "llm_failed"), "d": (None, None)}


def test_prefix_links_and_prescreen(spark):
    from bidlattice.operators import verification as vf

    rows, names = spark.createDataFrame([(1, "滨河路改造工程一期合同"), (2, "别的")], "k long, t string"), spark.createDataFrame([("滨河路改造工程一期施工",), ("滨河路改造工程一期",)], "n string")
    assert {r.k: r.linked for r in vf.linked_by_prefix(rows, names, "k", "t", "n").collect()} == {1: "滨河路改造工程一期", 2: None}
    projects = spark.createDataFrame([("p", "confirmed", None), ("q", None, date(2026, 9, 1))], "project_id string, identity_status string, bid_deadline date")
    none = spark.createDataFrame([], "project_id string, missing_data int, manual_review int")
    got = {r.project_id: r for r in vf.prescreen(projects, spark.createDataFrame([("p",)], "project_id string"), none).collect()}
    assert got["p"].facts == ["identity_confirmed", "materials_present"] and got["p"].missing == ["deadline"] and got["q"].review == ["identity"]


def test_upkeep(spark):
    people = spark.createDataFrame([("a-row3", "p1", "ledger:csv:row3"), ("b", "p2", "ledger:csv:row4"), ("c", None, "x")], "name string, project string, ref string")
    sheet = spark.createDataFrame([(3, "no"), (4, "yes")], "row_no int, on_site string")
    got = {r.name: r.project for r in lc.onsite_repair(people, sheet).collect()}
    assert got == {"a-row3": None, "b": "p2", "c": None}
    pool = spark.createDataFrame([(1, "pending"), (2, "deep_dive"), (3, "pending")], "k int, status string")
    out = lc.rescreen(pool, F.when(F.col("k") < 3, "excluded_keyword").otherwise("recommended"), ["pending"], ["excluded_keyword"])
    assert [r.status for r in out.orderBy("k").collect()] == ["excluded_keyword", "deep_dive", "pending"]
    d = spark.createDataFrame([(0.5, None), (0.7, None), (None, False), (0.9, True)], "c double, r boolean")
    assert [x.n for x in d.select(lc.needs_ocr_review(F.col("c"), F.col("r")).alias("n")).collect()] == [True, False, True, True]
    step = spark.createDataFrame([("投标保证金",), ("别的",)], "t string").select(lc.submission_step(F.col("t")).alias("s")).collect()
    assert (step[0].s.stage, step[1].s.stage, step[1].s.required) == ("submission_ready", "approval_ready", None)
    gate = spark.sql("select 'conflict' i, true o, false t union all select 'confirmed', true, false union all select 'confirmed', true, true")
    assert [r.g for r in gate.select(lc.gate_reason(F.col("i"), F.col("o"), F.lit(False), F.col("t")).alias("g")).collect()] == ["identity_conflict", "deadline_passed", None]


def test_rule_sets_keep_what_the_delta_lacks(spark):
    old, new = (spark.createDataFrame([(x,) for x in ids], "requirement_id string") for ids in (["a", "b-r2", "c"], ["b-r3", "d"]))
    assert sorted(r.requirement_id for r in lc.rule_set_delta(old, new).collect()) == ["a", "b-r3", "c", "d"]


def test_projects_are_merged_by_title(spark):
    from bidlattice.operators import reporting as rep

    rows = [(1, "s1", "滨河路改造招标公告"), (2, "s2", "滨河路改造中标候选人公示"), (3, "s1", "另一工程招标公告")]
    got = {r.project_key: r for r in rep.dedupe_by_project(spark.createDataFrame(rows, "candidate_id int, source_id string, title string")).collect()}
    one = got["滨河路改造"]
    assert (one.candidate_id, one.announcement_type, one.source_group, one.stage_count) == (1, "tender", ["s1", "s2"], 2) and len(got) == 2


def test_intake_and_rendering(spark):
    cur, gone = spark.createDataFrame([(1, "a"), (2, "b")], "intake_id int, v string"), spark.createDataFrame([(2, "c")], "intake_id int, v string")
    assert {r.intake_id: (r.v, r.dropped) for r in readers.intake(cur, gone).collect()} == {1: ("a", False), 2: ("c", True)}
    items = spark.createDataFrame([("i", 2, "two"), ("i", 1, "one")], "issue string, n int, t string")
    assert sinks.rendered(items, ["issue"], "n", F.concat(F.lit("- "), F.col("t"))).first().body == "- one\n- two"
    words = spark.createDataFrame([(1, 90.0), (1, -1.0), (1, 70.0)], "page int, conf double")
    assert readers.ocr_confidence(words, ["page"]).first().ocr_confidence == 0.8


def test_leak_guard_and_equality(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (1,)], "k int")
    assert rel.same_rows(a, b) and not rel.same_rows(a, b.limit(1))
    assert [r.k for r in rel.leaked(a, b.where("k = 1"), "k").collect()] == [2]


def test_html_to_text_against_plain_python(spark):
    """References are decoded after tags are gone; the registered query runs over whole pages."""
    import html
    import re

    from bidlattice.operators import extraction as ex

    pages = ["<p>R&amp;D &lt;b&gt; &#20013;&nbsp;x</p><script>no&amp;</script>y", "AT&T <br> a&b;", "", None, "<style>p</style>&copy; 2026<div>z</div>"]

    def plain(p):
        s = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ", p or "")
        s = re.sub(r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n", s)
        return re.sub(r"[\s\u3000\xa0]+", " ", html.unescape(re.sub(r"<[^>]+>", "", s))).strip()

    d = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    assert {r.id: r.t for r in d.select("id", ex.html_to_text(F.col("html")).alias("t")).collect()} == dict(enumerate(map(plain, pages)))


def test_passage_links_of_short_and_cut_passages(spark):
    """Passages of any number of words, inside longer words, and none for empty ones."""
    from bidlattice.operators import extraction as ex

    docs = spark.createDataFrame([(1, "xone two three four five sixy end"), (2, "one  two three"), (3, None), (4, "")], "doc_id int, text string")
    wanted = ["one two three four five six", "two three", "one", "", None, "one two three", "four five end"]
    got = {(r.doc_id, r.item_id) for r in ex.passage_links(docs, spark.createDataFrame(list(enumerate(wanted)), "item_id int, text string")).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (1, 5), (2, 1), (2, 2)}


def test_similar_names_of_copies_and_blanks(spark):
    from bidlattice.operators import relational as rel

    rows = [(1, "x", "abcdef"), (2, "x", "abcdef"), (3, "x", "abcdeg"), (4, "y", "abcdef"), (5, "x", ""), (6, "x", None), (7, None, "abcdef"), (8, "x", "a")]
    got = {r.k: (r.class_id, r.links, r.best) for r in rel.similar_names(spark.createDataFrame(rows, "k int, b string, n string"), "k", "n", "b", 0.8).collect()}
    assert got == {1: (1, 1, 0.8), 2: (1, 1, 0.8), 3: (3, 1, 0.8), 4: (4, 0, None), 5: (5, 0, None), 6: (6, 0, None), 7: (7, 0, None), 8: (8, 0, None)}


def test_queue_with_a_limit_counts_the_hidden(spark):
    from bidlattice.operators import verification as vf

    m = spark.createDataFrame([("r", f"q{i}", i, "hard_requirement", "admission", "not_satisfied") for i in range(5)], "run_id string, requirement_id string, position int, req_type string, decision_scope string, match_result string")
    assert [(r.place, r.hidden) for r in vf.queues(m, 2).orderBy("place").collect()] == [(1, 3), (2, 3)] and vf.queues(m).count() == 5
