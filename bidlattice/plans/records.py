"""Records of texts, tasks, ledgers and syncs, made of the driver's tables (inventory C16 to C22, D, E9 to E12, F15, I, J2, J4, K6, L5, O, P)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text, values
from ..operators import evidence as ev
from ..operators import extraction as ex
from ..operators import lifecycle as lc
from ..operators import relational as rel
from ..operators import retrieval as ret
from ..operators import temporal as tmp
from ..operators import verification as vf
from .registry import Tables, query
from .retrieval import COSINE, WORDS


def _one_of(key: Column, options: list) -> Column:
    """The option whose number is the key's remainder."""
    return F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in options]), (key % len(options) + 1).cast("int"))


@query(r"""SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'x' WHEN 4 THEN c_name END AS known, c_mktsegment || c_name AS bare, regexp_replace(c_name, '^(Customer|Cust|#)+', '') AS headless,
 left(c_name, 12) || '…' AS short, CASE WHEN c_acctbal = floor(c_acctbal) THEN format('{:,.0f}', c_acctbal) ELSE format('{:,.2f}', c_acctbal) END AS money, c_mktsegment AS folded, c_acctbal AS number, ['元', 'm²', 'km', 'kg'][(c_custkey % 4 + 1)::INT] AS unit FROM customer""")
def c16_i13_i20_texts(t: Tables) -> DataFrame:
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        k, text.without_placeholder(_one_of(k, ["待补", " x ", "", "None", name])).alias("known"), text.without_space(F.concat(F.lit(" "), seg, F.lit("\u3000 "), name)).alias("bare"),
        text.strip_head(name, ["Cust", "Customer", "#"]).alias("headless"), text.shorten(name, 12).alias("short"), text.format_money(F.col("c_acctbal")).alias("money"),
        text.fold_repeated_clause(F.concat(seg, F.lit("（"), seg, F.lit("）"))).alias("folded"), values.first_number(F.concat(F.lit("余额 "), F.col("c_acctbal").cast("string"), F.lit(" 元"))).alias("number"),
        text.normalise_unit(_one_of(k, ["人民币元", "m2", " 公里 ", "kg"])).alias("unit"),
    )


ACTIONS = "['报名和获取招标文件', '办理CA', '缴纳投标保证金', '踏勘', '参加开标', '递交投标文件', '编制标书', '其他事项']"


@query(f"""WITH a AS (SELECT p_partkey, {ACTIONS}[(p_partkey % 8 + 1)::INT] || p_size AS s FROM part) SELECT p_partkey,
 CASE WHEN regexp_matches(s, '报名|文件获取|获取招标文件') THEN 'registration' WHEN regexp_matches(s, 'CA|数字证书') THEN 'ca_cert' WHEN regexp_matches(s, '保证金|保函') THEN 'bond' WHEN regexp_matches(s, '踏勘|现场') THEN 'site_visit' WHEN contains(s, '开标') THEN 'opening' WHEN regexp_matches(s, '递交|投标文件') THEN 'submission' WHEN contains(s, '编制') THEN 'preparation' ELSE 'other' END AS kind,
 CASE WHEN regexp_matches(s, '保证金|保函') THEN 'submission_ready' WHEN regexp_matches(s, 'CA|数字证书|踏勘|现场|报名|文件获取') THEN 'preparation' WHEN regexp_matches(s, '递交|投标文件') THEN 'submission_ready' WHEN contains(s, '开标') THEN 'opened' ELSE 'approval_ready' END AS stage,
 CASE WHEN contains(s, 'CA') THEN 'ca_cert' ELSE 'construction_qual' END AS bucket, CASE WHEN regexp_matches(s, '截止|递交|开标|报名|保证金|踏勘') THEN '动作' END AS category FROM a""")
def i33_i34_i36_o11_action_kinds(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    a = t.part.select(k, F.concat(_one_of(k, ["报名和获取招标文件", "办理CA", "缴纳投标保证金", "踏勘", "参加开标", "递交投标文件", "编制标书", "其他事项"]), F.col("p_size").cast("string")).alias("s"))
    s = F.col("s")
    return a.select("p_partkey", classify.task_kind(s).alias("kind"), lc.submission_step(s)["stage"].alias("stage"), classify.qualification_bucket(s).alias("bucket"), classify.quote_category(s).alias("category"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderkey % 7 = 0 AS missing, o_orderkey % 2 = 0 AS hard, o_orderkey % 3 = 0 AS llm, o_orderkey % 11 = 0 AS clash FROM orders)
 SELECT o_orderkey, CASE WHEN clash THEN 'conflict' WHEN missing AND hard THEN 'hard_anchor_miss' WHEN llm THEN 'llm_pending' ELSE 'probe_miss' END AS exception, CASE WHEN clash THEN 1 WHEN missing AND hard THEN 2 WHEN llm THEN 3 ELSE 4 END AS rank,
 CASE WHEN s = 'F' THEN 'termination_correction' WHEN missing THEN 'evidence_supplement' WHEN hard THEN 'resource_confirmation' ELSE 'document_check' END AS task,
 CASE WHEN hard THEN 'L3_enterprise' WHEN llm THEN 'L2_tender' ELSE 'L1_public' END AS layer, CASE s WHEN 'F' THEN 'terminate_or_correct' WHEN 'O' THEN 'none' ELSE 'assign_reviewer' END AS next,
 CASE WHEN clash THEN 'identity_conflict' WHEN missing THEN 'identity_missing' WHEN llm THEN 'deadline_passed' WHEN s = 'P' THEN 'archived' END AS gate, missing OR o_orderkey % 10 < 6 AS look FROM o""")
def i38_i40_i41_i42_c20_o12_tasks(t: Tables) -> DataFrame:
    """Exceptions with their risk rank, tasks, layers, what comes next, gates, and which recognised texts need a person."""
    k = F.col("o_orderkey")
    missing, hard, llm, clash = k % 7 == 0, k % 2 == 0, k % 3 == 0, k % 11 == 0
    result = F.when(F.col("o_orderstatus") == "F", "not_satisfied").when(F.col("o_orderstatus") == "O", "satisfied").otherwise("unheard_of")
    wrong = classify.exception_type(F.when(clash, "编号冲突").otherwise("其他"), missing, F.when(hard, "hard_requirement").otherwise("scored_requirement"), F.when(llm, "llm").otherwise("regex"))
    spec = classify.task_spec(result, F.when(missing, "missing"), F.when(hard, "business_head").otherwise("nobody"), F.lit("核对文件"))
    return t.orders.select(
        k, wrong["type"].alias("exception"), wrong["rank"].alias("rank"), spec["type"].alias("task"), classify.knowledge_layer(F.when(hard, "enterprise"), F.when(llm, "tender_document")).alias("layer"),
        classify.next_action(result).alias("next"), lc.gate_reason(F.when(clash, "conflict").when(missing, None).otherwise("confirmed"), llm, F.col("o_orderstatus") == "P", F.lit(False)).alias("gate"),
        lc.needs_ocr_review((k % 10) / 10.0, missing).alias("look"),
    )


@query("""SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS day_start, (o_orderdate::DATE + 1)::TIMESTAMP AS day_end, o_orderkey % 2 = 0 AS inside, o_orderdate::DATE AS named, o_orderdate::DATE AS of_url,
 CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE + INTERVAL '9 hours 30 minutes' END AS due, o_orderdate::DATE::TIMESTAMP AS instant FROM orders""")
def i44_i45_i48_i51_dates(t: Tables) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    said = F.concat(F.lit("截止："), F.date_format(day, "yyyy年M月d日"), F.when(k % 3 > 0, "9:30").otherwise(""))
    bounds = values.day_bounds(day)
    return t.orders.select(
        k, bounds["start"].alias("day_start"), bounds["end"].alias("day_end"), values.in_day(F.to_timestamp(F.date_add(day, (k % 2).cast("int"))), day).alias("inside"), values.first_date(said).alias("named"),
        values.first_date(F.date_format(day, "yyyy/MM/dd")).alias("of_url"),
        values.deadline_instant(said).alias("due"), values.parse_instant(F.date_format(day, "yyyy-MM-dd")).alias("instant"),
    )


@query("""WITH r AS (SELECT c_custkey, c_name, c_mktsegment, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
 SELECT c_custkey, rank::INT AS rank, round(1 / rank, 6) AS relevance, left(sha256(c_name || '|' || c_mktsegment), 32) AS run_key, sha256('{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS print FROM r WHERE rank <= 30""")
def i61_i62_i66_ranked_keys(t: Tables) -> DataFrame:
    top = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(30)
    out = ret.rank_scores(top, [F.desc("c_acctbal"), F.col("c_custkey")])
    return out.select("c_custkey", "rank", "relevance", ret.retrieval_key(F.col("c_name"), F.col("c_mktsegment")).alias("run_key"), values.canonical_hash(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("print"))


@query("""SELECT event_id, event_type AS a, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE 'x' END AS b FROM events""")
def i69_overlaid_payloads(t: Tables) -> DataFrame:
    both = values.overlay(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("x")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("user_id").cast("string"))))
    return t.events.select("event_id", both.alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
 SELECT c_custkey, c_name, a.o_orderkey AS target_id, b.o_orderkey AS base_id FROM customer JOIN r a ON a.o_custkey = c_custkey AND a.n = 1 LEFT JOIN r b ON b.o_custkey = c_custkey AND b.n = 2""")
def d4_f7_base_and_target_runs(t: Tables) -> DataFrame:
    """The latest run of each project, with the one before it."""
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    pick = lambda n, c: tmp.latest_by(t.orders, ["o_custkey"], order, n).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias(c))
    return t.customer.select("c_custkey", "c_name").join(pick(1, "target_id"), "c_custkey").join(pick(2, "base_id"), "c_custkey", "left")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def d16_d17_without_blocked(t: Tables) -> DataFrame:
    """Evidence without the materials whose amount can't be read."""
    raw = F.when(F.col("o_orderstatus") == "P", "面议").otherwise(F.concat(F.lit("合同额"), F.col("o_orderkey").cast("string"), F.lit("元")))
    judged = vf.verified(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), raw.alias("raw")), {"amount": vf.amount_check(F.col("raw"), F.lit(1000))})
    return vf.without_blocked(t.lineitem.select("l_orderkey", "l_linenumber"), judged, "l_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'blocked' WHEN o_orderdate::DATE > DATE '1998-01-01' OR o_orderdate::DATE + 365 < DATE '1998-01-01' THEN 'failed' ELSE 'passed' END AS state, o_orderdate::DATE <= DATE '1998-01-01' AND o_orderdate::DATE + 365 >= DATE '1998-01-01' AS inside FROM orders""")
def c3_d19_validity_of_texts(t: Tables) -> DataFrame:
    """Validity bounds as texts: one that can't be read blocks the record."""
    k, day, at = F.col("o_orderkey"), F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")
    raw = F.when(k % 5 == 0, "长期").otherwise(F.date_format(F.date_add(day, 365), "yyyy-MM-dd"))
    end = values.normalise_date(raw)
    return t.orders.select(k, tmp.validity_state(day, end, at, raw.isNotNull() & end.isNull()).alias("state"), tmp.covers(day, F.date_add(day, 365), at).alias("inside"))


@query("""WITH r AS (SELECT p_type AS kind, p_retailprice AS amount, DATE '1993-01-01' + p_size::INT * 60 AS done FROM part), k AS (SELECT kind, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, kind LIMIT 4)
 SELECT (SELECT count(*) FROM r) AS total, count(*) FILTER (done >= DATE '1994-01-01') AS recent, round(sum(amount) FILTER (done >= DATE '1994-01-01'), 2) AS recent_amount, round(sum(amount), 2) AS amount, (SELECT string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) FROM k) AS top_types FROM r""")
def e9_performance_profile(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_type").alias("project_type"), F.date_add(F.lit("1993-01-01").cast("date"), F.col("p_size") * 60).alias("completed_at"), F.col("p_retailprice").alias("contract_amount"))
    out = vf.performance_profile(rows, F.lit("1999-01-01").cast("date"), 5, 4)
    return out.select("total", "recent", F.round("recent_amount", 2).alias("recent_amount"), F.round("amount", 2).alias("amount"), "top_types")


@query("""SELECT count(*) AS total, count(*) FILTER (s_nationkey % 2 = 0) AS free, count(*) FILTER (s_acctbal > 0) AS with_b_cert, count(*) FILTER (s_nationkey % 2 = 0 AND s_suppkey % 3 > 0) AS free_but_busy, count(*) FILTER (s_suppkey % 3 > 0 AND s_suppkey % 4 = 0) AS busy_but_expired FROM supplier""")
def e10_manager_profile(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.when(F.col("s_nationkey") % 2 == 0, "free").otherwise("busy").alias("availability"), (k % 3).alias("active_n"), F.when(F.col("s_acctbal") > 0, "B").alias("b_cert"), F.when(k % 4 == 0, F.lit("1990-01-01").cast("date")).alias("cert_valid_until"))
    return vf.manager_profile(rows, F.lit("1999-01-01").cast("date"))


@query("""SELECT event_type AS kind, count(*) AS total, count(*) FILTER (event_id % 5 > 0 AND (event_id % 100) / 100.0 < 0.9) AS low_confidence, count(*) FILTER (event_id % 5 = 0) AS unread, round(avg((event_id % 100) / 100.0) FILTER (event_id % 5 > 0), 6) AS mean_confidence FROM events GROUP BY 1""")
def e12_e26_evidence_profile(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return vf.evidence_profile(t.events.select(F.col("event_type").alias("kind"), F.when(k % 5 > 0, (k % 100) / 100.0).alias("ocr_confidence")))


@query("""WITH s AS (SELECT o_orderkey AS event_id, o_custkey AS dedup_key, o_orderstatus AS h FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT dedup_key, min(event_id) AS into_id FROM s GROUP BY 1),
 i AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS dedup_key, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS content_hash, CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' ELSE 'passed' END AS gate FROM orders),
 j AS (SELECT i.*, CASE WHEN i.dedup_key IS NULL THEN 'skipped' WHEN gate = 'rejected' THEN 'gate_blocked' WHEN s.event_id IS NOT NULL AND s.h = content_hash THEN 'unchanged' WHEN s.event_id IS NOT NULL THEN 'updated' WHEN into_id IS NOT NULL THEN 'merged' ELSE 'created' END AS outcome, into_id FROM i LEFT JOIN s USING (event_id) LEFT JOIN m ON m.dedup_key = i.dedup_key)
 SELECT event_id, dedup_key, content_hash, gate, outcome, CASE WHEN outcome = 'merged' THEN into_id WHEN outcome IN ('unchanged', 'updated', 'created') THEN event_id END AS stored_id FROM j""")
def l5_sync_outcomes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    stored = t.orders.where("o_orderstatus <> 'P'").select(k.alias("event_id"), F.col("o_custkey").alias("dedup_key"), F.col("o_orderstatus").alias("content_hash"))
    incoming = t.orders.select(k.alias("event_id"), F.when(k % 13 != 0, F.col("o_custkey")).alias("dedup_key"), F.when(k % 3 == 0, "N").otherwise(F.col("o_orderstatus")).alias("content_hash"), F.when(k % 17 == 0, "rejected").otherwise("passed").alias("gate"))
    return rel.sync_outcomes(stored, incoming)


SEEN = """t AS (SELECT doc_id AS chunk_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS s FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang IN ('en', 'de')), w AS (SELECT unnest(['the', 'of', 'and', 'er']) AS w),
 h AS (SELECT chunk_id, s, count(*) FILTER (instr(s, w) > 0) AS hits, min(instr(s, w) - 1) FILTER (instr(s, w) > 0) AS first FROM t, w GROUP BY 1, 2),
 k AS (SELECT chunk_id, round(hits / sqrt(greatest(length(s), 1)) * (1 + 1 / (1 + first / 200.0)), 9) AS score FROM h WHERE hits > 0)"""


@query(f"""WITH {SEEN}, {COSINE}, a AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r_keyword FROM k QUALIFY r_keyword <= 60), b AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r_vector FROM v WHERE vec_id IN (SELECT chunk_id FROM t) QUALIFY r_vector <= 60),
 f AS (SELECT chunk_id, r_keyword, r_vector, round(coalesce(1.0 / (60 + r_keyword), 0) + coalesce(1.0 / (60 + r_vector), 0), 9)::DOUBLE AS rrf FROM a FULL JOIN b USING (chunk_id) ORDER BY rrf DESC, chunk_id LIMIT 60)
 SELECT chunk_id, rrf, ((chunk_id * 37) % 101)::DOUBLE AS rerank FROM f ORDER BY rerank DESC, chunk_id LIMIT 20""")
def k5_k6_hybrid_search(t: Tables) -> DataFrame:
    """Visible chunks only, both ranks, fusion, and a caller's scores."""
    chunks = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("chunk_id"), "text", "lang", "embedding")
    probe = [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]
    score = lambda pool: pool.select("chunk_id", ((F.col("chunk_id") * 37) % 101).cast("double").alias("rerank"))
    return ret.hybrid_search(chunks, F.col("lang").isin("en", "de"), WORDS, probe, 20, score)[0].select("chunk_id", "rrf", "rerank")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'v' WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 > 0 THEN 'p' END AS value, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'llm_failed' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'llm_filled' END AS review FROM orders""")
def o6_o8_filled_fields(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    fields = t.orders.select(k.alias("id"), F.when(k % 3 > 0, "v").alias("value"))
    return vf.filled(fields, t.orders.where(k % 2 == 0).select(k.alias("id"), F.lit("p").alias("value"), F.when(k % 4 == 0, "bad").alias("reject_reason")), ["id"])


@query("""WITH n AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS ok, c_custkey % 3 > 0 AS due, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 4 END AS lacks, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 7 END AS open FROM customer)
 SELECT id AS project_id, concat_ws(',', CASE WHEN ok THEN 'identity_confirmed' END, CASE WHEN due THEN 'deadline_known' END, CASE WHEN n > 0 THEN 'materials_present' END) AS facts, concat_ws(',', CASE WHEN NOT due THEN 'deadline' END, CASE WHEN n = 0 THEN 'materials' END, CASE WHEN lacks > 0 THEN 'evidence' END) AS missing, concat_ws(',', CASE WHEN NOT ok THEN 'identity' END, CASE WHEN open > 0 THEN 'requirements' END) AS review FROM n""")
def o14_prescreen_snapshots(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    projects = t.customer.select(k.alias("project_id"), F.when(k % 2 == 0, "confirmed").when(k % 7 == 0, None).otherwise("warning").alias("identity_status"), F.when(k % 3 > 0, F.lit("2026-01-01")).alias("bid_deadline"))
    admitted = t.customer.where(k % 5 > 0).select(k.alias("project_id"), (k % 4).alias("missing_data"), (k % 7).alias("manual_review"))
    out = vf.prescreen(projects, t.orders.select(F.col("o_custkey").alias("project_id")), admitted)
    return out.select("project_id", *[F.array_join(c, ",").alias(c) for c in ("facts", "missing", "review")])


@query("""WITH p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'recommended' ELSE 'dismissed' END AS s, CASE WHEN c_acctbal < 0 THEN 'excluded_keyword' WHEN c_acctbal < 5000 THEN 'pending' ELSE 'recommended' END AS v FROM customer)
 SELECT c_custkey, CASE WHEN s <> 'dismissed' AND v = 'excluded_keyword' THEN v ELSE s END AS status FROM p""")
def p1_rescreened_pool(t: Tables) -> DataFrame:
    k, a = F.col("c_custkey"), F.col("c_acctbal")
    pool = t.customer.select(k, _one_of(k, ["pending", "recommended", "dismissed"]).alias("status"), a)
    verdict = F.when(a < 0, "excluded_keyword").when(a < 5000, "pending").otherwise("recommended")
    return lc.rescreen(pool, verdict, ["pending", "recommended"], ["excluded_keyword"]).select("c_custkey", "status")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS project, s_suppkey % 3 = 0 AS repaired FROM supplier""")
def p2_p3_onsite_repairs(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    people = t.supplier.select(k, F.concat(F.lit("sheet1:row"), k.cast("string")).alias("ref"), F.col("s_name").alias("project"))
    sheet = t.supplier.select(k.cast("int").alias("row_no"), F.when(k % 3 == 0, "no").otherwise("yes").alias("on_site"))
    return lc.onsite_repair(people, sheet).select("s_suppkey", "project", "repaired")


@query("""WITH e AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'safety_license' ELSE 'qualification_record' END AS kind FROM part UNION ALL SELECT 'similar_performance' FROM orders UNION ALL SELECT 'manager_profile' FROM supplier
 UNION ALL SELECT CASE WHEN c_custkey % 4 = 0 THEN 'safety_officer_cert' ELSE 'technical_team_member' END FROM customer) SELECT kind, count(*) AS n FROM e GROUP BY 1""")
def n1_built_evidence(t: Tables) -> DataFrame:
    q = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "安全生产许可").when(F.col("p_size") % 3 == 1, "施工总承包").alias("category"))
    people = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "C1").when(F.col("c_custkey") % 4 == 1, "B").alias("cert_level"))
    all_ = ev.build_evidence(q, t.orders.select(F.col("o_orderkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")), people)
    return all_.groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 120 + 1)::INT END AS days, CASE WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 90 + 1) * 10000.0 END AS amount, CASE WHEN o_orderkey % 3 = 2 THEN (o_orderkey % 9 + 1)::INT END AS need_count FROM orders""")
def j2_rule_parameters(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    said = lambda a, m, b: F.concat(F.lit(a), (k % m + 1).cast("string"), F.lit(b))
    quote = F.when(k % 3 == 0, said("投标有效期为", 120, "日历天")).when(k % 3 == 1, said("投标保证金：人民币", 90, "万元")).otherwise(said("专职安全员不少于", 9, "名"))
    p = ex.rule_parameters(_one_of(k, ["bid_validity", "bid_bond", "safety_officer"]), quote)
    return t.orders.select(k, p.alias("p")).select("o_orderkey", "p.days", F.col("p.amount").cast("double").alias("amount"), "p.need_count")


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS r, o_orderkey % 300 AS n FROM orders) SELECT doc_id, 'duration' AS field, 1 AS page_no, n || '日历天' AS value FROM o WHERE r > 0
 UNION ALL SELECT doc_id, 'quality_standard', CASE WHEN r = 1 THEN 1 ELSE 2 END, CASE WHEN r = 1 THEN '合格' ELSE '优良' END FROM o UNION ALL SELECT doc_id, 'downward_rate', 2, (n % 10) || '%' FROM o""")
def j4_j5_term_fields(t: Tables) -> DataFrame:
    """The first value after each label, over two pages a document."""
    k = F.col("o_orderkey")
    one = F.concat(F.lit("第一章 合同\n"), F.when(k % 3 > 0, F.concat(F.lit("计划工期："), (k % 300).cast("string"), F.lit("日历天；"))).otherwise(""), F.when(k % 3 == 1, "质量标准：合格。").otherwise("无"))
    two = F.concat(F.lit("质量要求: 优良\n下浮率："), (k % 300 % 10).cast("string"), F.lit("%。"))
    pages = t.orders.select(k.alias("doc_id"), F.posexplode(F.array(one, two)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)
    return ex.labelled_fields(pages, {f: ex.TERMS[f] for f in ("duration", "quality_standard", "downward_rate")}).select("doc_id", "field", "page_no", "value")
