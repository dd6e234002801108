"""Filters, joins, aggregates, windows, orders and sets (inventory C to H) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import reporting as rep
from ..operators import temporal as tmp
from .registry import Tables, query


def at():
    """The instant at which these queries look."""
    return F.lit("1998-06-01").cast("date")


def _terms(t: Tables) -> DataFrame:
    """Orders as records with a validity: open bounds, lack of verification and status by their keys."""
    o, k = t.orders, F.col("o_orderkey")
    return o.select(
        k.alias("record_id"), F.when(k % 5 == 0, "withdrawn").otherwise("active").alias("status"),
        F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("verified_at"), F.when(k % 7 != 0, F.to_date("o_orderdate")).alias("valid_from"),
        F.when(k % 7 != 1, F.date_add(F.to_date("o_orderdate"), 900)).alias("valid_until"), "o_orderpriority",
    )


TERMS = """terms AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 = 0 THEN 'withdrawn' ELSE 'active' END AS status,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS verified_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS valid_from,
 CASE WHEN o_orderkey % 7 <> 1 THEN o_orderdate::DATE + 900 END AS valid_until, o_orderpriority FROM orders)"""


@query(f"WITH {TERMS} SELECT record_id, valid_from, valid_until FROM terms WHERE status = 'active' AND verified_at IS NOT NULL AND coalesce(valid_from <= DATE '1998-06-01', true) AND coalesce(valid_until >= DATE '1998-06-01', true)")
def c1_asof_snapshot_filter(t: Tables) -> DataFrame:
    return tmp.as_of(_terms(t), at()).select("record_id", "valid_from", "valid_until")


@query(f"WITH {TERMS} SELECT record_id, CASE WHEN valid_until < DATE '1998-06-01' OR valid_from > DATE '1998-06-01' THEN 'failed' ELSE 'passed' END AS state, "
       "CASE WHEN verified_at IS NULL THEN 'unverified' WHEN valid_until < DATE '1998-06-01' THEN 'expired' WHEN valid_from > DATE '1998-06-01' THEN 'not_yet_valid' END AS reason FROM terms")
def c3_validity_tristate(t: Tables) -> DataFrame:
    s, e = F.col("valid_from"), F.col("valid_until")
    return _terms(t).select("record_id", tmp.validity_state(s, e, at()).alias("state"), tmp.ineligible_reason(s, e, F.col("verified_at"), at()).alias("reason"))


@query("""WITH d AS (SELECT doc_id, lang AS layer, source AS scope, CASE WHEN doc_id % 9 = 0 THEN 'stale' ELSE 'current' END AS index_status,
 CASE WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'active' END AS verification_status, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'p' || (doc_id % 4) END AS project_id FROM documents)
 SELECT doc_id, layer, scope FROM d WHERE layer IN ('en', 'fr') AND scope IN ('src0', 'src1', 'src2') AND index_status = 'current' AND verification_status = 'active' AND (project_id IS NULL OR project_id = 'p1')""")
def c4_row_level_security(t: Tables) -> DataFrame:
    k, none = F.col("doc_id"), F.lit(None).cast("date")
    d = t.documents.select(
        "doc_id", F.col("lang").alias("layer"), F.col("source").alias("scope"), F.when(k % 9 == 0, "stale").otherwise("current").alias("index_status"),
        F.when(k % 13 == 0, "pending").otherwise("active").alias("verification_status"), F.when(k % 4 != 0, F.concat(F.lit("p"), (k % 4).cast("string"))).alias("project_id"),
        F.lit(None).cast("string").alias("lot_id"), none.alias("valid_from"), none.alias("valid_until"),
    )
    grants = t.spark.createDataFrame([("analyst", "src0"), ("analyst", "src1"), ("analyst", "src2"), ("guest", "src3")], "role string, scope string")
    seen = rel.visible(d, ["en", "fr"], [f"src{i}" for i in range(20)], "p1", None, at())
    return rel.permitted(seen, grants, "analyst").select("doc_id", "layer", "scope")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND contains(p_name, 'e')")
def c7_keyword_and_filter(t: Tables) -> DataFrame:
    return t.part.where(rel.keywords_match(F.col("p_name"), "a e")).select("p_partkey", "p_name")


@query("SELECT p_partkey, (contains(p_type, 'STEEL') OR contains(p_type, 'BRASS')) AS metal, p_name ILIKE '%e%a%' AS wild FROM part")
def c8_c9_words_and_wildcards(t: Tables) -> DataFrame:
    words = {"metal": ["STEEL", "BRASS"]}
    return t.part.select("p_partkey", rel.any_word(F.col("p_type"), words, "metal").alias("metal"), rel.wildcard(F.col("p_name"), "*e*a*").alias("wild"))


@query(f"WITH {TERMS} SELECT record_id, valid_from, valid_from IS NULL AS pending FROM terms WHERE valid_from IS NULL OR valid_from BETWEEN DATE '1998-05-18' AND DATE '1998-06-01'")
def c10_date_window_pending(t: Tables) -> DataFrame:
    return tmp.window_or_unknown(_terms(t), "valid_from", F.date_sub(at(), 14), at()).select("record_id", "valid_from", "pending")


@query(f"WITH {TERMS} SELECT record_id, valid_until > DATE '1998-06-01' AND valid_until <= DATE '1998-08-30' AS soon, "
       "CASE WHEN record_id % 2 = 0 THEN TIMESTAMP '1998-06-01 12:00:00' >= valid_until::TIMESTAMP ELSE valid_until < DATE '1998-06-01' END AS overdue FROM terms")
def c11_c12_expiry_and_overdue(t: Tables) -> DataFrame:
    u = F.col("valid_until")
    late = tmp.overdue(F.when((F.col("record_id") % 2 == 0), u.cast("timestamp")), u, F.lit("1998-06-01 12:00:00").cast("timestamp"))
    return _terms(t).select("record_id", tmp.expires_soon(u, at()).alias("soon"), late.alias("overdue"))


@query("""SELECT page_id, url, CASE WHEN starts_with(p, '/en/7') THEN '/en/7' WHEN starts_with(p, '/en/') THEN '/en/' WHEN starts_with(p, '/de/') THEN '/de/' END AS rule,
 CASE WHEN starts_with(p, '/en/7') THEN true WHEN starts_with(p, '/en/') THEN false WHEN starts_with(p, '/de/') THEN true ELSE true END AS allowed
 FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM pages)""")
def c15_robots_longest_rule(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("/en/", False), ("/en/7", True), ("/de/", True), ("/de/", False)], "prefix string, allow boolean")
    rules = rules.groupBy("prefix").agg(F.bool_or("allow").alias("allow"))
    rows = t.pages.select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1).alias("p"))
    return rel.longest_rule(rows, rules, "p", "page_id").select("page_id", "url", "rule", "allowed")


@query("""SELECT l_partkey AS part_id, count(*) AS n, min(o_orderkey) AS first_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
 WHERE l_extendedprice >= p_retailprice * 10 AND o_orderdate >= TIMESTAMP '1996-01-01' AND l_quantity >= p_size GROUP BY l_partkey""")
def d13_rule_record_join(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    fit = (F.col("l_extendedprice") >= F.col("p_retailprice") * 10) & (F.col("o_orderdate") >= "1996-01-01") & (F.col("l_quantity") >= F.col("p_size"))
    return j.where(fit).groupBy(F.col("l_partkey").alias("part_id")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT DISTINCT p_brand FROM part WHERE p_size <= 10),
 m AS (SELECT l_suppkey, count(*) AS met FROM f SEMI JOIN n USING (p_brand) GROUP BY 1)
 SELECT s.l_suppkey, coalesce(met, 0) AS met, (SELECT count(*) FROM n) AS needed, coalesce(met, 0) = (SELECT count(*) FROM n) AS complete FROM (SELECT DISTINCT l_suppkey FROM f) s LEFT JOIN m USING (l_suppkey)""")
def d14_relational_division(t: Tables) -> DataFrame:
    facts = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", "p_brand")
    return rel.divides(facts, t.part.where("p_size <= 10").select("p_brand").distinct(), "l_suppkey", "p_brand")


@query("""WITH c AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS covered FROM orders GROUP BY 1)
 SELECT o_custkey, len(list_filter(['1-URGENT', '2-HIGH'], lambda x: NOT list_contains(covered, x))) = 0 AS complete, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH'], lambda x: NOT list_contains(covered, x))), ',') AS lacking FROM c""")
def d15_set_containment(t: Tables) -> DataFrame:
    c = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("covered"))
    gap = F.array_except(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.col("covered"))
    return c.select("o_custkey", (F.size(gap) == 0).alias("complete"), F.array_join(F.sort_array(gap), ",").alias("lacking"))


@query("""WITH a AS (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
 SELECT o_custkey, CASE WHEN a.v IS NULL THEN '(new)' ELSE a.v END AS from_value, CASE WHEN b.v IS NULL THEN '(removed)' ELSE b.v END AS to_value, a.v IS DISTINCT FROM b.v AS changed FROM a FULL JOIN b USING (o_custkey)""")
def d5_run_diff(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderdate < '1997-01-01'").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("v"))
    b = t.orders.where("o_orderdate >= '1997-01-01'").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("v"))
    return rel.run_diff(a, b, "o_custkey", "v")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT event_id AS o_orderkey FROM events) USING (o_orderkey)")
def d8_d9_anti_join(t: Tables) -> DataFrame:
    """Also C22: orders outside the set of known ids."""
    return rel.leaked(t.orders.select("o_orderkey", "o_custkey"), t.events.select(F.col("event_id").alias("o_orderkey")), "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 300000) USING (c_custkey)")
def d10_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def d11_nested_children(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    n = rel.nested(t.orders.select("o_orderkey"), {"lines": lines}, "o_orderkey")
    return n.select("o_orderkey", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("lines"))


@query("""WITH r AS (SELECT DISTINCT o_orderkey, o_custkey AS material_id FROM orders WHERE o_orderkey % 3 = 0)
 SELECT c_custkey AS material_id, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS place FROM customer JOIN r ON material_id = c_custkey QUALIFY place <= 4""")
def d12_linked_by_reference(t: Tables) -> DataFrame:
    file = F.array(F.concat(F.lit("file:"), F.col("o_custkey").cast("string")))
    refs = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, file).alias("refs"))
    files = t.customer.select(F.col("c_custkey").cast("string").alias("material_id"))
    return rel.linked_by_reference(refs, files, "refs", "material_id", "o_orderkey").withColumn("material_id", F.col("material_id").cast("long"))


@query("""SELECT n_name, CASE WHEN n_name = 'CHINA' THEN 'direct' WHEN r_name = 'ASIA' THEN 'broader' ELSE 'none' END AS coverage FROM nation JOIN region ON n_regionkey = r_regionkey""")
def d18_region_coverage(t: Tables) -> DataFrame:
    j = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    c = F.when(F.col("n_name") == "CHINA", F.col("n_name")).otherwise(F.when(F.col("r_name") == "ASIA", "全国").otherwise("?"))
    return j.select("n_name", rel.region_coverage(c, F.lit("CHINA")).alias("coverage"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def d23_latest_per_key(t: Tables) -> DataFrame:
    return tmp.latest_by(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT 'orders' AS panel, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY 2""")
def e1_dashboard_counts(t: Tables) -> DataFrame:
    count = lambda df, panel, c: df.groupBy(F.col(c).alias("state")).agg(F.count("*").alias("n")).select(F.lit(panel).alias("panel"), "state", "n")
    return count(t.orders, "orders", "o_orderstatus").union(count(t.events, "events", "event_type")).union(count(t.documents, "documents", "lang"))


@query("""SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars < 500) AS brief, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def e3_briefing_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") < 500).alias("brief"), F.sum("n_chars").alias("chars"))


@query("""WITH r AS (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 100), s AS (SELECT lang AS state, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM r)
 SELECT state, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (k <= 3) AS samples FROM s GROUP BY 1""")
def e4_rule_preview_samples(t: Tables) -> DataFrame:
    return rep.preview_samples(t.documents.withColumnRenamed("lang", "state"), "state", "doc_id", 100, [F.desc("doc_id")])


@query("""SELECT c_mktsegment AS bucket, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS negative, round(avg(c_acctbal), 4) AS mean_balance, max(c_acctbal) AS top FROM customer GROUP BY 1""")
def e8_profile_buckets(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_mktsegment").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.max("c_acctbal").alias("top"))


@query("""WITH p AS (SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS size FROM part WHERE p_size > 5 GROUP BY 1) SELECT p_brand, n, size FROM p ORDER BY n DESC, p_brand LIMIT 8""")
def e9_top_types(t: Tables) -> DataFrame:
    return t.part.where("p_size > 5").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size")).orderBy(F.desc("n"), "p_brand").limit(8)


@query("""SELECT r_name, n_name, count(*) AS n, grouping(r_name)::INT + grouping(n_name)::INT AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def e11_two_level_groups(t: Tables) -> DataFrame:
    j = t.customer.join(F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), (F.grouping("r_name") + F.grouping("n_name")).cast("int").alias("depth"))


@query("""SELECT count(*) AS total, count(quality) AS decided, count(*) - count(quality) AS pending, round(count(quality) / count(*), 3) AS ratio FROM documents LEFT JOIN labels USING (doc_id)""")
def e17_coverage_ratio(t: Tables) -> DataFrame:
    j = t.documents.join(t.labels, "doc_id", "left").select(F.when(F.col("quality").isNotNull(), "approved").otherwise("pending").alias("status"))
    return rep.coverage(j)


@query("""WITH g AS (SELECT DISTINCT l_returnflag || '-' || l_linestatus AS gap_key, l_orderkey FROM lineitem), f AS (SELECT gap_key, min(l_orderkey) AS first_seq FROM g GROUP BY 1) SELECT * FROM g JOIN f USING (gap_key)""")
def e21_gap_members(t: Tables) -> DataFrame:
    g = t.lineitem.select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("gap_key"), "l_orderkey")
    return rep.gap_members(g, "gap_key", "l_orderkey")


@query("""SELECT l_returnflag || '-' || l_linestatus AS gap_key, min(l_orderkey) AS first_seq, count(*) AS gaps FROM lineitem GROUP BY 1""")
def e21_gap_task_groups(t: Tables) -> DataFrame:
    g = t.lineitem.select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("gap_key"), "l_orderkey")
    return rep.gap_groups(g, "gap_key", "l_orderkey")


@query("""SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1""")
def e22_zero_filled_states(t: Tables) -> DataFrame:
    return rel.zero_filled_counts(t.orders.select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


@query("""SELECT o_orderpriority AS stage, count(*) AS n, bool_and(o_orderstatus = 'F') AS ready FROM orders GROUP BY 1""")
def e23_stage_plan(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("open").alias("status"), F.col("o_orderkey").alias("action_id"))
    return rep.stage_plan(a).select("stage", "n", "ready")


@query("""WITH s AS (SELECT c_custkey, sha256(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)) AS snapshot FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT * FROM s""")
def e28_snapshot_hash(t: Tables) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.col("o_orderkey").cast("string")))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.sha2(F.array_join(ids, "|").cast("binary"), 256).alias("snapshot"))


@query("""WITH g AS (SELECT md5(text) AS digest, list(doc_id ORDER BY source, n_chars, doc_id) AS ids FROM documents GROUP BY 1)
 SELECT digest, ids[1] AS doc_id, array_to_string(ids[2:], ',') AS backups, len(ids)::INT AS group_size FROM g""")
def f2_primary_source_pick(t: Tables) -> DataFrame:
    d = t.documents.withColumn("digest", F.md5("text"))
    return rep.pick_primary(d, "digest", [F.col("source"), F.col("n_chars")], "doc_id").withColumn("backups", F.array_join("backups", ","))


@query("""SELECT doc_id, first_value(doc_id) OVER w AS "primary", count(*) OVER (PARTITION BY md5(text))::INT AS group_size, first_value(doc_id) OVER w = doc_id AS is_primary FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY source, n_chars, doc_id)""")
def f2_primary_links(t: Tables) -> DataFrame:
    d = t.documents.withColumn("digest", F.md5("text"))
    return rep.primary_links(d, "digest", [F.col("source"), F.col("n_chars")], "doc_id")


@query("""SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN lead(event_id) OVER w END AS replaced_by,
 CASE WHEN event_type IN ('view', 'click') AND lead(event_id) OVER w IS NOT NULL THEN 'superseded' ELSE event_type END AS event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def f4_supersede(t: Tables) -> DataFrame:
    return rep.supersede(t.events, "user_id", "ts", "event_id", "event_type", ["view", "click"]).select("event_id", "user_id", "replaced_by", "event_type")


@query("""SELECT o_orderkey, row_number() OVER w AS display_order, o_custkey || '-I' || lpad((row_number() OVER w)::VARCHAR, 3, '0') AS item_id FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate, o_orderkey)""")
def f6_display_order(t: Tables) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "P", "urgent").when(F.col("o_orderstatus") == "O", "deadline").otherwise("new")
    items = rep.daily_items(t.orders.withColumn("section", s), "o_custkey", "section", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderkey"))
    return items.select("o_orderkey", "display_order", "item_id")


@query("""SELECT event_id, since_last, past_hour, coalesce(since_last, 30) >= 30 AND past_hour <= 1000 AS allowed FROM (
 SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY event_type ORDER BY epoch(date_trunc('second', ts))::BIGINT, event_id, user_id) AS since_last,
 count(*) OVER (PARTITION BY event_type ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS past_hour FROM events)""")
def f11_rate_limit_windows(t: Tables) -> DataFrame:
    return rep.rate_limit(t.events, "event_type", "ts").select("event_id", "since_last", "past_hour", "allowed")


@query("""WITH s AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS stop FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN s USING (l_orderkey) WHERE stop IS NULL OR l_linenumber <= stop""")
def f14_gate_prefix(t: Tables) -> DataFrame:
    return rel.gate_prefix(t.lineitem, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("""SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, toxic NULLS LAST, doc_id LIMIT 50 OFFSET 100""")
def g1_g2_nulls_last_page(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rel.page(j, [F.desc_nulls_last("quality"), F.asc_nulls_last("toxic"), F.col("doc_id")], 3, 50).select("doc_id", "quality", "toxic")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 3""")
def g4_topk_per_group(t: Tables) -> DataFrame:
    return rel.top_per_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "place")


@query("""WITH x AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS a, list(DISTINCT o_orderpriority) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY 1)
 SELECT o_custkey, array_to_string(list_sort(list_filter(coalesce(b, []), lambda v: NOT list_contains(coalesce(a, []), v))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(a, []), lambda v: NOT list_contains(coalesce(b, []), v))), ',') AS removed FROM x""")
def h5_revision_parts(t: Tables) -> DataFrame:
    side = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    x = t.orders.groupBy("o_custkey").agg(side(F.col("o_orderdate") < "1998-01-01").alias("a"), side(F.col("o_orderdate") >= "1998-01-01").alias("b"))
    p = rel.revision_parts(F.col("a"), F.col("b"))
    return x.select("o_custkey", F.array_join(p["added"], ",").alias("added"), F.array_join(p["removed"], ",").alias("removed"))


@query("""SELECT 'supplier' AS kind, s_suppkey AS record_id, s_name AS name, s_acctbal AS amount, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 'part', p_partkey, p_name, p_retailprice, NULL FROM part""")
def h1_union_evidence_kinds(t: Tables) -> DataFrame:
    return rel.union_kinds({
        "supplier": t.supplier.select(F.col("s_suppkey").alias("record_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount")),
        "customer": t.customer.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment")),
        "part": t.part.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("amount")),
    })


@query("SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def h7_repeated_keys(t: Tables) -> DataFrame:
    return rel.repeated_keys(t.documents.select(F.md5("text").alias("k")), ["k"])


@query("""WITH c AS (SELECT o_orderkey AS k, (o_orderkey % 8) AS claimed FROM orders), a AS (SELECT l_orderkey AS k, count(*) AS counted FROM lineitem GROUP BY 1)
 SELECT k, coalesce(claimed, 0) AS claimed, coalesce(counted, 0) AS counted, coalesce(claimed, 0) = coalesce(counted, 0) AS balanced FROM c FULL JOIN a USING (k)""")
def e7_reconciliation(t: Tables) -> DataFrame:
    claimed = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 8).alias("claimed"))
    return rep.reconcile(claimed, t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("counted")), "k")


@query("""WITH g AS (SELECT l_suppkey, l_partkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS parts FROM g""")
def f1_latest_version(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("last"))
    return g.withColumn("parts", F.count("*").over(W.partitionBy("l_suppkey")))
