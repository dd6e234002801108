"""State machines, upkeep and incremental forms (inventory L, N13 to N16, N23, O9, O15, P, B1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators import relational as rel
from ..operators import temporal as tmp
from .registry import Tables, query


def today():
    """The instant at which these queries look."""
    return F.lit("1998-06-15").cast("date")
STATES = {("new", "view"): "seen", ("seen", "click"): "active", ("active", "purchase"): "bought", ("bought", "error"): "failed", ("failed", "view"): "seen", ("seen", "error"): "failed"}


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, 0::BIGINT AS n, 'new' AS state, 0 AS refused FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT f.user_id, e.n, coalesce(t.t, f.state), f.refused + (t.t IS NULL)::INT FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1 LEFT JOIN (VALUES ('new', 'view', 'seen'), ('seen', 'click', 'active'), ('active', 'purchase', 'bought'), ('bought', 'error', 'failed'), ('failed', 'view', 'seen'), ('seen', 'error', 'failed')) t(s, e, t) ON t.s = f.state AND t.e = e.event_type)
 SELECT user_id, state, refused, n::INT AS events FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def l3_job_state_fold(t: Tables) -> DataFrame:
    return lc.fold_states(t.events, "user_id", ["ts", "event_id"], "event_type", "new", STATES).select("user_id", "state", "refused", "events")


@query("""SELECT user_id AS runner_id, max(ts) AS last, epoch(date_trunc('second', (SELECT max(ts) FROM events)))::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT > 86400 AS stale FROM events GROUP BY 1""")
def l4_stale_runners(t: Tables) -> DataFrame:
    now = F.lit(t.events.agg(F.max("ts").alias("m")).first().m)
    return lc.stale_runners(t.events.withColumnRenamed("user_id", "runner_id"), now, 86400)


@query("""SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-06-14') ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def l2_claimable_jobs(t: Tables) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded")
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), s.alias("status"), F.col("o_orderdate").alias("heartbeat_at"), F.col("o_orderdate").alias("created_at"))
    return lc.claimable(jobs, F.lit("1998-06-15").cast("timestamp"), 25, stale_s=86400).select("job_id")


@query("""SELECT date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR AS start, event_type AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def l7_tumbling_days(t: Tables) -> DataFrame:
    from ..streaming import streams

    return streams.tumbling_days(t.events, "ts", F.col("event_type")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true)::INT AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def l9_sessions(t: Tables) -> DataFrame:
    from ..streaming import streams

    return streams.sessions(t.events, "ts", "user_id", "6 hours")


@query("""SELECT o_orderkey AS fingerprint, o_orderkey IN (SELECT event_id FROM events) AS stored FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)""")
def l12_not_seen(t: Tables) -> DataFrame:
    from ..streaming import streams

    out = streams.not_seen(t.orders.select(F.col("o_orderkey").alias("fingerprint")), t.events.select(F.col("event_id").alias("fingerprint")), "fingerprint")
    return out.select("fingerprint", F.lit(False).alias("stored"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderdate::DATE < DATE '1998-06-15' THEN 'expired' WHEN o_orderkey % 3 <> 0 THEN 'active' ELSE 'withdrawn' END AS status FROM orders""")
def l13_expire_records(t: Tables) -> DataFrame:
    r = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, "active").otherwise("withdrawn").alias("status"), F.to_date("o_orderdate").alias("valid_until"))
    return lc.expire(r, today()).select("o_orderkey", "status")


@query("""WITH a AS (SELECT o_orderkey AS approval_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'draft' END AS state FROM orders), w AS (SELECT l_orderkey AS approval_id, max(l_shipdate::DATE) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT approval_id, CASE WHEN u < DATE '1998-06-15' AND state IN ('approved', 'pending') THEN 'blocked' ELSE state END AS state FROM a LEFT JOIN w USING (approval_id)""")
def l13_n15_waivers(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("draft")
    waivers = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("approval_id"), F.to_date("l_shipdate").alias("valid_until"))
    return lc.waivers_expired(t.orders.select(F.col("o_orderkey").alias("approval_id"), state.alias("state")), waivers, today()).select("approval_id", "state")


@query("""WITH e AS (SELECT c_custkey AS fingerprint, CASE c_custkey % 4 WHEN 0 THEN 'closed' ELSE 'open' END AS was FROM customer), c AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS fingerprint, true AS now FROM orders WHERE o_totalprice > 200000)
 SELECT fingerprint, CASE WHEN was IS NULL THEN 'create' WHEN now AND was = 'open' THEN 'touch' WHEN now THEN 'reopen' WHEN was = 'open' THEN 'close' ELSE 'keep' END AS action FROM e FULL JOIN c USING (fingerprint)""")
def n13_task_sync(t: Tables) -> DataFrame:
    """Every customer has a task; of the dear orders every third asks for one that is not there."""
    e = t.customer.select(F.col("c_custkey").alias("fingerprint"), F.when(F.col("c_custkey") % 4 == 0, "closed").otherwise("open").alias("state"))
    c = t.orders.where("o_totalprice > 200000").select(F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("fingerprint")).distinct()
    return lc.task_sync(e, c).select("fingerprint", "action")


@query("""WITH c AS (SELECT doc_id AS candidate_id, doc_id % 7 = 0 AS missing, doc_id % 5 AS version, CASE doc_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'revise' ELSE 'not_applicable' END AS event, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'why' END AS note, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'text' END AS revised, doc_id % 5 + (doc_id % 11 = 0)::INT AS seen FROM documents),
 t AS (SELECT *, CASE WHEN NOT missing AND event = 'approve' THEN 'approved' WHEN NOT missing AND event = 'reject' THEN 'rejected' WHEN event = 'revise' THEN 'revised' WHEN missing AND event = 'not_applicable' THEN 'not_applicable' END AS t FROM c),
 e AS (SELECT *, CASE WHEN seen <> version THEN 'version_conflict' WHEN t IS NULL THEN 'not_allowed' WHEN event IN ('reject', 'not_applicable') AND note = '' THEN 'note_missing' WHEN event = 'revise' AND revised = '' THEN 'revision_missing' END AS error FROM t)
 SELECT candidate_id, error, CASE WHEN error IS NULL THEN t ELSE 'pending' END AS new_status FROM e""")
def o9_review_decisions(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    c = t.documents.select(k.alias("candidate_id"), F.lit("pending").alias("status"), (k % 7 == 0).alias("missing"), (k % 5).alias("version"))
    event = F.element_at(F.array(*[F.lit(x) for x in ("approve", "reject", "revise", "not_applicable")]), (k % 4 + 1).cast("int"))
    d = t.documents.select(k.alias("candidate_id"), event.alias("event"), F.when(k % 3 == 0, "").otherwise("why").alias("note"), F.when(k % 3 == 1, "").otherwise("text").alias("revised"), (k % 5 + (k % 11 == 0).cast("int")).alias("version"))
    return lc.review(c, d).select("candidate_id", "error", "new_status")


@query("""WITH p AS (SELECT c_custkey AS project_id, CASE c_custkey % 10 WHEN 0 THEN 'conflict' ELSE 'confirmed' END AS identity_status, max(o_orderdate::DATE) AS day, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
 SELECT project_id, CASE WHEN day IS NULL THEN 'missing' ELSE 'date' END AS "precision", (day - DATE '1998-06-15')::INT AS days_left, array_to_string(list_filter([CASE WHEN identity_status = 'conflict' THEN 'identity_conflict' END, CASE WHEN n = 0 THEN 'no_requirements' END, CASE WHEN day < DATE '1998-06-15' THEN 'deadline_passed' END, CASE WHEN x > 0 THEN 'exceptions_open' END], lambda v: v IS NOT NULL), ',') AS blocking,
 identity_status <> 'conflict' AND n > 0 AND coalesce(day >= DATE '1998-06-15', true) AS can_match FROM p""")
def o15_readiness(t: Tables) -> DataFrame:
    j = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("project_id")).agg(
        F.max(F.to_date("o_orderdate")).alias("deadline_day"), F.count("o_orderkey").alias("requirements_n"), F.count_if(F.col("o_orderstatus") == "P").alias("open_exceptions"))
    j = j.withColumns({"identity_status": F.when(F.col("project_id") % 10 == 0, "conflict").otherwise("confirmed"), "deadline_at": F.lit(None).cast("timestamp"), "run_n": F.lit(1)})
    return lc.readiness(j, F.lit("1998-06-15 08:00:00").cast("timestamp")).select("project_id", "precision", "days_left", F.array_join("blocking", ",").alias("blocking"), "can_match")


@query("""WITH s AS (SELECT o_custkey AS item_id, o_orderpriority AS gate, bool_and(o_totalprice > 30000) AS passed FROM orders GROUP BY 1, 2), g AS (SELECT *, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], gate) AS k FROM s)
 SELECT item_id, (ARRAY['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[min(k) FILTER (NOT passed)] AS blocked_at, count(*) FILTER (NOT passed) = 0 AND count(*) = 5 AS through FROM g GROUP BY 1""")
def n23_pipeline_gates(t: Tables) -> DataFrame:
    s = t.orders.groupBy(F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("gate")).agg(F.bool_and(F.col("o_totalprice") > 30000).alias("passed"))
    return lc.pipeline_gates(s, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


@query("""WITH s AS (SELECT o_custkey AS k, count(*) AS s FROM orders GROUP BY 1), t AS (SELECT c_custkey AS k, 1 AS t FROM customer)
 SELECT sum(coalesce(s, 0))::BIGINT AS source_rows, sum(coalesce(t, 0))::BIGINT AS target_rows, count(*) FILTER (t IS NULL) AS missing_keys, count(*) FILTER (s IS NULL) AS extra_keys, sum(CASE WHEN t IS NOT NULL AND s IS NOT NULL THEN greatest(s - t, 0) ELSE 0 END)::BIGINT AS folded_rows FROM s FULL JOIN t USING (k)""")
def p4_reconcile_tables(t: Tables) -> DataFrame:
    return lc.reconcile_tables(t.orders.select(F.col("o_custkey").alias("key")), t.customer.select(F.col("c_custkey").alias("key")), F.col("key"))


@query("""WITH v AS (SELECT l_orderkey AS candidate_id, l_linenumber AS version, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS summary, l_linestatus FROM lineitem)
 SELECT candidate_id, version, coalesce(summary, 'new-' || l_linestatus) AS summary FROM v QUALIFY version = max(version) OVER (PARTITION BY candidate_id)""")
def p5_backfill_latest(t: Tables) -> DataFrame:
    v = t.lineitem.select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("version"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("summary"), "l_linestatus")
    return lc.backfill(v, "candidate_id", "version", F.concat(F.lit("new-"), F.col("l_linestatus")), "summary").select("candidate_id", "version", "summary")


@query("""SELECT o_orderkey AS project_id, o_orderdate::DATE AS bid_deadline FROM orders ANTI JOIN (SELECT event_id AS o_orderkey FROM events) USING (o_orderkey)""")
def p7_restored_projects(t: Tables) -> DataFrame:
    refs = t.orders.select(F.col("o_orderkey").alias("project_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("deadline"))
    return lc.restored_projects(refs, t.events.select(F.col("event_id").alias("project_id")))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, 1 AS rev FROM orders), i AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -1 - o_orderkey END AS id, 'N' AS status, 2 AS rev FROM orders)
 SELECT * FROM s WHERE NOT (status = 'P' AND id IN (SELECT id FROM i)) UNION ALL SELECT * FROM i WHERE id NOT IN (SELECT id FROM s WHERE NOT (status = 'P' AND id IN (SELECT id FROM i)))""")
def b1_upsert_new_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    s = t.orders.select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("rev"))
    i = t.orders.select(F.when(k % 3 == 0, k).otherwise(-1 - k).alias("id"), F.lit("N").alias("status"), F.lit(2).alias("rev"))
    return rel.upsert_new(s, i, ["id"], F.col("status") == "P")


@query("""WITH s AS (SELECT p_partkey AS k, md5(p_name) AS digest, p_size AS version FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_partkey AS k, md5(CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand END) AS digest FROM part)
 SELECT i.k, i.digest, coalesce(s.version, t.version + 1, 1) AS version FROM i LEFT JOIN s ON s.k = i.k AND s.digest = i.digest LEFT JOIN s t ON t.k = i.k""")
def a17_next_versions(t: Tables) -> DataFrame:
    s = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.md5("p_name").alias("digest"), F.col("p_size").alias("version"))
    i = t.part.select(F.col("p_partkey").alias("k"), F.md5(F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.col("p_brand"))).alias("digest"))
    return tmp.next_version(s, i, "k", "digest").select("k", "digest", "version")


@query("""WITH r AS (SELECT l_orderkey AS requirement_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 END AS lot_id FROM lineitem) SELECT requirement_id, lot_id::INT AS lot_id FROM r WHERE lot_id IS NOT NULL UNION ALL SELECT requirement_id, l FROM r, (VALUES (1), (2)) v(l) WHERE lot_id IS NULL""")
def p9_per_lot(t: Tables) -> DataFrame:
    lot = F.col("l_linenumber") % 3
    r = t.lineitem.select(F.col("l_orderkey").alias("requirement_id"), F.when(lot != 0, lot).alias("lot_id"))
    return lc.per_lot(r, t.spark.createDataFrame([(1,), (2,)], "lot_id int")).select("requirement_id", "lot_id")
