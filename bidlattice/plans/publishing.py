"""Events to daily issues and weekly reports (inventory N18, N19, E5 to E7, C13, C14, I29 to I31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import reporting as rep
from ..operators import temporal as tmp
from .registry import Tables, query


def now():
    """The instant at which these queries look."""
    return F.lit("1998-06-15 12:00:00").cast("timestamp")


def _notices(t: Tables) -> DataFrame:
    """Orders as announcement events: deadlines from the order date, gate and type by key."""
    o, k = t.orders, F.col("o_orderkey")
    day = F.to_timestamp(F.to_date("o_orderdate"))
    return o.select(
        k.alias("event_id"), F.when(k % 4 != 0, day + F.expr("INTERVAL 20 DAYS")).alias("signup"), F.when(k % 6 != 0, day + F.expr("INTERVAL 45 DAYS")).alias("bid"),
        F.when(k % 17 == 0, "rejected").when(k % 2 == 0, "passed").otherwise("").alias("gate"), day.alias("publish_time"),
        F.when(k % 5 == 0, "change").when(k % 5 == 1, "win").otherwise("tender").alias("title_type"), (F.col("o_custkey") % 50).alias("dedup_key"), F.col("o_orderpriority").alias("platform"),
    )


NOTICES = """n AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL 20 DAY END AS signup, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL 45 DAY END AS bid,
 CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'passed' ELSE '' END AS gate, o_orderdate::DATE::TIMESTAMP AS publish_time,
 CASE o_orderkey % 5 WHEN 0 THEN 'change' WHEN 1 THEN 'win' ELSE 'tender' END AS title_type, o_custkey % 50 AS dedup_key, o_orderpriority AS platform FROM orders)"""
STATE = """CASE WHEN gate NOT IN ('passed', '') THEN 'gate_rejected' WHEN event_id % 10 = 0 THEN 'pushed' WHEN signup IS NULL AND bid IS NULL THEN 'missing_deadline'
 WHEN coalesce(signup >= TIMESTAMP '1998-06-15 12:00:00', false) OR coalesce(bid >= TIMESTAMP '1998-06-15 12:00:00', false) THEN 'participable' ELSE 'expired' END"""


@query(f"WITH {NOTICES} SELECT event_id, {STATE} AS state FROM n")
def c13_participable_admission(t: Tables) -> DataFrame:
    n = _notices(t)
    return n.select("event_id", tmp.admission_state(F.col("signup"), F.col("bid"), now(), F.col("gate"), F.col("event_id") % 10 == 0).alias("state"))


@query(f"WITH {NOTICES} SELECT event_id, CASE WHEN publish_time < TIMESTAMP '1998-06-15' THEN 'late' WHEN publish_time >= TIMESTAMP '1998-06-16' THEN 'future' ELSE 'day' END AS bucket FROM n")
def c14_day_bucket(t: Tables) -> DataFrame:
    start = F.lit("1998-06-15").cast("timestamp")
    return _notices(t).select("event_id", tmp.day_bucket(F.col("publish_time"), start, start + F.expr("INTERVAL 1 DAY")).alias("bucket"))


URGENCY = """u AS (SELECT *, CASE WHEN coalesce(signup, bid) IS NULL THEN 'unknown' WHEN coalesce(signup, bid) - TIMESTAMP '1998-06-15 12:00:00' <= INTERVAL 24 HOUR THEN 'urgent'
 WHEN coalesce(signup, bid) - TIMESTAMP '1998-06-15 12:00:00' <= INTERVAL 72 HOUR THEN 'high' ELSE 'normal' END AS urgency, CASE WHEN signup IS NOT NULL THEN 'signup' WHEN bid IS NOT NULL THEN 'bid' END AS basis FROM n)"""
SECTION = "CASE WHEN urgency IN ('urgent', 'high') THEN CASE WHEN basis = 'signup' THEN 'urgent' ELSE 'deadline' END WHEN title_type = 'change' THEN 'change' WHEN title_type = 'win' THEN 'result' ELSE 'new' END"


@query(f"WITH {NOTICES}, {URGENCY} SELECT event_id, urgency, basis, {SECTION} AS section FROM u")
def i29_urgency_sections(t: Tables) -> DataFrame:
    n = _notices(t).withColumn("u", classify.urgency(F.col("signup"), F.col("bid"), now()))
    return n.select("event_id", "u.urgency", "u.basis", classify.section(F.col("title_type"), F.col("u.urgency"), F.col("u.basis"), ["change"], ["win"]).alias("section"))


@query(f"""WITH {NOTICES}, x AS (SELECT *, coalesce(signup::DATE, bid::DATE - 7) AS s FROM n) SELECT event_id, CASE WHEN s IS NULL THEN 'P2' WHEN DATE '1998-06-15' > s THEN 'REJECT' WHEN bid IS NOT NULL AND DATE '1998-06-15' > bid::DATE THEN 'REJECT'
 WHEN s - DATE '1998-06-15' <= 3 THEN 'P0' WHEN s - DATE '1998-06-15' <= 7 THEN 'P1' ELSE 'P2' END AS level FROM x""")
def i30_urgency_level(t: Tables) -> DataFrame:
    return _notices(t).select("event_id", classify.urgency_level(F.col("signup"), F.col("bid"), F.lit("1998-06-15").cast("date")).alias("level"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'official' WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'partner' ELSE 'other' END AS level FROM orders")
def i31_source_priority(t: Tables) -> DataFrame:
    levels = [("official", ["urgent", "HIGH"]), ("partner", ["medium"])]
    return t.orders.select("o_orderkey", classify.priority_level(F.col("o_orderpriority"), F.lit(""), levels).alias("level"))


@query(f"""WITH {NOTICES}, {URGENCY}, p AS (SELECT *, {STATE} AS state FROM u), f AS (SELECT * FROM p WHERE state = 'participable' QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY platform, publish_time, event_id) = 1)
 SELECT event_id, dedup_key, urgency, section, row_number() OVER (ORDER BY list_position(['urgent', 'deadline', 'new', 'change', 'result'], section), publish_time, event_id) AS display_order FROM (SELECT *, {SECTION} AS section FROM f)""")
def n18_daily_issue(t: Tables) -> DataFrame:
    n = _notices(t)
    pushed = n.where("event_id % 10 = 0").select("event_id")
    issue = rep.daily_issue(n, pushed, now(), "dedup_key", [F.col("platform"), F.col("publish_time")])
    items = rep.daily_items(issue.withColumn("issue", F.lit("DI")), "issue", "section", [F.col("publish_time"), F.col("event_id")], F.col("event_id"))
    return items.select("event_id", "dedup_key", "urgency", "section", "display_order")


def _runs(t: Tables) -> DataFrame:
    """Each user's events of a day as a source run."""
    e = t.events.withColumn("day", F.to_date("ts"))
    return e.groupBy((F.col("user_id") % 20).alias("source_id"), "day").agg(
        F.count("*").alias("raw"), F.count_if(F.col("event_type") != "error").alias("valid"), F.count_if(F.col("event_type") == "click").alias("duplicates"),
        F.count_if(F.col("event_type") == "signup").alias("late"), F.max("ts").alias("finished_at"),
        F.when(F.count_if(F.col("event_type") == "error") == 0, "success").when(F.count_if(F.col("event_type") == "error") == 1, "partial").otherwise("failed").alias("status"),
    )


RUNS = """r AS (SELECT user_id % 20 AS source_id, ts::DATE AS day, count(*) AS raw, count(*) FILTER (event_type <> 'error') AS valid, count(*) FILTER (event_type = 'click') AS duplicates, count(*) FILTER (event_type = 'signup') AS late, max(ts) AS finished_at,
 CASE count(*) FILTER (event_type = 'error') WHEN 0 THEN 'success' WHEN 1 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY 1, 2)"""


@query(f"""WITH {RUNS} SELECT sum(raw)::BIGINT AS raw_items, sum(valid)::BIGINT AS valid_events, sum(valid - duplicates)::BIGINT AS deduplicated_events, sum(late)::BIGINT AS late_events, greatest(0, sum(duplicates - late))::BIGINT AS excluded_others,
 round(100.0 * count(*) FILTER (status = 'success') / count(*), 1) AS success_rate, count(*) AS run_count FROM r""")
def e5_funnel(t: Tables) -> DataFrame:
    return rep.funnel(_runs(t))


@query(f"""WITH {RUNS}, s AS (SELECT source_id, count(*) AS runs, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, sum(raw)::BIGINT AS raw_items, sum(valid)::BIGINT AS valid_events,
 max(finished_at) FILTER (status = 'success') AS last_success_at, max(finished_at) AS last_run_at FROM r GROUP BY 1)
 SELECT *, CASE WHEN failed > 0 AND success = 0 AND partial = 0 THEN 'failed' WHEN success > 0 AND failed = 0 AND partial = 0 THEN 'success' ELSE 'partial' END AS status FROM s""")
def e6_source_stats(t: Tables) -> DataFrame:
    return rep.source_stats(_runs(t))


@query("""WITH i AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -1 - o_orderkey END AS event_id, o_orderdate::DATE AS issue_date FROM orders), e AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'late_discovered' WHEN 'click' THEN 'excluded' ELSE 'delivered' END AS delivery_status FROM events)
 SELECT event_id, issue_date, delivery_status FROM i JOIN e USING (event_id) UNION ALL SELECT event_id, NULL, delivery_status FROM e WHERE delivery_status <> 'delivered' AND event_id NOT IN (SELECT event_id FROM i)""")
def d7_n19_lineage(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    items = t.orders.select(F.when(k % 3 == 0, k).otherwise(-1 - k).alias("event_id"), F.to_date("o_orderdate").alias("issue_date"))
    state = F.when(F.col("event_type") == "error", "late_discovered").when(F.col("event_type") == "click", "excluded").otherwise("delivered")
    return rep.lineage(items, t.events.select("event_id", "ts", state.alias("delivery_status")), F.lit(True))


@query(f"""WITH {RUNS} SELECT strftime(day, '%G-W%V') AS week, count(*) AS runs, sum(raw)::BIGINT AS raw_items, count(DISTINCT source_id) AS sources FROM r GROUP BY 1""")
def n19_weekly_report(t: Tables) -> DataFrame:
    from ..functions.values import iso_week

    return _runs(t).groupBy(iso_week(F.col("day")).alias("week")).agg(F.count("*").alias("runs"), F.sum("raw").alias("raw_items"), F.countDistinct("source_id").alias("sources"))


#: First and second selection of each day's events, numbered by time and by value; every third day is forced, later ones are new.
_ISSUES = """e AS (SELECT ts::DATE AS day, event_id, event_type, value, ts FROM events), cut AS (SELECT max(day) - 5 AS d FROM e),
 s AS (SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY ts, event_id)::INT AS place, (day(day) % 2 + 1)::INT AS version FROM e, cut WHERE day < d),
 n AS (SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY value DESC NULLS LAST, event_id)::INT AS place FROM e WHERE event_type <> 'error'),
 j AS (SELECT coalesce(s.day, n.day) AS day, coalesce(s.event_id, n.event_id) AS event_id, s.place AS old_place, n.place AS place FROM s FULL JOIN n ON s.day = n.day AND s.event_id = n.event_id),
 c AS (SELECT j.*, coalesce(was, 0) + 1 AS version, CASE WHEN old_place IS NULL THEN 'added' WHEN place IS NULL THEN 'removed' WHEN old_place <> place THEN 'moved' ELSE 'same' END AS change
  FROM j LEFT JOIN (SELECT day, max(version) AS was FROM s GROUP BY 1) v USING (day) WHERE was IS NULL OR day(day) % 3 = 0)"""


def _issues(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events.withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day").alias("d")).first().d
    number = lambda *order: F.row_number().over(W.partitionBy("day").orderBy(*order))
    stored = e.where(F.col("day") < F.date_sub(F.lit(last), 5)).select("day", "event_id", number(F.col("ts"), F.col("event_id")).alias("place"), (F.day("day") % 2 + 1).alias("version"))
    items = e.where("event_type <> 'error'").select("day", "event_id", number(F.col("value").desc_nulls_last(), F.col("event_id")).alias("place"))
    return stored, items


@query(f"WITH {_ISSUES} SELECT day, event_id, version::INT AS version, old_place, place, change FROM c")
def n18_issue_changes(t: Tables) -> DataFrame:
    return rep.issue_changes(*_issues(t), "day", "event_id", "place", F.day("day") % 3 == 0)


@query(f"WITH {_ISSUES} SELECT day, event_id, place, version::INT AS version FROM c WHERE change <> 'removed' UNION ALL SELECT day, event_id, place, version FROM s WHERE day NOT IN (SELECT day FROM c)")
def n18_next_snapshots(t: Tables) -> DataFrame:
    stored, items = _issues(t)
    return rep.next_snapshot(stored, rep.issue_changes(stored, items, "day", "event_id", "place", F.day("day") % 3 == 0), "day", "event_id", "place")
