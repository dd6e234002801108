"""Scalar functions (inventory I) over the driver's tables, or over texts that their keys fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text, values
from ..operators import relational as rel
from .registry import Tables, cases, cases_sql, query


@query(r"""SELECT doc_id, md5(regexp_replace(translate(text, '，。！？：；（）', ',。!?:;()'), '[\s]+', '', 'g')) AS name_md5, len(regexp_extract_all(text, '[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]'))::INT AS tokens, 2 * length(text)::INT - length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\n]', '', 'g'))::INT AS width FROM
 (SELECT doc_id, trim(regexp_replace(text, '[-_|/\\—·、]|，', ' ', 'g')) AS text FROM documents)""")
def i1_i11_i12_normalise_and_tokenise(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.trim(F.regexp_replace("text", r"[-_|/\\—·、]|，", " ")).alias("text"))
    return d.select("doc_id", F.md5(text.normalise_name(F.col("text"))).alias("name_md5"), F.size(text.tokenise(F.col("text"))).alias("tokens"), text.text_width(F.col("text")).alias("width"))


@query("""WITH n AS (SELECT p_partkey, p_brand, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS s FROM part), c AS (SELECT p_brand, s, min(p_partkey) AS class_id FROM n GROUP BY 1, 2),
 g AS (SELECT p_brand, class_id, substr(s, i::INT, 2) AS gram, count(*) AS k FROM c, generate_series(1, length(s) - 1) AS x(i) GROUP BY ALL), t AS (SELECT class_id, sum(k) AS total FROM g GROUP BY 1),
 o AS (SELECT x.class_id AS a, y.class_id AS b, sum(least(x.k, y.k)) AS shared FROM g x JOIN g y ON x.p_brand = y.p_brand AND x.gram = y.gram AND x.class_id <> y.class_id GROUP BY 1, 2),
 l AS (SELECT a AS class_id, count(*) AS links, max(round(2.0 * shared / (ta.total + tb.total), 4)::DOUBLE) AS best FROM o JOIN t ta ON ta.class_id = a JOIN t tb ON tb.class_id = b WHERE 2 * shared >= 0.6 * (ta.total + tb.total) GROUP BY 1)
 SELECT p_partkey, class_id, coalesce(links, 0) AS links, best FROM n JOIN c USING (p_brand, s) LEFT JOIN l USING (class_id)""")
def i8_dice_similarity_pairs(t: Tables) -> DataFrame:
    """Part names of a brand that are alike, from a Dice coefficient of 0.6."""
    n = t.part.select("p_partkey", "p_brand", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", "")).alias("s"))
    return rel.similar_names(n, "p_partkey", "s", "p_brand", 0.6)


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\b\d{17}[\dXx]\b', '[REDACTED]', 'g'), '\b1[3-9]\d{9}\b', '[REDACTED]', 'g') AS redacted, left(role, 1) || repeat('*', length(role) - 1) AS masked FROM conversations""")
def i16_mask_pii(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.redact(F.col("text")).alias("redacted"), text.mask_name(F.col("role")).alias("masked"))


@query("""SELECT o_orderkey, coalesce(nullif(trim(o_orderstatus), 'P'), '') || '|' || coalesce(o_custkey::VARCHAR, '') AS business_key, left(sha256(coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '')), 16) AS joined, left(sha1(replace(o_orderpriority, ' ', '')), 16) AS content FROM orders""")
def i17_i63_i65_keys_and_hashes(t: Tables) -> DataFrame:
    o = t.orders
    return o.select("o_orderkey", text.business_key(F.col("o_orderstatus"), F.col("o_custkey"), sentinel="P").alias("business_key"),
                    values.joined_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("joined"), values.content_hash(F.col("o_orderpriority")).alias("content"))


TITLES = (
    ("某市道路{a}工程招标公告", "tender", "某市道路{a}工程"), ("某市道路{a}工程中标候选人公示", "win", "某市道路{a}工程"), ("设备{a}采购竞争性磋商公告", "procure", "设备{a}采购竞争性"), ("桥梁{a}项目资格预审公告", "prequal", "桥梁{a}项目"),
    ("桥梁{a}项目更正公告", "change", "桥梁{a}项目更正公告"), ("商铺{a}出租公告", "lease", "商铺{a}出租公告"), ("{d}号楼施工招标公告", "other", "{d}号楼施工"), ("", "other", ""), ("管网{a}改造一标段招标公告", "tender", "管网{a}改造"),
)


@query("SELECT p_partkey, kind, project FROM (" + cases_sql("part", "p_partkey", TITLES, ("raw", "kind", "project")) + ")")
def i26_i27_title_types(t: Tables) -> DataFrame:
    d = cases(t.part, "p_partkey", [x[0] for x in TITLES])
    return d.select("p_partkey", classify.title_type(F.col("raw")).alias("kind"), classify.project_key(F.col("raw")).alias("project"))


AMOUNTS = (("合同额1,2{a}.5万元", "12{a}5000"), ("{d}亿", "{d}00000000"), ("5{a}元整", "5{a}"), ("没有数字", None), ("{a}.34", "{a}.34"))


@query("SELECT p_partkey, yuan::DOUBLE AS yuan FROM (" + cases_sql("part", "p_partkey", AMOUNTS, ("raw", "yuan")) + ")")
def i53_amounts(t: Tables) -> DataFrame:
    d = cases(t.part, "p_partkey", [a for a, _ in AMOUNTS])
    return d.select("p_partkey", values.normalise_amount(F.col("raw")).cast("double").alias("yuan"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 10000, 2) AS yuan FROM lineitem")
def i53_amounts_from_text(t: Tables) -> DataFrame:
    raw = F.concat(F.format_string("%.2f", F.col("l_extendedprice")), F.lit("万元"))
    return t.lineitem.select("l_orderkey", "l_linenumber", values.normalise_amount(raw).cast("double").alias("yuan"))


CAPITALS = (("人民币{c}佰贰拾叁万肆仟元整", "{d}234000"), ("{c}亿零伍万元", "{d}00050000"), ("拾{c}元", "1{d}"), ("捌仟零{c}元", "800{d}"), ("无", None))


@query("SELECT p_partkey, yuan::BIGINT AS yuan FROM (" + cases_sql("part", "p_partkey", CAPITALS, ("raw", "yuan")) + ")")
def i54_capital_amounts(t: Tables) -> DataFrame:
    d = cases(t.part, "p_partkey", [a for a, _ in CAPITALS])
    return d.select("p_partkey", values.capital_amount(F.col("raw")).alias("yuan"))


DATES = (("2026-09-{a}", None), ("2026-09-0{d}", "2026-09-0{d}"), ("2026/{d}/2", "2026-0{d}-02"), ("2026.09.0{d}", "2026-09-0{d}"), ("2026年9月{d}日", "2026-09-0{d}"), ("2026年{d}月", "2026-0{d}-01"), ("2026-13-4{d}", None), ("soon {d}", None))


@query("SELECT p_partkey, CASE WHEN raw LIKE '2026-09-__' AND right(raw, 2) BETWEEN '10' AND '30' THEN raw ELSE day END::DATE AS day FROM (" + cases_sql("part", "p_partkey", DATES, ("raw", "day")) + ")")
def i47_dates(t: Tables) -> DataFrame:
    return cases(t.part, "p_partkey", [a for a, _ in DATES]).select("p_partkey", values.normalise_date(F.col("raw")).alias("day"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, (date_trunc('week', o_orderdate)::DATE - 7) AS previous_start, date_trunc('week', o_orderdate)::DATE AS monday FROM orders""")
def i46_iso_weeks(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    week = values.iso_week(d)
    return t.orders.select("o_orderkey", week.alias("week"), values.previous_week(d)["start"].alias("previous_start"), values.week_start(week).alias("monday"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey * 7 BETWEEN 36526 AND 73415 THEN DATE '1899-12-30' + (o_orderkey * 7)::INT END AS day FROM orders""")
def i49_excel_serials(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", values.excel_date(F.col("o_orderkey") * 7).alias("day"))


@query("""SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS value, coalesce(trim(json_extract_string(props, '$.k')), '') = '' AS missing FROM events""")
def i68_json_fields(t: Tables) -> DataFrame:
    s = values.field_state(F.col("props"), "$.k")
    return t.events.select("event_id", s["value"].alias("value"), s["missing"].alias("missing"))


CLAUSES = (
    ("第{a}标段接受联合体投标。", "allowed", None), ("第{a}标段不接受联合体投标。", "refused", None), ("联合体投标：☑不接受 □接受，见{a}页", "refused", None), ("第{a}标段中标后不允许分包。", None, "refused"), ("另见附件{a}。", None, None),
)


@query("SELECT s_suppkey, consortium, subcontract FROM (" + cases_sql("supplier", "s_suppkey", CLAUSES, ("raw", "consortium", "subcontract")) + ")")
def i35_polarity_fields(t: Tables) -> DataFrame:
    d = cases(t.supplier, "s_suppkey", [a[0] for a in CLAUSES])
    return d.select("s_suppkey", *[classify.polarity(F.col("raw"), *classify.POLARITY_FIELDS[k]).alias(k) for k in ("consortium", "subcontract")])


LEVELS = (("建筑工程{a}壹级资质", "一级", 4, 3), ("{a}特级", "特级", 5, 4), ("工程设计{a}乙级", "乙级", 3, 2), ("不详{a}", None, None, -1))


@query("SELECT s_suppkey, level, proof_rank::INT AS proof_rank, rule_rank::INT AS rule_rank FROM (" + cases_sql("supplier", "s_suppkey", LEVELS, ("raw", "level", "proof_rank", "rule_rank")) + ")")
def i21_i22_levels(t: Tables) -> DataFrame:
    level = text.normalise_level(F.col("raw"))
    return cases(t.supplier, "s_suppkey", [x[0] for x in LEVELS]).select("s_suppkey", level.alias("level"), text.proof_level_rank(level).alias("proof_rank"), text.rule_level_rank(level).alias("rule_rank"))


@query("""SELECT part.p_partkey, abs(p_retailprice - p_size * 30) / greatest(p_retailprice, p_size * 30) AS gap, round(25 * (p_size / 50.0) + 25 * (p_partkey % 2) + 25 + 15 * 0.5 + 10, 2) AS score FROM part""")
def i43_i56_scores_and_gaps(t: Tables) -> DataFrame:
    s = classify.source_score(F.col("p_size") / 50.0, (F.col("p_partkey") % 2).cast("double"), F.lit(1.0), F.lit(0.5), F.lit(1.0))
    return t.part.select("p_partkey", values.relative_gap(F.col("p_retailprice"), (F.col("p_size") * 30).cast("double")).alias("gap"), s["score"].alias("score"))
