"""Clauses and anchors on notices that are built from keys of the driver's tables (inventory O1 to O5, J1, J5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cards, clauses
from ..operators import extraction as ex
from ..operators import submissions as subs
from .registry import Tables, cases, cases_sql, filled, filled_sql, query

#: Field, its clause, its value: {a} is a number of two digits, {d} one of one digit, both of the supplier's key.
CLAUSES = (
    ("region", "建设地点：石家庄市第{a}区", "石家庄市第{a}区"), ("budget_amount", "预算金额：{a}00万元", "{a}00万元"), ("ceiling_price", "最高投标限价： {a}50万元", "{a}50万元"),
    ("equip_amount", "设备购置费最高限价为{a}万元", "{a}万元"), ("work_amount", "工程费最高限价为{a}1万元", "{a}1万元"), ("duration", "计划工期：{a}0日历天", "{a}0日历天"), ("section_count", "共计划分为{d}个标段", "{d}"),
    ("pm_registered", "拟派项目经理须具备二级及以上注册建造师执业资格", "拟派项目经理须具备二级及以上注册建造师执业资格"), ("pm_b_cert", "同时具有有效的安全生产考核合格证书（B类）", "同时具有有效的安全生产考核合格证书（B类）"),
    ("safety_officer", "安全生产管理人员配备人数：{d}个", "{d}"), ("credit_ok", "未被法院列入失信被执行人名单", "未被法院列入失信被执行人名单"), ("bid_bond", "投标保证金金额：人民币{a}万元", "{a}万元"),
    ("performance_bond", "履约保证金为合同价的{d}%", "{d}%"), ("advance_payment", "预付款为合同价的{a}%", "{a}%"), ("retention_money", "质量保证金为结算价的{d}%", "{d}%"), ("bid_validity", "投标有效期：{a}日历天", "{a}日历天"),
    ("warranty", "保修期：{a}个月", "{a}个月"), ("provisional_sum", "暂列金额：{a}万元", "{a}万元"), ("downward_rate", "下浮率：不低于{d}%", "{d}%"), ("file_price", "招标文件售价：{a}0元", "{a}0元"),
    ("safety_fee", "安全文明施工费按{a}万元计", "{a}万元"), ("evaluation_method", "评标办法：综合评估法", "综合评估法"), ("price_score", "投标报价（{a}分）", "{a}分"), ("tech_score", "技术标（{a}分）", "{a}分"),
    ("business_score", "商务得分：{d}分", "{d}分"), ("contract_type", "合同类型：固定总价合同", "固定总价合同"), ("prequalification", "资格审查方式：资格后审", "资格后审"), ("safety_license", "有效的安全生产许可证", "有效的安全生产许可证"),
    ("similar_performance", "近3年完成过类似工程业绩", "近3年完成过类似工程业绩"), ("no_violation", "近3年内没有重大违法记录", "近3年内没有重大违法记录"), ("credit_blacklist", "重大税收违法失信主体名单", "重大税收违法失信主体名单"),
    ("tech_lead", "技术负责人具有高级工程师职称", "技术负责人具有高级工程师职称"), ("pm_similar", "项目经理担任过类似工程项目", "项目经理担任过类似工程"), ("social_security", "连续3个月缴纳社保证明", "连续3个月缴纳社保证明"),
    ("quality", "质量标准：合格\n 之{a}", "合格 之{a}"), ("qualification", "资质要求：（1）建筑工程{d}；（2）市政工程{a}", "（1）建筑工程{d}；（2）市政工程{a}"), ("performance", "业绩要求：至少{d}项", "至少{d}项"), ("scale", "建设规模：{a}00平方米", "{a}00平方米"),
    ("purchaser", "招标人：第{a}局", "第{a}局"), ("financial", "财务要求：注册资本{a}", "注册资本{a}"), ("payment_terms", "付款方式：按月支付{a}%", "按月支付{a}%"), ("tech_standard", "技术标准：国标{a}号", "国标{a}号"),
    ("scope_content", "招标范围：施工图{a}张", "施工图{a}张"), ("open_location", "开标地点：第{a}会议室", "第{a}会议室"), ("bid_location", "递交地点：第{a}窗口", "第{a}窗口"), ("agency", "代理机构：第{a}公司", "第{a}公司"),
    ("funding_source", "资金来源：财政{a}", "财政{a}"), ("approval_doc", "批准文号：发改{a}号", "发改{a}号"), ("deadline_signup", "请于2026年1月{d}日至2026年2月{d}日报名", "2026年1月{d}日至2026年2月{d}日"),
    ("deadline_bid", "投标截止时间为2026年3月{d}日", "2026年3月{d}日"), ("open_date", "开标时间：2026 年\t4 月 {d} 日", "2026年4月{d}日"), ("doc_deadline", "招标文件获取时间至2026年5月{d}日", "2026年5月{d}日"),
    ("q_deadline", "质疑截止时间2026年6月{d}日", "2026年6月{d}日"), ("site_visit", "现场踏勘：2026年7月{d}日", "2026年7月{d}日"),
)


def _notices(t: Tables) -> DataFrame:
    """A notice of each supplier: all clauses in order, between white space of lengths that its key sets. Of every seventh
    key it doesn't state the duration."""
    gap = F.repeat(F.lit(" \n"), (F.col("s_suppkey") % 3 + 1).cast("int"))
    parts = [F.when((F.lit(f) == "duration") & (F.col("s_suppkey") % 7 == 0), F.lit("")).otherwise(F.concat(gap, filled(c, "s_suppkey"), F.lit("。"))) for f, c, _ in CLAUSES]
    # the keys are few bytes, which Spark would read in one task
    return t.supplier.repartition(t.spark.sparkContext.defaultParallelism * 2, "s_suppkey").select("s_suppkey", F.concat(*parts, gap).alias("text"))


_WANTED = ", ".join(f"('{f}', '{v}')" for f, _, v in CLAUSES)


@query(f"""SELECT s_suppkey, field, CASE WHEN gone THEN NULL ELSE {filled_sql("v", "s_suppkey")} END AS value, gone AS missing, NOT gone AS quoted
 FROM (SELECT s_suppkey, field, v, field = 'duration' AND s_suppkey % 7 = 0 AS gone FROM supplier, (VALUES {_WANTED}) w(field, v))""")
def j5_o1_o4_prescreened_notices(t: Tables) -> DataFrame:
    """Every anchor on every notice; quoted: the quote is the slice of the original that its span names."""
    notices = _notices(t)
    found = clauses.prescreen_fields(notices, "s_suppkey").join(notices.hint("merge"), "s_suppkey")  # texts by far outgrow the keys that they are built from, so they are not broadcast
    own = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    quoted = F.coalesce((own == F.col("quote")) & (F.trim(F.regexp_replace("quote", r"\s+", " ")) == F.col("assertion")), F.lit(False))
    return found.select("s_suppkey", "field", "value", "missing", quoted.alias("quoted"))


@query(r"""SELECT doc_id, length(f)::INT AS size, md5(f) AS folded_md5, true AS led_back FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS f FROM documents)""")
def o1_folded_documents(t: Tables) -> DataFrame:
    """Whole documents folded; led_back: the folded text is the whole original's, and each of its characters is that of the
    original at its offset, a space the first of its white space."""
    folded = clauses.folded_text(t.documents)
    # white space, as the fold takes it, becomes spaces one for one, so places stay; four bytes a character, so any is found at once
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1C-\x1F]", " ")
    codes = lambda c: F.encode(c, "UTF-32")
    cut = lambda c, i, n: F.substring(c, i * 4 + 1, n * 4)
    place = lambda i: F.get("offsets", i)
    # the characters whose next one's place does not follow, the last of all too: stretches end there, and all of a stretch is compared
    ends = F.array_compact(F.transform("offsets", lambda o, i: F.when(F.coalesce(place(i + 1) != o + 1, F.lit(True)), i)))

    def led(s: Column, last: Column, k: Column) -> Column:
        first = F.coalesce(F.get(s["ends"], k - 1) + 1, F.lit(0))
        same = cut(s["folded"], first, last - first + 1) == cut(s["text"], place(first), last - first + 1)
        return same & (place(last + 1).isNull() | ((cut(s["folded"], last, F.lit(1)) == codes(F.lit(" "))) & (place(last + 1) > place(last))))

    # as the one element of an array, so that texts are encoded once and not for each stretch
    both = F.array(F.struct(codes("folded").alias("folded"), codes(plain).alias("text"), ends.alias("ends")))
    every = F.transform(both, lambda s: F.forall(F.transform(s["ends"], lambda last, k: led(s, last, k)), lambda x: x))[0]
    whole = (F.length("folded") == F.size("offsets")) & (F.trim(F.regexp_replace(plain, " +", " ")) == F.col("folded"))
    led_back = F.coalesce(whole & ((F.size("offsets") == 0) | ((place(F.lit(0)) >= 0) & every)), F.lit(False))
    return folded.select("doc_id", F.length("folded").alias("size"), F.md5("folded").alias("folded_md5"), led_back.alias("led_back"))


#: Anchor, a sentence that meets it and no earlier one, and the hit.
SENTENCES = (
    ("qualification_grade", "资质等级为二级", "资质等级为二级"), ("safety_license", "持有安全生产许可证", "安全生产许可证"), ("business_license", "持有营业执照", "营业执照"),
    ("pm_registered_builder", "须为注册建造师", "注册建造师"), ("pm_b_cert", "安全生产考核合格证B", "安全生产考核合格证B"), ("pm_no_active", "无在建", "无在建"),
    ("pm_social_security", "社保三个月", "社保三个月"), ("safety_officer", "专职安全员", "专职安全员"), ("tech_lead", "设技术负责人", "技术负责人"), ("tech_team", "设施工员", "施工员"),
    ("design_lead", "设设计负责人", "设计负责人"), ("construction_lead", "设施工负责人", "施工负责人"), ("financial_audit", "财务审计报告", "财务审计报告"),
    ("tax_social_proof", "完税凭证", "完税凭证"), ("credit_no_loser", "非失信被执行人", "失信被执行人"), ("credit_blacklist", "未列入黑名单", "黑名单"),
    ("no_major_violation", "无重大违法记录", "重大违法记录"), ("consortium", "接受联合体", "联合体"), ("bid_validity", "投标有效期90", "投标有效期90"),
    ("bid_bond", "交投标保证金", "投标保证金"), ("ceiling_price", "设最高投标限价", "最高投标限价"), ("similar_performance_hard", "有类似工程业绩", "类似工程业绩"),
    ("prequalification_method", "资格后审", "资格后审"), ("evaluation_method", "综合评估法", "综合评估法"), ("scoring_tech", "技术标满分", "技术标满分"),
    ("scoring_price", "报价得分", "报价得分"), ("scoring_construction_plan", "施工组织设计", "施工组织设计"), ("scoring_equipment", "机械设备", "机械设备"),
    ("action_file_acquisition", "凭证报名", "报名"), ("action_deadline_bid", "投标截止时间", "投标截止时间"), ("action_open", "开标时间", "开标时间"),
    ("action_q_and_a", "答疑", "答疑"), ("action_site_visit", "踏勘", "踏勘"), ("pm_similar_performance", "项目经理担任过同类项目", "项目经理担任过同类项目"),
    ("scoring_similar_performance", "同类工程每项得3分", "同类工程每项得3分"), ("scoring_pm", "项目经理有职称得2分", "项目经理有职称得2分"),
    ("scoring_business_credit", "信用满80分", "信用满80分"), ("scoring_enterprise_honor", "鲁班奖计分", "鲁班奖计分"), ("action_bid_bond_due", "保证金到账", "保证金到账"),
)


def _pages(t: Tables) -> DataFrame:
    """Two pages of each supplier, by its key: a clause whose box is open and later a ticked one; a numbered clause on the
    first page; a clause on the second page that is broken after every character."""
    kind = F.col("s_suppkey") % 3
    joined = lambda before, each: F.concat(*[F.concat(F.lit(before), each(F.lit(s)), F.lit("。\n")) for _, s, _ in SENTENCES])
    same = lambda s: s
    one = F.when(kind == 0, joined("□1.1 ", same)).when(kind == 1, joined("3.4 ", same)).otherwise("总则。")
    two = F.when(kind == 0, joined("☑ 1.2 ", same)).when(kind == 1, "附则。").otherwise(joined("", lambda s: F.regexp_replace(s, "(.)", "$1 \n")))
    return t.supplier.select("s_suppkey", F.posexplode(F.array(one, two)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


_SENTENCES = ", ".join(f"('{k}', '{h}')" for k, _, h in SENTENCES)


@query(f"""SELECT s_suppkey, anchor_key, CASE WHEN s_suppkey % 3 = 1 OR s_suppkey % 3 = 0 AND anchor_key = 'consortium' THEN 1 ELSE 2 END AS page_no, assertion,
 CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN anchor_key = 'consortium' THEN '1.1' ELSE '1.2' END WHEN 1 THEN '3.4' END AS clause_ref, true AS quoted
 FROM supplier, (VALUES {_SENTENCES}) v(anchor_key, assertion)""")
def j1_anchor_candidates(t: Tables) -> DataFrame:
    """All anchors on all pages; quoted: the quote is the slice of the page that its span names."""
    pages = _pages(t)
    found = ex.anchor_candidates(pages, doc="s_suppkey").where("not missing").join(pages.hint("merge"), ["s_suppkey", "page_no"])
    own = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select("s_suppkey", "anchor_key", "page_no", "assertion", "clause_ref", (own == F.col("quote")).alias("quoted"))


def _card_pages(t: Tables) -> DataFrame:
    """By the supplier's key modulo 3: all on the first pages; the region behind the notice and no closing date; no name, and
    what a table says."""
    kind, none = F.col("s_suppkey") % 3, F.lit("")
    fill = lambda s: filled(s, "s_suppkey")
    first = fill("第{a}号道路工程 已由发改委批准，施工招标公告。项目编号：ZB-2026{a}。招 标人为：第一建设局，代理机构为：诚信咨询公司。最高投标限价{a}00万元。")
    one = (
        F.when(kind == 0, F.concat(first, F.lit("建设地点：河北省石家\n庄市长安区。"), fill("投标截止时间为2026年3月{d}日9时30分。请于2026年1月{d}日8:00前报名。")))
        .when(kind == 1, F.concat(first, F.lit("建设地点：见前附表。"))).otherwise("目录。设计招标。")
    )
    far = F.when(kind == 1, fill("工程地点：中山路{a}号院。")).otherwise(none)
    return t.supplier.select("s_suppkey", F.explode(F.array(F.struct(F.lit(1).alias("page_no"), one.alias("text")), F.struct(F.lit(13).alias("page_no"), far.alias("text")))).alias("p")).select("s_suppkey", "p.*")


def _card_cells(t: Tables) -> DataFrame:
    rows = (("1.1.2 招标人", "", "名称：石家庄第{a}建设局 地址：中山路"), ("10.1 招标控制价", "{a}0万元整", ""), ("建设地点", "详见图纸", ""), ("说明", "", ""))
    cells = [F.struct(F.lit(i).alias("row_no"), F.lit(j).alias("col_no"), filled(c, "s_suppkey").alias("cell")) for i, r in enumerate(rows) for j, c in enumerate(r)]
    return t.supplier.select("s_suppkey", F.lit(2).alias("page_no"), F.lit(0).alias("table_no"), F.explode(F.array(*cells)).alias("c")).select("s_suppkey", "page_no", "table_no", "c.*")


_CARDS = (
    (0, "project_name", "第{a}号道路工程", 1), (0, "tender_no", "ZB-2026{a}", 1), (0, "tenderee", "第一建设局", 1), (0, "agency", "诚信咨询公司", 1), (0, "region", "河北省石家庄市长安区", 1), (0, "ceiling_price", "{a}00万元", 1),
    (0, "deadline_bid", "2026-03-0{d} 09:30", 1), (0, "deadline_signup", "2026-01-0{d} 08:00", 1), (0, "project_type", "工程（施工招标）", None),
    (1, "project_name", "第{a}号道路工程", 1), (1, "tender_no", "ZB-2026{a}", 1), (1, "tenderee", "第一建设局", 1), (1, "agency", "诚信咨询公司", 1), (1, "region", "中山路{a}号院", 13), (1, "ceiling_price", "{a}00万元", 1),
    (1, "deadline_bid", ex.MISSING, None), (1, "project_type", "工程（施工招标）", None),
    (2, "project_name", ex.MISSING, None), (2, "tenderee", "石家庄第{a}建设局", 2), (2, "ceiling_price", "{a}0万元", 2), (2, "region", ex.MISSING, None), (2, "deadline_bid", ex.MISSING, None), (2, "project_type", "工程（设计招标）", None),
)
_CARD_ROWS = ", ".join(f"({k}, '{f}', '{v}', {'NULL' if p is None else p})" for k, f, v, p in _CARDS)


@query(f"""SELECT s_suppkey, field, {filled_sql("v", "s_suppkey")} AS value, p::INT AS page_no, v = '{ex.MISSING}' AS missing FROM supplier JOIN (VALUES {_CARD_ROWS}) w(k, field, v, p) ON k = s_suppkey % 3""")
def j3_main_card(t: Tables) -> DataFrame:
    return cards.main_card(_card_pages(t), _card_cells(t), "s_suppkey").select("s_suppkey", "field", "value", "page_no", "missing")


#: Anchor, number of the proposal, quote, the page that it stands on, why it is refused.
PROPOSALS = (
    ("bid_bond", 1, "投标 保证金{a}万元", 2, None), ("bid_bond", 2, "保证金{a}万元", 2, "late"), ("ceiling_price", 1, "最高限价详见附件", 1, "no_value"), ("bid_validity", 1, "工期为{a}天", 1, "topic"),
    ("consortium", 1, "关于联合体的规定", 2, "polarity"), ("consortium", 2, "本项目不接受联合体", 1, None), ("safety_license", 1, "安全生产许可证{a}号", None, "not_verbatim"), ("scoring_pm", 1, "项目经理按职称计分", 1, "no_guard"),
    ("qualification_grade", 1, "资质为二级", 1, "not_missing"), ("pm_registered_builder", 1, "项目经理为\n一级建造师", 2, None), ("similar_performance_hard", 1, "业绩良好", 2, "topic"),
)


def _proposed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, proposals and pages of each supplier."""
    fill = lambda s: filled(s, "s_suppkey")
    on = lambda n: F.concat(F.lit("正文。"), *[F.concat(fill(q.replace(" ", "")), F.lit("。\n")) for _, _, q, p, _ in PROPOSALS if p == n])
    pages = t.supplier.select("s_suppkey", F.posexplode(F.array(on(1), on(2))).alias("n", "text")).select("s_suppkey", (F.col("n") + 1).alias("page_no"), "text")
    keys = list(dict.fromkeys(k for k, *_ in PROPOSALS))
    cand = t.supplier.select("s_suppkey", F.explode(F.array(*[F.lit(k) for k in keys])).alias("anchor_key")).withColumn("missing", F.col("anchor_key") != "qualification_grade")
    cand = cand.withColumns({"assertion": F.when(F.col("missing"), ex.MISSING).otherwise("资质等级"), "page_no": F.when(~F.col("missing"), 1)})
    asked = [F.struct(F.lit(k).alias("anchor_key"), F.lit(n).alias("seq"), fill(q).alias("quote")) for k, n, q, _, _ in PROPOSALS]
    return cand, t.supplier.select("s_suppkey", F.inline(F.array(*asked))), pages


_JUDGED = ", ".join(f"('{k}', {n}, {'NULL' if r in ('not_missing', 'not_verbatim') else p}, {'NULL' if r is None else repr(r)})" for k, n, _, p, r in PROPOSALS)


@query(f"SELECT s_suppkey, anchor_key, seq, page_no::INT AS page_no, reject_reason FROM supplier, (VALUES {_JUDGED}) v(anchor_key, seq, page_no, reject_reason)")
def o8_judged_proposals(t: Tables) -> DataFrame:
    return cards.judged_proposals(*_proposed(t), doc="s_suppkey").select("s_suppkey", "anchor_key", "seq", "page_no", "reject_reason")


@query(f"""WITH v AS (SELECT * FROM (VALUES {_JUDGED}) v(anchor_key, seq, page_no, reason)),
 w AS (SELECT anchor_key, max(page_no) FILTER (reason IS NULL) AS p, string_agg(reason, ',' ORDER BY seq) AS r FROM v GROUP BY 1)
 SELECT s_suppkey, anchor_key, CASE WHEN anchor_key = 'qualification_grade' THEN '资质等级' WHEN anchor_key = 'bid_bond' THEN '投标保证金' || (s_suppkey % 90 + 10) || '万元' WHEN anchor_key = 'consortium' THEN '本项目不接受联合体'
 WHEN anchor_key = 'pm_registered_builder' THEN '项目经理为一级建造师' ELSE '{ex.MISSING}' END AS assertion, CASE WHEN anchor_key = 'qualification_grade' THEN 1 ELSE p END::INT AS page_no,
 p IS NULL AND anchor_key <> 'qualification_grade' AS missing, CASE WHEN p IS NULL AND anchor_key <> 'qualification_grade' THEN r END AS refused FROM supplier, w""")
def o8_replaced_rules(t: Tables) -> DataFrame:
    out = cards.replaced_rules(*_proposed(t), doc="s_suppkey")
    return out.select("s_suppkey", "anchor_key", "assertion", "page_no", "missing", F.array_join("refused", ",").alias("refused"))


#: Clause, type, evidence kind, branch.
SUBMISSIONS = (
    ("应附技术负责人{a}的职称证、养老保险证明扫描件", "hard", "", "package"), ("须交投标保证金{a}万元", "hard", "", "bond"), ("须交第{a}号凭证", "hard", "bid_bond", "bond"), ("信用记录由评委查询，第{a}条", "hard", "", "credit"),
    ("附项目业主同意更换第{a}号证明", "hard", "", "replacement"), ("企业主要负责人具有安全生产考核合格证书{a}", "hard", "", "principals"), ("项目经理具有安全生产考核合格证书{a}", "hard", "", "manager_b"),
    ("持有安全生产考核合格证书{a}", "hard", "manager_profile", "manager_b"), ("由建设行政主管部门核发的证书{a}", "hard", "", "grade"), ("法定代表人授权书{a}", "hard", "", "mandate"), ("营业执照{a}", "hard", "", "business_license"),
    ("具备安全生产许可证{a}", "hard", "", "safety_license"), ("专职安全生产管理人员配备{d}名", "hard", "", "safety_officer"), ("项目经理为注册建造师{a}", "hard", "", "manager"), ("到场{a}", "action_requirement", "", "action"), ("其他{a}", "hard", "", "other"),
)
_SUBMITTED = ", ".join(f"('{b}', {str(r).lower()}, '{s}', {'NULL' if m is None else repr(m)})" for b, (r, s, m) in subs.MATERIALS.items())


@query(f"SELECT p_partkey, branch, required, CASE WHEN branch = 'action' AND p_partkey % 3 = 0 THEN '开标' ELSE stage END AS stage, materials FROM ({cases_sql('part', 'p_partkey', [(b,) for *_, b in SUBMISSIONS], ('branch',))}) c JOIN (VALUES {_SUBMITTED}) m(branch, required, stage, materials) USING (branch)")
def o11_submission_metadata(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda i: F.get(F.array(*[F.lit(x[i]) for x in SUBMISSIONS]), (k % len(SUBMISSIONS)).cast("int"))
    rows = cases(t.part, "p_partkey", [x[0] for x in SUBMISSIONS])
    return rows.select("p_partkey", subs.submission_metadata(F.col("raw"), pick(1), F.array(pick(2)), F.when(k % 3 == 0, "开标")).alias("s")).select("p_partkey", "s.*")
