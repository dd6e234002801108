"""Ordered rules that put titles, dates and records into classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_keyword

#: Title patterns of announcement types, in the order of their precedence; a title that fits none is a tender.
TITLE_TYPES = (
    ("other", r"(?i)(暂行|办法|条例|实施办法|实施细则|征求意见|备案|令\s*\d*号|\d+\s*号令|号令|\d+\s*号|规费结?算|招标人须知|资格标准)"),
    ("win", r"(中标结果|中标候选人|候选中标|候选人公示|中标公示|成交结果|成交候选人|成交公示|成交公告|成交供应商|中标供应商|中标通知书|采购结果|采购成交|采购结果公示|中选结果|中选候选人|中选公告|定标结果|评标结果|评标公示|招标结果|中标公告|结果公告|结果公示|中标侯选|资格后审结果)"),
    ("procure", r"(?i)(采购公告|竞争性磋商|竞争性谈判|磋商|谈判|比选|竞价|单e渠道|单一来源|询价|询比|邀请招标|框架协议)"),
    ("prequal", r"(资格预审|资审)"),
    ("change", r"(变更公告|更正|澄清|答疑|更正通知|延期|补充公告|补遗)"),
    ("lease", r"(招租|竞租|出租|房屋租赁|场地租赁|店面租赁|车位租赁|商铺出租|摊位出租|门市出租|资产处置|资产转让|资产出租|产权交易|产权转让|挂牌出让|国有产权)"),
)
TYPE_PRIORITY = {"tender": 0, "prequal": 1, "change": 2, "procure": 3, "win": 4, "lease": 5, "other": 6}
#: Fixed values, as the results need them: stage and lot words that a project key leaves out.
STAGE_WORDS = "(中标结果公告|中标候选人公示|资格预审公告|资格预审|中标候选人|招标公告|采购公告|中标公告|候选人公示|成交公告|结果公告|磋商公告|询价公告|资格预审资格预审)"
LOT_WORDS = r"[一二三四五六七八九十百\d]{1,5}[—\-]?[一二三四五六七八九十百\d]*标段|段号|标段|[A-Za-z]{1,10}[-—·]?\d{1,4}"


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """The name of the first rule whose pattern the column fits."""
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(default)


def title_type(c: Column) -> Column:
    """Announcement type by title; other where it is empty."""
    title = normalise_keyword(c)
    return F.when(title == "", "other").otherwise(first_match(title, TITLE_TYPES, F.lit("tender")))


def project_key(c: Column) -> Column:
    """A title without stage and lot words, so that all stages and lots of a project share a key."""
    return normalise_keyword(F.regexp_replace(F.regexp_replace(normalise_keyword(c), STAGE_WORDS, ""), LOT_WORDS, ""))


def screen(title: Column, kind: Column, excluded: Sequence[str], industry: Sequence[str], fields: Mapping[str, Column]) -> Column:
    """struct(state, hits, missing) of a candidate: its type, then words that exclude, then words of the trade."""
    words = lambda ws: F.filter(F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>"), lambda w: title.contains(w))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(v.cast("string"), F.lit("")) == "", k) for k, v in fields.items()])) if fields else F.array().cast("array<string>")
    out, trade = words(excluded), words(industry)
    state = (
        F.when(kind != "tender", "excluded_type").when(F.size(out) > 0, "excluded_keyword")
        .when(F.size(trade) > 0, "recommended").otherwise("pending")
    )
    return F.struct(state.alias("state"), F.when(F.size(out) > 0, out).otherwise(trade).alias("hits"), missing.alias("missing"))


def urgency(signup: Column, bid: Column, now: Column, urgent_hours: int = 24, high_hours: int = 72) -> Column:
    """struct(urgency, basis, deadline); the sign-up deadline counts first, and one gone by is urgent too."""
    due = F.coalesce(signup, bid)
    left = F.unix_timestamp(due) - F.unix_timestamp(now)
    level = F.when(due.isNull(), "unknown").when(left <= urgent_hours * 3600, "urgent").when(left <= high_hours * 3600, "high").otherwise("normal")
    basis = F.when(signup.isNotNull(), "signup").when(bid.isNotNull(), "bid")
    return F.struct(level.alias("urgency"), basis.alias("basis"), due.alias("deadline"))


def section(kind: Column, level: Column, basis: Column, change: Sequence[str], result: Sequence[str]) -> Column:
    """Display section of an event."""
    holds = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.coalesce(kind, F.lit("")).contains(w))
    return (
        F.when(level.isin("urgent", "high"), F.when(basis == "signup", "urgent").otherwise("deadline"))
        .when(holds(change), "change").when(holds(result), "result").otherwise("new")
    )


def urgency_level(signup: Column, bid: Column, today: Column, working_days: bool = False) -> Column:
    """P0, P1, P2 or REJECT by days to the sign-up deadline, which is the bid deadline less 7 days where missing.

    Days are calendar days; with working_days the first limit counts days from Monday to Friday.
    """
    s = F.coalesce(signup.cast("date"), F.date_sub(bid.cast("date"), 7))
    left = F.datediff(s, today)
    near = left
    if working_days:
        days = F.filter(F.sequence(F.date_add(today, 1), F.greatest(s, F.date_add(today, 1))), lambda d: F.dayofweek(d).between(2, 6))
        near = F.when(left <= 0, left).otherwise(F.size(days))
    return (
        F.when(s.isNull(), "P2").when(today > s, "REJECT").when(bid.isNotNull() & (today > bid.cast("date")), "REJECT")
        .when(near <= 3, "P0").when(left <= 7, "P1").otherwise("P2")
    )


def priority_level(platform: Column, url: Column, levels: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """The first level one of whose keywords the source's name or address holds."""
    hay = F.lower(F.concat_ws(" ", platform, url))
    out = F.lit(default)
    for name, words in reversed(list(levels)):
        out = F.when(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: hay.contains(w)), name).otherwise(out)
    return out


def polarity(text: Column, subject: str, allowed: str, refused: str) -> Column:
    """Allowed or refused as the text says of the subject: a ticked form first, then a plain clause; null if undecided."""
    tick = F.regexp_extract(text, rf"{subject}[^。；\n]{{0,40}}?[☑√■]\s*({allowed}|{refused})", 1)
    plain = F.regexp_extract(text, rf"({refused}|{allowed})[^。；\n]{{0,6}}{subject}", 1)
    said = F.coalesce(F.nullif(tick, F.lit("")), F.nullif(plain, F.lit("")))
    return F.when(said.rlike(f"^({refused})$"), "refused").when(said.rlike(f"^({allowed})$"), "allowed")


#: Polarity fields with the words of their subject, of leave and of refusal.
POLARITY_FIELDS = {
    "consortium": ("联合体", "接受|允许", "不接受|不允许|拒绝"),
    "subcontract": ("分包", "允许|接受", "不允许|不接受|禁止"),
    "import": ("进口产品", "接受|允许", "不接受|不允许|拒绝"),
    "sme_only": ("面向中小企业", "专门|专项", "非专门|不专门"),
}


def source_score(official: Column, complete: Column, fresh: Column, stable: Column, legal: Column) -> Column:
    """struct(score, grade) from five shares in 0..1 weighted 25, 25, 25, 15 and 10, cut at 80 and 60."""
    total = F.round(25 * official + 25 * complete + 25 * fresh + 15 * stable + 10 * legal, 2)
    return F.struct(total.alias("score"), F.when(total >= 80, "A").when(total >= 60, "B").when(total.isNotNull(), "C").alias("grade"))

#: Kinds of work by words in a title, in the order of their precedence.
TITLE_WORKS = (
    ("EPC总承包", "EPC|工程总承包|设计施工总承包|设计采购施工"), ("施工", "施工"), ("监理", "监理"), ("勘察", "勘察"), ("设计", "设计"), ("货物", "货物"), ("服务", "服务"),
)
#: Project types by words of a title or cover, in the order of their precedence.
PROJECT_TYPES = (
    ("工程（总承包招标）", "工程总承包|施工总承包|总承包|EPC"), ("工程（设计招标）", "施工图设计"), ("工程（施工招标）", "施工"), ("工程（监理招标）", "监理"), ("工程（设计招标）", "设计"), ("工程（勘察招标）", "勘察"),
    ("货物（采购）", "(?=.*(采购|询比|磋商|谈判)).*(货物|设备)"), ("服务（采购）", "(?=.*(采购|询比|磋商|谈判)).*服务"),
)
#: Categories of quotes found beside the anchors; what a clause does comes before whom it is about.
QUOTE_CATEGORIES = (
    ("评分", "得分|评分|加分|分值|满分|评标|(?:得|加|计)[0-9]{1,3}(?:\\.[0-9])?分"), ("动作", "截止|递交|开标|报名|保证金|踏勘|答疑|质疑|有效期|中标通知书|订立合同"),
    ("资质", "资质要求|施工资质|总承包资质|专业承包|资质等级|工程设计资质|安全生产许可证|营业执照|资格证书|资格条件|资格预审|资格后审"),
    ("人员", "项目经理|建造师|技术负责人|设计负责人|施工负责人|项目负责人|安全生产管理人员|专职安全|安全员|技术人员|执业资格|安全生产考核|职称|社保|社会保险|养老保险|劳动合同"),
    ("业绩", "业绩|类似工程|类似项目|竣工验收"), ("财务", "财务|审计|纳税|税收|资产负债|会计报表"), ("信用", "失信|违法|信用|利害关系|投标禁止期|黑名单|信誉"),
)
#: Kinds of tasks by words of an action, in the order of their precedence.
TASK_KINDS = (
    ("registration", "报名|文件获取|获取招标文件"), ("ca_cert", "(?i)CA|数字证书"), ("bond", "保证金|保函"), ("site_visit", "踏勘|现场"), ("opening", "开标"), ("submission", "递交|投标文件"), ("preparation", "编制"),
)
#: What is to be done after a result, and the role that does it.
NEXT_ACTIONS = {
    "satisfied": "none", "not_satisfied": "terminate_or_correct", "unverifiable": "create_or_merge_evidence_task", "manual_review": "assign_reviewer", "not_calculable": "supply_scoring_input",
    "not_applicable": "none", "not_started": "complete_operation_task",
}


def title_works(c: Column) -> Column:
    """The kind of work that a title names; null where it names none."""
    return first_match(c, TITLE_WORKS, F.lit(None).cast("string"))


def project_type(c: Column) -> Column:
    """Project type with its way of award; null where it can't be told."""
    return first_match(F.coalesce(c, F.lit("")), PROJECT_TYPES, F.lit(None).cast("string"))


def quote_category(c: Column) -> Column:
    """The first category with a strong word in the quote; null drops it."""
    return first_match(c, QUOTE_CATEGORIES, F.lit(None).cast("string"))


def task_kind(*parts: Column) -> Column:
    """The kind of task that an action's category, assertion and clause name."""
    return first_match(F.concat_ws(" ", *parts), TASK_KINDS, F.lit("other"))


def qualification_bucket(c: Column) -> Column:
    """The bucket of a qualification by its ledger category."""
    rules = (("safety_license", "安全生产"), ("credit_rating", "信用"), ("ca_cert", "(?i)CA"), ("quality_system", "(?i)质量|ISO"))
    return first_match(F.coalesce(c, F.lit("")), rules, F.lit("construction_qual"))


def next_action(result: Column) -> Column:
    """What follows a result; an unknown result goes to review, none waits."""
    table = F.create_map(*[F.lit(x) for kv in NEXT_ACTIONS.items() for x in kv])
    return F.when(result.isNull(), "wait").otherwise(F.coalesce(F.try_element_at(table, result), F.lit("assign_reviewer")))


def exception_type(issue: Column, missing: Column, req_type: Column, located_by: Column) -> Column:
    """struct(type, rank) of a candidate that waits for a person; the riskiest has rank 1."""
    put = lambda t, r: F.struct(F.lit(t).alias("type"), F.lit(r).alias("rank"))
    return (
        F.when(issue.contains("冲突"), put("conflict", 1)).when(missing & (req_type == "hard_requirement"), put("hard_anchor_miss", 2))
        .when(located_by == "llm", put("llm_pending", 3)).otherwise(put("probe_miss", 4))
    )


def task_spec(result: Column, bucket: Column, owner: Column, text: Column) -> Column:
    """struct(type, done_when) of the task that a result asks for."""
    put = lambda t, d: F.struct(t.alias("type"), F.lit(d).alias("done_when"))
    review = (
        F.when(owner.isin("resource_manager", "business_head"), F.when(text.contains("身份"), "identity_confirmation").otherwise("resource_confirmation"))
        .when(text.contains("身份"), "identity_confirmation").when(text.rlike("文件|条款"), "document_check").otherwise("rule_review")
    )
    return (
        F.when((bucket == "blocked") | (result == "not_satisfied"), put(F.lit("termination_correction"), "resolved_by_new_match"))
        .when(bucket == "missing", put(F.lit("evidence_supplement"), "verified_evidence_and_new_match")).otherwise(put(review, "resolved_by_new_match"))
    )


def knowledge_layer(owner: Column, kind: Column) -> Column:
    """The layer that a material belongs to."""
    return F.when(owner == "enterprise", "L3_enterprise").when(kind == "tender_document", "L2_tender").otherwise("L1_public")


def is_submission_package(assertion: Column) -> Column:
    """A clause that lists papers of persons to attach, not a requirement on persons."""
    papers = sum(((assertion.contains(w)).cast("int") for w in ("职称证", "养老保险", "注册资格证书")), assertion.contains("身份证").cast("int"))
    attach = assertion.contains("应附") & assertion.rlike("扫描件|原件")
    return F.coalesce(attach & (papers >= 2) & assertion.rlike("项目管理机构|技术负责人|合同商务负责人|岗位人员"), F.lit(False))
