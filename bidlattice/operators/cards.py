"""The main card of a tender document from its pages and table cells, and the guard of rules that are proposed for missing
ones. Joins, windows and aggregates; a document's pages meet its own proposals only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from .extraction import MISSING

# --- fixed values -------------------------------------------------------------------------------------------------
_CHINESE = "一-鿿"
_CLOCK = r"(\d{4})年(\d{1,2})月(\d{1,2})日(\d{1,2})[时:：](\d{2})分?"
#: Fields of the card by patterns on text without white space: the first group that took part is the value.
CARD = {
    "project_name": rf"(?:第[一二三四五六七八九十]+章)?(?:招标公告)?([{_CHINESE}（）()]{{4,80}}?建设项目施工)(?:招标公告|施工招标)?|项目名称[：:]([{_CHINESE}0-9（）()、]{{4,120}}?)(?=\d\.\d|。|；|招标公告|$)|([{_CHINESE}（）()0-9]{{4,60}}?(?:工程|项目))已由",
    "tender_no": r"(?:招标|项目)编号[：:]?([A-Z0-9\-]{6,40})", "tenderee": rf"(?:招标人|建设单位)为?[：:]?([{_CHINESE}（）()]{{2,40}}?)[，,。；]",
    "agency": rf"(?:委托)?代理机构为?[：:]?([{_CHINESE}（）()]{{2,40}}?)[。，,；]",
    "region": rf"(?:建设地点|工程地点)[：:]?(?!见|详见)(?:((?:[{_CHINESE}]{{2,3}}省)?[{_CHINESE}]{{2,3}}?市[{_CHINESE}]{{2,10}}?[区县])|([{_CHINESE}A-Za-z0-9（）()、，,．.\-—/／]{{2,80}}?)(?=。|；|;|\d\.\d))",
    "ceiling_price": r"最高投标限价([0-9，,.]+万?元)", "budget_amount": r"总投资([0-9，,.]+万?元)", "bid_bond_amount": r"金额[：:]?人民币[：:]?([0-9，,.]+万?元)",
}
CLOCKS = {"deadline_signup": f"请于{_CLOCK}", "deadline_bid": f"投标(?:文件)?(?:递交)?(?:的)?截止时间.{{0,30}}?{_CLOCK}", "open_date": f"开标时间[：:]?{_CLOCK}"}
#: Labels of table cells whose value stands in a cell to the right, tried where no page says it.
CELL_LABELS = {
    "region": ("建设地点", "工程地点"), "tenderee": ("招标人", "建设单位", "采购人"), "agency": ("招标代理机构", "采购代理机构", "代理机构"),
    "ceiling_price": ("最高投标限价", "招标控制价", "最高限价", "拦标价"), "budget_amount": ("总投资", "投资总额", "预算金额", "采购预算"),
}
REQUIRED = ("deadline_bid", "project_name", "project_type", "region", "tenderee")
#: Pages of the notice; a region may stand beyond them. Pages whose text tells the type, and as many where they don't.
NOTICE_PAGES, COVER_PAGES, MORE_COVER_PAGES = 12, 2, 6
#: For each anchor the groups of words of which a proposal must hold one each.
GUARDS = {
    "qualification_grade": (("资质",),), "safety_license": (("安全生产许可证",),), "pm_registered_builder": (("项目经理", "项目负责人"), ("建造师",)),
    "pm_b_cert": (("安全生产考核合格证", "B类", "B证", "安全考核合格证"),), "pm_no_active": (("项目经理",), ("在施", "在建", "在岗", "其他项目")),
    "pm_social_security": (("社保", "社会保险", "养老保险", "社会保障"),), "safety_officer": (("安全生产管理人员", "安全员", "安全管理人员"),),
    "tech_team": (("技术人员", "技术负责人", "专业人员", "技术团队"),), "financial_audit": (("审计报告", "财务报告", "财务审计", "财务状况", "审计"),), "credit_no_loser": (("失信",),),
    "consortium": (("联合体",),), "bid_validity": (("投标有效期",),), "bid_bond": (("保证金",),), "ceiling_price": (("限价", "控制价", "拦标价"),),
    "scoring_tech": (("技术标", "技术部分", "技术评审", "暗标"),), "scoring_similar_performance": (("业绩",),), "similar_performance_hard": (("业绩",), ("项", "万元", "平方米", "公里", "年", "以来")),
}
_NUMBER = r"[0-9][0-9，,]*(?:\.[0-9]+)?"
#: What some proposals must state.
TYPED = {"bid_validity": rf"{_NUMBER}(?:日历天|个月|个工作日|工作日|天|日|年|周)", "bid_bond": rf"{_NUMBER}(?:万元|亿元|万|元)", "ceiling_price": rf"{_NUMBER}(?:万元|亿元|万|元)"}
#: Proposals that must say yes or no.
POLAR = {"consortium": classify.POLARITY_FIELDS["consortium"]}
# ------------------------------------------------------------------------------------------------------------------


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def _groups(body: str, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(body, pattern, g), F.lit("")) for g in range(1, n + 1)]


def _text_hits(pages: DataFrame) -> DataFrame:
    """(doc, field, page, value, assertion): the first hit of each field on each page."""
    hits = []
    for field, pattern in CARD.items():
        n = {"project_name": 3, "region": 2}.get(field, 1)
        hits.append(F.struct(F.lit(field).alias("field"), F.coalesce(*_groups("bare", pattern, n)).alias("value"), F.regexp_extract("bare", pattern, 0).alias("assertion")))
    for field, pattern in CLOCKS.items():
        y, mo, d, h, mi = _groups("bare", f"(?s){pattern}", 5)
        two = lambda c: F.lpad(c, 2, "0")
        value = F.concat(y, F.lit("-"), two(mo), F.lit("-"), two(d), F.lit(" "), two(h), F.lit(":"), mi)
        hits.append(F.struct(F.lit(field).alias("field"), value.alias("value"), F.regexp_extract("bare", f"(?s){pattern}", 0).alias("assertion")))
    rows = pages.select("doc", "page", F.explode(F.filter(F.array(*hits), lambda h: h["value"].isNotNull())).alias("h")).select("doc", "page", "h.*")
    return rows.where((F.col("page") <= NOTICE_PAGES) | (F.col("field") == "region"))


def _cell_hits(cells: DataFrame) -> DataFrame:
    """(doc, field, page, value, assertion) of cells with a label and the next filled cell of their row.

    A label is a cell that is the label but for a clause number, or holds it and is at most 12 characters longer.
    """
    row = W.partitionBy("doc", "page", "table_no", "row_no").orderBy("col_no").rowsBetween(1, W.unboundedFollowing)
    there = F.when(F.trim("cell") != "", F.trim("cell"))
    near = cells.withColumn("right", F.first(there, ignorenulls=True).over(row)).where(there.isNotNull() & F.col("right").isNotNull())
    bare = squeezed(F.col("cell"))
    own = F.regexp_replace(bare, r"^[0-9]{1,2}(?:\.[0-9]{1,3}){0,3}[）)、.．]?", "")
    said = squeezed(F.col("right"))
    party = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "^(?:名称|单位名称)[：:]?", ""), "(?:地址|联系人|联系电话|电话|邮箱|传真)[：:].*$", ""), "^[；;，,。]+|[；;，,。]+$", "")
    place = F.regexp_replace(said, "[。；;，,]+$", "")
    amount = F.nullif(F.regexp_extract(said, r"([0-9][0-9，,.]{0,14}万?元)", 1), F.lit(""))
    shapes = {"tenderee": F.when(F.length(party) >= 4, party), "agency": F.when(F.length(party) >= 4, party), "ceiling_price": amount, "budget_amount": amount, "region": F.when((F.length(place) >= 2) & ~place.rlike("^(见|详见)"), place)}
    hits = []
    for field, labels in CELL_LABELS.items():
        fits = reduce(lambda a, b: a | b, [(own == x) | (bare.contains(x) & (F.length(own) <= len(x) + 12)) for x in labels])
        hits.append(F.when(fits, F.struct(F.lit(field).alias("field"), shapes[field].alias("value"))))
    rows = near.select("doc", "page", "table_no", "row_no", "col_no", "cell", "right", F.explode(F.array_compact(F.array(*hits))).alias("h")).where("h.value is not null")
    return rows.select("doc", "page", "h.field", "h.value", F.concat(F.trim("cell"), F.lit("："), F.col("right")).alias("assertion"), F.struct("table_no", "row_no", "col_no").alias("place"))


def _types(pages: DataFrame) -> DataFrame:
    """(doc, value): the project type that the cover says, else the pages behind it."""
    upto = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page") <= n, F.struct("page", "body")))), lambda x: x["body"]), " ")
    covers = pages.where(F.col("page") <= MORE_COVER_PAGES).groupBy("doc").agg(upto(COVER_PAGES).alias("cover"), upto(MORE_COVER_PAGES).alias("more"))
    return covers.select("doc", F.coalesce(classify.project_type(F.col("cover")), classify.project_type(F.col("more"))).alias("value")).where("value is not null")


def main_card(pages: DataFrame, cells: DataFrame | None = None, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """(doc, field, value, page, assertion, missing): what pages say, else what table cells say, and a row with the
    missing mark for each required field that neither does.

    A field's first page counts; the region may also stand behind the notice, and a reference (见, 详见) is none. Values over
    200 characters are cut with …. cells (doc, page_no, table_no, row_no, col_no, cell) may be left out. Documents are those
    of pages; repeated pages say the same twice.
    """
    p = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.coalesce(body, F.lit("")).alias("body")).withColumn("bare", squeezed(F.col("body")))
    said = _text_hits(p).select("doc", "field", F.struct((F.col("page") > NOTICE_PAGES).alias("far"), "page", "value", "assertion").alias("f"))
    best = said.groupBy("doc", "field").agg(F.min("f").alias("f")).select("doc", "field", "f.page", "f.value", "f.assertion")
    if cells is not None:
        c = cells.select(F.col(doc).alias("doc"), F.col(page).alias("page"), "table_no", "row_no", "col_no", "cell")
        from_cells = _cell_hits(c).groupBy("doc", "field").agg(F.min(F.struct("page", "place", "value", "assertion")).alias("f")).select("doc", "field", "f.page", "f.value", "f.assertion")
        best = best.unionByName(from_cells.join(best.select("doc", "field"), ["doc", "field"], "left_anti"))
    typed = _types(p).select("doc", F.lit("project_type").alias("field"), F.lit(None).cast(dict(p.dtypes)["page"]).alias("page"), "value", F.lit("").alias("assertion"))
    best = best.unionByName(typed)
    wanted = p.select("doc").distinct().select("doc", F.explode(F.array(*[F.lit(x) for x in REQUIRED])).alias("field"))
    gone = wanted.join(best.select("doc", "field"), ["doc", "field"], "left_anti")
    short = F.when(F.length("value") > 200, F.concat(F.left("value", F.lit(200)), F.lit("…"))).otherwise(F.col("value"))
    found = best.select("doc", "field", short.alias("value"), "page", F.left("assertion", F.lit(200)).alias("assertion"), F.lit(False).alias("missing"))
    none = gone.select("doc", "field", F.lit(MISSING).alias("value"), F.lit(None).cast(dict(p.dtypes)["page"]).alias("page"), F.lit("").alias("assertion"), F.lit(True).alias("missing"))
    return found.unionByName(none).withColumnRenamed("doc", doc).withColumnRenamed("page", page)


def guard_reason(anchor: Column, quote: Column) -> Column:
    """Why a quote without white space can't stand for an anchor: no_guard, topic, no_value or polarity; null if it can."""
    any_of = lambda words: reduce(lambda a, b: a | b, [quote.contains(w) for w in words])
    out = F.lit("no_guard")
    for key, groups in GUARDS.items():
        why = F.when(~reduce(lambda a, b: a & b, [any_of(g) for g in groups]), "topic")
        if key in TYPED:
            why = why.when(~quote.rlike(TYPED[key]), "no_value")
        if key in POLAR:
            why = why.when(classify.polarity(quote, *POLAR[key]).isNull(), "polarity")
        out = F.when(anchor == key, why).otherwise(out)
    return out


def judged_proposals(candidates: DataFrame, proposals: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """Proposals (doc, anchor_key, seq, quote) with the first page that holds the quote and the reason of a refusal:
    not_missing (no missing candidate of the anchor), not_verbatim (on no page, white space aside), then guard_reason.

    The first proposal of an anchor by seq that nothing speaks against is accepted; later ones are `late`.
    """
    keys = [doc, "anchor_key", "seq"]
    asked = candidates.where("missing").select(doc, "anchor_key").distinct().withColumn("asked", F.lit(True))
    p = proposals.select(*keys, "quote", squeezed(F.col("quote")).alias("bare")).join(asked, [doc, "anchor_key"], "left")
    texts = pages.select(doc, page, squeezed(F.col(body)).alias("text_"))
    place = p.where("asked and bare <> ''").join(texts.hint("merge"), doc).where(F.col("text_").contains(F.col("bare"))).groupBy(*keys, "bare").agg(F.min(page).alias(page))
    reason = F.when(F.col("asked").isNull(), "not_missing").when(F.col(page).isNull(), "not_verbatim").otherwise(guard_reason(F.col("anchor_key"), F.col("bare")))
    judged = p.join(place, [*keys, "bare"], "left").withColumn("reject_reason", reason)
    first = F.min(F.when(F.col("reject_reason").isNull(), F.col("seq"))).over(W.partitionBy(doc, "anchor_key"))
    late = F.when(F.col("reject_reason").isNull() & (F.col("seq") > first), "late").otherwise(F.col("reject_reason"))
    return judged.withColumn("reject_reason", late).select(*keys, "quote", "bare", page, "reject_reason")


def replaced_rules(candidates: DataFrame, proposals: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """Candidates whose missing ones take their accepted proposal (assertion of 300 characters at most, page, located_by
    `proposal`); those that stay missing name the reasons of their refused proposals in order."""
    judged = judged_proposals(candidates, proposals, pages, doc, page, body)
    taken = judged.where("reject_reason is null").select(doc, "anchor_key", F.left("bare", F.lit(300)).alias("new"), F.col(page).alias("new_page"))
    refused = judged.where("reject_reason is not null").groupBy(doc, "anchor_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reject_reason"))), lambda x: x["reject_reason"]).alias("reasons"))
    j = candidates.join(taken, [doc, "anchor_key"], "left").join(refused, [doc, "anchor_key"], "left")
    take = F.col("missing") & F.col("new").isNotNull()
    return j.select(
        doc, "anchor_key", F.when(take, F.col("new")).otherwise(F.col("assertion")).alias("assertion"), F.when(take, F.col("new_page")).otherwise(F.col(page)).alias(page),
        (F.col("missing") & ~take).alias("missing"), F.when(take, "proposal").alias("located_by"), F.when(F.col("missing") & ~take, F.col("reasons")).alias("refused"),
    )
