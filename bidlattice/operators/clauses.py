"""Clause boundaries in notices: folded text with its way back to the original, where a clause begins and ends, and the
values and quotes of a table of anchors.

Work is done on folded text, in which white space is one space; an array of offsets leads each of its characters back to
the original, so a quote is always a slice of the original. Pages are read once, by a map over Arrow batches: Spark's own
functions give no places of all matches and have no loop over a continued list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts

# --- fixed values -------------------------------------------------------------------------------------------------
#: Clause numbers: 2.6, 3.1.1, (1), （二）, 一、, and 3. before a Chinese character.
NUMBER = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3})+|[（(][一二三四五六七八九十0-9]{1,3}[)）]|[一二三四五六七八九十]+、|(?<![0-9.])[0-9]{1,2}\.(?=\s*[一-鿿])")
#: A label: two to ten Chinese characters and a colon.
LABEL = re.compile(r"[一-鿿]{2,10}\s*[：:]")
#: Labels that are known without a colon.
LABEL_WORDS = (
    r"[(（]是[/／]?否[)）]\s*接受联合体投标|是否接受联合体投标|是否允许联合体投标|是否专门面向中小企业|是否允许分包|是否接受进口产品|合同履行期限|服务期限|"
    r"项目名称|项目编号|采购需求|采购预算金额|采购预算|采购人|招标人|代理机构|建设地点|建设规模|项目规模|计划工期|资质要求|业绩要求|项目经理资格要求|项目经理|"
    r"质量标准|质量要求|投标截止时间|开标时间|投标保证金|最高投标限价|最高限价|预算金额|联系人|联系方式|地址|电话|投标有效期|履约保证金|履约担保|付款方式|支付方式|"
    r"开标地点|递交地点|评标办法|评标方法|资格审查方式|招标范围|采购内容|建设内容|招标内容|资金来源|合同类型|计价方式|暂列金额|招标文件售价|财务要求|批准文号|项目概况|"
    r"技术标准|技术要求|保修期|质保期|缺陷责任期|预付款|工程预付款|质量保证金|质保金|招标文件获取|文件获取时间|踏勘时间|答疑时间"
)
KNOWN_LABEL = re.compile(rf"(?:{LABEL_WORDS})(?=[：:]|\s|$)")
#: A known label and its short value, parted from what follows by a space.
LABEL_UNIT = re.compile(rf"(?:{LABEL_WORDS})[：:]?[ 　]?[^\s：:，。；]{{1,40}}(?=[ 　]|$)")
#: How far a clause is looked for before and behind a hit, and behind one that may be a list; the lengths of quotes.
BACK, AHEAD, TAIL, LIST, GROUP, QUOTE, LABEL_QUOTE = 100, 240, 300, 380, 400, 220, 260

_AMOUNT = r"(?:[0-9][0-9，,.\s]{0,12}[0-9]?\s*(?:万元|亿元|万|元)(?:整)?|(?:人民币)?[零壹贰叁肆伍陆柒捌玖拾佰仟万亿]{2,14}元(?:整)?)"
_PERCENT = r"[0-9]{1,2}(?:\.[0-9]{1,2})?\s*[%％]"
_DATE = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
_SUM = r"([0-9][0-9，,.\s]{0,10}[0-9]?\s*(?:万元|亿元|万|元)?)"
_POINTS = r"\s*[:：（(]?\s*(?:满分|权重|占|为|共|计)?\s*[:：]?\s*(?:为)?\s*([0-9]{1,3}\s*(?:分|[%％]))"
_METHOD = r"(?:最低投标价法|{}综合评估法|综合评分法|合理低价法|综合评审法|{}最低评标价法|综合评价法{})"
#: What a notice says in the words of the pattern: the first group that took part is the value, else the whole hit.
VALUES = {
    "region": r"建设地点[:：]\s*([一-鿿0-9]{2,40}?(?:[区县镇]|市(?=[^一-鿿0-9]|$)))",
    "budget_amount": rf"(?:总投资|预算金额|采购预算|项目预算)(?:（元）|\(元\))?\s*[:：为]?\s*(?:约)?\s*{_SUM}",
    "ceiling_price": rf"(?:最高投标限价|最高限价|招标控制价)\s*[:：]?\s*(?:为)?\s*{_SUM}",
    "equip_amount": r"设备购置费最高限价(?:为)?\s*[:：]?\s*([0-9][0-9\s，,.]{0,10}[0-9]?\s*万元)",
    "work_amount": r"工程费最高限价(?:为)?\s*[:：]?\s*([0-9][0-9\s，,.]{0,10}[0-9]?\s*万元)",
    "duration": r"(?:计划工期|工期)\s*[:：]?\s*(?:为|约)?\s*([0-9]+\s*(?:日历天|天|个月))",
    "section_count": r"共?计划?划分(?:为)?\s*([一二三四五六七八九十0-9]+)\s*个标段",
    "pm_registered": r"(?:拟派)?项目经理[^；。\n]{0,60}?[一二三壹贰叁特]级(?:及以上)?注册建造师[^；。，\n]{0,16}",
    "pm_b_cert": r"[＋\+☑□＝]?同时(?:具有|取得)[^。；]{0,10}安全生产考核合格证书(?:[（(][A-Z]类?[)）])?",
    "safety_officer": r"安全生产管理人员[^。]{0,70}(?:配备人数|配备)[\s:：]*([0-9一二三四五六七八九十])\s*个(?!人)",
    "credit_ok": r"未(?:被[^。；]{0,60}?)?列入失信被执行人名单",
    "bid_bond": rf"投标保证金(?:金额|数额)?\s*[:：]?\s*(?:为|人民币|金额为|数额为)?\s*[:：]?\s*[¥￥]?\s*({_AMOUNT})",
    "performance_bond": rf"履约(?:保证金|担保|保函)(?:金额|数额|比例)?[^。；]{{0,24}}?(?:为|按|不(?:得)?超过|不(?:得)?高于)?\s*(?:合同(?:总)?(?:价|金额|价款)的?)?\s*({_PERCENT}|{_AMOUNT})",
    "advance_payment": rf"(?:工程|合同)?预付款[^。；]{{0,30}}?({_PERCENT}|{_AMOUNT})",
    "retention_money": rf"(?:质量保证金|质保金|保修金|工程质量保修金)[^。；]{{0,30}}?({_PERCENT}|{_AMOUNT})",
    "bid_validity": r"投标有效期\s*[:：]?\s*(?:为|自[^。；]{0,30}?起)?\s*([0-9]{2,3}\s*(?:日历天|天|日))",
    "warranty": r"(?:工程)?(?:保修期|质保期|质量保修期|缺陷责任期|保修期限)\s*[:：]?\s*(?:为|自[^。；]{0,30}?起)?\s*([0-9]{1,3}\s*(?:个月|年|日历天|天))",
    "provisional_sum": rf"暂列金额\s*[:：]?\s*(?:为)?\s*({_AMOUNT})",
    "downward_rate": rf"下浮率\s*[:：]?\s*(?:为|不(?:得)?低于|不(?:得)?高于|不(?:得)?超过|按)?\s*({_PERCENT})",
    "file_price": r"(?:招标|采购)?文件(?:每套)?(?:售价|工本费|费用)\s*[:：]?\s*(?:为|人民币|每套)?\s*[¥￥]?\s*([0-9][0-9，,.]{0,8}\s*元(?:/套)?)",
    "safety_fee": rf"安全(?:文明)?施工(?:措施)?费[^。；]{{0,30}}?(不(?:得)?(?:参与|作为|列入)?竞争(?:性)?(?:费用|报价)?|{_AMOUNT}|{_PERCENT})",
    "evaluation_method": r"(?:评标|评审|评定|评选|评分)(?:办法|方法|方式)\s*[:：]?\s*(?:本项目)?(?:采用|为|拟采用)?\s*((?:经评审的)?"
    + _METHOD.format("最低价法|", "性价比法|", "|定性评审法?|随机抽取法") + r")|(?:采用|实行|使用)\s*((?:经评审的)?" + _METHOD.format("", "", "") + ")",
    "price_score": rf"(?:价格|报价|投标报价)(?:分|部分|得分|评分|分值){_POINTS}|投标报价\s*[（(]\s*([0-9]{{1,3}}\s*分)\s*[)）]",
    "tech_score": rf"(?:技术|技术标|技术部分|施工组织设计)(?:分|得分|评分|分值){_POINTS}|技术(?:标|部分)?\s*[（(]\s*([0-9]{{1,3}}\s*分)\s*[)）]",
    "business_score": rf"(?:商务|商务标|商务部分|信用)(?:分|得分|评分|分值){_POINTS}|商务(?:标|部分)?\s*[（(]\s*([0-9]{{1,3}}\s*分)\s*[)）]",
    "contract_type": r"(?:合同(?:类型|形式|计价(?:方式|模式)?)|计价(?:方式|模式|形式)|承包方式)\s*[:：]?\s*(?:采用|为|本项目采用|实行)?\s*((?:固定|可调)?(?:总价|单价|成本加酬金)(?:合同|包干|承包)?)|(?:采用|实行)\s*((?:固定|可调)(?:总价|单价)(?:合同|包干))",
    "prequalification": r"资格审查(?:方式|方法)?\s*[:：]?\s*(?:采用|为)?\s*(资格后审|资格预审|后审|预审)|(?:采用|实行)\s*(资格后审|资格预审)",
    "safety_license": r"(?:有效的|有效期内的|合法有效的)?(?:企业)?安全生产许可证(?![书])",
    "similar_performance": r"(?:近|自)\s*[0-9一二三四五]\s*年(?:内|以来|至今)?[^。；]{0,60}?(?:完成|承建|承担|竣工)[^。；]{0,60}?类似[^。；，]{0,40}?(?:[一-鿿]{0,8}?业绩|工程|项目|经验)",
    "no_violation": r"(?:近|前|参加[^。；]{0,12}?活动前)\s*[0-9一二三]\s*年(?:内)?[^。；]{0,30}?(?:无|没有)(?:重大)?(?:违法|违规|违约)(?:记录|行为)?",
    "credit_blacklist": r"重大税收违法(?:失信)?(?:案件)?(?:当事人|主体)?名单|政府采购严重违法失信行为(?:记录)?名单|(?:建筑市场监管公共服务平台|信用中国)[^。；]{0,24}?(?:黑名单|失信|不良)",
    "tech_lead": r"技术负责人[^；。\n]{0,60}?(?:高级|中级|初级)?(?:工程师|职称|技术职务)[^；。，\n]{0,24}",
    "pm_similar": r"项目经理[^；。\n]{0,40}?(?:担任|主持|负责|完成)[^；。\n]{0,40}?类似[^；。，\n]{0,30}?(?:[一-鿿]{0,8}?业绩|工程|项目)",
    "social_security": r"(?:连续|近|最近)\s*[0-9一二三六十二]{1,2}\s*个月[^。；]{0,30}?(?:社保|社会保险|养老保险|社会保障)[^。；，]{0,24}",
}
#: Labels whose value is the clause behind them.
LABELS = {
    "quality": r"(?<!设计)质量(?:标准|要求)\s*[:：]",
    "qualification": r"资质要求\s*[:：]|(?:具备|具有|须具有)[^。；\n]{0,80}(?:施工总承包|专业承包|专项设计|工程设计综合|不分等级)[^。；\n]{0,200}?资质",
    "performance": r"业绩要求\s*[:：]", "scale": r"(?:建设规模|项目规模)\s*[:：]", "purchaser": r"(?:采购人|招标人)\s*(?:名称)?\s*[:：]",
    "financial": r"(?:财务(?:状况|要求|能力)|资金要求)\s*[:：]",
    "payment_terms": r"(?:付款(?:方式|条件)|支付(?:方式|条件)|工程款支付(?:方式)?|资金支付(?:方式)?|进度款支付(?:方式)?)\s*[:：]",
    "tech_standard": r"(?:技术(?:标准|要求|规范)(?:和要求|及要求)?|主要技术(?:参数|指标|要求)|执行标准)\s*[:：]",
    "scope_content": r"(?:招标范围|采购内容|建设内容|工程内容|服务内容|采购范围|招标内容|项目概况(?:及招标范围)?)\s*[:：]",
    "open_location": r"开标地点\s*[:：]", "bid_location": r"(?:投标文件)?(?:递交|提交|送达)(?:地点|地址)\s*[:：]", "agency": r"(?:招标)?代理机构\s*(?:名称)?\s*[:：]",
    "funding_source": r"(?:资金来源|资金性质|资金来源及落实情况)\s*[:：]", "approval_doc": r"(?:批准文号|批复文号|审批文号|项目批准文号)\s*[:：]",
}
#: Times; a second group is the end of a window.
TIMES = {
    "deadline_signup": rf"请于\s*({_DATE})(?:\s*\d{{1,2}}[:：时]\d{{2}}分?)?\s*(?:至|于)\s*({_DATE})",
    "deadline_bid": rf"投标(?:文件)?(?:递交)?(?:的)?截止时间[^。；]{{0,30}}?({_DATE})", "open_date": rf"开标时间\s*[:：]?\s*({_DATE})",
    "doc_deadline": rf"(?:招标|采购|资格预审)文件(?:的)?(?:获取|发售|领取|下载|出售|购买)(?:时间|期限|截止时间)?[^。；]{{0,30}}?(?:至|到|止于)\s*({_DATE})",
    "q_deadline": rf"(?:质疑|答疑|澄清|异议)(?:截止)?(?:时间|期限|日期)[^。；]{{0,25}}?({_DATE})", "site_visit": rf"(?:现场踏勘|踏勘现场|踏勘)(?:时间)?\s*[:：]?[^。；]{{0,20}}?({_DATE})",
}
#: Labels whose value may be a numbered list, and fields that get a row when they are nowhere.
LISTED = ("qualification", "performance")
REQUIRED = ("region", "budget_amount", "ceiling_price", "quality", "qualification", "duration", "deadline_bid")
# ------------------------------------------------------------------------------------------------------------------

_STOP = re.compile("[。；;]")
_BEFORE = re.compile(r"[。；;\n]|(?<![0-9])[：:]|[：:](?![0-9])")  # a colon between digits is a time of day
_BLANK = " 　\n\r\t"
_TAIL_MARKS = "。；;，, "


class Folded(NamedTuple):
    """Text with white space folded, and the place of each of its characters in the original."""

    text: str
    offsets: list[int]

    def slice(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original for a span of the text that is not empty."""
        return self.offsets[start], self.offsets[end - 1] + 1


def fold(raw: str) -> Folded:
    words, offsets = [], []
    for m in re.finditer(r"\S+", raw):
        if words:
            offsets.append(last)
        words.append(m[0])
        offsets.extend(range(m.start(), m.end()))
        last = m.end()  # where the white space behind begins
    return Folded(" ".join(words), offsets)


def next_start(text: str, at: int, upto: int, *forms: re.Pattern) -> int | None:
    """The nearest place beyond `at` where the first hit of one of the forms begins."""
    hits = (f.search(text, at, upto) for f in forms)
    return min((m.start() for m in hits if m and m.start() > at), default=None)


def clause_start(text: str, at: int) -> int:
    """Behind the last sentence mark, label colon or short labelled value before `at`; else as far back as is looked."""
    low = max(0, at - BACK)
    marks = [m.start() for m in _BEFORE.finditer(text, low, at + 1) if m.start() < at]  # what follows a colon counts
    units = [m.end() for m in LABEL_UNIT.finditer(text, low, at) if m.end() < at]
    return max((*marks, *units), default=low - 1) + 1


def clause_end(text: str, at: int, ahead: int = AHEAD) -> int:
    """Behind the next sentence mark, or before the next number or label; else as far as is looked."""
    stop = _STOP.search(text, at, at + ahead)
    places = (stop.end() if stop else None, next_start(text, at, at + ahead, NUMBER), next_start(text, at, at + ahead, LABEL, KNOWN_LABEL))
    return min((p for p in places if p is not None), default=at + ahead)


def number_shape(number: str) -> str:
    return "bracket" if number[0] in "(（" else "chinese" if number[-1] == "、" else "dotted"


def _past_blanks(text: str, at: int, upto: int) -> int:
    while at < upto and text[at] in _BLANK:
        at += 1
    return at


def list_end(text: str, at: int, shape: str | None, ahead: int = GROUP) -> int:
    """End of a clause that may hold parts: it goes on behind a ； and behind a number of the same shape (a bracketed one
    behind the ； of an unnumbered clause), and ends before a label or number inside a part, behind 。, and behind a mark
    that another label or number follows."""
    upto = min(len(text), at + ahead)
    while at < upto:
        stop = _STOP.search(text, at, upto)
        end = stop.start() if stop else upto
        inside = next_start(text, at, end, LABEL, KNOWN_LABEL)
        inside = next_start(text, at, end, NUMBER) if inside is None else inside
        if inside is not None:
            return inside
        begin = _past_blanks(text, stop.end(), upto) if stop else upto
        if begin >= upto:
            return stop.end() if stop else upto
        number = NUMBER.match(text, begin)
        behind = _past_blanks(text, number.end() if number else begin, upto)
        labelled = any(f.match(text, behind) for f in (LABEL, KNOWN_LABEL))
        if number:
            kind = number_shape(number[0])
            goes_on = not labelled and (kind == shape or (shape is None and kind == "bracket" and stop[0] != "。"))
        else:
            goes_on = not labelled and stop[0] != "。"
        if not goes_on:
            return stop.end()
        at = number.end() if number else begin
    return upto


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
    end -= len(text[start:end]) - len(text[start:end].rstrip(_BLANK))
    return min(end, _past_blanks(text, start, end)), end


def clause_around(text: str, m: re.Match, longest: int = QUOTE, end: int | None = None) -> tuple[int, int, bool]:
    """The span of the clause that a hit stands in, and whether it was cut to the longest length."""
    start, end = _trimmed(text, clause_start(text, m.start()), clause_end(text, m.end()) if end is None else end)
    return (start, end, False) if end - start <= longest else (*_trimmed(text, start, start + longest), True)


def _said(text: str, start: int, end: int, most: int) -> str:
    return re.sub(r"\s+", " ", text[start:end].rstrip(_TAIL_MARKS)).strip()[:most]


def labelled_value(text: str, m: re.Match, listed: bool = False) -> tuple[str, int | None]:
    """The value behind a label and, where it may be a numbered list, its end."""
    if not listed:
        return _said(text, m.end(), clause_end(text, m.end(), TAIL), TAIL), None
    begin = _past_blanks(text, m.end(), len(text))
    number = NUMBER.match(text, begin)
    end = list_end(text, number.end() if number else begin, number_shape(number[0]) if number else None, LIST)
    return _said(text, begin, end, LIST), end


class Hit(NamedTuple):
    field: str
    value: str | None
    start: int
    end: int
    truncated: bool


def notice_hits(text: str, values: Mapping[str, re.Pattern], labels: Mapping[str, re.Pattern], times: Mapping[str, re.Pattern]) -> Iterator[Hit]:
    """The first hit of each anchor in folded text, with the span of its clause there."""
    for key, form in values.items():
        if m := form.search(text):
            taken = next((g for g in m.groups() if g), m[0]).strip()
            yield Hit(key, taken or None, *clause_around(text, m))
    for key, form in labels.items():
        if m := form.search(text):
            if key == "qualification" and "资质要求" not in m[0]:  # no label: the phrase itself is the value
                end = list_end(text, m.end(), None)
                value = _said(text, m.start(), end, GROUP)
            else:
                value, end = labelled_value(text, m, key in LISTED)
            yield Hit(key, value or None, *clause_around(text, m, LABEL_QUOTE, end))
    for key, form in times.items():
        if m := form.search(text):
            yield Hit(key, "至".join(re.sub(r"\s+", "", g) for g in m.groups() if g), *clause_around(text, m))


def _prescreen(forms: Sequence[Mapping[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [{k: re.compile(v) for k, v in f.items()} for f in forms]
        for batch in texts.slices(batches, "body"):
            rows: list[tuple] = []
            ids = []
            for i, raw in enumerate(batch.column("body").to_pylist()):
                folded = fold(raw or "")
                found = set()
                for h in notice_hits(folded.text, *compiled) if folded.text else ():
                    found.add(h.field)
                    start, end = folded.slice(h.start, h.end) if h.end > h.start else (None, None)
                    quote = None if start is None else raw[start:end]
                    rows.append((h.field, h.value, folded.text[h.start : h.end], quote, start, end, h.truncated, h.value is None and h.field in REQUIRED))
                    ids.append(i)
                if folded.text:
                    for field in REQUIRED:
                        if field not in found:
                            rows.append((field, None, "", None, None, None, False, True))
                            ids.append(i)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            doc = batch.column("doc").take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc", *FIELD_COLUMNS])

    return run


FIELD_COLUMNS = ("field", "value", "assertion", "quote", "start", "end", "truncated", "missing")


def prescreen_fields(notices: DataFrame, doc: str = "doc_id", body: str = "text", values: Mapping[str, str] = VALUES, labels: Mapping[str, str] = LABELS, times: Mapping[str, str] = TIMES) -> DataFrame:
    """J5 on O1 to O4: (doc, field, value, assertion, quote, start, end, truncated, missing), a row for each anchor that a
    notice meets and for each required one that it does not.

    assertion is the clause in folded text, quote the slice [start, end) of the original for it, in code points; truncated
    says that the clause was longer. An empty or null body gives no rows; repeated notices have rows of their own.
    """
    kind = dict(notices.dtypes)[doc]
    schema = f"doc {kind}, field string, value string, assertion string, quote string, start int, end int, truncated boolean, missing boolean"
    found = notices.select(F.col(doc).alias("doc"), F.col(body).alias("body")).mapInArrow(_prescreen((dict(values), dict(labels), dict(times))), schema)
    return found.withColumnRenamed("doc", doc)


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.slices(batches, "body"):  # a number takes some 40 bytes in Python
        folded = [fold(t or "") for t in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("body"), pa.array([f.text for f in folded], pa.string()), pa.array([f.offsets for f in folded], pa.list_(pa.int32()))],
            names=["doc", "body", "folded", "offsets"],
        )


def folded_text(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """O1: (doc, body, folded, offsets): white space runs as one space, and for each character its place in the original, a run's
    being its first. A span [a, b) of folded text is [offsets[a], offsets[b - 1] + 1) there. Null counts as empty."""
    kind = dict(docs.dtypes)[doc]
    src = docs.select(F.col(doc).alias("doc"), F.col(body).alias("body"))
    return src.mapInArrow(_fold_batches, f"doc {kind}, body string, folded string, offsets array<int>").withColumnsRenamed({"doc": doc, "body": body})
