"""Text to rows: listings, anchored candidates, quotes, chunks. Patterns and limits are parameters or named tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, values

MISSING = "__待补__"
#: Characters of a labelled value; passages that are broadcast at once, and as many keys of passages.
VALUE, PASSAGES, KEYS = 220, 10_000, 1_000_000


class Anchor(NamedTuple):
    """A clause to look for: its key, a Java pattern, and whether its absence is reported."""

    key: str
    req_type: str
    category: str
    pattern: str
    must: bool


#: Clauses of a tender document by key, kind and category; the patterns are our own.
ANCHORS = (
    Anchor("qualification_grade", "hard", "资质", r"资质[^。；\n]{0,30}?(特级|[一二三壹贰叁]级|[甲乙丙]级)", True),
    Anchor("safety_license", "hard", "资质", r"安全生产许可证", True),
    Anchor("business_license", "hard", "资质", r"营业执照", False),
    Anchor("pm_registered_builder", "hard", "人员", r"(注册)?建造师", True),
    Anchor("pm_b_cert", "hard", "人员", r"安全生产考核合格证[^。；]{0,6}B|B(类|本|证)", True),
    Anchor("pm_no_active", "hard", "人员", r"(无|没有|不得有)在建", True),
    Anchor("pm_social_security", "hard", "人员", r"社(会)?保(险|障)?[^。；\n]{0,20}(月|证明|缴纳)", True),
    Anchor("safety_officer", "hard", "人员", r"(专职)?安全(生产管理人)?员", True),
    Anchor("tech_lead", "hard", "人员", r"技术负责人", False),
    Anchor("tech_team", "hard", "人员", r"(施工员|质量员|技术人员|项目管理机构)", True),
    Anchor("design_lead", "hard", "人员", r"设计负责人", False),
    Anchor("construction_lead", "hard", "人员", r"施工负责人", False),
    Anchor("financial_audit", "hard", "财务", r"(财务|审计)(审计)?报告", True),
    Anchor("tax_social_proof", "hard", "财务", r"(纳税|完税)(证明|凭证)", False),
    Anchor("credit_no_loser", "hard", "信用", r"失信被执行人", True),
    Anchor("credit_blacklist", "hard", "信用", r"(黑名单|严重违法失信)", False),
    Anchor("no_major_violation", "hard", "信用", r"重大违法(记录)?", False),
    Anchor("consortium", "hard", "联合体", r"联合体", True),
    Anchor("bid_validity", "hard", "响应性", r"投标有效期[^。；\n]{0,12}?\d+", True),
    Anchor("bid_bond", "hard", "保证金", r"投标保证金", True),
    Anchor("ceiling_price", "hard", "响应性", r"(最高(投标)?限价|招标控制价)", True),
    Anchor("similar_performance_hard", "hard", "业绩", r"(类似|同类)[^。；\n]{0,8}业绩", True),
    Anchor("prequalification_method", "hard", "资格审查", r"资格(预审|后审)", False),
    Anchor("evaluation_method", "scored", "评标办法", r"(综合评估法|经评审的最低投标价法|综合评分法)", False),
    Anchor("scoring_tech", "scored", "技术标", r"技术(标|部分)[^。；\n]{0,10}分", True),
    Anchor("scoring_price", "scored", "商务标/价格", r"(报价|价格)(得分|评分)", False),
    Anchor("scoring_construction_plan", "scored", "技术标/施工组织设计", r"施工组织设计", False),
    Anchor("scoring_equipment", "scored", "技术标/设备", r"机械设备", False),
    Anchor("action_file_acquisition", "action", "报名/文件获取", r"(招标)?文件的?获取|报名", False),
    Anchor("action_deadline_bid", "action", "递交", r"投标(文件)?(递交)?截止时间", False),
    Anchor("action_open", "action", "开标", r"开标(时间|地点)", False),
    Anchor("action_q_and_a", "action", "答疑/质疑", r"(答疑|质疑)", False),
    Anchor("action_site_visit", "action", "踏勘", r"踏勘", False),
    Anchor("pm_similar_performance", "hard", "人员", r"项目经理[^。；]{0,30}?(担任|主持|完成)[^。；]{0,30}?(类似|同类)[^。；，]{0,20}?(业绩|项目|工程)", False),
    Anchor("scoring_similar_performance", "scored", "技术标明标/类似业绩", r"(类似|同类)[^。；]{0,12}?(业绩|工程)[^。；]{0,20}?[得加]\d+分", True),
    Anchor("scoring_pm", "scored", "技术标/人员评分", r"项目经理[^。；]{0,30}?[得加]\d+分", False),
    Anchor("scoring_business_credit", "scored", "商务标/信用", r"信用[^。；]{0,10}?\d+分", False),
    Anchor("scoring_enterprise_honor", "scored", "商务标/企业信誉", r"(鲁班奖|优质工程|安全文明工地|AAA)[^。；]{0,30}?分", False),
    Anchor("action_bid_bond_due", "action", "保证金到账", r"保证金(递交|到账|缴纳)(时间|截止)?", False),
)
#: Ticked boxes; anchors whose polarity is read from their own text, so that their boxes don't matter; how
#: many characters before a hit its box and clause number are looked for; clause numbers.
TICKED, TICKED_OR_NOT, BEFORE_HIT = "☑■√☒✓✔", ("consortium",), 24
CLAUSE_NUMBER = re.compile(r"(?<![\d.])(\d{1,2}(?:\.\d{1,2}){1,3})(?![\d.])")
#: Fields of the main card and their labels.
MAIN_CARD = {
    "project_name": "项目名称", "tender_no": "(?:招标|项目)编号", "tenderee": "招标人", "agency": "(?:招标)?代理(?:机构)?", "region": "(?:建设)?地点",
    "ceiling_price": "(?:最高(?:投标)?限价|招标控制价)", "budget_amount": "(?:预算|投资)(?:金额|额)?", "bid_bond_amount": "投标保证金(?:金额)?",
    "deadline_bid": "投标截止时间", "open_date": "开标时间",
}
#: Terms of a contract and their labels.
TERMS = {
    "duration": "(?:计划)?工期", "quality_standard": "质量(?:标准|要求)", "contract_type": "合同(?:价格)?形式", "payment_terms": "(?:工程)?付款(?:方式|条件)",
    "advance_payment": "预付款", "performance_bond": "履约(?:保证金|担保)", "retention_money": "(?:质量)?保证金|质保金", "warranty": "(?:质量)?保修期|缺陷责任期",
    "provisional_sum": "暂列金额", "downward_rate": "下浮率", "safety_fee": "安全文明施工费", "tech_standard": "技术(?:标准|规范)", "subcontract": "分包",
}


def html_to_text(html: Column) -> Column:
    """A4: scripts and styles out, block ends to spaces, tags out, references decoded, white space to single spaces."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n")
    return F.trim(F.regexp_replace(text.unescape(F.regexp_replace(s, r"<[^>]+>", "")), text.SPACE + "+", " "))


def listing_links(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "url") -> DataFrame:
    """A3, A5: links of a listing page with title and absolute address, the first of each title on a page."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""), r"(?is)<script\b.*?</script\s*>", "")
    found = F.regexp_extract_all(bare, F.lit(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(?:.*?)</a>'), F.lit(0))
    rows = pages.select(key, base, F.posexplode(found).alias("pos", "a"))
    href = F.regexp_extract("a", r'(?is)href="([^"]*)"', 1)
    title = F.coalesce(F.nullif(F.regexp_extract("a", r'(?is)title="([^"]*)"', 1), F.lit("")), text.strip_tags(F.col("a")))
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    full = F.when(href.rlike("^[a-zA-Z]+://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), href))
    rows = rows.select(key, "pos", title.alias("title"), full.alias("link")).where("title <> ''")
    first = F.row_number().over(W.partitionBy(key, "title").orderBy("pos"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def _squeezed(raw: str) -> tuple[str, list[int]]:
    """Text without white space, and the place of each of its characters in the original."""
    at = [i for i, c in enumerate(raw) if c not in " \t\r\n\f"]
    return "".join(raw[i] for i in at), at


def _not_ticked(before: str, hit: str) -> bool:
    """An open box in the sentence before a hit or at its beginning, and no ticked one up to its end."""
    own = re.split("[。；;]", before)[-1]
    return "□" in own + hit[:3] and not re.search(f"[{TICKED}]", own + hit)


def _clause_number(before: str, hit: str) -> str | None:
    """The last number of the sentence before a hit, else the first one in it."""
    near = CLAUSE_NUMBER.findall(re.split("[。；;]", before)[-1])
    return near[-1] if near else next(iter(CLAUSE_NUMBER.findall(hit)), None)


def _anchor_hits(anchors: Sequence[Anchor]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = [re.compile(a.pattern) for a in anchors]
        for batch in text.slices(batches, "body"):
            rows, ids = [], []
            for i, raw in enumerate(batch.column("body").to_pylist()):
                bare, places = _squeezed(raw or "")
                for n, (anchor, form) in enumerate(zip(anchors, forms, strict=True)):
                    for m in form.finditer(bare):
                        before = bare[max(0, m.start() - BEFORE_HIT) : m.start()]
                        if m[0] and (anchor.key in TICKED_OR_NOT or not _not_ticked(before, m[0])):
                            start, end = places[m.start()], places[m.end() - 1] + 1
                            rows.append((n, m.start(), m[0], raw[start:end], start, end, _clause_number(before, m[0])))
                            ids.append(i)
                            break
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            keys = [batch.column(c).take(pa.array(ids, pa.int64())) for c in ("doc", "page")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc", "page", "anchor", "at", "hit", "quote", "start", "end", "clause_ref"])

    return run


def anchor_candidates(pages: DataFrame, anchors: Sequence[Anchor] = ANCHORS, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """For each document and anchor the first hit of its pages whose box, if it has one, is ticked; anchors that must be
    reported and are nowhere get a row with the missing mark.

    Anchors are matched on the page without white space, so a clause may be broken over lines anywhere; all hits of a page
    are tried until one is ticked. assertion is the hit without white space (300 characters, then …), quote the original
    slice [start, end) for it. A page is read once for all anchors; the rest is a least-page aggregate.
    """
    kinds = dict(pages.dtypes)
    schema = f"doc {kinds[doc]}, page {kinds[page]}, anchor int, at int, hit string, quote string, start int, end int, clause_ref string"
    found = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(body).alias("body")).mapInArrow(_anchor_hits(tuple(anchors)), schema)
    first = found.groupBy("doc", "anchor").agg(F.min(F.struct("page", "at", "hit", "quote", "start", "end", "clause_ref")).alias("f")).select(F.col("doc").alias(doc), "anchor", "f.*")
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip((i, *a[:3], a.must), ("anchor", "anchor_key", "req_type", "category", "must"), strict=True)]) for i, a in enumerate(anchors)])
    wanted = pages.select(doc).distinct().select(doc, F.inline(table))
    cut = F.when(F.length("hit") > 300, F.concat(F.left("hit", F.lit(300)), F.lit("…"))).otherwise(F.col("hit"))
    return (
        wanted.join(first, [doc, "anchor"], "left").where(F.col("hit").isNotNull() | F.col("must"))
        .select(doc, "anchor_key", "req_type", "category", F.col("page").alias(page), F.coalesce(cut, F.lit(MISSING)).alias("assertion"), "quote", "start", "end", "clause_ref", F.col("hit").isNull().alias("missing"))
    )


def labelled_fields(pages: DataFrame, labels: dict[str, str], doc: str = "doc_id", page: str = "page_no", body: str = "text", max_pages: int | None = None) -> DataFrame:
    """The first value after each label (`label: value`, up to the sentence's end) with its place in the page.

    A value longer than VALUE characters is cut, and truncated says so.
    """
    src = pages if max_pages is None else pages.where(F.col(page) <= max_pages)
    p = {k: rf"(?:{v})\s*[:：]\s*([^。；;\n]+)" for k, v in labels.items()}
    hits = F.array_compact(F.array(*[
        F.when(F.regexp_extract(body, q, 1) != "", F.struct(F.lit(k).alias("field"), F.trim(F.left(F.regexp_extract(body, q, 1), F.lit(VALUE))).alias("value"), (F.length(F.regexp_extract(body, q, 1)) > VALUE).alias("truncated"), F.regexp_instr(F.col(body), F.lit(q)).alias("at")))
        for k, q in p.items()
    ]))
    found = src.select(doc, page, body, F.explode(hits).alias("h")).select(doc, page, F.col("h.field").alias("field"), F.col("h.value").alias("value"), F.col("h.truncated").alias("truncated"), F.col("h.at").alias("at"), values.quote_at(F.col(body), F.col("h.value")).alias("span"))
    return found.groupBy(doc, "field").agg(F.min(F.struct(page, "at", "value", "span", "truncated")).alias("f")).select(doc, "field", f"f.{page}", "f.value", "f.span", "f.truncated")


def rule_parameters(anchor: Column, quote: Column) -> Column:
    """Struct of the parameters that a quote states for its anchor; what is not stated is null."""
    days = F.regexp_extract(quote, r"(\d+)\s*(?:个)?(?:日历天|日历日|天|日)", 1)
    return F.struct(
        text.normalise_level(quote).alias("level"), F.when(anchor == "bid_validity", F.nullif(days, F.lit("")).cast("int")).alias("days"),
        F.when(anchor.isin("bid_bond", "ceiling_price"), values.normalise_amount(quote)).alias("amount"),
        F.when(anchor == "safety_officer", F.nullif(F.regexp_extract(quote, r"(\d+)\s*[名人]", 1), F.lit("")).cast("int")).alias("need_count"),
        F.when(anchor == "financial_audit", F.transform(F.regexp_extract_all(quote, F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))).alias("years"),
        F.regexp_extract(quote, r"(\d+)\s*个?月", 1).alias("months"),
    )


def verified_quotes(proposals: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """Proposed quotes with the first page that holds them as they are, their span and value, or why not.

    proposals (doc, field, kind, quote). A quote that no page holds, or that states no value of its kind, is rejected.
    """
    joined = proposals.join(pages.select(doc, page, body).hint("merge"), doc, "left").withColumn("span", values.quote_at(F.col(body), F.col("quote")))
    first = joined.groupBy(doc, "field", "kind", "quote").agg(F.min(F.when(F.col("span").isNotNull(), F.struct(page, "span"))).alias("f"))
    value = values.derive_value(F.col("kind"), F.col("quote"))
    reason = F.when(F.col("f").isNull(), "quote_not_found").when(value.isNull(), "no_value")
    return first.select(doc, "field", "quote", f"f.{page}", "f.span", F.when(reason.isNull(), value).alias("value"), reason.alias("reject_reason"))


def not_overlapping(new: DataFrame, old: DataFrame, doc: str = "doc_id", quote: str = "quote", least: int = 16) -> DataFrame:
    """New quotes that neither hold nor are held by an old quote of the same document, among those of some length."""
    o = old.select(doc, F.col(quote).alias("__o")).where(F.length("__o") >= least)
    hit = (F.col(f"n.{doc}") == F.col(f"o.{doc}")) & (F.length(f"n.{quote}") >= least) & (F.col(f"n.{quote}").contains(F.col("o.__o")) | F.col("o.__o").contains(F.col(f"n.{quote}")))
    return new.alias("n").join(o.alias("o"), hit, "left_anti")


def pages_within_budget(pages: DataFrame, hints: Sequence[str], budget: int, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """Pages by the number of different hints they hold, as many as fit into the budget of characters, in page order."""
    score = F.size(F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.col(body).contains(h)))
    by = W.partitionBy(doc).orderBy(F.desc("score"), page)
    scored = pages.select(doc, page, score.alias("score"), F.length(body).alias("size")).where("score > 0")
    return scored.withColumn("used", F.sum("size").over(by.rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= budget).orderBy(doc, page)


def _pieces(s: str, size: int, overlap: int) -> list[str]:
    """A paragraph cut where its width reaches size; a short last piece joins the one before; each takes the end of the last."""
    wide = [1 if "一" <= ch <= "鿿" or ch == "\n" else 2 for ch in s]
    if sum(wide) <= size:
        return [s]
    spans, start, width = [], 0, 0
    for i, w in enumerate(wide):
        width += w
        if width >= size:
            spans.append((start, i + 1))
            start, width = i + 1, 0
    if start < len(s):
        spans.append((start, len(s)))
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and sum(wide[a:b]) < size // 2:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    out = [s[merged[0][0] : merged[0][1]]]
    for a, b in merged[1:]:
        tail, width = len(out[-1]), 0
        while tail and width < overlap:
            tail -= 1
            ch = out[-1][tail]
            width += 1 if "一" <= ch <= "鿿" or ch == "\n" else 2
        out.append(out[-1][tail:] + s[a:b] if overlap else s[a:b])
    return out


def chunks(docs: DataFrame, doc: str = "doc_id", body: str = "text", size: int = 600, overlap: int = 80) -> DataFrame:
    """(doc, para_no, piece_no, chunk_seq, chunk): paragraphs cut by width with an overlap.

    Paragraphs are cut one by one in a map; the running number is a window within the document.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, p, k, c) for d, p, t in zip(pdf[doc], pdf["para_no"], pdf["para"], strict=True) for k, c in enumerate(_pieces(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[doc, "para_no", "piece_no", "chunk"])

    paras = docs.select(doc, F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("para_no", "para")).withColumn("para", F.trim("para")).where("para <> ''")
    kind = docs.schema[doc].dataType.simpleString()
    short = 2 * F.length("para") <= size
    whole = paras.where(short).select(doc, "para_no", F.lit(0).cast("long").alias("piece_no"), F.col("para").alias("chunk"))
    parts = paras.where(~short).mapInPandas(cut, f"{doc} {kind}, para_no int, piece_no long, chunk string")
    n = F.row_number().over(W.partitionBy(doc).orderBy("para_no", "piece_no")) - 1
    return whole.unionByName(parts).withColumn("chunk_seq", n)


def passage_links(docs: DataFrame, passages: DataFrame, doc: str = "doc_id", item: str = "item_id", body: str = "text", words: int = 4) -> DataFrame:
    """(doc, item) where a document's text holds the whole text of a passage.

    Both sides meet on a hash of `words` words in a row. Those of a passage are its second and following ones, since its
    first and last may stand inside longer words of the document; a passage with fewer words between its ends gives as many
    as it has. What meets is confirmed on whole texts. Up to KEYS of these keys are counted and then tested where the
    documents are read; beyond that, both sides are shuffled. Passages of one or two words have no inner word and are
    compared with every text, PASSAGES of them at a time. Empty and null passages link with nothing.
    """
    tokens = F.split(body, r"[ \t\n\x0B\f\r]+")
    p = passages.where(F.col(body) != "").select(item, F.col(body).alias("__passage"), tokens.alias("__w")).withColumn("__n", F.least(F.lit(words), F.size("__w") - 2))
    keyed = p.where("__n > 0").select(item, "__passage", F.xxhash64("__n", F.slice("__w", F.lit(2), F.col("__n"))).alias("__key"))
    sizes = [r[0] for r in p.where("__n > 0").select("__n").distinct().collect()]  # at most `words` numbers
    at = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.lit(n), F.slice(w, i, F.lit(n))))
    keys = text.bound(tokens, lambda w: F.array_distinct(F.concat(*[at(w, n) for n in sizes]))) if sizes else F.array().cast("array<bigint>")
    d = docs.select(doc, F.explode(keys).alias("__key"))
    few = keyed.limit(KEYS + 1).count() <= KEYS
    met = d.join(F.broadcast(keyed.select(item, "__key")) if few else keyed.select(item, "__key"), "__key").select(doc, item).distinct()
    long = met.join(keyed.select(item, "__passage"), item).join(docs.select(doc, body), doc)
    out = long.where(F.col(body).contains(F.col("__passage"))).select(doc, item)
    tiny = p.where("__n <= 0").select(item, "__passage")
    rounds = -(-tiny.count() // PASSAGES)
    for i in range(rounds):  # a part of so many rows is broadcast, and no row leaves that doesn't hold it
        part = tiny.where(F.pmod(F.xxhash64(item, "__passage"), F.lit(rounds)) == i)
        out = out.unionByName(docs.select(doc, body).join(F.broadcast(part), F.col(body).contains(F.col("__passage"))).select(doc, item))
    return out.distinct()


def folded(c: Column) -> Column:
    """O1: white space runs to one space, trimmed; a quote's place in the original comes from quote_at on the original."""
    return F.trim(F.regexp_replace(c, text.SPACE + "+", " "))


def label_lines(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """`label: value` lines with the lines that follow each up to the next label joined to it."""
    lines = docs.select(doc, F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    p = r"^\s*([^:：\s]{1,20})\s*[:：]\s*(.*)$"
    lines = lines.withColumn("label", F.nullif(F.regexp_extract("line", p, 1), F.lit(""))).withColumn("part", F.when(F.col("label").isNotNull(), F.regexp_extract("line", p, 2)).otherwise(F.trim("line")))
    by = W.partitionBy(doc).orderBy("pos")
    grouped = lines.withColumn("block", F.count("label").over(by)).where("block > 0")
    return grouped.groupBy(doc, "block").agg(
        F.max("label").alias("label"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " ").alias("value")
    ).withColumn("value", F.trim("value"))
