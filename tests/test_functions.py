"""Column functions on literal rows."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from bidlattice.functions import classify, text, values


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_names(spark):
    assert one(spark, "Ａ公司（ ）　有限公司", text.normalise_name) == "A公司有限公司"
    assert one(spark, "某某建设集团有限公司", text.normalise_publisher) == "某某建设集团"
    assert one(spark, None, text.normalise_name) == ""
    assert one(spark, "ＨＢ－2024 ０１", text.normalise_code) == "hb202401"
    assert one(spark, "滨河路改造工程招标公告", text.normalise_project_name) == "滨河路改造"


def test_dice(spark):
    d = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abce"), ("", "a"), ("aaaa", "aa"), (None, "x")], "a string, b string")
    assert [r.y for r in d.select(text.dice(F.col("a"), F.col("b")).alias("y")).collect()] == [1.0, 0.6667, 0.0, 0.5, 0.0]


def test_tokens_and_width(spark):
    assert one(spark, "投标ABC12标", text.tokenise) == ["投", "标", "abc12", "标"]
    assert one(spark, "投标a\n", text.text_width) == 5
    assert one(spark, "市政公用工程/公路、市政", text.specialty_tokens) == ["市政", "公路"]


def test_masks(spark):
    assert one(spark, "张三丰", text.mask_name) == "张**"
    assert one(spark, "id 11010119900307123X tel 13800138000", text.redact) == "id [REDACTED] tel [REDACTED]"
    assert one(spark, "第一条（第一条）", text.fold_repeated_clause) == "第一条"
    assert one(spark, 1234567.5, text.format_money, "double") == "1,234,567.50"
    assert one(spark, 1234567.0, text.format_money, "double") == "1,234,567"


def test_key_keeps_empty_parts(spark):
    d = spark.createDataFrame([("a", None, "__待补__", "b")], "p string, q string, r string, s string")
    assert d.select(text.business_key(*[F.col(c) for c in "pqrs"]).alias("y")).first().y == "a|||b"


def test_money(spark):
    assert one(spark, "1,200.5万元", values.normalise_amount) == Decimal("12005000.0000")
    assert one(spark, "无", values.normalise_amount) is None
    assert one(spark, "壹佰贰拾叁万元整", values.capital_amount) == 1_230_000
    assert one(spark, "叁亿肆仟万圆", values.capital_amount) == 340_000_000


def test_dates(spark):
    assert one(spark, "2026年9月2日 9:30 开标", values.first_date) == date(2026, 9, 2)
    assert one(spark, "2026年9月2日 9:30 开标", values.clock) == "09:30:00"
    assert one(spark, "2026年9月2日", values.deadline_instant) is None
    assert one(spark, "not a date", values.parse_instant) is None
    assert one(spark, "2026-08-17T12:00:00+08:00", values.parse_instant).hour == 4
    assert one(spark, "2026-02-30", values.normalise_date) is None
    assert one(spark, "2026-W34", values.week_start) == date(2026, 8, 17)
    assert one(spark, "http://x/2026/08/17/a.html", values.url_date) == date(2026, 8, 17)


def test_levels_are_two_scales(spark):
    assert one(spark, "甲级", text.rule_level_rank) == 3 and one(spark, "甲级", text.proof_level_rank) == 4
    d = spark.createDataFrame([("一级", "乙级"), ("二级", "甲级"), ("x", "一级")], "a string, b string")
    assert [r.y for r in d.select(text.level_at_least(F.col("a"), F.col("b")).alias("y")).collect()] == [True, False, None]


def test_screening(spark):
    f = lambda c: classify.screen(c, classify.title_type(c), ["监理"], ["道路"], {"title": c})
    assert one(spark, "某道路招标公告", f).state == "recommended"
    assert one(spark, "某道路监理招标公告", f).state == "excluded_keyword"
    assert one(spark, "道路中标公示", f).state == "excluded_type"


def test_urgency_of_a_past_signup(spark):
    d = spark.sql("select timestamp'2026-08-01' s, timestamp'2026-09-01' b, timestamp'2026-08-17 12:00:00' n")
    u = d.select(classify.urgency(F.col("s"), F.col("b"), F.col("n")).alias("u")).first().u
    assert (u.urgency, u.basis) == ("urgent", "signup")


def test_working_days(spark):
    d = spark.sql("select date'2026-08-18' s, date'2026-08-14' t")  # Friday to Tuesday
    got = d.select(classify.urgency_level(F.col("s"), F.lit(None), F.col("t")).alias("a"), classify.urgency_level(F.col("s"), F.lit(None), F.col("t"), True).alias("b")).first()
    assert (got.a, got.b) == ("P1", "P0")


def test_quotes(spark):
    d = spark.createDataFrame([("前文。投标有效期90天。", "投标有效期90天"), ("x", "y"), ("x", "")], "t string, q string")
    got = [r.y for r in d.select(values.quote_at(F.col("t"), F.col("q")).alias("y")).collect()]
    assert (got[0].start, got[0].end) == (3, 11) and got[1] is None and got[2] is None
    at = d.limit(1).select(values.round_trips(F.col("t"), F.col("q"), F.lit(3), F.lit(11)).alias("y"))
    assert at.first().y


def test_overlay(spark):
    d = spark.sql("select map('a','1','b','2') b, map('b','3','c','4') r, cast(null as map<string,string>) n")
    got = d.select(values.overlay(F.col("b"), F.col("r")).alias("x"), values.overlay(F.col("n"), F.col("r")).alias("y")).first()
    assert got.x == {"a": "1", "b": "3", "c": "4"} and got.y == {"b": "3", "c": "4"}


def test_ordered_rules(spark):
    assert one(spark, "某市设计施工总承包（EPC）招标", classify.title_works) == "EPC总承包"
    assert one(spark, "施工图设计招标", classify.project_type) == "工程（设计招标）" and one(spark, "办公设备采购", classify.project_type) == "货物（采购）"
    assert one(spark, "无关", classify.project_type) is None
    assert one(spark, "每项业绩得3分", classify.quote_category) == "评分" and one(spark, "天气", classify.quote_category) is None
    assert one(spark, "开标现场递交", classify.task_kind) == "site_visit" and one(spark, "x", classify.task_kind) == "other"
    assert one(spark, "ISO9001", classify.qualification_bucket) == "quality_system" and one(spark, None, classify.qualification_bucket) == "construction_qual"
    assert one(spark, "unverifiable", classify.next_action) == "create_or_merge_evidence_task" and one(spark, None, classify.next_action) == "wait"
    assert one(spark, "项目管理机构人员应附身份证、职称证扫描件", classify.is_submission_package) is True and one(spark, None, classify.is_submission_package) is False
    assert one(spark, " 待补 ", text.without_placeholder) is None and one(spark, "待补充资料", text.without_placeholder) == "待补充资料"


def test_page_addresses(spark):
    rows = [("http://x/list.html", 3, "path_page", "http://x/list_3.html"), ("http://x/l?a=1&pageNo=9", 2, "pageNo", "http://x/l?a=1&pageNo=2"), ("http://x/l", 2, "p", "http://x/l?p=2"), ("http://x/l", 1, "p", "http://x/l"), ("http://x/l", 5, None, "http://x/l")]
    d = spark.createDataFrame(rows, "t string, n int, p string, want string")
    assert [r.u for r in d.select(text.page_url(F.col("t"), F.col("n"), F.col("p")).alias("u")).collect()] == [r[3] for r in rows]


def test_region(spark):
    names = spark.createDataFrame([("石家庄市", "石家庄市", 1), ("正定县", "石家庄市", 2), ("唐山", "唐山市", 1)], "name string, region string, rank int")
    rows = spark.createDataFrame([("正定县道路工程",), ("某地",), (None,)], "t string")
    assert {r.t: r.region for r in text.with_region(rows, "t", names).collect()} == {"正定县道路工程": "石家庄市", "某地": None, None: None}
