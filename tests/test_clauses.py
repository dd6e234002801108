"""Folding and clause boundaries: generated clauses against how they were put together, lists, times of day, cut quotes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bidlattice.operators import clauses

SCHEMA = "doc_id long, text string"


def test_fold_leads_back():
    rng = random.Random(1)
    for _ in range(500):
        raw = "".join(rng.choice("ab项 \n\t　") for _ in range(rng.randint(0, 30)))
        folded = clauses.fold(raw)
        assert folded.text == " ".join(raw.split()) and len(folded.offsets) == len(folded.text)
        for c, at in zip(folded.text, folded.offsets, strict=True):
            assert raw[at] == c or (c == " " and raw[at].isspace() and not raw[at - 1].isspace())
        for a in range(len(folded.text)):
            for b in range(a + 1, len(folded.text) + 1):
                s, e = folded.slice(a, b)
                if not folded.text[a].isspace() and not folded.text[b - 1].isspace():
                    assert " ".join(raw[s:e].split()) == folded.text[a:b]


WORDS = "按照规定执行施工现场管理办法合格工程进度资料完整移交验收标准材料设备供应单位"


def test_generated_clauses(spark):
    """100 notices of clauses with known labels; each quote is the slice of the original and runs over the whole clause."""
    rng = random.Random(7)
    labels = {"quality": "质量标准", "scale": "建设规模", "payment_terms": "付款方式", "open_location": "开标地点", "funding_source": "资金来源", "purchaser": "招标人"}
    rows, want = [], {}
    for i in range(100):
        text = ""
        for field in rng.sample(sorted(labels), rng.randint(1, 6)):
            words = "".join(rng.choice(WORDS) for _ in range(rng.randint(3, 20)))
            k = rng.randrange(1, len(words))
            spaced = words[:k] + rng.choice(["", " ", "\n\n", " \t "]) + words[k:]
            number = rng.choice(["", "3.1 ", "（2）", "二、"])
            mark = rng.choice(["。", "；", ";"])
            text += rng.choice(["", "\n", "  "]) + number + labels[field] + rng.choice(["：", ":"]) + spaced + mark
            want[i, field] = (re.sub(r"\s+", " ", spaced), mark)
        rows.append((i, text))
    raw = dict(rows)
    got = clauses.prescreen_fields(spark.createDataFrame(rows, SCHEMA)).where("not missing").collect()
    assert {(r.doc_id, r.field) for r in got} == set(want)
    for r in got:
        value, mark = want[r.doc_id, r.field]
        assert r.value == value and raw[r.doc_id][r.start : r.end] == r.quote and " ".join(r.quote.split()) == r.assertion and not r.truncated
        assert r.quote.endswith(mark) and value in r.assertion


@pytest.mark.parametrize("text, value", [
    ("资质要求：（1）甲级资质；（2）乙级资质；（3）许可证。业绩要求：一项。", "（1）甲级资质；（2）乙级资质；（3）许可证"),
    ("资质要求：施工总承包二级；安全生产许可证；（2）具有良好信誉。3.1.2 其他", "施工总承包二级；安全生产许可证；（2）具有良好信誉"),
    ("资质要求：甲级；3.1.2 项目经理一级。", "甲级"), ("资质要求：一、甲级；二、乙级。三、丙级。招标人：某局", "一、甲级；二、乙级。三、丙级"),
    ("资质要求：甲级；业绩要求：三项。", "甲级"), ("资质要求：甲级 招标人：某局", "甲级"), ("本次须具有建筑工程施工总承包二级资质；有效的许可证。开标", "须具有建筑工程施工总承包二级资质；有效的许可证"),
])
def test_lists(spark, text, value):
    got = {r.field: r for r in clauses.prescreen_fields(spark.createDataFrame([(1, text)], SCHEMA)).collect()}
    assert got["qualification"].value == value and text[got["qualification"].start : got["qualification"].end] == got["qualification"].quote


def test_times_of_day_end_no_clause():
    text = "请于9:00前到开标室递交质量标准材料"
    assert clauses.clause_start(text, text.index("质")) == 0
    text = "说明：到开标室"
    assert clauses.clause_start(text, 5) == 3


def test_long_clauses_say_that_they_are_cut(spark):
    text = "总工期很长的说明" * 60 + "工期：30天"
    r = clauses.prescreen_fields(spark.createDataFrame([(1, "工期：30天" + "又" * 500), (2, text), (3, None), (4, " ")], SCHEMA)).where("field = 'duration'").collect()
    assert [(x.doc_id, x.value, x.truncated, len(x.quote)) for x in sorted(r)] == [(1, "30天", True, 220), (2, "30天", False, 106)]


def test_required_fields_get_a_row(spark):
    got = clauses.prescreen_fields(spark.createDataFrame([(1, "无"), (1, "无"), (2, "")], SCHEMA)).groupBy("doc_id").agg(F.count("*").alias("n"), F.every("missing").alias("m")).collect()
    assert [tuple(r) for r in got] == [(1, 14, True)]


def test_anchors_take_the_first_ticked_hit_anywhere():
    from bidlattice.operators import extraction as ex

    bond = next(a for a in ex.ANCHORS if a.key == "bid_bond")
    run = ex._anchor_hits([bond])
    import pyarrow as pa

    def hits(*pages):
        batch = pa.RecordBatch.from_arrays([pa.array([1] * len(pages)), pa.array(range(len(pages))), pa.array(list(pages))], names=["doc", "page", "body"])
        return [(r["page"], r["quote"], r["clause_ref"]) for b in run([batch]) for r in b.to_pylist()]

    assert hits("□3.4 须交投标保证金。☑3.5 须交投标 保\n证金。") == [(0, "投标 保\n证金", "3.5")]  # an open box, then a ticked one on the same page
    assert hits("□须交投标保证金。", "投标保证金") == [(1, "投标保证金", None)]
    assert hits("□不要求 ☑要求提交投标保证金") == [(0, "投标保证金", None)]
    assert hits(None, "", "□投标保证金") == []
    far = "□" + "很" * 30 + "投标保证金"
    assert [h[0] for h in hits(far)] == [0]  # the box is beyond the characters that are looked at


def test_missing_anchors(spark):
    from bidlattice.operators import extraction as ex

    pages = spark.createDataFrame([(1, 1, "投标保证金" * 2 + "长" * 400), (2, 1, None), (2, 1, None)], "doc_id long, page_no int, text string")
    got = ex.anchor_candidates(pages).collect()
    must = sum(a.must for a in ex.ANCHORS)
    assert len(got) == 2 * must and {r.assertion for r in got if r.doc_id == 2} == {ex.MISSING}
    assert [(r.anchor_key, r.start, r.end) for r in got if not r.missing] == [("bid_bond", 0, 5)]
