"""Personal data: strict forms against plain patterns, the graph against a plain version, planted contexts, odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bidlattice.llm import personal, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for i, (kind, form) in enumerate(PLAIN.items()):
        for m in re.finditer(form, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            twice = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and twice % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((i, *m.span()))
    return out


def test_strict_forms_against_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("ab.@-1", "0123456789. -", "+0123456789 ().-", "a1.@+4 -é\n"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert personal.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "001.0255.3.4", "a@b.c.@d.e", "9" * 4000 + ".1.1.1"):
        assert personal.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("part", ["a", "a@", "a.", "1", "1.", "+1", "+1 ", "1 ", "(1", "é", "a at ", "1:", " "])
def test_long_texts_take_linear_time(part):
    import time

    text, begin = part * ((1 << 20) // len(part)), time.process_time()
    list(personal.loose_spans(text)), personal.base_spans(text)
    assert time.process_time() - begin < 15


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, texts):
    rows = personal.span_digests(personal.personal_spans(frame(spark, texts))).collect()
    return {r.doc_id: r for r in rows}


def test_contexts_find_what_forms_do_not(spark):
    filler = ["the house of the card was on the hill and the phone of the other"] * 5
    texts = [f"Bitte Kontonummer: {4000_0000_0000_0000 + k}" for k in range(0)]
    texts += [f"{filler[0]} callme: +1 (20{i}) 555-77{i:02d} {filler[0]}" for i in range(10, 20)]
    texts += [f"{filler[0]} mailto: ann{i}@mail{i}.example.com" for i in range(6)]
    texts += filler + [
        "callme: (202) 555-7799", "elsewhere 202-555-7799 again, and 303-555-1000 not", "mailto: bob at example dot com", "we met bob2 at example dot com",
        "callme (202) 555-7801 ring: (202) 555-7802", "card 4845168114407320",
    ]
    got = found(spark, texts)
    assert [got[i].spans[-5:] for i in (21, 22, 23, 24, 25, 26)] == [f"phone:{a}:{b}"[-5:] if k == 3 else f"email:{a}:{b}"[-5:] if k == 0 else "" for k, a, b in ((3, 8, 22), (3, 10, 22), (0, 8, 30), (9, 0, 0), (3, 7, 21), (9, 0, 0))]
    assert got[21].spans == "phone:8:22" and got[22].spans == "phone:10:22" and got[23].spans == "email:8:30" and got[24].spans == "" and got[26].spans == ""
    assert got[25].spans == "phone:7:21" and sum(r.n_phone for r in got.values()) == 10 and got[16].n_added == 0


def test_a_context_must_mark_mentions_in_the_whole_corpus(spark):
    """The same contexts, but the word before is common elsewhere: nothing is added."""
    texts = [f"number +1 (20{i}) 555-77{i:02d}" for i in range(10, 20)] + ["number (202) 555-7799"]
    assert found(spark, texts)[10].n_added == 1
    assert found(spark, texts + ["number one and number two"] * 20)[10].n_added == 0


def test_graph_rounds_reach_new_patterns(spark):
    """ring: holds no strict mention; values first met behind call: make it a pattern, which then finds others."""
    texts = [f"call: +1 (20{i}) 555-77{i:02d}" for i in range(10, 30)]
    texts += [f"call: (30{i}) 555-88{i:02d}" for i in range(10, 16)] + [f"ring: (30{i}) 555-88{i:02d}" for i in range(10, 16)] + ["ring: (404) 555-0001"]
    got = found(spark, texts)
    assert [got[i].n_added for i in range(20, 33)] == [1] * 13
    assert personal._trusted(spark.createDataFrame([], "kind int, side int, code long, value binary, seed boolean, n long"), spark.createDataFrame([], "code long, n long")) is None


def test_query_against_plain_version(spark):
    """Strict spans of all documents; nothing is added where no context marks personal data."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_personal_data(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = plain_spans(r.text or "")
        listed = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in spans))
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
        assert g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and (g.spans == listed or g.n_added)


def test_odd_rows(spark):
    texts = [None, "", " ", "x@y.z", "x@y.z", "é" * 100_000 + " a@b.cd", "+" * 10]
    got = personal.span_digests(personal.personal_spans(frame(spark, texts).union(frame(spark, ["a@b.cd"])).withColumn("row", F.lit(1)).withColumn("base", F.lit("c"))))
    assert sorted((r.doc_id, r.spans) for r in got.collect()) == [(0, ""), (0, "email:0:6"), (1, ""), (2, ""), (3, "email:0:5"), (4, "email:0:5"), (5, "email:100001:100007"), (6, "")]
    assert personal.personal_spans(frame(spark, [None]).limit(0)).count() == 0
