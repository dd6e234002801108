"""Queries on tables that are odd or have many rows under one key, against their SQL."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from bidlattice.plans import catalogue
from oracle import TABLES, differences

SF = "/root/testdata/sf0.001"


def folder(spark, tmp_path, **changed):
    """The smallest tables, some replaced."""
    for name in TABLES:
        if name in changed:
            changed[name].coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            Path(tmp_path, f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_identity_of_balances_without_size(spark, tmp_path):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    odd = F.when(F.col("c_custkey") % 3 == 0, 0.0).when(F.col("c_custkey") % 7 == 0, -0.0).when(F.col("c_custkey") % 8 == 0, F.lit(None)).otherwise(F.col("c_acctbal"))
    sf = folder(spark, tmp_path, customer=c.withColumn("c_acctbal", odd))
    assert differences(catalogue.QUERIES["n12_identity_check"](spark, sf), catalogue.ORACLE_SQL["n12_identity_check"], sf) == ""


def test_texts_built_from_keys_are_not_broadcast(spark):
    for name in ("j5_o1_o4_prescreened_notices", "j1_anchor_candidates", "j6_o5_verified_quotes"):
        joins = [x for x in plan_of(catalogue.QUERIES[name](spark, SF)).splitlines() if "HashJoin" in x or "MergeJoin" in x]
        assert any("SortMergeJoin" in x for x in joins)
    assert "Broadcast" not in plan_of(catalogue.QUERIES["j5_o1_o4_prescreened_notices"](spark, SF))


def test_slices_hold_all_rows_and_few_bytes():
    import pyarrow as pa

    from bidlattice.functions import text

    batch = pa.RecordBatch.from_pydict({"body": ["x" * 40, None, "", "y" * 70, "z" * 200, "w"]})
    parts = list(text.slices([batch, batch.slice(0, 0)], "body", 100))
    assert [r for p in parts for r in p.column("body").to_pylist()] == batch.column("body").to_pylist()
    assert [p.num_rows for p in parts] == [3, 1, 1, 1, 0]


def test_folding_copies_no_text(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    twice = d.unionByName(d).unionByName(d.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(None).cast("string")}))
    sf = folder(spark, tmp_path, documents=twice)
    df = catalogue.QUERIES["o1_folded_documents"](spark, sf)
    assert differences(df, catalogue.ORACLE_SQL["o1_folded_documents"], sf) == ""
    assert not {w for w in ("Exchange", "Join", "Generate") if w in plan_of(df)}


def test_every_place_of_folded_text_is_looked_at(spark, tmp_path, monkeypatch):
    """Document i has a wrong place at its character i; a text that lost a word is found out as well."""
    from bidlattice.operators import clauses

    text = " \n" + "aa 中\U0001f600 \t b\u3000\x1c\x85c\ufeff\n" * 60 + "aa \n"
    n = len(clauses.fold(text).text)
    assert n > 512
    rows = [(i, text) for i in range(n)] + [(-1, text), (-2, text), (-3, None), (-4, " \n"), (-5, "".join(f"{chr(c)}x" for c in range(1, 0x3100)))]
    sf = folder(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    whole = clauses.folded_text
    for by in (0, 1, -1, None):

        def doctored(docs, by=by):
            moved = F.transform("offsets", lambda o, i: F.when(i == F.col("doc_id"), o + F.lit(by).cast("int")).otherwise(o))
            return whole(docs).withColumns({"offsets": F.when(F.col("doc_id") == -2, F.slice("offsets", 4, n)).otherwise(moved), "folded": F.when(F.col("doc_id") == -2, F.expr("substring(folded, 4)")).otherwise(F.col("folded"))})

        monkeypatch.setattr(clauses, "folded_text", doctored)
        got = {r.doc_id: r.led_back for r in catalogue.QUERIES["o1_folded_documents"](spark, sf).collect()}
        assert got == {i: i != -2 and (by == 0 or i < 0) for i, _ in rows}


def test_nearest_of_blocks_ranks_as_spark_does(spark, tmp_path, monkeypatch):
    from pyspark.sql import Window as W

    from bidlattice.functions import values
    from bidlattice.operators import retrieval as ret
    from bidlattice.plans import retrieval as plans

    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(120).select("vec_id", "embedding", "label")
    k = F.col("vec_id")
    odd = F.when(k % 13 == 5, F.lit(None)).when(k % 17 == 3, F.transform("embedding", lambda x: x * 0)).when(k % 11 < 4, F.array(*[F.lit(float(i)).cast("float") for i in range(64)])).otherwise(F.col("embedding"))
    e = e.withColumn("embedding", odd).localCheckpoint()
    sf = folder(spark, tmp_path, embeddings=e.where("vec_id % 13 <> 5 and vec_id % 17 <> 3"))
    q = e.where("vec_id % 10 = 0").withColumn("b", F.lit(1))
    got = q.groupBy("b").cogroup(e.withColumn("b", F.lit(1)).groupBy("b")).applyInArrow(ret.nearest_of_blocks(30), "query long, item long, place long, hit boolean")
    near = F.round(values.cosine(F.col("q.embedding"), F.col("e.embedding")), 6)
    order = W.partitionBy("query").orderBy(F.desc("near"), "item")
    want = q.alias("q").join(e.alias("e"), F.col("q.vec_id") != F.col("e.vec_id")).select(F.col("q.vec_id").alias("query"), F.col("e.vec_id").alias("item"), near.alias("near"), F.coalesce(F.col("q.label") == F.col("e.label"), F.lit(False)).alias("hit"))
    want = want.withColumn("rank", F.row_number().over(order)).where("rank <= 30").select("query", "item", "rank", "hit")
    got = got.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("place", "item"))).select("query", "item", "rank", "hit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(plans, "ROW_BLOCK", 40)
    monkeypatch.setattr(plans, "QUERY_BLOCK", 3)
    df = catalogue.QUERIES["e27_mrr_recall_metrics"](spark, sf)
    assert "CoGroups" in plan_of(df) and "zip_with" not in plan_of(df)
    assert differences(df, catalogue.ORACLE_SQL["e27_mrr_recall_metrics"], sf) == ""


def test_references_alone_go_to_python(spark):
    import html

    from bidlattice.functions import text

    texts = ["", "no reference", "&", "a&b &amp;&lt;x&gt;&amp;lt; R&D &#65;&#x42;&#x1F600; &notit; &notin; &#0;&#1114112; é&eacute", "&amp", "&#12345678901234567890;", "&" * 5 + ";", "x&" + "y" * 40 + ";z\n&nbsp;", "&中\U0001f600;&copy2", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.unescape(F.col("t")).alias("u"), "t")
    assert {r.i: r.u for r in d.collect()} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    udf = [x for x in plan_of(d).splitlines() if "ArrowEvalPython" in x]
    assert udf and all("regexp_extract_all" in x or "_unescape_all(pythonUDF" in x for x in udf)


def test_requirements_that_ask_the_same_are_one_question(spark, tmp_path):
    """Rows of the join with records don't grow with the requirements."""
    s = spark.read.parquet(f"{SF}/supplier.parquet")
    more = s.crossJoin(spark.range(42).withColumnRenamed("id", "i")).withColumn("s_suppkey", F.col("s_suppkey") + F.col("i") * 420).drop("i").repartition(1)
    sf = folder(spark, tmp_path, supplier=more)
    df = catalogue.QUERIES["n4_rule_types"](spark, sf)
    assert differences(df, catalogue.ORACLE_SQL["n4_rule_types"], sf) == ""
    joins = [x for x in plan_of(df).splitlines() if "Join" in x and "at_" in x]
    assert joins and not any("run_id" in x for x in joins)


def test_sentencepiece_query_encodes_and_decodes_every_document(spark, tmp_path):
    import __spark_entry__

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(4)
    d = d.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " a \u2581b\n")], "doc_id long, text string"))
    sf = folder(spark, tmp_path, documents=d)
    rows = __spark_entry__.queries()["op10_sentencepiece_sampling"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.text == texts[r.doc_id] and r.round_trip and len(r.ids) == r.n_pieces for r in rows)
