"""Bounds that hold whatever repeats, texts of very many lines, odd column names."""

import time

import pytest
from pyspark.sql import functions as F

from bidlattice.llm import langid, lines, mixing, pieces, quality, queries

SF = "/root/testdata/sf0.001"


def test_training_samples_are_bounded_by_documents(spark, monkeypatch):
    rows = [(1, f"the cat and the dog number {i}", "en") for i in range(3000)] + [(i, "über größe und das", "de") for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = []
    fit = langid.fit_ftrl
    monkeypatch.setattr(langid, "fit_ftrl", lambda bags, n, **k: fitted.append(len(bags)) or fit(bags, n, **k))
    assert langid.train(docs, per_language=64).languages == ["de", "en"] and fitted[0] <= 2 * 64
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 300)] * 2, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "fit", lambda bags: fitted.append(len(bags)))
    quality.train(docs, labels, limit=10)
    assert fitted[-1] <= 10
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)


def test_lines_of_one_text_take_linear_time(spark):
    few = [(i, f"common line that is here a\nown words {i}") for i in range(12)]
    took = {}
    for n in (1000, 250_000, 1_000_000):
        text = "\n".join("common line that is here a" if k % 2 else f"other text number w{k} of it all{k}" for k in range(n))
        begin = time.time()
        got = lines.drop_recurring_lines(spark.createDataFrame([*few, (99, text)], "doc_id long, text string"), whole=True).where("doc_id = 99").select("n_lines", "n_dropped", F.size(F.split("text", "\n"))).first()
        took[n] = time.time() - begin
        assert tuple(got) == (n, n // 2, n // 2)
    assert took[1_000_000] < 6 * took[250_000] + 10


def test_long_lines_are_a_parameter(spark):
    line = " ".join(f"w{chr(97 + i)}" for i in range(20))
    docs = spark.createDataFrame([(1, line + "\na"), (2, line + "\nb")], "doc_id long, text string")
    assert [sum(r.n_dropped for r in lines.drop_recurring_lines(docs, whole=True, long=n).collect()) for n in (50, 20)] == [0, 1]


def test_odd_column_names_pass_through(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit("x")).withColumn("topic", F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs.limit(3), SF).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    assert pieces.decode_samples(last, queries.tokenizer_path()).columns == [*last.columns, "text"]


def test_deviation_of_the_rake(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 12)
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "s string, l string, tokens long")
    ask = lambda s, l: {"s": spark.createDataFrame(s, "s string, target double"), "l": spark.createDataFrame(l, "l string, target double")}
    fine = mixing.rake(cells, ask([("a", 0.3), ("b", 0.7)], [("x", 0.3), ("y", 0.7)])).collect()
    assert all(r.deviation < 1e-6 for r in fine)
    with pytest.warns(UserWarning, match="not settled"):  # a and x are one cell, so that 0.3 and 0.5 can't both hold
        never = mixing.rake(cells, ask([("a", 0.3), ("b", 0.7)], [("x", 0.5), ("y", 0.5)])).collect()
    assert all(r.deviation > 0.1 for r in never)


def test_line_stage_against_sql(spark):
    """The pipeline's line stage on whole documents against the SQL of the operator."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parents[1]))
    import corpus_pipeline
    from oracle import sql_rows

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.line_dedup(spark, docs, SF).select("doc_id", "n_chars", F.md5("text").alias("m")).collect()
    names, rows = sql_rows(lines.oracle(whole=True), SF)
    at = {n: i for i, n in enumerate(names)}
    want = {r[at["doc_id"]]: (r[at["n_chars_kept"]], r[at["text_md5"]]) for r in rows if r[at["n_dropped"]] == 0 or r[at["n_chars_kept"]]}
    blank = {i for i, (n, _) in want.items() if n} - {r.doc_id for r in kept}  # white space alone goes too
    assert {r.doc_id: (r.n_chars, r.m) for r in kept} == {i: v for i, v in want.items() if i not in blank} and len(blank) < 5
