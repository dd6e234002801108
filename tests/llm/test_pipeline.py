"""The pipeline's stages against plain versions, each on its own input."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute
import corpus_pipeline as cp
from bidlattice.llm import common, lines, pieces, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(cp.STAGES)
    assert [k.split()[0] for k in stages] == ["quality", "line", "MinHash", "mixing", "SentencePiece"]
    seen = {}
    for name, stage in cp.STAGES:
        out = common.stash(stage(spark, docs, SF))
        seen[name] = (docs, out)
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    before, after = seen["MinHash near-dedup"]
    want = brute.components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in want.items() if c == i}
    before, after = seen["line dedup"]
    kept = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        if r.doc_id in kept:
            left = kept[r.doc_id].text.split("\n")
            lines = iter(r.text.split("\n"))
            assert all(x in lines for x in left) and kept[r.doc_id].n_chars == len(kept[r.doc_id].text)
    before, after = seen["SentencePiece encoding and decoding"]
    back = pieces.decode_samples(after, queries.tokenizer_path()).join(before.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.count() == after.count() and back.where("text <> was").count() == 0
    assert after.groupBy("doc_id").agg(F.countDistinct("ids").alias("n"), F.count("*").alias("m")).where("n <> m").count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = cp.quality_classifier(spark, docs, "/root/testdata/sf0.1").select("doc_id", F.lit(1).alias("k"))
    rate = lab.join(kept, "doc_id", "left").groupBy("quality", "toxic").agg(F.avg(F.coalesce("k", F.lit(0))).alias("a"))
    got = {(r.quality, r.toxic): r.a for r in rate.collect()}
    assert got[(1, 0)] > 0.98 and got[(1, 1)] < 0.1 and got[(0, 0)] < 0.2


def test_run_on_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_documents(spark, tmp_path):
    """Null, empty, long, repeated and clashing input: no stage fails, clean rows come through, and columns stay."""
    texts = [None, "", " \n", "word", " ".join(f"w{i % 977}" for i in range(60_000)), "a b c d e f g", "a b c d e f g"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, "no id", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in ("doc", "drop", "k_source", "rep", "rank")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = common.stash(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns and out.where("doc <> 'mine' or drop <> 'mine' or k_source <> 'mine'").count() == 0, name
        if name == "quality classifier":
            assert out.count() == docs.count()
        if name == "MinHash near-dedup":
            assert out.where("doc_id = 6").count() == 0 and out.where("doc_id = 5 or doc_id is null").count() == 2
        docs = out
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).where("n_pieces < 0").count() == 0


def test_quality_stage_keeps_what_the_model_accepts(spark):
    """The stage against probabilities worked out on the driver."""
    import pyarrow as pa
    from bidlattice.llm import quality

    docs, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, lab)
    rows = docs.collect()
    p = quality.probabilities(model, pa.array([r.text for r in rows]))[:, 1]
    assert {r.doc_id for r in cp.quality_classifier(spark, docs, SF).collect()} == {r.doc_id for r, x in zip(rows, p, strict=True) if x >= 0.5}


def test_mixing_stage_keeps_what_is_drawn(spark):
    from bidlattice.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in mixing.mix_sources(docs).collect() if r.probability > 0 and int(__import__("hashlib").md5(f"{r.doc_id}:17".encode()).hexdigest()[:13], 16) / (1 << 52) < r.probability}
    assert {r.doc_id for r in cp.source_mixing(spark, docs, SF).collect()} == want


def test_stash_collects_the_drivers_garbage(spark, monkeypatch):
    """Once the driver's heap has grown beyond its share, what earlier plans left goes with the next stash."""
    monkeypatch.setattr(common, "GROWN", 0)
    plan = spark._jvm.java.util.ArrayList()
    left = spark._jvm.java.lang.ref.WeakReference(plan)
    del plan
    common.discard(common.stash(spark.range(1)))
    assert left.get() is None


def test_line_dedup_plans_stay_small(spark):
    """The joins of the four kinds of recurring lines are written one by one: no plan of the stage holds them all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, write = [], common.stash

    def counted(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lines, "stash", counted)
        lines.drop_recurring_lines(docs, whole=True)
    assert max(sizes) <= 6 and len(sizes) >= 9
