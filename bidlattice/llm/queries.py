"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, exponion, hilbert, htmltext, langid, lines, minhash, mixing, personal, pieces, prefixes, quality, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The SentencePiece model on the driver; BIDLATTICE_TOKENIZER names another."""
    return os.environ.get("BIDLATTICE_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.identify(docs, model)
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(_table(spark, sf_dir, "pages"), htmltext.train(htmltext.sample_pages()))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _lines_left(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the pipeline drops them: long ones from the second document on, short ones, several templates a leaf."""
    return _lines_left(lines.drop_recurring_lines(_table(spark, sf_dir, "documents"), whole=True))


def line_templates_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup by masked lines and general forms of three tokens and more alone."""
    return _lines_left(lines.drop_recurring_lines(_table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    graded = quality.grade_documents(docs.select("doc_id", "text"), model)
    return graded.select("doc_id", "expected_grade", "tail_probability", F.col("accepted").alias("kept"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", F.col("sampled").alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, null as an empty one, encoded to ids and decoded again; round_trip compares what the ids spell with the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own_md5", F.md5("text"))
    decoded = pieces.decode_samples(pieces.encode_samples(docs, tokenizer_path(), keep="own_md5"), tokenizer_path())
    return decoded.select("doc_id", "rank", "score", "log_prob", "n_pieces", "ids", "text", (F.md5("text") == F.col("own_md5")).alias("round_trip"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_digests(personal.personal_spans(_table(spark, sf_dir, "documents")))


def op12_conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.clusters_with_inertia(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_language_id, op3_html_extraction, op4_nearest_neighbours, op5_line_dedup, op6_quality_classifier, op7_url_filters,
        op8_source_mixing, op9_exact_dedup, op10_sentencepiece_sampling, op11_personal_data, op12_conversation_prefixes, op13_centroid_clustering, line_templates_only,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": lines.oracle(whole=True),
    "line_templates_only": lines.oracle(whole=False),
    "op7_url_filters": urls.ORACLE,
    "op9_exact_dedup": exact.ORACLE,
    "op12_conversation_prefixes": prefixes.ORACLE,
    "op13_centroid_clustering": exponion.oracle(),
}
