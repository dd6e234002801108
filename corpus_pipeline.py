"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlattice.llm import common, lines, minhash, mixing, pieces, quality, queries


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels of these documents, takes for good."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.grade_documents(docs, model).where("accepted").select(*common.columns_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; one that loses all its lines goes. n_chars follows the text."""
    out = lines.drop_recurring_lines(docs, whole=True).where("n_dropped = 0 or trim(text) <> ''")
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(common.quoted(c)) for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest doc_id."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*common.columns_of(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that holds the raked source, language and topic weights."""
    return mixing.mix_sources(docs).where("sampled").select(*common.columns_of(docs))


def sentencepiece_sampling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, rank, score, log_prob, n_pieces and ids of two sampled segmentations of each text."""
    return pieces.encode_samples(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece_sampling),
]

#: The classifier, the components and the sampled segmentations are beyond SQL. The tests hold the classifier, near-dedup
#: and mixing stages against plain versions, encoding against an exact round trip, and line dedup against small cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = []
        with common.sweeping(kept):
            docs = common.stash(stage(spark, docs, sf_dir))
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
