"""Keyword, vector and hybrid retrieval with its metrics (inventory K, E27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values
from ..operators import reporting as rep
from ..operators import retrieval as ret
from .registry import Tables, query

WORDS = "the of and er"
#: Queries, and rows, in one block of the join.
QUERY_BLOCK, ROW_BLOCK = 4096, 8192
KEYWORD = """t AS (SELECT doc_id AS chunk_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS s FROM documents), w AS (SELECT unnest(['the', 'of', 'and', 'er']) AS w),
 h AS (SELECT chunk_id, s, count(*) FILTER (instr(s, w) > 0) AS hits, min(instr(s, w) - 1) FILTER (instr(s, w) > 0) AS first FROM t, w GROUP BY 1, 2),
 k AS (SELECT chunk_id, round(hits / sqrt(greatest(length(s), 1)) * (1 + 1 / (1 + first / 200.0)), 9) AS score FROM h WHERE hits > 0)"""


def _chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"WITH {KEYWORD} SELECT chunk_id, score FROM k ORDER BY score DESC, chunk_id LIMIT 60")
def k2_keyword_topk(t: Tables) -> DataFrame:
    return ret.keyword_search(_chunks(t), WORDS, 60)


def _probe(t: Tables) -> list[float]:
    """The query vector: that of the row with vec_id 0, as a caller would hand it over."""
    return [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]


COSINE = "v AS (SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)"


@query(f"WITH {COSINE} SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT 20")
def k3_cosine_topk(t: Tables) -> DataFrame:
    return ret.vector_search(t.embeddings, _probe(t), 20)


@query(f"""WITH {KEYWORD}, {COSINE}, a AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r_keyword FROM k QUALIFY r_keyword <= 60), b AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r_vector FROM v QUALIFY r_vector <= 60)
 SELECT chunk_id, r_keyword, r_vector, round(coalesce(1.0 / (60 + r_keyword), 0) + coalesce(1.0 / (60 + r_vector), 0), 9)::DOUBLE AS rrf FROM a FULL JOIN b USING (chunk_id) ORDER BY rrf DESC, chunk_id LIMIT 20""")
def k4_rrf_hybrid(t: Tables) -> DataFrame:
    n = values.pool_size(20)
    vector = ret.vector_search(t.embeddings, _probe(t), n).withColumnRenamed("vec_id", "chunk_id")
    return ret.fuse(ret.keyword_search(_chunks(t), WORDS, n), vector, "chunk_id", 20)


@query("""WITH q AS (SELECT vec_id AS query, label, embedding FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT query, e.vec_id AS item, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM q, embeddings e WHERE e.vec_id <> query),
 g AS (SELECT query, e.vec_id AS item FROM q JOIN embeddings e USING (label) WHERE e.vec_id <> query), j AS (SELECT g.query, min(rank) AS first, count(*) FILTER (rank <= 10) AS found, count(*) AS wanted FROM g LEFT JOIN r ON r.query = g.query AND r.item = g.item AND rank <= 50 GROUP BY 1)
 SELECT count(*) AS queries, sum(found)::DOUBLE / sum(wanted) AS recall, avg(1.0 / first) AS mrr FROM j""")
def e27_mrr_recall_metrics(t: Tables) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows, in blocks of both, ranked to 50 places, judged by label.

    A block takes its cosines as one product of matrices and keeps 50 rows a query before they meet; a query's gold is as many rows as its label has, but itself.
    """
    e = t.embeddings
    asked = e.where("vec_id % 20 = 0")
    q_blocks, r_blocks = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-e.count() // ROW_BLOCK))
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("vec_id", "label", "embedding", salt(q_blocks).alias("qb"), every(r_blocks).alias("rb"))
    rows = e.where("vec_id is not null").select("vec_id", "label", "embedding", salt(r_blocks).alias("rb"), every(q_blocks).alias("qb"))
    near = q.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInArrow(ret.nearest_of_blocks(50), "query long, item long, place long, hit boolean")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("place", "item"))).where("rank <= 50")
    wanted = asked.select(F.col("vec_id").alias("query"), "label").join(e.groupBy("label").agg((F.count("*") - 1).alias("wanted")), "label").where("wanted > 0")
    return rep.metrics_of_hits(ranked.where("hit").select("query", "rank"), wanted.select("query", "wanted"), 10)


@query("""SELECT lang AS material_id, doc_id % 3 AS material_version, count(*) FILTER (doc_id % 9 <> 0) AS current, count(*) FILTER (doc_id % 9 = 0) AS stale FROM documents GROUP BY 1, 2""")
def k7_index_status(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("lang").alias("material_id"), (F.col("doc_id") % 3).alias("material_version"), F.when(F.col("doc_id") % 9 == 0, "stale").otherwise("current").alias("index_status"))
    return ret.index_status(d)


@query("""WITH s AS (SELECT doc_id % 50 AS material_id, 1 AS material_version, doc_id AS chunk_seq, md5(text) AS content_hash FROM documents), f AS (SELECT doc_id % 50 AS material_id, CASE WHEN doc_id % 50 < 10 THEN 2 ELSE 1 END AS material_version, doc_id AS chunk_seq, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5(text || 'x') END AS content_hash FROM documents),
 e AS (SELECT * FROM s UNION ALL SELECT f.* FROM f ANTI JOIN s USING (material_id, chunk_seq, content_hash)) SELECT *, CASE WHEN material_version = max(material_version) OVER (PARTITION BY material_id) THEN 'current' ELSE 'stale' END AS index_status FROM e""")
def k8_reindex_marks_stale(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rows = lambda version, text: t.documents.select((k % 50).alias("material_id"), version.alias("material_version"), k.alias("chunk_seq"), F.md5(text).alias("content_hash"))
    again = F.when(k % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    return ret.reindexed(rows(F.lit(1), F.col("text")), rows(F.when(k % 50 < 10, 2).otherwise(1), again))
