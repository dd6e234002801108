"""Permission-filtered hybrid retrieval: keyword and vector ranks, fused, reranked, and measured."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, values


def ready(chunks: DataFrame) -> bool:
    """K1: whether any chunk is current."""
    return not chunks.where("index_status = 'current'").limit(1).isEmpty()


def keyword_search(chunks: DataFrame, query: str, k: int, body: str = "text", key: str = "chunk_id") -> DataFrame:
    """The k best visible chunks by keyword score; all are scored, ties go to the smaller key.

    The query's tokens are constants, so that each text is normalised once; chunks without a hit go after the cut, where
    no filter can be pushed below the columns that it needs.
    """
    tokens = chunks.sparkSession.range(1).select(text.tokenise(F.lit(query))).first()[0]
    norm = chunks.select(key, text.normalise_keyword(F.col(body)).alias("__s"))
    places = F.array(*[F.position(F.lit(w), F.col("__s")) for w in tokens]).cast("array<int>")
    placed = norm.select(key, F.length("__s").alias("__n"), places.alias("__p"))
    best = placed.select(key, F.round(values.keyword_score(F.col("__p"), F.col("__n")), 9).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.where("score > 0")


def vector_search(chunks: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest chunks by exact cosine; each task keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.select(key, F.round(values.cosine(F.col(vector), q), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)


#: Cosines as millionths: a place of 0 is the best there is (not a number sorts first), NOWHERE that of a missing cosine.
_ONE, NOWHERE = 1_000_001, 3_000_000
#: Queries of a block whose cosines are held at once.
_AT_ONCE = 128


def _vectors(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the rows whose vectors have it, and these as a matrix; rows with a missing vector or component are in none."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    size = pc.fill_null(pc.list_value_length(whole), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(whole)
    begin = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    size = np.where(gaps[begin[1:]] > gaps[begin[:-1]], -1, size)
    values_ = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    rows = [(n, np.flatnonzero(size == n)) for n in np.unique(size[size > 0]).tolist()]
    return [(at, values_[(begin[at][:, None] + np.arange(n)).ravel()].reshape(-1, n)) for n, at in rows]


def nearest_of_blocks(k: int):
    """K3 for many queries: of a block of queries and one of rows (vec_id, label, embedding) the k nearest rows of each query
    but itself, for a cogroup in Arrow: (query, item, place, hit); hit: both have the same label.

    Places order cosines to six decimals from the largest on, ties go to the smaller item; a missing cosine comes last.
    """

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        query, item = (x.column("vec_id").to_numpy().astype(np.int64) for x in (asked, rows))
        theirs, out_q, out_r, out_p = {m.shape[1]: (at, m) for at, m in _vectors(rows.column("embedding"))}, [], [], []
        own = {m.shape[1]: (at, m) for at, m in _vectors(asked.column("embedding"))}
        found = np.zeros(len(query), bool)
        lots = []
        for n, (at, m) in own.items():
            found[at] = True
            lots += [(at[i : i + _AT_ONCE], m[i : i + _AT_ONCE], theirs.get(n)) for i in range(0, len(at), _AT_ONCE)]
        rest = np.flatnonzero(~found)
        lots += [(rest[i : i + _AT_ONCE], None, None) for i in range(0, len(rest), _AT_ONCE)]
        for at, m, other in lots if len(item) else ():
            place = np.full((len(at), len(item)), NOWHERE, np.int64)
            if other is not None:
                with np.errstate(all="ignore"):
                    length = np.sqrt((m * m).sum(1))[:, None] * np.sqrt((other[1] * other[1]).sum(1))
                    near = (m @ other[1].T) / length
                    worth = np.copysign(np.floor(np.abs(near) * 1e6 + 0.5), near)
                    worth = np.where(length == 0, _ONE - NOWHERE, np.where(np.isnan(near), _ONE, worth))
                place[:, other[0]] = _ONE - worth.astype(np.int64)
            gone = query[at][:, None] == item
            order = np.where(gone, np.iinfo(np.int64).max, place * len(item) + np.arange(len(item)))  # items ascend, so ties go to the smaller one
            best = np.argpartition(order, k, axis=1)[:, :k] if len(item) > k else np.tile(np.arange(len(item)), (len(at), 1))
            i, j = np.nonzero(~np.take_along_axis(gone, best, 1))
            out_q.append(at[i]), out_r.append(best[i, j]), out_p.append(place[i, best[i, j]])
        a, b, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_r, out_p))
        same = pc.equal(asked.column("label").take(pa.array(a)), rows.column("label").take(pa.array(b)))
        return pa.table({"query": query[a], "item": item[b], "place": p, "hit": pc.fill_null(same, False)})

    return run


def fuse(keyword: DataFrame, vector: DataFrame, key: str, k: int, base: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two short ranked lists; ties go to the smaller key."""
    rank = lambda df, name: df.select(key, F.row_number().over(W.orderBy(F.desc("score"), key)).alias(name))
    part = lambda c: F.coalesce(1.0 / (base + F.col(c)), F.lit(0.0))
    j = rank(keyword, "r_keyword").join(rank(vector, "r_vector"), key, "full_outer")
    return j.select(key, "r_keyword", "r_vector", F.round(part("r_keyword") + part("r_vector"), 9).alias("rrf")).orderBy(F.desc("rrf"), key).limit(k)


def reranked(pool: DataFrame, score: Callable[[DataFrame], DataFrame] | None, key: str, k: int) -> tuple[DataFrame, str]:
    """K5: the pool by a caller's scores (key, rerank); without a scorer, or where a score is missing or not finite, the base order stands."""
    order = [F.desc("rrf"), F.col(key)]
    if score is None:
        return pool.orderBy(*order).limit(k), "rerank_degraded"
    scored = pool.join(score(pool), key, "left")
    bad = scored.where(F.col("rerank").isNull() | F.isnan("rerank") | (F.abs("rerank") == float("inf"))).limit(1)
    if not bad.isEmpty():
        return pool.orderBy(*order).limit(k), "rerank_degraded"
    return scored.orderBy(F.desc("rerank"), key).limit(k), "reranked"


def rank_scores(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """1 / rank to six places, for a short list."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("relevance", F.round(1 / F.col("rank"), 6))


def hybrid_search(chunks: DataFrame, visible: Column, query: str, vector: Sequence[float] | None, k: int = 20, scorer=None) -> tuple[DataFrame, str]:
    """K6: visible chunks only, then keyword and vector ranks, fusion and rerank; without a vector by keyword alone."""
    seen = chunks.where(visible)
    n = values.pool_size(k)
    keyword = keyword_search(seen, query, n)
    if vector is None:
        return keyword.withColumnRenamed("score", "rrf").limit(k), "keyword_only"
    return reranked(fuse(keyword, vector_search(seen, vector, n, key="chunk_id"), "chunk_id", n), scorer, "chunk_id", k)


def index_status(chunks: DataFrame) -> DataFrame:
    """K7: chunks of each material version by index status."""
    return chunks.groupBy("material_id", "material_version").pivot("index_status", ["current", "stale"]).count().fillna(0, ["current", "stale"])


def reindexed(stored: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("material_id", "chunk_seq", "content_hash")) -> DataFrame:
    """K8: stored and fresh chunks without repeats; all but the newest version of each material are stale."""
    every = stored.unionByName(fresh.join(stored.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
    top = every.groupBy("material_id").agg(F.max("material_version").alias("__top"))
    return every.join(top, "material_id").withColumn("index_status", F.when(F.col("material_version") == F.col("__top"), "current").otherwise("stale")).drop("__top")


def embedded(df: DataFrame, embed: Callable, body: str = "text") -> DataFrame:
    """K9: vectors by a caller's batch function (a pandas UDF from text to array<float>)."""
    return df.withColumn("embedding", embed(F.col(body)))


def hashing_embedder(width: int = 64):
    """A deterministic embedder for tests: tokens hashed into signed buckets."""
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        import zlib

        def one(t: str) -> list[float]:
            v = [0.0] * width
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h & (1 << 20) else -1.0
            return v

        return s.map(one)

    return embed


def retrieval_key(query: Column, filters: Column) -> Column:
    """The key under which a retrieval run is kept and replayed."""
    return values.joined_hash(text.normalise_keyword(query), filters, length=32)
