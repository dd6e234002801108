"""Approximate nearest neighbours by shifted space-filling curves.

Every distinct vector gets a key on each of several Hilbert curves: a random projection of its direction to DIMS
coordinates, a random shift, BITS bits a coordinate. One range-partitioned sort over (curve, key, id), without the
vectors, gives each vector its rank on each curve. A query meets all vectors whose rank is within `window` of its own on
some curve; the windows are read in blocks of fixed size, scored on the original vectors, and their best hits merge.

Window and number of curves are fitted, not guessed: the true neighbours of at most SAMPLE_QUERIES queries are found by
scanning all rows (a bounded block of queries against everything). For each number of curves the window is the rank
distance that covers `recall` of them on their nearest curve; that number is taken whose windows copy the least, two
curves at least. Vectors with low-dimensional structure get narrow windows; for vectors without any, no curve keeps
neighbours together and the window grows to a share of the rows, read along few curves. Scale and centre of the
projections come from at most SAMPLE_ROWS rows; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import stash
from .minhash import _grouped

CURVES, DIMS, BITS = 8, 6, 8
#: BLOCK: ranks in one block. ASKING: about how many queries meet a block in one group.
SAMPLE_ROWS, SAMPLE_QUERIES, BLOCK, ASKING = 4096, 128, 2048, 2048


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (integers of so many bits in each coordinate)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the sub-cubes, from the largest down
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class _Curves:
    """Projections, shifts and scales of all curves."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        width = sample.shape[1]
        dims = min(DIMS, width)
        self.axes = [np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(CURVES)]
        self.shift = rng.random((CURVES, dims))
        seen = [sample @ a for a in self.axes]
        self.centre = [s.mean(axis=0) for s in seen]
        self.scale = [np.maximum(s.std(axis=0), 1e-12) for s in seen]

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        out = []
        for a, s, c, d in zip(self.axes, self.shift, self.centre, self.scale, strict=True):
            z = ((unit @ a - c) / d).clip(-4, 4) / 16 + 0.25  # [0, 0.5]; the shift moves it within [0, 1]
            out.append(hilbert_keys(((z + s * 0.5) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1), BITS))
        return out


def _index(curves, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, keys in enumerate(curves.value.keys(_unit(_vectors(batch.column("embedding"), width)))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), batch.column("id"), batch.column("asked")],
                    names=["curve", "key", "id", "asked"],
                )

    return run


def _cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of pairs of vectors along the last axis, added up one component after another in double precision."""
    fold = lambda x: np.cumsum(x, axis=-1)[..., -1]
    return fold(q * rows) / (np.sqrt(fold(q * q)) * np.sqrt(fold(rows * rows)))


def _best(asked: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most best rows for each asked vector: query id, row id, cosine; ties go to the smaller row id.

    Products of unit vectors choose the rows, with a margin for rounding; where more than `most` fall within it, all of
    them are compared exactly.
    """
    score = _unit(asked) @ _unit(rows).T
    most = min(most, score.shape[1])
    top = np.argpartition(-score, most - 1, axis=1)[:, :most]
    exact = _cosines(asked[:, None, :], rows[top])
    least = np.take_along_axis(score, top, axis=1).min(axis=1) - 1e-12
    for i in np.flatnonzero((score >= least[:, None]).sum(axis=1) > most).tolist():
        near = np.flatnonzero(score[i] >= least[i])
        own = _cosines(asked[i], rows[near])
        first = np.lexsort((ids[near], -own))[:most]
        top[i], exact[i] = near[first], own[first]
    return np.repeat(q_ids, most), ids[top].ravel(), exact.ravel()


def _hits(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q, i, s = (np.concatenate(x) if found else np.zeros(0) for x in (zip(*found, strict=True) if found else ([], [], [])))
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(s.astype(np.float64))], names=["q", "id", "near"])


def _scan(shared, width: int, most: int):
    """Exact hits of a bounded block of queries; kept small from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, asked = shared.value
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy()
                for a in range(0, len(ids), 8192):
                    part = batch.column("embedding").slice(a, 8192)
                    yield _hits([_best(asked, q_ids, _vectors(part, width), ids[a : a + 8192], most)])

    return run


def _search(width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "grp"):
            table = table.combine_chunks()
            grp, ids, asks = (table.column(c).to_numpy() for c in ("grp", "id", "asks"))
            whole = _vectors(table.column("embedding").chunk(0), width)
            cut = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
            found = []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                a = asks[lo:hi]
                rows, own = whole[lo:hi][~a], ids[lo:hi][~a]
                q, q_ids = whole[lo:hi][a], ids[lo:hi][a]
                for at in range(0, len(q) if len(rows) else 0, 512):
                    found.append(_best(q[at : at + 512], q_ids[at : at + 512], rows, own, most))
            yield _hits(found)

    return run


def _top(hits: DataFrame, most: int) -> DataFrame:
    best = hits.groupBy("q", "id").agg(F.max("near").alias("near"))
    return best.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("near"), "id"))).where(F.col("n") <= most).drop("n")


def _window(gaps: DataFrame, curves: int, recall: float, total: int, asked: int) -> tuple[int, int]:
    """The number of curves and the window that cover recall of the true pairs with the fewest rows copied.

    gaps (q, id, curve, gap) holds the rank distance of a bounded number of pairs on each curve.
    """
    table = gaps.toArrow()
    if not table.num_rows:
        return min(2, curves), 1
    pair = np.unique(np.stack([table.column(c).to_numpy() for c in ("q", "id")], axis=1), axis=0, return_inverse=True)[1].ravel()
    gap = np.full((pair.max() + 1, curves), total, np.int64)
    gap[pair, table.column("curve").to_numpy()] = table.column("gap").to_numpy()
    best = None
    for n in range(min(2, curves), curves + 1):
        window = int(np.quantile(gap[:, :n].min(axis=1), recall, method="higher")) + 1
        copies = n * (total + asked * (2 * min(window, total) / BLOCK + 1))
        if best is None or copies < best[0]:
            best = copies, n, window
    return best[1:]


def nearest(vectors: DataFrame, queries, k: int = 5, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that the condition `queries` picks.

    vectors needs vec_id (unique) and embedding, an array of float or double; other columns are ignored. Nearness is the
    cosine in double precision; ties go to the smaller vec_id; a query is no candidate of its own. Vectors that are null,
    empty, zero, of another length than most (no cosine is defined with those), or that hold a null or a non-finite
    component take no part. Equal vectors are indexed once, with their k + 1 smallest vec_ids, so a vector that a third of
    the rows share is one entry. Of repeated rows with one vec_id each counts as a candidate. With no valid vector or no
    query the result is empty; with fewer candidates than k all are returned.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    vectors = vectors.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.select("vec_id", "embedding", F.coalesce(queries, F.lit(False)).alias("asked")).where(
        F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    )
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sound.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return empty
    width = width.w
    sound = sound.where(F.size("embedding") == width)
    few = sound.withColumn("n", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = sound.where("asked").groupBy("embedding").agg(F.lit(True).alias("asked"))
    classes = stash(
        classes.join(asked, "embedding", "left").select(F.element_at("ids", 1).alias("id"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "embedding")
    )
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("embedding").toArrow().column("embedding").combine_chunks()
    few_queries = classes.where("asked").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).select("id", "embedding").toArrow().combine_chunks()
    if not few_queries.num_rows:
        return empty
    curves = spark.sparkContext.broadcast(_Curves(_unit(_vectors(sample, width))))
    keyed = classes.select("id", "asked", "embedding").mapInArrow(common.releasing(_index(curves, width)), "curve int, key long, id long, asked boolean")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stash(
        keyed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
        .select("curve", "id", "asked", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    begin, starts = 0, {}
    for row in placed.groupBy("part").count().orderBy("part").collect():  # one number a partition
        starts[row.part] = begin
        begin += row["count"]
    start = F.element_at(F.create_map(*[F.lit(x) for p in starts.items() for x in (p[0], int(p[1]))]), F.col("part")).cast("long")
    ranked = placed.select("curve", "id", "asked", (start + F.col("at") - F.col("curve").cast("long") * total).alias("rank"))

    truth = _top(classes.select("id", "embedding").mapInArrow(
        _scan(spark.sparkContext.broadcast((few_queries.column("id").to_numpy(), _vectors(few_queries.column("embedding").chunk(0), width))), width, k + 1),
        "q long, id long, near double"), k + 1)
    ranks = ranked.select("curve", "id", "rank")
    gaps = (
        truth.where("q <> id").join(ranks, "id").join(ranks.select("curve", F.col("id").alias("q"), F.col("rank").alias("q_rank")), ["curve", "q"])
        .select("q", "id", "curve", F.abs(F.col("rank") - F.col("q_rank")).alias("gap"))
    )
    n_asked = classes.where("asked").count()
    used, window = _window(gaps, CURVES, recall, total, n_asked)

    block = lambda r: F.floor(r / F.lit(BLOCK))
    # of each vector one row travels, with its ranks on the curves in use; blocks that many queries meet are copied per chunk of these
    chunks = max(1, -(-(n_asked * min(total, 2 * window + BLOCK)) // (total * ASKING)))
    salts = F.sequence(F.lit(0), F.lit(chunks - 1))
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(chunks)).cast("int")
    places = ranked.where(F.col("curve") < used).groupBy("id", "asked").agg(F.collect_list(F.struct("curve", "rank")).alias("at"))  # as many as curves
    whole = places.join(classes.select("id", "embedding"), "id").select("id", "asked", "embedding", F.explode("at").alias("p"))
    rows = whole.select(F.lit(False).alias("asks"), "p.curve", "id", "embedding", block(F.col("p.rank")).alias("block"), F.explode(salts).alias("chunk"))
    asking = whole.where("asked").select(
        F.lit(True).alias("asks"), "p.curve", "id", "embedding",
        F.explode(F.sequence(block(F.greatest(F.lit(0), F.col("p.rank") - window)), block(F.least(F.lit(total - 1), F.col("p.rank") + window)))).alias("block"),
        own.alias("chunk"),
    )
    hits = (
        rows.unionByName(asking).withColumn("grp", F.xxhash64("curve", "block", "chunk")).repartition("grp").sortWithinPartitions("grp")
        .select("grp", "asks", "id", "embedding").mapInArrow(common.releasing(_search(width, k + 1)), "q long, id long, near double")
    )
    best = _top(hits, k + 1)
    scored = best.join(classes.select("id", "ids"), "id").select("q", F.col("near").alias("score"), F.explode("ids").alias("vec_id"))
    ahead = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    scored = scored.withColumn("n", ahead).where(F.col("n") <= k + 1).drop("n")
    of_q = classes.where("asked").select(F.col("id").alias("q"), F.col("embedding").alias("q_vector"))
    members = sound.where("asked").select(F.col("vec_id").alias("query_id"), "embedding").join(of_q, F.col("embedding") == F.col("q_vector")).select("query_id", "q")
    pairs = members.join(scored, "q").where("vec_id <> query_id")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
