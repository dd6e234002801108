"""Centroid clustering of integer vectors by Lloyd rounds with Exponion search.

Each vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other. A
round moves the bounds by what the centroids moved. Where the lower bound, or half the way to the nearest other centroid,
is beyond the upper bound, nothing is looked at. Otherwise only the centroids in a ball around the current one are
scanned: the list of the others, sorted by distance from it, up to 2 x upper + distance of its nearest neighbour. That
ball holds the nearest and the second nearest centroid; its radius is inclusive, so that ties are seen. Bounds are rounded
outwards and decide only what is skipped: assignments compare exact integer distances.

Vectors stay where they were read: a round is a map over a table in the shared folder, and what is shuffled is one row of
exact sums for each task and centroid, taken of the vectors that changed their centroid. The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import stash

#: Largest size of an integer component: with it a squared distance over 64 components fits a long.
LARGEST = 1 << 27
#: Vectors that are compared at once.
SLICE = 4096
_UP, _DOWN = 1 + 2.0**-49, 1 - 2.0**-49


class _Round:
    """The centroids of a round, the sorted lists of their distances, and how far each has moved since the last."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2).astype(np.float64))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.reach = np.take_along_axis(apart, self.order, axis=1) * _DOWN
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1)
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)) * _UP
        self.moved = moved
        self.others = np.full(len(moved), moved.max())
        if len(moved) > 1:  # the farthest mover's own bound is against the second farthest
            self.others[moved.argmax()] = np.partition(moved, -2)[-2]
        else:
            self.others[:] = 0.0

    def assign(self, v: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bring near, upper and lower up to date in place; returns how many centroids each vector was compared with."""
        upper[:] = (upper + self.moved[near]) * _UP
        lower[:] = lower - self.others[near] - (lower + self.others[near]) * 2.0**-49
        looked = np.zeros(len(v), np.int64)
        open_ = np.flatnonzero(~(np.maximum(lower, self.nearest[near] * (0.5 * _DOWN)) > upper))
        bounded = open_[np.isfinite(upper[open_])]
        upper[bounded] = np.sqrt(self.squared(v[bounded], near[bounded]).astype(np.float64)) * _UP
        looked[bounded] += 1
        open_ = open_[~(np.maximum(lower[open_], self.nearest[near[open_]] * (0.5 * _DOWN)) > upper[open_])]
        start = near[open_]
        ball = (2 * upper[open_] + self.nearest[start]) * _UP
        inside = (self.reach[start] <= ball[:, None]).sum(axis=1)  # the lists are sorted: those inside are their beginning
        best, who = np.full(len(open_), np.iinfo(np.int64).max), np.full(len(open_), len(self.centroids), np.int64)
        second = np.full(len(open_), np.inf)
        for r in range(int(inside.max(initial=0))):
            at = np.flatnonzero(inside > r)
            c = self.order[start[at], r]
            d = self.squared(v[open_[at]], c)
            wins = (d < best[at]) | ((d == best[at]) & (c < who[at]))
            behind = np.where(wins, np.where(who[at] < len(self.centroids), best[at].astype(np.float64), np.inf), d.astype(np.float64))
            second[at] = np.minimum(second[at], behind)
            best[at], who[at] = np.where(wins, d, best[at]), np.where(wins, c, who[at])
        looked[open_] += inside
        near[open_] = who
        upper[open_] = np.sqrt(best.astype(np.float64)) * _UP
        lower[open_] = np.sqrt(second) * _DOWN
        return looked

    def squared(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        gap = v - self.centroids[c]
        return (gap * gap).sum(axis=1)


def _step(shared, width: int):
    """A round over batches of (vec_id, v, near, upper, lower): the same with `was`, the centroid before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
                was = batch.column("near").to_numpy(zero_copy_only=False).astype(np.int64)
                near, upper, lower = was.copy(), *(batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower"))
                first = np.isinf(upper)
                looked = shared.value.assign(v, near, upper, lower)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(upper), pa.array(lower),
                     pa.array(np.where(first, -1, was).astype(np.int32)), pa.array(shared.value.squared(v, near)), pa.array(looked)],
                    names=["vec_id", "v", "near", "upper", "lower", "was", "distance", "looked"],
                )

    return run


def integer_vectors(rows: DataFrame, width: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): the vectors of exactly `width` components, none null or non-finite, each component floor(scale * x).

    A component beyond LARGEST stops the query with an error, since squared distances would not fit a long.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce((F.size(x) == width) & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))), F.lit(False))
    scaled = F.transform(x, lambda a: F.floor(F.lit(float(scale)) * a))
    fits = F.forall(x, lambda a: F.abs(a * scale) < LARGEST)
    told = F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for exact squared distances")).cast("array<int>"))
    return rows.where(sound).select("vec_id", told.alias("v"))


def _moves(state: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (rows, sums)} that the last round added to, or took off, each centroid: at most one row a centroid."""
    moved = state.where("near <> was")
    flows = moved.select(F.col("near").alias("c"), F.lit(1).alias("s"), "v").unionByName(moved.where("was >= 0").select(F.col("was").alias("c"), F.lit(-1).alias("s"), "v"))
    sums = [F.sum(F.col("s").cast("long") * F.get("v", F.lit(i))).alias(f"x{i}") for i in range(width)]
    return {r.c: (r.n, [r[f"x{i}"] for i in range(width)]) for r in flows.groupBy("c").agg(F.sum("s").alias("n"), *sums).collect()}


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, looked) of every kept vector, the final centroids as integers).

    rows needs vec_id and embedding; other columns are ignored. Centroids start as the k kept vectors with the smallest
    SHA-256 of salt and vec_id; of repeated vec_ids the smaller vector comes first, a null vec_id comes last. With fewer
    kept vectors there are as many centroids, with none the result is empty. Ties go to the smaller number. `looked` is the
    number of centroids that the last assignment compared a vector with.
    """
    spark = rows.sparkSession
    kept = integer_vectors(rows, width, scale)
    draw = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(draw.alias("d"), "v").orderBy(F.col("d").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("looked")).limit(0), np.zeros((0, width), np.int64)
    centroids, before = np.array([r.v for r in first], np.int64), None
    count, sums = [0] * len(centroids), [[0] * width for _ in centroids]
    kind = dict(kept.dtypes)["vec_id"]
    state = kept.select("vec_id", "v", F.lit(0).alias("near"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    schema = f"vec_id {kind}, v array<int>, near int, upper double, lower double, was int, distance long, looked long"
    last = None
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast(_Round(centroids, before))
        state = stash(state.select("vec_id", "v", "near", "upper", "lower").mapInArrow(common.releasing(_step(shared, width)), schema))
        if last is not None:
            common.discard(last)
        last = state
        if n == rounds:
            break
        for c, (more, added) in _moves(state, width).items():
            count[c] += more
            sums[c] = [a + b for a, b in zip(sums[c], added, strict=True)]
        before = centroids
        centroids = np.array([[s // count[c] for s in sums[c]] if count[c] else before[c].tolist() for c in range(len(before))], np.int64)
    return state.select("vec_id", F.col("near").alias("cluster"), "distance", "looked"), centroids


def clusters_with_inertia(rows: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; options as in cluster."""
    found, centroids = cluster(rows, **options)
    spark = rows.sparkSession
    totals = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(c, n, sum(totals.values()), digest[c]) for c, n in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256) -> str:
    """DuckDB SQL for clusters_with_inertia over embeddings with unique vec_ids: every vector against every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"""xs AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, vec_id FROM (SELECT vec_id, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k}))""",
        "m0 AS MATERIALIZED (SELECT c, i, x FROM c0 JOIN xs USING (vec_id))",
    ]
    for n in range(rounds + 1):
        parts += [
            f"d{n} AS MATERIALIZED (SELECT vec_id, c, sum((xs.x - m.x) * (xs.x - m.x))::BIGINT AS d FROM xs JOIN m{n} m USING (i) GROUP BY ALL)",
            f"a{n} AS MATERIALIZED (SELECT vec_id, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)",
        ]
        if n < rounds:
            parts += [
                f"s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{n} JOIN xs USING (vec_id) GROUP BY ALL)",
                f"m{n + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM m{n} m LEFT JOIN s{n} s USING (c, i))",
            ]
    parts.append(f"e AS (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN e USING (c)"""
