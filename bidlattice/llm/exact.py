"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries (at most `counters` entries a task, then merged to `counters`) hold every digest with more than
one row in counters + 1. Those few are counted exactly with map-side combining, and their winners, at most `counters`
rows of fixed width, are broadcast: rows of a heavy digest never meet in a shuffle. All other digests are grouped by
an ordinary shuffle, in which no group can exceed that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: The white space that the comparison ignores.
SPACES = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _pruned(held: dict[str, int], counters: int) -> dict[str, int]:
    """Misra-Gries: take the (counters + 1)-th largest count off all and keep what is left."""
    if len(held) <= counters:
        return held
    cut = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -counters - 1)[-counters - 1])
    return {k: v - cut for k, v in held.items() if v > cut}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            counted = pc.value_counts(batch.column("digest"))
            for k, v in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + v
            held = _pruned(held, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"]
        )

    return run


def exact_duplicates(docs: DataFrame, counters: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs, which needs doc_id and text.

    Texts are equal when identical without white space `[\\x20\\x09-\\x0D]`; null counts as empty, and empty texts
    equal each other. Of equal texts the row with the most code points stays, then the smallest doc_id (a null doc_id
    comes last). Other columns are ignored; an empty table gives an empty result.
    """
    digests = stash(
        docs.select(
            "doc_id",
            F.length(F.coalesce("text", F.lit(""))).alias("size"),
            F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
        )
    )
    frequent = (
        digests.select("digest").mapInArrow(_summaries(counters), "digest string, n long")
        .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    )
    best = F.min(F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id")))
    winner = [F.count("*").alias("group_size"), best.alias("best")]
    heavy = stash(digests.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*winner))
    hot = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*winner), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.col("best.id").eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, digest AS text_sha256
FROM d WINDOW w AS (PARTITION BY digest ORDER BY size DESC, doc_id)
"""
