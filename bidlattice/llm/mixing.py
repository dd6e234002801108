"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The token weights of the cells (source, language, topic) are raked: scaled to one marginal after the other until all
hold. A document's probability follows from its cell: scale * weight / tokens, at most 1, where the scale is such that
the expected tokens meet the budget. A hash of doc_id and seed decides, so a rerun or a lost executor changes nothing.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, spare, stash

DIMS = ("source", "lang", "topic")
#: Largest number of cells that are broadcast to the documents; beyond it the join shuffles.
BROADCAST_CELLS = 50_000
ROUNDS, ROUNDS_A_JOB, TOLERANCE = 60, 4, 1e-6


def token_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null. Each word becomes one character, whose number is counted."""
    words = F.regexp_replace(text, r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*", "w")
    return F.when(text.rlike(r"[^ \t\n\x0B\f\r]"), F.length(words)).otherwise(0).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: table, web (holds a link or an address), brief (under 400 code points) or prose."""
    return (
        F.when(text.isNull(), "none").when(text.contains(" | "), "table")
        .when(text.contains("://") | text.contains("@"), "web").when(F.length(text) < 400, "brief").otherwise("prose")
    )


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def tempered_targets(cells: DataFrame, exponents: Mapping[str, float]) -> dict[str, DataFrame]:
    """Marginals that flatten the present shares: share ** exponent, scaled to sum 1."""
    out = {}
    for dim, power in exponents.items():
        share = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).select(dim, F.pow(F.col("n").cast("double"), power).alias("x"))
        total = share.agg(F.sum("x").alias("n")).first().n or 1.0
        out[dim] = share.select(dim, (F.col("x") / F.lit(float(total))).alias("target"))
    return out


def rake(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """cells (one row for each combination, with tokens > 0) plus weight, proportional to tokens within the marginals, and
    deviation: by which share of its target the marginal of the cell that is farthest off was off in the last round.

    Each of targets has one row (value, target) per value; values without a target keep weight 0. Stops once no
    marginal is off by more than TOLERANCE relatively, or after ROUNDS with a warning that says by how much: marginals that
    no weights meet (a value whose cells all belong to values of weight 0, say) never settle. The sums are windows over
    the cells, which are already aggregated: a round adds one exchange a marginal to the plan, where self-joins would
    double it.
    """
    for dim, target in targets.items():
        cells = cells.join(target.select(dim, F.col("target").alias(f"to_{dim}")), dim, "left").fillna(0.0, [f"to_{dim}"])
    dims = list(targets)
    s = spare(cells, "s")[0]
    live = F.lit(True)
    for dim in dims:
        live = live & (F.col(f"to_{dim}") > 0)
    now = stash(cells.withColumn("weight", F.when(live, F.col("tokens").cast("double")).otherwise(0.0)))
    held = now
    for _ in range(0, ROUNDS, ROUNDS_A_JOB):
        for _ in range(ROUNDS_A_JOB):
            off = []
            for dim in dims:
                now = now.withColumn(s, F.sum("weight").over(W.partitionBy(dim)))
                off.append(F.col(f"off_{dim}"))
                now = now.withColumn(f"off_{dim}", F.when(F.col("weight") > 0, F.abs(F.col(s) / F.col(f"to_{dim}") - 1)).otherwise(0.0))
                now = now.withColumn("weight", F.when(F.col(s) > 0, F.col("weight") * F.col(f"to_{dim}") / F.col(s)).otherwise(0.0)).drop(s)
        now = stash(now.withColumn("off", F.array_max(F.array(*off))))
        discard(held)
        held = now
        worst = now.agg(F.max("off").alias("x")).first().x
        done = now.drop(*[f"off_{d}" for d in dims])
        now = done.drop("off")
        if worst is None or worst <= TOLERANCE:
            break
    else:
        warnings.warn(f"the rake has not settled in {ROUNDS} rounds: a marginal is off by {worst:.2g} of its target", stacklevel=2)
    return done.withColumnRenamed("off", "deviation").drop(*[f"to_{d}" for d in dims])


def _scale(cells: DataFrame, budget: float) -> float:
    """The scale at which sum(min(1, scale * weight / tokens) * tokens) meets the budget; a few numbers per step."""
    scale = budget
    for _ in range(50):
        full = F.col("weight") * scale >= F.col("tokens")
        got = cells.where("weight > 0").agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if not got.free:
            return scale
        new = max(scale, (budget - got.capped) / got.free)
        if abs(new - scale) <= 1e-12 * scale:
            return new
        scale = new
    return scale


def uniform(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that the columns and the seed fix: 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    fraction: float = 0.5,
    seed: int = 17,
    exponents: Mapping[str, float] | None = None,
) -> DataFrame:
    """docs plus topic, tokens, weight (of its cell), deviation (how far the rake was from the cell's targets), probability
    and sampled.

    docs needs doc_id, text, source and lang. Without targets each marginal is the present one flattened by its
    exponent. A null source or lang is a value of its own. The budget is fraction of all tokens; documents without
    words belong to no cell: probability 0. Columns by the new names are replaced. Repeated rows share their fate.
    """
    docs = docs.drop("topic", "tokens", "weight", "deviation", "probability", "sampled")
    sized = docs.withColumns({"topic": topic_of(F.col("text")), "tokens": token_count(F.col("text"))})
    names = dict(zip(DIMS, spare(docs, *[f"k_{d}" for d in DIMS]), strict=True))
    keys = {names[d]: _key(d) for d in DIMS}
    cells = stash(
        sized.select("tokens", *[k.alias(n) for n, k in keys.items()]).where("tokens > 0")
        .groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    )
    if targets is None:
        exponents = exponents or {"source": 0.5, "lang": 0.7, "topic": 0.7}
        wanted = tempered_targets(cells, {names[d]: exponents[d] for d in DIMS})
    else:
        wanted = {names[d]: t.select(_key(d).alias(names[d]), "target") for d, t in targets.items()}
    raked = rake(cells, wanted)
    total = cells.agg(F.sum("tokens").alias("n")).first().n or 0
    scale = _scale(raked, fraction * total)
    chance = raked.select(*keys, "weight", "deviation", F.least(F.lit(1.0), F.lit(float(scale)) * F.col("weight") / F.col("tokens")).alias("probability"))
    if raked.count() <= BROADCAST_CELLS:
        chance = F.broadcast(chance)
    out = sized.withColumns(keys).join(chance, list(keys), "left").drop(*keys)
    live = F.col("tokens") > 0
    return out.withColumns(
        {"weight": F.when(live, F.col("weight")).otherwise(0.0), "deviation": F.when(live, F.col("deviation")).otherwise(0.0), "probability": F.when(live, F.col("probability")).otherwise(0.0)}
    ).withColumn("sampled", uniform(F.col("doc_id"), seed=seed) < F.col("probability"))
