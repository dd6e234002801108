"""Joins, set operations, groupings and orders that the domain operators are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visible(df: DataFrame, layers: Sequence[str], scopes: Sequence[str], project: str | None, lot: str | None, at: Column) -> DataFrame:
    """Row-level security as one filter below everything else, so that it reaches the scan."""
    from .temporal import covers

    mine = lambda c, v: F.col(c).isNull() | (F.col(c) == v) if v is not None else F.col(c).isNull()
    return df.where(
        F.col("layer").isin(*layers) & F.col("scope").isin(*scopes) & (F.col("index_status") == "current")
        & (F.col("verification_status") == "active") & mine("project_id", project) & mine("lot_id", lot)
        & covers(F.col("valid_from"), F.col("valid_until"), at)
    )


def permitted(df: DataFrame, grants: DataFrame, role: str) -> DataFrame:
    """Rows whose scope the role may see; an unknown role sees none. grants (role, scope) is a small dimension."""
    return df.join(grants.where(F.col("role") == role).select("scope").distinct(), "scope", "left_semi")


def keywords_match(text: Column, query: str) -> Column:
    """All words of the query stand in the text; an empty query matches."""
    words = query.split()
    return F.lit(True) if not words else F.forall(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def any_word(text: Column, words: Mapping[str, Sequence[str]], category: str) -> Column:
    """A word of the category's list stands in the text; an unknown category is its own word."""
    return F.exists(F.array(*[F.lit(w) for w in words.get(category, [category])]), lambda w: text.contains(w))


def wildcard(c: Column, pattern: str) -> Column:
    """Case-insensitive; * stands for anything, and without * the pattern may stand anywhere."""
    plain = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(plain.replace("*", "%") if "*" in pattern else f"%{plain}%")


def longest_rule(rows: DataFrame, rules: DataFrame, path: str, key: str) -> DataFrame:
    """Rows with the longest rule that starts their path: allow wins a tie, and no rule means allow.

    rules (prefix, allow) meet the path's own prefixes by equality, one row for each length that some rule has, so
    no row is compared with every rule.
    """
    sizes = rules.select(F.length("prefix").alias("n")).distinct()
    lengths = F.broadcast(sizes.agg(F.collect_set("n").alias("sizes")))
    heads = rows.join(lengths).select(key, F.col(path).alias("p"), F.explode("sizes").alias("n")).where("length(p) >= n")
    best = (
        heads.withColumn("prefix", F.left("p", F.col("n"))).join(rules, "prefix")
        .groupBy(key).agg(F.max_by(F.struct("prefix", "allow"), F.struct("n", "allow")).alias("rule"))
    )
    return rows.join(best, key, "left").select(*rows.columns, F.col("rule.prefix").alias("rule"), F.coalesce("rule.allow", F.lit(True)).alias("allowed"))


def run_diff(base: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer difference of two runs, with labels for rows that are new or gone."""
    a, b = base.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), target.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    j = a.join(b, key, "full_outer")
    return j.select(
        key,
        F.when(F.col("__in_a").isNull(), "(new)").otherwise(F.col("__a")).alias("from_value"),
        F.when(F.col("__in_b").isNull(), "(removed)").otherwise(F.col("__b")).alias("to_value"),
        (F.col("__in_a").isNull() | F.col("__in_b").isNull() | ~F.col("__a").eqNullSafe(F.col("__b"))).alias("changed"),
    )


def divides(facts: DataFrame, needs: DataFrame, who: str, what: str) -> DataFrame:
    """For each `who` how many of the needed things it has and whether it has them all; needs (what) is distinct.

    Counting distinct hits against the number of needs asks for no product of people and rules.
    """
    total = needs.agg(F.count("*").alias("needed"))
    hits = facts.join(needs, what, "left_semi").select(who, what).distinct().groupBy(who).agg(F.count("*").alias("met"))
    return (
        facts.select(who).distinct().join(hits, who, "left").join(F.broadcast(total))
        .select(who, F.coalesce("met", F.lit(0)).alias("met"), "needed", (F.coalesce("met", F.lit(0)) == F.col("needed")).alias("complete"))
    )


def linked_by_reference(records: DataFrame, files: DataFrame, refs: str, file_id: str, key: str, cap: int = 4) -> DataFrame:
    """For each file the first `cap` records that refer to it; a reference is the id, or holds it after a colon."""
    refs_of = records.select(key, F.explode(refs).alias("ref")).select(key, F.regexp_extract("ref", r"([^:]+)$", 1).alias(file_id)).distinct()
    n = F.row_number().over(W.partitionBy(file_id).orderBy(key))
    return files.select(file_id).join(refs_of, file_id).withColumn("place", n).where(F.col("place") <= cap)


def nested(parents: DataFrame, children: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Parents with one sorted list of structs for each kind of child; none is an empty list."""
    out = parents
    for name, child in children.items():
        rest = [c for c in child.columns if c != key]
        out = out.join(child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def similar_names(df: DataFrame, key: str, name: str, block: str, least: float) -> DataFrame:
    """(key, class_id, links, best): names of a block whose Dice coefficient over bigrams reaches `least`.

    Equal names are one class, whose id is its smallest key, so copies are never paired. Two sets can only reach `least` if
    they share one of the size - ceil(least * size / (2 - least)) + 1 rarest bigrams of each; classes that do are compared.
    links counts the other classes that are alike, best is the largest coefficient among these, null without any. Empty
    and null names are classes without links.
    """
    from ..functions import text

    rows = df.select(F.col(block).alias("block"), F.col(name).alias("name"), F.col(key).alias("key"))
    classes = rows.groupBy("block", "name").agg(F.min("key").alias("class_id"))
    sets = classes.where("name <> ''").select("block", "class_id", text.bigram_items(F.col("name")).alias("items"))
    posted = sets.select("block", "class_id", F.size("items").alias("size"), F.explode("items").alias("item"))
    often = posted.groupBy("block", "item").agg(F.count("*").alias("n"))
    ranked = posted.join(often, ["block", "item"]).groupBy("block", "class_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("o"))
    needed = F.ceil(F.lit(least) * F.col("size") / F.lit(2 - least) - 1e-9).cast("int")
    heads = ranked.select("block", "class_id", "size", F.explode(F.slice("o", F.lit(1), F.col("size") - needed + 1)).alias("h")).select("block", "class_id", "size", "h.item")
    other = heads.select("block", "item", F.col("class_id").alias("b"), F.col("size").alias("size_b"))
    near = 2.0 * F.least("size", "size_b") >= F.lit(least) * (F.col("size") + F.col("size_b"))
    pairs = heads.join(other, ["block", "item"]).where(F.col("class_id") < F.col("b")).where(near).select(F.col("class_id").alias("a"), "b").distinct()
    pairs = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("items").alias("y")), "b")
    pairs = pairs.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
    links = pairs.where(2.0 * F.col("both") >= F.lit(least) * F.col("all")).withColumn("dice", F.round(2.0 * F.col("both") / F.col("all"), 4))
    ends = links.select(F.col("a").alias("class_id"), "dice").unionByName(links.select(F.col("b").alias("class_id"), "dice"))
    found = classes.join(ends.groupBy("class_id").agg(F.count("*").alias("links"), F.max("dice").alias("best")), "class_id", "left")
    found = found.select(F.col("block").alias("b"), F.col("name").alias("n"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "best")
    return rows.join(found, F.col("block").eqNullSafe(F.col("b")) & F.col("name").eqNullSafe(F.col("n"))).select(F.col("key").alias(key), "class_id", "links", "best")


def region_coverage(source: Column, wanted: Column, country: str = "全国") -> Column:
    """Direct if the regions are the same, broader if the source's holds the wanted one, else none."""
    return F.when(source == wanted, "direct").when((source == country) | wanted.startswith(source), "broader").otherwise("none")


def revision_parts(old: Column, new: Column) -> Column:
    """H5: struct(added, removed) between two lists, each sorted."""
    return F.struct(F.sort_array(F.array_except(new, old)).alias("added"), F.sort_array(F.array_except(old, new)).alias("removed"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """H6: whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H7: keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def leaked(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows outside the allowed set; a sound result is empty."""
    return rows.join(allowed, key, "left_anti")


def union_kinds(parts: Mapping[str, DataFrame]) -> DataFrame:
    """H1: tables of several kinds under one superset of columns, told apart by `kind`."""
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def zero_filled_counts(df: DataFrame, column: str, states: Sequence[str]) -> DataFrame:
    """A count for each state of a fixed list, 0 for those that do not occur."""
    every = df.sparkSession.createDataFrame([(s,) for s in states], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page, its size held to 1..500."""
    size = max(1, min(500, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def gate_prefix(df: DataFrame, run: str, position: str, failed: Column) -> DataFrame:
    """rows of each run up to its first failure, that row included."""
    first = df.where(failed).groupBy(run).agg(F.min(position).alias("__stop"))
    return df.join(first, run, "left").where(F.col("__stop").isNull() | (F.col(position) <= F.col("__stop"))).drop("__stop")


def upsert_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], refreshable: Column | None = None) -> DataFrame:
    """B1: stored rows with those incoming whose key is new; a refreshable stored row takes the incoming values."""
    if refreshable is not None:
        stale = stored.where(refreshable).join(incoming.select(*keys), list(keys), "left_semi").select(*keys)
        stored = stored.join(stale, list(keys), "left_anti")
    return stored.unionByName(incoming.join(stored.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def sync_outcomes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events (event_id, dedup_key, content_hash, gate) with what a sync does with each.

    In this order: without id or key it is skipped, a rejected one is gate_blocked, a known id is unchanged or updated as
    its content says, an unknown id whose dedup_key is stored is merged into the smallest such id, any other is created.
    """
    known = stored.select("event_id", F.col("content_hash").alias("__hash"), F.lit(True).alias("__known"))
    same = stored.groupBy("dedup_key").agg(F.min("event_id").alias("__into"))
    j = incoming.join(known, "event_id", "left").join(same, "dedup_key", "left")
    outcome = (
        F.when(F.col("event_id").isNull() | F.col("dedup_key").isNull(), "skipped").when(F.col("gate") == "rejected", "gate_blocked")
        .when(F.col("__known") & F.col("content_hash").eqNullSafe(F.col("__hash")), "unchanged").when(F.col("__known"), "updated")
        .when(F.col("__into").isNotNull(), "merged").otherwise("created")
    )
    j = j.withColumn("outcome", outcome).withColumn("stored_id", F.when(F.col("outcome") == "merged", F.col("__into")).when(F.col("outcome").isin("unchanged", "updated", "created"), F.col("event_id")))
    return j.select(*incoming.columns, "outcome", "stored_id")
