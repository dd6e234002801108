"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes a set of word shingles, its fingerprint and a signature of MinHash coordinates. Texts with equal
   sets form one class at once; from here on only the smallest doc_id of a class takes part.
2. Classes are posted under every (coordinate, value) key. A key that only one class holds cannot collide and goes.
   A class needs `need` keys left, else it matches nothing.
3. Two classes that agree in `need` of their keys agree in one of the n - need + 1 rarest of each (prefix), so only
   these are posted for the join. In a posting list the collisions of two classes are counted over whole signatures;
   a class that already hangs on another of its list is not compared again (skip).
4. Links that reach `need` make cells (connected components); each class sends its full set to its cell once, where
   links are confirmed on full sets. Confirmed links make the components of the result.

Long posting lists and large cells are cut into blocks, so no task gets a whole hot group, and a group returns at most a
spanning forest of its links, never all pairs. First each block is linked on its own, together with a few pivots that
stand in every block of their key and are the first to be roots of its trees. Rows of the root that most rows of their key
have need not meet each other any more; only the others visit all blocks. A group of m near-copies that hang together so
costs about 2 m rows, however large it is.

`need` follows from the threshold: the largest count that a pair at the threshold misses with probability `miss` or less.
Nulls, empty texts and texts of white space only have an empty set: n_shingles 0, linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components

COORDINATES = 32
#: Rows of a posting list, and shingles or rows of a cell, in one block.
LIST_BLOCK, CELL_SHINGLES, CELL_ROWS = 1024, 1 << 20, 1024
#: Rows of a key, about so many, that stand in each of its blocks.
PIVOTS = 8

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, 256), dtype=np.uint64)


def collisions_needed(threshold: float, coordinates: int = COORDINATES, miss: float = 1e-4) -> int:
    """The largest count of equal coordinates that a pair at the threshold reaches but with probability miss."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * threshold**k * (1 - threshold) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def _sketches(width: int, coordinates: int):
    multiply, add = _SEEDS[0][:coordinates] * np.uint64(2) + np.uint64(1), _SEEDS[1][:coordinates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.text_slices(whole):
                sets = common.shingles(batch.column("text"), width)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, len(sets)), np.uint64)
                keys = np.zeros((len(full), coordinates), np.uint64)
                if len(full):
                    flat, at = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(2):
                        prints[k, full] = np.add.reduceat(common.mix(flat + _SEEDS[0][200 + k]), at)
                    for k in range(coordinates):
                        keys[:, k] = np.minimum.reduceat(flat * multiply[k] + add[k], at)
                    keys = common.mix(keys + np.arange(coordinates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[full + 1] = coordinates
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "sig"],
                )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _forest(rows: int, near) -> list[tuple[int, int, int]]:
    """Links that join the same rows as all links do, with the root of their tree: from each reached row, only rows not
    reached yet are compared."""
    left, links = np.arange(rows), []
    while len(left):
        root, todo, left = int(left[0]), [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = near(x, left)
            if hit.any():
                links += [(x, y, root) for y in left[hit].tolist()]
                todo += left[hit].tolist()
                left = left[~hit]
    return links


def _bridges(part: np.ndarray, guest: np.ndarray, near) -> list[tuple[int, int, int]]:
    """Links of guests with rows of other parts, with the guest as their root: as many as join the same parts as all
    these links do."""
    part, homes, links = part.copy(), np.flatnonzero(~guest), []
    for x in np.flatnonzero(guest).tolist():
        rest = homes[part[homes] != part[x]]
        if len(rest):
            hit = rest[near(x, rest)]
            joined, first = np.unique(part[hit], return_index=True)
            links += [(x, y, x) for y in hit[first].tolist()]
            part[np.isin(part, joined)] = part[x]
    return links


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of whole groups out of batches that are sorted by key; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        turn = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(turn):
            yield pa.Table.from_batches([*held, batch.slice(0, turn[-1])])
            held = []
            batch = batch.slice(turn[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


_EDGES = "key long, a long, b long, root long"


def _edges(*columns: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "a", "b", "root"])


def _group_links(table: pa.Table, lo: int, hi: int, near) -> list[tuple[int, int, int]]:
    """Links of the rows lo to hi: those of guests with other parts where rows have a part, else those of all rows."""
    if "part" not in table.column_names:
        return _forest(hi - lo, near)
    return _bridges(*(table.column(c).chunk(0).to_numpy(zero_copy_only=False)[lo:hi] for c in ("part", "guest")), near)


def _list_links(coordinates: int, need: int):
    """Links of `need` equal coordinates in each posting list; a list, or a block of one, comes as rows of one `grp`.
    Where rows have a part, guests are compared with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "grp"):
            table = table.combine_chunks()
            grp, key, ids = (table.column(c).chunk(0).to_numpy(zero_copy_only=False) for c in ("grp", "key", "rep"))
            sig = _matrix(table.column("sig").chunk(0), coordinates)
            cut = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
            size = np.repeat(np.diff(cut), np.diff(cut))
            second = "part" in table.column_names
            a, b, roots = [], [], []
            small = np.flatnonzero(size <= 8)  # all lists of up to 8 rows at once
            for d in range(1, 0 if second else 8):
                x = small[small + d < len(grp)]
                x = x[grp[x] == grp[x + d]]
                x = x[(sig[x] == sig[x + d]).sum(axis=1) >= need]
                a += x.tolist()
                b += (x + d).tolist()
                roots += x.tolist()
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo <= 8 and not second:
                    continue
                s = sig[lo:hi]
                for x, y, root in _group_links(table, lo, hi, lambda x, rest, s=s: (s[rest] == s[x]).sum(axis=1) >= need):
                    a.append(lo + x)
                    b.append(lo + y)
                    roots.append(lo + root)
            yield _edges(key[a], ids[a], ids[b], ids[roots]) if a else _edges([], [], [], [])

    return run


def _cell_links(percent: int):
    """Links with 100 * intersection >= percent * union, on the full sets of each cell or of a block of it. Where rows have
    a part, guests are compared with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "grp"):
            table = table.combine_chunks()
            grp, key, ids = (table.column(c).chunk(0).to_numpy(zero_copy_only=False) for c in ("grp", "key", "rep"))
            sets = table.column("shingles").chunk(0)
            cut = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
            a, b, roots = [], [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                each = [np.frombuffer(sets[i].as_py(), np.uint64) for i in range(lo, hi)]
                flat = np.concatenate(each)
                vocabulary, flat = np.unique(flat, return_inverse=True)
                size = np.array([len(s) for s in each])
                at = np.concatenate([[0], np.cumsum(size)])
                mark = np.zeros(len(vocabulary), np.int32)

                def near(x: int, rest: np.ndarray, size=size, at=at, flat=flat, mark=mark) -> np.ndarray:
                    fits = 100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x])
                    hit = np.zeros(len(rest), bool)
                    y = rest[fits]
                    if len(y):
                        mark[flat[at[x] : at[x + 1]]] = 1
                        if len(y) == len(size) - at.searchsorted(at[y[0]]):  # all rows from y[0] on
                            both = np.add.reduceat(mark[flat[at[y[0]] :]], at[y] - at[y[0]])
                        else:
                            n = size[y]
                            start = np.concatenate([[0], np.cumsum(n)[:-1]])
                            take = np.arange(n.sum()) - np.repeat(start, n) + np.repeat(at[y], n)
                            both = np.add.reduceat(mark[flat[take]], start)
                        mark[flat[at[x] : at[x + 1]]] = 0
                        hit[fits] = 100 * both >= percent * (size[y] + size[x] - both)
                    return hit

                for x, y, root in _group_links(table, lo, hi, near):
                    a.append(lo + x)
                    b.append(lo + y)
                    roots.append(lo + root)
            yield _edges(key[a], ids[a], ids[b], ids[roots]) if a else _edges([], [], [], [])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.text_slices(whole):
                sets = pa.array([s.tobytes() for s in common.shingles(batch.column("text"), width)], pa.binary())
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], names=[*kept, "shingles"])

    return run


def _block(blocks: str, salt: int) -> Column:
    """The block, of so many, that a row of a key is in."""
    return F.pmod(F.xxhash64(F.lit(salt), "key", "rep"), F.col(blocks))


def _all(blocks: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)


def _first_groups(rows: DataFrame) -> DataFrame:
    """Deal the rows of a key to its blocks: each to its own, pivots to all and before the others."""
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(13), "key", "rep"), F.ceil(F.col("m") / PIVOTS)) == 0)
    at = F.when(pivot, _all("blocks")).otherwise(F.array(_block("blocks", 11)))
    return rows.withColumn("late", ~pivot).withColumn("i", F.explode(at)).withColumn("grp", F.xxhash64("key", "i"))


def _second_groups(rows: DataFrame) -> DataFrame:
    """Deal the rows of a key to groups of one block and one block of guests, who are the rows outside the part `top`."""
    home, own = _block("blocks", 11), _block("guest_blocks", 12)
    met = F.transform(_all("guest_blocks"), lambda j: F.struct(home.alias("i"), j.alias("j"), F.lit(False).alias("guest")))
    visits = F.transform(_all("blocks"), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(True).alias("guest")))
    met = F.when(F.col("part") == F.col("top"), met).otherwise(F.concat(met, visits))
    return rows.withColumn("at", F.explode(met)).withColumn("grp", F.xxhash64("key", "at.i", "at.j")).withColumn("guest", F.col("at.guest"))


def _linked(members: DataFrame, found: DataFrame, fill, payload: str, run) -> DataFrame:
    """(id, component) of the links that run finds between members (rep, key) of one key.

    found has the number m of rows and of blocks of each key; fill joins the payload to members.
    """

    def links(groups: DataFrame, *more: str) -> DataFrame:
        dealt = groups.select("grp", "key", "rep", *more, payload).repartition("grp").sortWithinPartitions("grp", more[0], "rep")
        return dealt.mapInArrow(common.releasing(run), _EDGES)

    first = links(_first_groups(fill(members.join(found, "key"))), "late")
    many = found.where("blocks > 1")
    if many.isEmpty():
        return connected_components(first)
    first = common.stash(first)
    roots = first.groupBy("key", F.col("b").alias("rep")).agg(F.min("root").alias("part"))
    rows = members.join(many, "key").join(roots, ["key", "rep"], "left")
    rows = common.stash(rows.withColumn("part", F.coalesce("part", "rep")))
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("top"), (F.sum("n") - F.max("n")).alias("others"))
    split = common.stash(split.where("others > 0"))
    if split.isEmpty():
        return connected_components(first)
    rest = rows.join(split, "key").withColumn("guest_blocks", F.ceil(F.col("others") * F.col("blocks") / F.col("m")))
    return connected_components(first.unionByName(links(_second_groups(fill(rest)), "guest", "part")))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    miss: float = 1e-4,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id): the near-duplicate component of every document.

    docs needs doc_id (unique) and text; other columns are ignored. Documents are linked when
    100 * |A and B| >= percent * |A or B| over sets of width-word shingles. component_id is the smallest doc_id
    reachable by links, kept tells whether it is the document's own. class_id is the smallest doc_id with the same
    set. Ties do not arise; an empty table gives an empty result. A null doc_id is linked with nothing: its row has no
    component_id and stays. Repeated rows stay and share their result.
    """
    docs = docs.select("doc_id", "text")
    need = collisions_needed(percent / 100, coordinates, miss)
    sketches = common.stash(
        docs.mapInArrow(common.releasing(_sketches(width, coordinates)), "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>")
    )
    whole = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    bare, keys = sketches.drop("sig"), ["f1", "f2", "n_shingles"]
    classes = bare.where(whole).groupBy(*keys).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    classed = common.met(bare.where(whole), classes, keys, "n", sketches.count()).select("doc_id", "n_shingles", "class_id")
    alone = bare.where(~whole).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class_id"))
    classed = common.stash(classed.unionByName(alone))
    reps = sketches.join(classed.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rep"), "n_shingles", "sig"
    )

    posted = reps.select("rep", F.explode("sig").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    prefixed = (
        posted.join(shared, "key")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
        .where(F.size("keys") >= need)
        .select("rep", F.slice("keys", F.lit(1), F.size("keys") - need + 1).alias("keys"))
    )
    prefixed = common.stash(prefixed.join(reps, "rep").select("rep", "n_shingles", "sig", "keys"))
    members = prefixed.select("rep", F.explode("keys.key").alias("key"))
    lists = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / LIST_BLOCK))
    signed = prefixed.select("rep", "sig")
    cells = common.stash(
        _linked(members, common.stash(lists), lambda rows: rows.join(signed, "rep"), "sig", _list_links(coordinates, need))
    )

    members = cells.select(F.col("id").alias("rep"), F.col("component").alias("key"))
    loads = members.join(prefixed.select("rep", "n_shingles"), "rep").groupBy("key").agg(
        F.count("*").alias("m"), F.sum("n_shingles").alias("w")
    )
    blocks = F.greatest(F.ceil(F.col("w") / CELL_SHINGLES), F.ceil(F.col("m") / CELL_ROWS))

    def with_sets(rows: DataFrame) -> DataFrame:
        read = rows.join(docs.withColumnRenamed("doc_id", "rep"), "rep")
        return read.mapInArrow(common.releasing(_sets(width)), T.StructType(read.drop("text").schema.fields).add("shingles", "binary"))

    parts = _linked(
        members, common.stash(loads.select("key", "m", blocks.alias("blocks"))), with_sets, "shingles", _cell_links(percent)
    ).select(F.col("id").alias("class_id"), "component")
    own = F.coalesce("component", "class_id", "doc_id")
    return classed.join(parts, "class_id", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id")
    )
