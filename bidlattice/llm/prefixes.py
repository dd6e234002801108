"""Conversation prefix trie with a pointer-jumping rollup.

Every conversation is rebuilt from the head of its family's base conversation and its own later turns. A node of the trie
is a distinct sequence of first turns, keyed by its depth and a 127-bit digest: the polynomial hash, modulo the prime
2^127 - 1, of the turns' SHA-256 digests. Such digests join: that of a sequence follows from those of its parts, so
conversations of any length are hashed in pieces by the partitions of one range-partitioned sort, and what the driver
carries from one partition into the next is one row a partition. The parent's digest follows from a node's own digest and
last turn, so edges need no self-join.

Leaf counts and savings reach all ancestors in logarithmic rounds. Each node holds a pointer to the ancestor 2^k above it
and the sums of its subtree down to 2^k - 1 levels. A round adds the sums of all that point at a node to its own and
replaces pointers by their pointers. Nodes that have nobody 2^k above leave the rounds, so the work is about a row for each
doubling that a node's depth holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import discard, met, stash

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest()[:15], "big")
INVERSE = pow(BASE, -1, PRIME)
#: Largest number of turns that a conversation takes from its base, and the size of a family.
HEAD, FAMILY = 8, 5
#: Conversation ids in one packed piece of a list that is hashed.
PACKED = 512


def head_length(conv_id: Column) -> Column:
    """How many turns of its base a conversation takes: unsigned crc32 of the decimal id modulo HEAD + 1."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _number(x: bytes) -> int:
    return int.from_bytes(x, "big")


def extended(digest: int, turn: int) -> int:
    return (digest * BASE + turn + 1) % PRIME


def joined(left: int, n: int, right: int) -> int:
    """Digest of a sequence from that of its beginning and that of its last n turns."""
    return (left * pow(BASE, n, PRIME) + right) % PRIME


def shortened(digest: int, turn: int) -> int:
    """Digest of the sequence without its last turn."""
    return (digest - turn - 1) * INVERSE % PRIME


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and running digest of each turn of a sorted partition, as if it were the beginning of its conversation."""
    conv, n, digest = None, 0, 0
    for batch in batches:
        ids, turns, places, digests = batch.column("conv_id").to_pylist(), batch.column("turn_digest").to_pylist(), [], []
        for c, t in zip(ids, turns, strict=True):
            if c != conv:
                conv, n, digest = c, 0, 0
            n, digest = n + 1, extended(digest, _number(t))
            places.append(n)
            digests.append(_bytes(digest))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn_digest"), batch.column("size"), pa.array(places, pa.int64()), _binary(digests)],
            names=["conv_id", "turn_digest", "size", "place", "digest"],
        )


def _carry(shared):
    """Add what earlier partitions hold of the conversation that a partition begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = shared.value
        for batch in batches:
            places, digests = batch.column("place").to_pylist(), batch.column("digest").to_pylist()
            for i, (c, p) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if (c, p) in carried:
                    before, digest = carried[c, p]
                    digests[i] = _bytes(joined(digest, places[i], _number(digests[i])))
                    places[i] += before
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn_digest"), batch.column("size"), pa.array(places, pa.int64()), _binary(digests)],
                names=["conv_id", "turn_digest", "size", "place", "digest"],
            )

    return run


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_digest, size, place, digest) of every turn: its place in its conversation from 1, the bytes of its
    text, and the digest of all turns up to it.

    Turns are ordered by turn (null first), then role, the first 24 characters of the text, and the digest of both; null
    role or text counts as empty, rows without conv_id are left out. A conversation may fill many partitions.
    """
    spark = turns.sparkSession
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = stash(
        turns.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 24).alias("begin"),
            F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, 15).alias("turn_digest"), F.octet_length(text).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("begin"), F.col("turn_digest"), F.col("row")]
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn_digest", "size")
    local = stash(
        spread.mapInArrow(_scan, "conv_id long, turn_digest binary, size long, place long, digest binary").withColumn("part", F.spark_partition_id())
    )
    discard(rows)
    edges = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "digest")).alias("last")).orderBy("part").collect()
    carried, held = {}, (None, 0, 0)  # one row a partition
    for row in edges:
        if row.first == held[0]:
            carried[row.first, row.part] = held[1:]
        conv, n, digest = row.last.conv_id, row.last.place, _number(bytes(row.last.digest))
        before = held[1:] if conv == held[0] else (0, 0)
        held = (conv, before[0] + n, joined(before[1], n, digest))
    shared = spark.sparkContext.broadcast(carried)
    return local.mapInArrow(_carry(shared), "conv_id long, turn_digest binary, size long, place long, digest binary")


def _head_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation the nodes of its head, its root, and the digest that its own turns join."""
    for batch in batches:
        out = []
        for c, head, own, h in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "head", "n_turns", "h")), strict=True):
            own = max(0, own - h)
            digest = 0
            out.append((c, 0, _bytes(0), None, 0, not head and not own))
            for d, t in enumerate(head, 1):
                parent, digest = digest, extended(digest, _number(t["turn_digest"]))
                out.append((c, d, _bytes(digest), _bytes(parent), t["size"], d == len(head) and not own))
        yield _node_batch(out)


def _own_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of turns beyond the head: the head's digest is put before the turns from place h + 1 on."""
    for batch in batches:
        out = []
        names = ("conv_id", "place", "turn_digest", "size", "digest", "h", "at_h", "head", "n_turns")
        for c, place, turn, size, digest, h, at_h, head, n_turns in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            n, start = place - h, 0
            for t in head:
                start = extended(start, _number(t["turn_digest"]))
            skipped = _number(at_h) if at_h else 0
            whole = joined((start - skipped) % PRIME, n, _number(digest))
            out.append((c, len(head) + n, _bytes(whole), _bytes(shortened(whole, _number(turn))), size, place == n_turns))
        yield _node_batch(out)


NODE = "conv_id long, depth long, node binary, parent binary, size long, ends boolean"


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "node", "parent", "size", "ends"])


def rebuilt_prefixes(turns: DataFrame) -> DataFrame:
    """One row for each prefix of each rebuilt conversation: conv_id, depth, node and parent digest, bytes of the last
    text, and whether the conversation ends here. A head is at most HEAD turns, so it travels as an array."""
    placed = stash(numbered_turns(turns))
    heads = (
        placed.where((F.col("place") <= HEAD) & (F.col("conv_id") % FAMILY == 0)).groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "turn_digest", "size"))).alias("turns")).withColumnRenamed("conv_id", "base")
    )
    h = head_length(F.col("conv_id"))
    convs = placed.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max(F.when(F.col("place") == h, F.col("digest"))).alias("at_h"))
    told = stash(
        convs.withColumn("base", base_of(F.col("conv_id"))).join(heads, "base", "left")
        .select("conv_id", "n_turns", "at_h", h.alias("h"), F.coalesce(F.slice("turns", 1, h), F.array().cast("array<struct<place:bigint,turn_digest:binary,size:bigint>>")).alias("head"))
    )
    own = met(placed.where(F.col("place") > h), told.where(F.col("n_turns") > F.col("h")).withColumn("n", F.col("n_turns")), ["conv_id"], "n", placed.count())
    return told.select("conv_id", "head", "n_turns", "h").mapInArrow(common.releasing(_head_nodes), NODE).unionByName(own.mapInArrow(common.releasing(_own_nodes), NODE))


def subtree_sums(nodes: DataFrame, values: list[str], id: str = "id", parent: str = "parent") -> DataFrame:
    """(id, *values): each value, a long, summed over the node and all below it, in log2(depth) + 1 rounds.

    nodes needs unique ids and acyclic parents (null at a root, or the id of a node of the table). A pointer that a large
    share of all nodes holds is broadcast; sums are combined on the map side. Each round is written to the shared folder.
    """
    add = lambda by: [F.sum(v).alias(v) for v in by]
    whole = nodes.select(F.col(id).alias("id"), *values)
    active = stash(nodes.select(F.col(id).alias("id"), F.col(parent).alias("up"), *values))
    shares, stale = [whole], None
    while (total := active.where("up is not null").count()) > 0:
        movers = active.where("up is not null")
        share = stash(movers.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n"), *add(values)))
        shares.append(share.select("id", *values))
        grown = active.join(share.select("id", "n", *[F.col(v).alias(f"more_{v}") for v in values]), "id", "left").select(
            "id", "up", F.coalesce("n", F.lit(0)).alias("n"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
        )
        grown = stash(grown.where("up is not null or n > 0"))
        nexts = grown.where("n > 0").select(F.col("id").alias("up"), F.col("up").alias("up_"), "n")
        jumped = met(grown.where("up is not null").select("id", "up", *values), nexts, ["up"], "n", total)
        stale, active = [active, grown], stash(jumped.select("id", F.col("up_").alias("up"), *values))
        for table in stale:
            discard(table)
    out = shares[0]
    for share in shares[1:]:
        out = out.unionByName(share)
    return out.groupBy("id").agg(*add(values))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as pieces of at most PACKED ids: the first id, and all of them joined by commas."""
    node, held, out = None, [], []

    def close():
        if held:
            out.append((node, held[0], ",".join(map(str, held))))
            held.clear()

    def batch_of():
        columns = list(zip(*out, strict=True)) or [()] * 3
        made = pa.RecordBatch.from_arrays([_binary(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["node", "first", "ids"])
        out.clear()
        return made

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if n != node or len(held) == PACKED:
                close()
                node = n
            held.append(c)
        yield batch_of()
    close()
    yield batch_of()


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined pieces, fed one after another."""
    node, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n != node:
                if state is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([_binary(nodes), pa.array(digests, pa.string())], names=["id", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([_binary([node]), pa.array([state.hexdigest()], pa.string())], names=["id", "ends_sha256"])


def list_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) for each node of ends (node, conv_id): SHA-256 of its ascending conv_ids joined by commas.

    A hash goes over its list in order, so one task feeds each. The ids come to it sorted and packed by PACKED, and it
    holds one piece of a list at a time.
    """
    parts = max(8, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = (
        ends.select("node", "conv_id").repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
        .mapInArrow(_pack, "node binary, first long, ids string")
    )
    return packed.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_hash_lists, "id binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the empty root included.

    turns needs conv_id, turn, role and text; other columns are ignored. Columns, as the contract of op12 names them:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Repeated
    rows are turns of their own; an empty table, or one without conv_ids, gives an empty result. Nodes are equal when
    their depth and 127-bit digest are.
    """
    prefixes = stash(rebuilt_prefixes(turns))
    key = F.concat(F.col("node"), F.unhex(F.lpad(F.hex("depth"), 16, "0")))
    above = F.when(F.col("depth") > 0, F.concat(F.col("parent"), F.unhex(F.lpad(F.hex(F.col("depth") - 1), 16, "0"))))
    keyed = prefixes.select("conv_id", "depth", key.alias("node"), above.alias("parent"), "size", "ends")
    nodes = stash(
        keyed.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("size").alias("size")
        ).withColumnRenamed("node", "id")
    )
    children = stash(nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children")))
    own = nodes.join(children, "id", "left").select(
        "id", "parent", F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")
    )
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"])
    ends = list_digests(keyed.where("ends"))
    parents = children.join(nodes.select("id", F.col("conv_id").alias("parent_conv_id")), "id").withColumnRenamed("id", "parent")
    below = met(nodes.where("parent is not null"), parents.withColumnRenamed("n_children", "n"), ["parent"], "n", nodes.count())
    whole = below.drop("parent").unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).drop("parent"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        whole.join(children, "id", "left").join(sums, "id").join(ends, "id", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )


#: CRC-32 by its reflected polynomial, a bit at a time: 8 shifts after each byte.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, ({_CRC} % {HEAD + 1}) AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND place <= h
            UNION ALL SELECT t.conv_id, 1, place, role, text FROM t JOIN convs USING (conv_id) WHERE place > h),
steps AS (SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS size,
                 list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING) AS seq
          FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
paths AS (SELECT conv_id, depth, size, sha256(seq::VARCHAR) AS node FROM steps UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
tops AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM paths GROUP BY node, depth),
ends AS (SELECT node, sha256(string_agg(conv_id, ',' ORDER BY conv_id)) AS e FROM paths JOIN tops USING (conv_id, depth) GROUP BY node),
linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent, count(*) AS k FROM linked WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT p.node, sum((kids.k IS NULL)::INT) AS leaves, sum((n.n_convs - 1) * n.size) AS saved
         FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids ON kids.parent = n.node GROUP BY p.node)
SELECT l.conv_id, l.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, l.n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM linked l LEFT JOIN nodes m ON m.node = l.parent LEFT JOIN kids ON kids.parent = l.node JOIN sums ON sums.node = l.node LEFT JOIN ends ON ends.node = l.node
"""
