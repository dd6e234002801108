"""The conversation trie against a plain version, deep and hot conversations, odd rows; subtree sums on random trees."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from bidlattice.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    kids, under = defaultdict(int), defaultdict(lambda: [0, 0])
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n, members in nodes.items():
        saved = (len(members) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            under[n[:d]][0] += not kids[n]
            under[n[:d]][1] += saved
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), kids[n], *under[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(n)))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def got(df):
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefixes.prefix_trie(df).select(*cols).collect())


def test_against_plain_version(spark):
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(200), 90):
        for t in range(rng.choice([0, 1, 3, 9, 14])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü", "", None])))
    rows += [(7, t, "user", "deep") for t in range(300)] + [(9, t, "user", "deep") for t in range(280)]  # deep paths
    rows += [(c, t, "user", f"hot {t}") for c in range(1000, 1150) for t in range(3)] + rows[:20]  # a hot beginning, repeated rows
    rows += [(None, 1, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.withColumn("node", F.lit(1)).withColumn("id", F.lit("c"))) == plain_trie(rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(3, t, "user", f"t{t % 7}") for t in range(240)] + [(4, t, "user", f"t{t % 7}") for t in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain_trie(rows)
    parts = prefixes.numbered_turns(df).where("conv_id = 3").select("place").collect()
    assert sorted(r.place for r in parts) == list(range(1, 241))


def test_turnless_and_empty(spark):
    # conversation 1 takes all of a base that is absent, and has no turns beyond
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 400) if c % 5}
    c = next(c for c in h if h[c] >= 1)
    rows = [(c, 0, "user", "gone")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain_trie(rows) and got(df)[0][1:4] == (0, -1, 1)
    assert got(df.limit(0)) == []


def test_subtree_sums(spark):
    rng = random.Random(2)
    parent = {0: None} | {i: (i - 1 if i < 120 else rng.randrange(i)) for i in range(1, 400)} | {i: 3 for i in range(400, 700)}
    want = defaultdict(int)
    for i in parent:
        j = i
        while j is not None:
            want[j] += i + 1
            j = parent[j]
    df = spark.createDataFrame([(i, p, i + 1) for i, p in parent.items()], "node long, above long, v long")
    assert {r.id: r.v for r in prefixes.subtree_sums(df, ["v"], "node", "above").collect()} == want


def test_digests_join():
    ts = [random.Random(1).getrandbits(120) for _ in range(9)]
    of = lambda xs: __import__("functools").reduce(prefixes.extended, xs, 0)
    assert all(prefixes.joined(of(ts[:k]), 9 - k, of(ts[k:])) == of(ts) for k in range(10)) and prefixes.shortened(of(ts), ts[-1]) == of(ts[:-1])


def test_lists_are_hashed_in_order(spark):
    rows = [(b"a", i * 7 % 3001) for i in range(3001)] + [(b"b", 5)]
    want = {b"a": hashlib.sha256(",".join(map(str, range(3001))).encode()).hexdigest(), b"b": hashlib.sha256(b"5").hexdigest()}
    assert {bytes(r.id): r.ends_sha256 for r in prefixes.list_digests(spark.createDataFrame(rows, "node binary, conv_id long")).collect()} == want
