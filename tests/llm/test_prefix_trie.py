"""The prefix trie against brute force, over small shards and blocks, odd rows included."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth long, end string, key string, first long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)


def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0, turn_key(role, text)),
                                            (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    built = own
    if rebuild:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    nodes, kids = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def down(k):
        yield k
        for x in kids.get(k, ()):
            yield from down(x)
    out = []
    for k, members in nodes.items():
        below = list(down(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members),
                    len(kids.get(k, ())), sum(x not in kids for x in below),
                    sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
                    ",".join(str(c) for c in sorted(members) if tuple(built[c]) == k)))
    return sorted(out, key=str)


def found(spark, rows, rebuild=True, **sizes):
    turns = pt.encode_turns(table(spark, rows))
    convs = turns.select("conv_id").distinct()
    nodes, ends = pt.prefix_trie(pt.share_openings(turns, convs) if rebuild else turns, convs, **sizes)
    ids = {}
    for r in ends.collect():
        ids.setdefault(bytes(r["end"]), []).append(r["conv_id"])
    sha = {bytes(r["end"]): r["sha"] for r in pt.ends_digest(ends).collect()}
    for end, members in ids.items():
        assert sha[end] == hashlib.sha256(",".join(map(str, sorted(members))).encode()).hexdigest()
    return sorted(((r["first"], r["depth"], r["parent_first"], r["n_convs"], r["n_children"], r["n_leaves"],
                    r["saved"], ",".join(map(str, sorted(ids[bytes(r["end"])]))) if r["end"] else "")
                   for r in nodes.collect()), key=str)


def rows_of(seed, convs=40, length=9):
    r = random.Random(seed)
    rows = []
    for c in range(-7, convs):
        for t in range(r.randint(1, length)):
            rows.append((c, t, r.choice(["user", "bot", None]), r.choice(["a", "bé", "", None])))
    rows += [(90, t, "u", "one") for t in range(30)]  # long and alone
    rows += [(c, t, "u", "two") for c in (91, 92, 93) for t in range(20 + c % 3)]  # long and shared
    rows += [(200 + c, 0, "s", "hot") for c in range(60)]
    return rows


@pytest.mark.parametrize("sizes, rebuild", [
    ({}, True), ({"shard": 4}, True), ({"block": 3}, True), ({"block": 2, "shard": 5}, False)])
def test_trie_equals_brute_force(spark, sizes, rebuild):
    rows = rows_of(len(sizes))
    assert found(spark, rows, rebuild, **sizes) == brute(rows, rebuild)


def test_odd_turns(spark):
    rows = [(None, 0, "u", "nobody"), (0, None, None, None), (0, None, None, None), (0, 5, "u", "x"),
            (1, 3, "u", "b"), (1, 3, "u", "a"), (1, -2, "", ""), (3, 0, "", "y" * 100_000), (11, 0, "u", "z")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, rows[:1]) == []


def test_positions_run_on_over_tasks(spark):
    rows = [(1, t % 50, "u", str(t)) for t in range(900)] + [(2, 1, "u", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = pt.encode_turns(table(spark, rows)).filter("conv_id = 1")
        assert got.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (0, 899, 900)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_median_order_and_search_tree():
    for n in range(40):
        assert sorted(pt.median_order(n)) == list(range(n))
    sequences = sorted({tuple(random.Random(i).choices(range(5), k=4)) for i in range(200)})
    tree = pt.Tree([list(s) for s in sequences])
    for s, end in zip(sequences, tree.end):
        assert tuple(tree.symbol[i] for i in tree.path(end)) == s
    flat = pt.Tree([[i] for i in range(1023)])  # balanced: no more than 10 comparisons
    deepest = [0] * 1023
    for i in range(1022, -1, -1):
        deepest[i] = 1 + max([deepest[x] for x in (flat.low[i], flat.high[i]) if x >= 0], default=0)
    assert deepest[0] == 10
