"""Operator 11: the prefix trie of conversations, by ternary search trees over sharded turn ids.

Turns are ordered by turn number (null first; equal numbers by a 128-bit digest of role and text), null roles
and texts are empty, and rows without a conversation id belong to none. Columns beyond the four are ignored.

1. Each distinct (role, text) gets a number, ascending by digest; only digests are shuffled, no texts.
2. Rows are range-sorted by (id, turn), so that a very long conversation is spread over many tasks, and cut
   into blocks of at most ``BLOCK`` turns. Blocks are joined to tries level by level: a conversation that goes
   on in the next block starts there from the node where it left this one. Once a conversation is alone, its
   further nodes are written down from its blocks.
3. A level counts equal blocks first (a hot conversation becomes one row), then range-sorts the distinct
   sequences and cuts them into shards of at most ``SHARD`` turns. Each shard builds a ternary search tree,
   inserting its sorted sequences from the median outwards, and adds up members, children, leaves and savings
   from the last node made to the first, as each node is made after those above it.
4. A node whose prefix goes on in the neighbouring shard is on the boundary. What a shard adds to it is made
   additive (a child or a node's own tokens count where they occur first), so boundary nodes merge by sums.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.common import bounded, query, stage

BLOCK = 1024
SHARD = 100_000
#: Ids of members are joined to texts of at most this many (a power of two) before they are hashed.
CHUNK_BITS = 12
FAMILY, OPENING = 5, 9

NODE = ("path binary, parent_path binary, depth long, first long, parent_first long, n_convs long, "
        "n_children long, n_leaves long, saved long, end binary, root binary")


# ---------------------------------------------------------------------- turns

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the place of each row among those of its conversation in a sorted task."""
    import numpy as np
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        first = np.flatnonzero(np.r_[conv[0] != last, conv[1:] != conv[:-1]])
        start = np.zeros(len(conv), np.int64)
        start[first] = first
        at = np.arange(len(conv)) - np.maximum.accumulate(start)
        if conv[0] == last:
            at[:first[0] if len(first) else None] += count
        last, count = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(at), batch.column("tid"), batch.column("size"),
             pa.array([part] * len(conv), pa.int32())], names=["conv_id", "at", "tid", "size", "part"])


def encode_turns(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), tid (number of the distinct turn), size (UTF-8 bytes of its text)."""
    role, text = (F.coalesce(table[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = stage(table.filter(table[id_col].isNotNull()).select(
        table[id_col].cast("long").alias("conv_id"), table[turn_col].cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size")), "turns")
    numbers = stage(rows.select("digest").distinct().repartitionByRange("digest")
                    .sortWithinPartitions("digest")
                    .withColumn("tid", F.monotonically_increasing_id()), "numbers")
    # a range of (id, turn) is a bounded part of even the longest conversation
    placed = stage(rows.join(numbers, "digest").select("conv_id", "turn", "tid", "size")
                   .repartitionByRange("conv_id", "turn", "tid")
                   .sortWithinPartitions("conv_id", "turn", "tid")
                   .mapInArrow(_numbered, "conv_id long, at long, tid long, size long, part int"), "placed")
    parts = placed.groupBy("conv_id", "part").agg((F.max("at") + 1).alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a task goes on with one conversation of the task before at most: no more rows than tasks
    carried = parts.withColumn("before", F.sum("rows").over(before)).filter("before > 0").drop("rows")
    return placed.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "size")


def share_openings(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rebuild every conversation c: the first h turns of conversation c-c%5, then its own after its first h.

    h is the unsigned crc32 of the decimal id, modulo 9; at most 8 turns of each conversation are borrowed. The remainder of
    a negative id is negative, as in SQL.
    """
    convs = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).alias("h"))
    heads = (turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < OPENING - 1))
             .groupBy(F.col("conv_id").alias("family"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("head")))
    convs = stage(convs.join(heads, "family", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast(
            "array<struct<pos:long,tid:long,size:long>>")), F.lit(1), F.col("h").cast("int")).alias("head")),
        "openings")
    own = (turns.join(convs.select("conv_id", "h", F.size("head").alias("got")), "conv_id")
           .filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"),
                                      "tid", "size"))
    return own.unionByName(convs.select("conv_id", F.inline("head")))


# ---------------------------------------------------------------------- trees

def median_order(n: int) -> Iterator[int]:
    """0 to n-1, each range from its median outwards."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


class Tree:
    """A ternary search tree over sorted distinct sequences of numbers."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.symbol: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.down: list[int] = []  # first of the next symbols
        self.parent: list[int] = []
        self.end = [-1] * len(sequences)
        for i in median_order(len(sequences)):
            self.end[i] = self._insert(sequences[i])

    def _insert(self, sequence: list[int]) -> int:
        symbol, low, high, down = self.symbol, self.low, self.high, self.down
        link, at, parent = None, (0 if symbol else -1), -1
        for s in sequence:
            while at >= 0 and (here := symbol[at]) != s:
                link = (low if s < here else high), at
                at = link[0][at]
            if at < 0:
                at = len(symbol)
                symbol.append(s)
                low.append(-1)
                high.append(-1)
                down.append(-1)
                self.parent.append(parent)
                if link:
                    link[0][link[1]] = at
            parent, link, at = at, (down, at), down[at]
        return parent

    def path(self, node: int) -> list[int]:
        """The nodes from the top to ``node``."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def _shard_rows(table: pa.Table) -> pa.Table:
    """Task function: the nodes of one shard."""
    row = {c: table.column(c).to_pylist() for c in table.column_names}
    order = sorted(range(table.num_rows), key=lambda i: (row["root"][i], row["tids"][i]))
    row = {c: [v[i] for i in order] for c, v in row.items()}
    roots = {r: i for i, r in enumerate(sorted(set(row["root"])))}
    tree = Tree([[roots[r], *t] for r, t in zip(row["root"], row["tids"])])
    count = len(tree.symbol)
    big = 1 << 63
    n, first, size = [0] * count, [big] * count, [0] * count
    end: list[bytes | None] = [None] * count
    extra = [(0, 0, 0)] * count
    for i, node in enumerate(tree.end):
        n[node], first[node], end[node] = row["n"][i], row["first"][i], row["end"][i]
        extra[node] = row["more_children"][i], row["more_leaves"][i], row["more_saved"][i]
        for step, b in zip(tree.path(node)[1:], row["sizes"][i]):
            size[step] = b

    first_path, last_path = tree.path(tree.end[0]), tree.path(tree.end[-1])
    with_before = set(first_path[:max(row["with_before"][0], 0)])
    with_next = set(last_path[:max(row["with_next"][0], 0)])
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    # sums over a node, its lesser and its greater siblings, once it is done
    group = [(0, big, 0, 0, 0)] * count
    none = (0, big, 0, 0, 0)
    for i in range(count - 1, -1, -1):
        below = group[tree.down[i]] if tree.down[i] >= 0 else none
        own = extra[i]
        n[i] += below[0]
        first[i] = min(first[i], below[1])
        children[i] = below[2] + own[0]
        leaf = tree.down[i] < 0 and not own[1] and i not in with_next
        leaves[i] = below[3] + own[1] + leaf
        saved[i] = below[4] + own[2] + n[i] * size[i] - (0 if i in with_before else size[i])
        left = group[tree.low[i]] if tree.low[i] >= 0 else none
        right = group[tree.high[i]] if tree.high[i] >= 0 else none
        group[i] = (n[i] + left[0] + right[0], min(first[i], left[1], right[1]),
                    (i not in with_before) + left[2] + right[2], leaves[i] + left[3] + right[3],
                    saved[i] + left[4] + right[4])

    shared = with_before | with_next
    names: dict[int, bytes] = {}
    by_number = {i: r for r, i in roots.items()}
    for path in (first_path, last_path):
        name = hashlib.md5(by_number[tree.symbol[path[0]]])
        for node in path:
            if node != path[0]:
                name.update(struct.pack("<q", tree.symbol[node]))
            names[node] = name.digest()
    depth, root_of = [0] * count, [0] * count
    for i, parent in enumerate(tree.parent):
        depth[i] = depth[parent] + 1 if parent >= 0 else 0
        root_of[i] = root_of[parent] if parent >= 0 else i
    known = {roots[r]: f for r, f in zip(row["root"], row["root_first"])}
    out: dict[str, list] = {c.split()[0]: [] for c in NODE.split(", ")}
    base = row["base"][0]
    for i, parent in enumerate(tree.parent):
        above = None
        if parent >= 0:
            above = known[tree.symbol[parent]] if tree.parent[parent] < 0 and base else first[parent]
        open_parent = parent in shared and not (base and tree.parent[parent] < 0)
        for name, value in zip(out, (
                names[i] if i in shared else None, names[parent] if open_parent else None,
                base + depth[i], first[i], None if open_parent else above, n[i], children[i], leaves[i],
                saved[i], end[i], by_number[tree.symbol[root_of[i]]] if parent < 0 else None)):
            out[name].append(value)
    kinds = {"path": pa.binary(), "parent_path": pa.binary(), "end": pa.binary(), "root": pa.binary()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def _cut(most: int):
    """Task function: shard numbers of sorted rows, in order over all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for length in batch.column("turns").to_pylist():
                if held and held + length > most:
                    shard, held = shard + 1, 0
                held += length + 1
                numbers.append(shard)
            yield batch.append_column("shard", pa.array(numbers, pa.int64()))
    return run


def _common(left: str, right: str) -> Column:
    """How many symbols (the root first) two sequences of distinct content share."""
    same = F.zip_with(f"{left}.tids", f"{right}.tids", lambda a, b: a.eqNullSafe(b))
    other = F.array_position(same, False)
    return F.when(F.col(f"{left}.root") == F.col(f"{right}.root"), F.when(
        other > 0, other).otherwise(F.size(same) + 1)).otherwise(0).cast("long")


def _nodes(items: DataFrame, base: int, shard: int) -> DataFrame:
    """The merged nodes of one level; the top of each tree has its ``root``, others null."""
    keys = ["root", "tids"]
    placed = stage(items.withColumn("turns", F.size("tids").cast("long")).repartitionByRange(*keys)
                   .sortWithinPartitions(*keys)
                   .mapInArrow(_cut(shard), items.withColumn("turns", F.lit(0).cast("long"))
                               .withColumn("shard", F.lit(0).cast("long")).schema), "placed")
    order = Window.orderBy("shard")
    ends = (placed.groupBy("shard").agg(F.min(F.struct(*keys)).alias("head"), F.max(F.struct(*keys)).alias("tail"))
            .withColumns({"last": F.lag("tail").over(order), "next": F.lead("head").over(order)})
            .select("shard", F.coalesce(_common("last", "head"), F.lit(0)).alias("with_before"),
                    F.coalesce(_common("tail", "next"), F.lit(0)).alias("with_next")))
    found = stage(placed.join(ends, "shard").withColumn("base", F.lit(base).cast("long"))
                  .groupBy("shard").applyInArrow(_shard_rows, NODE), "nodes")
    merged = stage(found.filter(F.col("path").isNotNull()).groupBy("path").agg(
        *[F.max(c).alias(c) for c in ("parent_path", "depth", "parent_first", "end", "root")],
        F.min("first").alias("first"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]), "merged")
    rows = found.filter(F.col("path").isNull()).unionByName(merged)
    above = merged.select(F.col("path").alias("parent_path"), F.col("first").alias("of_parent"))
    open_ = rows.filter(F.col("parent_path").isNotNull()).join(bounded(above), "parent_path")
    columns = ["depth", "first", "n_convs", "n_children", "n_leaves", "saved", "end", "root"]
    return (rows.filter(F.col("parent_path").isNull()).select(*columns, "parent_first")
            .unionByName(open_.select(*columns, F.col("of_parent").alias("parent_first"))))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, shard: int = SHARD
                ) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of ``turns`` (conv_id, pos from 0 without gaps, tid, size).

    Every id of ``convs`` is a member of the root, with or without turns. Nodes: depth, first (smallest
    member), parent_first, n_convs, n_children, n_leaves, saved, end. Ends: end, conv_id of each
    conversation whose last turn is that node's (null ``end``: none). No conversation: no node.
    """
    blocks = stage(turns.groupBy("conv_id", F.floor(F.col("pos") / block).cast("long").alias("level")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("rows")).select(
        "conv_id", "level", F.col("rows.tid").alias("tids"), F.col("rows.size").alias("sizes")), "blocks")
    lengths = blocks.groupBy("conv_id").agg(F.max("level").alias("top"))
    alive = convs.select("conv_id").join(lengths, "conv_id", "left").select(
        "conv_id", F.coalesce("top", F.lit(0)).alias("top"), F.lit(b"").alias("root"),
        F.lit(None).cast("long").alias("root_first"))
    none, levels, ends, chains = F.array().cast("array<long>"), [], [], []
    while True:
        level = len(levels)
        here = alive.join(blocks.filter(F.col("level") == level).drop("level"), "conv_id", "left").select(
            "conv_id", "top", "root", "root_first", F.coalesce("tids", none).alias("tids"),
            F.coalesce("sizes", none).alias("sizes"))
        here = stage(here.withColumn("key", F.unhex(F.md5(F.concat(
            "root", F.encode(F.array_join(F.col("tids").cast("array<string>"), ","), "UTF-8"))))), "level")
        ended = F.col("top") == level
        items = stage(here.groupBy("key", "root", "tids", "sizes").agg(
            F.max("root_first").alias("root_first"), F.count(F.lit(1)).alias("n"),
            F.min("conv_id").alias("first"), F.max(F.when(ended, F.col("key"))).alias("end"),
            F.count_if(~ended).alias("more")), "items")
        ends.append(here.filter(ended).select(F.col("key").alias("end"), "conv_id"))
        levels.append(items)
        lonely = items.filter("n = 1 AND more = 1").select(F.col("first").alias("conv_id"), "key")
        tail = lonely.drop("key").join(blocks.filter(F.col("level") > level), "conv_id").join(lengths, "conv_id")
        chains.append(tail.select(
            "conv_id", (F.col("level") == F.col("top")).alias("ends"), F.size("tids").alias("turns"),
            F.posexplode("tids").alias("at", "tid"), "level").select(
            (F.col("level") * block + F.col("at") + 1).alias("depth"), F.col("conv_id").alias("first"),
            F.lit(1).cast("long").alias("n_convs"),
            F.when(F.col("ends") & (F.col("at") + 1 == F.col("turns")), 0).otherwise(1).cast("long")
            .alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
            F.when(F.col("ends") & (F.col("at") + 1 == F.col("turns")),
                   F.unhex(F.md5(F.concat(F.lit("alone:"), F.col("conv_id").cast("string"))))).alias("end"),
            F.col("conv_id").alias("parent_first")))
        ends.append(lonely.select(F.unhex(F.md5(F.concat(
            F.lit("alone:"), F.col("conv_id").cast("string")))).alias("end"), "conv_id"))
        alive = stage(here.filter(~ended).select("conv_id", "top", "key").join(
            items.filter("n > 1").select("key", F.col("first").alias("root_first")), "key").select(
            "conv_id", "top", F.col("key").alias("root"), "root_first"), "alive")
        if alive.isEmpty():
            break

    zero = F.lit(0).cast("long")
    out, totals = [], None
    for level in range(len(levels) - 1, -1, -1):
        items = levels[level]
        alone = (F.col("n") == 1) & (F.col("more") == 1)
        if totals is None:
            items = items.withColumns({"below_children": F.lit(None).cast("long"),
                                       "below_leaves": F.lit(None).cast("long"),
                                       "below_saved": F.lit(None).cast("long")})
        else:
            items = items.join(totals, "key", "left")
        items = items.select(
            "root", "tids", "sizes", "n", "first", "end", "root_first",
            F.when(alone, 1).otherwise(F.coalesce("below_children", zero)).cast("long").alias("more_children"),
            F.when(alone, 1).otherwise(F.coalesce("below_leaves", zero)).cast("long").alias("more_leaves"),
            F.coalesce("below_saved", zero).alias("more_saved"))
        nodes = _nodes(items, level * block, shard)
        if level:
            totals = nodes.filter(F.col("root").isNotNull()).select(
                F.col("root").alias("key"), F.col("n_children").alias("below_children"),
                F.col("n_leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
            nodes = nodes.filter(F.col("root").isNull())
        out.append(nodes.drop("root"))
    for rows in chains:
        out.append(rows)
    every, all_ends = out[0], ends[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    for rows in ends[1:]:
        all_ends = all_ends.unionByName(rows)
    return every, all_ends


# ----------------------------------------------------------------------- ends

def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: SHA-256 of the comma-joined pieces of each end, which arrive together and in order."""
    key, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"end": pa.array([key], pa.binary()), "sha": [state.hexdigest()]})
    for batch in batches:
        done = {"end": [], "sha": []}
        for end, piece in zip(batch.column("end").to_pylist(), batch.column("piece").to_pylist()):
            if end == key:
                state.update(b"," + piece.encode())
                continue
            if state:
                done["end"].append(key)
                done["sha"].append(state.hexdigest())
            key, state = end, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_pydict({"end": pa.array(done["end"], pa.binary()),
                                          "sha": pa.array(done["sha"], pa.string())})
    if state:
        yield row()


def ends_digest(ends: DataFrame) -> DataFrame:
    """end, sha: SHA-256 of the ascending decimal ids of each end, joined by commas.

    Ids are joined in pieces of at most 2**CHUNK_BITS first; one task then streams the pieces of an end
    through one hash, whose order allows no other way, in constant memory.
    """
    pieces = ends.groupBy("end", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
    return (pieces.repartition("end").sortWithinPartitions("end", "chunk").select("end", "piece")
            .mapInArrow(_hash_runs, "end binary, sha string"))


@query("op11_prefix_trie", r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
 FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS family, xor(4294967295::UBIGINT, list_reduce(
   list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''),
     lambda ch: ord(ch)::UBIGINT)),
   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
     lambda y, z: xor(y >> 1, (y & 1::UBIGINT) * 3988292384::UBIGINT)))) % 9 AS h
 FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT c.conv_id, c.h, least(c.h, count(b.conv_id)) AS got
 FROM c LEFT JOIN t b ON b.conv_id = c.family
 GROUP BY c.conv_id, c.h),
r AS (SELECT c.conv_id, b.pos + 1 AS d, b.role, b.text FROM c JOIN t b ON b.conv_id = c.family AND b.pos < c.h
 UNION ALL
 SELECT t.conv_id, t.pos - n.h + n.got + 1, t.role, t.text FROM t JOIN n USING (conv_id) WHERE t.pos >= n.h),
l AS (SELECT conv_id, max(d) AS len FROM r GROUP BY 1),
p AS (SELECT conv_id, d, strlen(text) AS bytes,
  sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d)
   OVER (PARTITION BY conv_id ORDER BY d)) AS k
 FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT p.*, lag(k) OVER (PARTITION BY p.conv_id ORDER BY d) AS pk,
  coalesce(l.len, 0) = d AS ends FROM p LEFT JOIN l USING (conv_id)),
v AS (SELECT d, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
 FROM q GROUP BY d, k),
ch AS (SELECT pk, d - 1 AS d, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
s AS (SELECT p.d, p.k, count(*) FILTER (ch.n IS NULL) AS leaves, sum((v.n - 1) * v.bytes) AS saved
 FROM v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.d LEFT JOIN ch ON ch.pk = v.k AND ch.d = v.d GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(ch.n, 0) AS n_children,
 s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN s USING (d, k) LEFT JOIN ch ON ch.pk = v.k AND ch.d = v.d
LEFT JOIN v u ON u.d = v.d - 1 AND u.k = v.pk""")
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = stage(encode_turns(spark.read.parquet(f"{folder}/conversations.parquet")), "encoded")
    convs = stage(turns.select("conv_id").distinct(), "convs")
    nodes, ends = prefix_trie(share_openings(turns, convs), convs)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
             "ends_sha256"]
    nodes = stage(nodes.select(F.col("first").alias("conv_id"), "depth",
                               F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children",
                               "n_leaves", F.col("saved").alias("saved_tokens"), "end"), "nodes")
    with_ends = nodes.filter(F.col("end").isNotNull()).join(ends_digest(ends), "end")
    return with_ends.withColumnRenamed("sha", "ends_sha256").select(names).unionByName(
        nodes.filter(F.col("end").isNull()).withColumn("ends_sha256", F.sha2(F.lit(""), 256)).select(names))
