"""Operator 4: similarity join of texts by Jaccard similarity of their word n-grams.

Words are runs of ``[^\\x20\\x09-\\x0D]``; an n-gram is ``width`` consecutive words. A text of fewer words
has one n-gram, all its words; a text without words (null, empty, blank) has none and no link. Texts
with a similarity of ``threshold`` or more are linked; texts with equal n-gram sets are copies and
linked. A class is a connected component; its id is its smallest doc_id.

1. Each text gives a 128-bit hash of its n-gram set and MinHash values in bands. Bands and rows are the
   most selective ones with at most ``max_hashes`` values whose recall at the threshold is ``recall``.
2. Copies become one node with a count.
3. Nodes meet by band hash. Bands of more than ``WIDE`` nodes never make pairs: their nodes are put
   together by connected components, dealt into chunks, and each pair of chunks is multiplied in one
   task of bounded memory that returns link counts and a forest of links only. Other bands give pairs,
   without those inside one such component.
4. Candidates are verified on their full n-gram sets, read again from the texts of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, arrow_texts, bounded, documents, id_text, query, stage
from shelfspark.llm.graph import components

WIDTH, THRESHOLD = 5, 0.8
RECALL, MAX_HASHES = 0.9999, 128
WIDE = 32  # nodes of a band hash that still make pairs
CHUNK = 1 << 17  # n-grams of a chunk, as expected
LEAST = 256  # a node counts at least so many n-grams in its chunk
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands fit into ``max_hashes`` at the target recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-threshold ** rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of each text."""
    import xxhash

    split = [text.split() for text in texts]
    code = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)}
    out = []
    with np.errstate(over="ignore"):
        for words in split:
            h = np.array([code[w] for w in words], np.uint64)
            n = min(width, len(h))
            grams = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
            for i in range(n):
                grams = grams * MIX + h[i:len(h) - n + 1 + i]
            out.append(np.unique(scramble(grams + np.uint64(n))))
    return out


def _signatures(width: int, bands: int, rows: int):
    """Task function: hash of the n-gram set, its size, and one hash a band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        r = np.random.default_rng(4)
        times = r.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        plus = r.integers(0, 1 << 63, bands * rows, np.uint64)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                hashes, sizes, marks = [], [], []
                for grams in gram_sets(arrow_texts(batch), width):
                    sizes.append(len(grams))
                    if not len(grams):
                        hashes.append(None)
                        marks.append(None)
                        continue
                    hashes.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                    with np.errstate(over="ignore"):
                        for at in range(0, len(grams), 2048):
                            part = grams[at:at + 2048, None] * times + plus
                            np.minimum(low, part.min(axis=0), out=low)
                    marks.append([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)
                                  for x in low.reshape(bands, rows)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"),
                     pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(marks, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "set_hash", "grams", "bands"])
    return run


def _sets(width: int):
    """Task function: n-gram sets of the texts that stand for candidate nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sets = gram_sets(arrow_texts(batch), width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"),
                     pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                    names=["node", "grams"])
    return run


def _block(threshold: float):
    """Group function: links between two chunks, as a count per node and a forest."""
    def run(table: pa.Table) -> pa.Table:
        side, first = table.column("side").to_numpy(), table.column("i")[0].as_py()
        inside = first == table.column("j")[0].as_py()
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        grams = table.column("grams").combine_chunks()
        size = np.diff(grams.offsets.to_numpy())
        flat = grams.flatten().to_numpy()
        owner = np.repeat(np.arange(len(nodes)), size)
        _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often[column] > 1
        number = np.cumsum(often > 1) - 1
        owner, column = owner[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        rows = np.arange(len(nodes)) if inside else np.flatnonzero(side == first)
        cols = rows if inside else np.flatnonzero(side != first)
        common = np.zeros((len(rows), len(cols)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((len(nodes), 4096), np.float32)
            m[owner[a:b], column[a:b] - at] = 1
            common += m[rows] @ m[cols].T
        union = size[rows][:, None] + size[cols][None, :] - common.astype(np.float64)
        linked = common / union >= threshold
        if inside:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(nodes), np.int64)
        links[rows] += linked @ copies[cols]
        if not inside:
            links[cols] += copies[rows] @ linked
        peer = nodes.copy()
        x, y = np.nonzero(linked)
        x, y = rows[x], cols[y]
        while True:  # smallest node within the block's links
            old = peer.copy()
            np.minimum.at(peer, x, peer[y])
            np.minimum.at(peer, y, peer[x])
            if (old == peer).all():
                break
        some = links > 0
        return pa.table({"node": nodes[some], "links": links[some], "peer": peer[some]})
    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL,
                 max_hashes: int = MAX_HASHES, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id, n_links, keeps.

    ``n_links`` counts the other rows linked to this one. ``keeps`` is true for one row of each class,
    that with the smallest doc_id, and of equal ids the first. A class without any id has a null id.
    """
    texts = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("doc_id", "text"))
    bands, rows = bands_for(threshold, recall, max_hashes)
    signed = stage(texts.mapInArrow(
        _signatures(width, bands, rows),
        "doc_id long, text_key long, set_hash binary, grams long, bands array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = stage(signed.filter("grams > 0").groupBy("set_hash").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"),
        F.min_by("text_key", "row").alias("text_key"), F.any_value("grams").alias("grams"),
        F.any_value("bands").alias("bands")), "nodes")

    marks = nodes.select("node", "grams", F.posexplode("bands").alias("band", "mark"))
    sizes = marks.groupBy("band", "mark").agg(
        F.count(F.lit(1)).alias("members"), F.min("node").alias("head")).filter("members > 1")
    met = stage(marks.join(sizes, ["band", "mark"]), "met")
    pooled = stage(components(met.filter(F.col("members") > wide), "node", "head"), "pools")

    few = (met.filter(F.col("members") <= wide).join(pooled, "node", "left")
           .select("band", "mark", "node", "grams",
                   F.coalesce("component", F.bitwise_not("node")).alias("pool")))
    a, b = few.alias("a"), few.alias("b")
    pairs = stage(a.join(b, [
        F.col("a.band") == F.col("b.band"), F.col("a.mark") == F.col("b.mark"),
        F.col("a.node") < F.col("b.node"), F.col("a.pool") != F.col("b.pool"),
        F.least("a.grams", "b.grams") >= F.lit(threshold) * F.greatest("a.grams", "b.grams")])
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")

    wanted = (pairs.select(F.col("a").alias("node"))
              .unionByName(pairs.select(F.col("b").alias("node")))
              .unionByName(pooled.select("node")).distinct()
              .join(nodes.select("node", "text_key"), "node"))
    wanted = stage(wanted, "wanted")
    sets = stage(texts.join(bounded(wanted), "text_key").select("node", "text")
                 .mapInArrow(_sets(width), "node long, grams array<long>")
                 .dropDuplicates(["node"]), "sets")
    counted = nodes.select("node", "copies")

    verified = (pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
                .withColumn("common", F.size(F.array_intersect("x", "y")))
                .filter(F.col("common") / (F.size("x") + F.size("y") - F.col("common"))
                        >= threshold).select("a", "b"))
    verified = stage(verified, "verified")
    ends = verified.unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b")))
    single = (ends.join(counted, ends["b"] == counted["node"])
              .select(F.col("a").alias("node"), F.col("copies").alias("links")))

    pool = pooled.join(sets, "node").join(counted, "node")
    chunks = (pooled.join(nodes.select("node", "grams"), "node").groupBy("component")
              .agg(F.ceil(F.sum(F.greatest("grams", F.lit(LEAST))) / F.lit(CHUNK)).alias("chunks")))
    dealt = (pool.join(chunks, "component")
             .withColumn("side", F.pmod(F.xxhash64("node"), "chunks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")))
    # rows lie by component after the joins; each pair of chunks gets a task of its own
    blocks = stage(dealt.repartition("component", "i", "j").groupBy("component", "i", "j").applyInArrow(
        _block(threshold), "node long, links long, peer long"), "blocks")

    linked = (single.unionByName(blocks.select("node", "links"))
              .groupBy("node").agg(F.sum("links").alias("links")))
    joined = components(verified.unionByName(
        blocks.select(F.col("node").alias("a"), F.col("peer").alias("b"))))
    facts = stage(nodes.select("set_hash", "node", "copies")
                  .join(linked, "node", "left").join(joined, "node", "left")
                  .select("set_hash", F.coalesce("component", "node").alias("component"),
                          (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
                  "facts")
    placed = stage(signed.select("doc_id", "text_key", "row", "set_hash")
                   .join(facts, "set_hash", "left")
                   .select("doc_id", "text_key", "row", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                           F.coalesce("component", F.bitwise_not("row")).alias("component")), "placed")
    heads = stage(placed.groupBy("component").agg(
        F.max(F.struct(F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))
        .alias("head")), "heads")
    return placed.join(heads, "component").select(
        "doc_id", "text_key", F.bitwise_not("head.id").alias("class_id"), "n_links",
        (F.col("row") == F.bitwise_not("head.row")).alias("keeps"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns.

    Rows without words are classes of their own and all stay. Of rows with words that are equal in id and
    text, one stays, whichever its other columns.
    """
    stay = stage(jaccard_join(docs).filter("keeps").select("text_key"), "stay")
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.xxhash64(docs["doc_id"].cast("long"), text)
    out = docs.join(stay, key == stay["text_key"], "left_semi")
    worded = F.translate(text, SPACES, "") != ""
    repeated = docs.filter(worded).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if repeated.isEmpty():
        return out
    return out.filter(worded).dropDuplicates(["doc_id", "text"]).unionByName(out.filter(~worded))


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(documents(spark, folder)).select("doc_id", "class_id", "n_links")
