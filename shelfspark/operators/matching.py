"""Groups of listings that are the same product under slightly different names.

Similar names are found with an exact filter chain. For two names of given
lengths the threshold fixes how many characters they must share, so their
rarest characters must meet; a rare character together with both lengths is the
equi-join key. A bound on the shared characters from bit counts follows, and
the common subsequence is computed only for pairs that are left.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.similarity import lcs, normalize_name, sorted_tokens
from shelfspark.operators.graph import components
from shelfspark.operators.listings import valid_price
from shelfspark.operators.stats import value_counts
from shelfspark.session import cut_lineage, spread, stage

THRESHOLD, BEST = 85, 10
RANKED_TOKENS = 1_000
HOT_KEY = 20_000
PEELS, COMPONENT = 4, 1_000_000  # rounds before components are sought; edges that one task goes through
CELLS, CLASSES_PER_WORD, WORDS = 6, 10, 4
SIGNED = ("ord long, text string, len int, tokens array<long>, bag0 long, bag1 long, bag2 long, "
          "bag3 long, bag_rest int")


def with_normalized_name(df: DataFrame) -> DataFrame:
    return df.withColumn("normalized_name", normalize_name("title", "size_value", "size_unit"))


def distinct_names(df: DataFrame, order: str = "seq") -> DataFrame:
    """Each normalised name once, numbered by its first appearance."""
    return df.groupBy("normalized_name").agg(F.min(order).alias("ord"))


def number_names(names: DataFrame) -> DataFrame:
    """Names in order of ``ord``, then of the name, each with a number of its own.

    Needed where several listings may share one value of the order column.
    """
    first = stage(names.select(F.struct("ord", "normalized_name").alias("spot")), "names-in-order")
    return value_counts(first, "spot").select(
        F.col("spot.normalized_name").alias("normalized_name"), F.col("n_below").alias("ord"))


def _tokens(text: str) -> list[tuple[str, int]]:
    """Characters with their occurrence number, so that a bag becomes a set."""
    seen: Counter = Counter()
    out = []
    for ch in text:
        seen[ch] += 1
        out.append((ch, seen[ch]))
    return out


def _token_id(token: tuple[str, int]) -> int:
    return ord(token[0]) * 100_000 + token[1]


def _packed_bag(counts: Counter) -> list[int]:
    """Unary character counts in four words, and what does not fit.

    Characters beyond the 40 classes share classes, which can only raise the
    overlap of two bags, so the bound taken from them stays a bound.
    """
    classes = [0] * (CLASSES_PER_WORD * WORDS)
    for ch, n in counts.items():
        code = ord(ch)
        if 97 <= code <= 122:
            place = code - 97
        elif 48 <= code <= 57:
            place = 26 + code - 48
        else:
            place = 36 + code % 4
        classes[place] += n
    words = []
    for w in range(WORDS):
        word = 0
        for n in classes[w * CLASSES_PER_WORD:(w + 1) * CLASSES_PER_WORD]:
            word = (word << CELLS) | ((1 << min(n, CELLS)) - 1)
        words.append(word)
    return [*words, sum(max(n - CELLS, 0) for n in classes)]


def _common_tokens(texts: DataFrame) -> list[int]:
    """The commonest tokens, most frequent first; a list of fixed size."""
    chars = texts.select(F.array_sort(F.split("text", "")).alias("c"))
    tokens = chars.select(F.posexplode("c").alias("i", "ch"), "c").where(F.col("ch") != "")
    nth = F.col("i") + 2 - F.array_position("c", F.col("ch"))
    ranked = tokens.groupBy("ch", nth.alias("nth")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "ch", "nth").limit(RANKED_TOKENS).collect()
    return [_token_id((r["ch"], int(r["nth"]))) for r in ranked]


def _signed(names: DataFrame) -> DataFrame:
    """Names with sorted tokens, length, characters from rare to common, packed bag."""
    texts = spread(names.select("ord", sorted_tokens("normalized_name").alias("text")).where(
        F.length("text") > 0))
    # The order only decides how selective the join is, not what it finds.
    rank = {token: i for i, token in enumerate(_common_tokens(texts))}

    def sign(batches):
        for pdf in batches:
            rows = []
            for number, text in zip(pdf["ord"], pdf["text"]):
                ids = [_token_id(t) for t in _tokens(text)]
                ids.sort(key=lambda t: (-rank.get(t, RANKED_TOKENS), t))
                rows.append((number, text, len(text), ids, *_packed_bag(Counter(text))))
            yield pd.DataFrame(rows, columns=["ord", "text", "len", "tokens", "bag0", "bag1",
                                              "bag2", "bag3", "bag_rest"])

    return texts.mapInPandas(sign, SIGNED)


def _split_hot(left: DataFrame, right: DataFrame, hot: int) -> tuple[DataFrame, DataFrame, list]:
    """Cut both sides of hot keys into chunks and pair every two chunks.

    Keys with at most ``hot`` rows on each side stay whole. No row is lost: a
    row of one chunk is copied to each chunk of the other side.
    """
    def sizes(side: DataFrame, name: str) -> DataFrame:
        counts = side.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
        return counts.select("key", F.ceil(F.col("n") / hot).cast("int").alias(name))

    parts = sizes(left, "cuts_a").join(sizes(right, "cuts_b"), "key", "full")
    if parts.isEmpty():
        return left, right, ["key"]
    one = F.lit(1)

    def cut(side: DataFrame, number: str, own: str, own_cuts: str, other: str,
            other_cuts: str) -> DataFrame:
        rows = side.join(parts, "key", "left")
        return rows.withColumn(own, F.pmod(
            F.xxhash64(number), F.coalesce(own_cuts, one)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.coalesce(other_cuts, one) - 1))).drop(
            "cuts_a", "cuts_b")

    return (cut(left, "a", "part_a", "cuts_a", "part_b", "cuts_b"),
            cut(right, "b", "part_b", "cuts_b", "part_a", "cuts_a"),
            ["key", "part_a", "part_b"])


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD,
                  hot: int = HOT_KEY) -> DataFrame:
    """All pairs (a, b, score) of names(ord, normalized_name) at or above the threshold.

    Two names are compared at the rarest character that both have in their prefix and nowhere else, where both
    texts are at hand, so candidates are not shuffled.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must lie in (0, 100]")
    eps = 1e-9
    rows = stage(_signed(names), "names")
    reach = (200.0 - threshold) / threshold
    bags = [f"bag{w}" for w in range(WORDS)] + ["bag_rest"]

    def keyed(number: str, side: str, low, high) -> DataFrame:
        """One row per length of a possible partner and per character of the prefix."""
        other = F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("other")
        lengths = rows.select("*", other)
        shared = F.ceil((F.col("len") + F.col("other")) * (threshold / 200.0) - eps)
        prefix = F.slice("tokens", 1, (F.col("len") - shared + 1).cast("int"))
        short, long = ("len", "other") if side == "a" else ("other", "len")
        return lengths.select(
            F.posexplode(prefix).alias("n", "t"), F.col(short).alias("short"), F.col(long).alias("long"),
            F.col("ord").alias(number), F.col("text").alias(f"text_{side}"), "tokens",
            *[F.col(b).alias(f"{b}_{side}") for b in bags]
        ).withColumn("key", F.xxhash64("short", "long", "t")).withColumn(
            f"rarer_{side}", F.slice("tokens", F.lit(1), F.col("n"))).drop(
            "n", "t", "tokens", *(["short", "long"] if side == "b" else []))

    n = F.col("len")
    shorter = keyed("a", "a", n, F.floor(n * reach + eps))
    longer = keyed("b", "b", F.ceil(n / reach - eps), n)
    shorter, longer, on = _split_hot(shorter, longer, hot)
    overlap = F.least("bag_rest_a", "bag_rest_b")
    for w in range(WORDS):
        overlap = overlap + F.bit_count(F.col(f"bag{w}_a").bitwiseAND(F.col(f"bag{w}_b")))
    once = (F.col("short") < F.col("long")) | (F.col("a") < F.col("b"))
    enough = overlap * 200 >= (F.col("short") + F.col("long")) * threshold
    first = ~F.arrays_overlap("rarer_a", "rarer_b")
    # Estimates do not count what explode multiplies, so a broadcast of either side could be of any size.
    candidates = shorter.hint("merge").join(longer.hint("merge"), on).where(once & enough & first)
    return (
        candidates.select("a", "b", "text_a", "text_b")
        .withColumn("common", lcs("text_a", "text_b"))
        .withColumn("both", F.length("text_a") + F.length("text_b"))
        .where(F.col("common") * 200 >= F.col("both") * threshold - eps)
        .select("a", "b", (F.col("common") * F.lit(200.0) / F.col("both")).alias("score"))
    )


def top_k_similar(names: DataFrame, k: int = BEST, threshold: float = THRESHOLD) -> DataFrame:
    """The ``k`` most similar names of each name; the name itself is one of them.

    Ties go to the name that appeared first. Only matches at or above the
    threshold are listed, which is all that grouping looks at.
    """
    pairs = stage(similar_pairs(names, threshold), "pairs")
    both_ways = F.explode(F.array(F.struct(F.col("a").alias("ord"), F.col("b").alias("match")),
                                  F.struct(F.col("b").alias("ord"), F.col("a").alias("match"))))
    found = pairs.select(both_ways.alias("p"), "score").select("p.ord", "p.match", "score")
    itself = names.select("ord", F.col("ord").alias("match"), F.lit(100.0).alias("score"))
    spot = Window.partitionBy("ord").orderBy(F.desc("score"), "match")
    return found.unionByName(itself).withColumn("place", F.row_number().over(spot)).where(
        F.col("place") <= k)


def _by_component(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(followers, solved nodes) of the components of at most ``most`` edges, each gone through once."""
    placed = cut_lineage(edges.join(components(edges, "src", "dst").withColumnRenamed("node", "src"), "src"))
    small = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    held = cut_lineage(placed.join(small.select("component"), "component", "left_semi"))

    def claim(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "dst"])
        followed: set[int] = set()
        for src, dst in zip(rows["src"], rows["dst"]):
            # an edge comes after all edges into its source, as those come from earlier names
            if src not in followed:
                followed.add(dst)
        return pd.DataFrame({"ord": sorted(followed)}, dtype="int64")

    followers = cut_lineage(held.groupBy("component").applyInPandas(claim, "ord long"))
    solved = held.select(F.explode(F.array("src", "dst")).alias("ord")).distinct()
    return followers, cut_lineage(solved)


def elect_leaders(nodes: DataFrame, edges: DataFrame, rounds: int = PEELS,
                  most: int = COMPONENT) -> DataFrame:
    """(ord, leader) of every node, equal to claiming names in order of appearance.

    ``edges`` (src, dst) point from an earlier to a later name that the earlier
    one would claim. In each round the open names without open claimants lead,
    and the names they list follow; a follower belongs to its first leader.
    That ends most graphs in few rounds. What is left after ``rounds`` (long
    chains) is parted into components, found in a logarithmic number of rounds,
    and each of at most ``most`` edges is gone through once in its order of
    appearance; larger ones go on in rounds.
    """
    spark = nodes.sparkSession
    all_edges = cut_lineage(edges.select("src", "dst").distinct())
    open_nodes = cut_lineage(nodes.select("ord").distinct())
    open_edges, followers = all_edges, None
    everyone, turn = open_nodes, 0

    def both_open(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return cut_lineage(edges.join(nodes.select(F.col("ord").alias("src")), "src", "left_semi")
                           .join(nodes.select(F.col("ord").alias("dst")), "dst", "left_semi"))

    while not open_edges.isEmpty():
        turn += 1
        if turn % (rounds + 1) == 0:
            following, solved = _by_component(open_edges, most)
            open_nodes = cut_lineage(open_nodes.join(solved, "ord", "left_anti"))
        else:
            claimed = open_edges.select(F.col("dst").alias("ord")).distinct()
            leading = open_nodes.join(claimed, "ord", "left_anti")
            following = cut_lineage(open_edges.join(
                leading.select(F.col("ord").alias("src")), "src", "left_semi").select(
                F.col("dst").alias("ord")).distinct())
            open_nodes = cut_lineage(open_nodes.join(claimed, "ord", "left_semi").join(
                following, "ord", "left_anti"))
        followers = following if followers is None else followers.unionByName(following)
        open_edges = both_open(open_edges, open_nodes)
    if followers is None:
        followers = spark.createDataFrame([], everyone.schema)
    leaders = everyone.join(followers, "ord", "left_anti")
    first = all_edges.join(leaders.select(F.col("ord").alias("src")), "src", "left_semi").groupBy(
        "dst").agg(F.min("src").alias("leader"))
    return everyone.join(first.withColumnRenamed("dst", "ord"), "ord", "left").select(
        "ord", F.coalesce("leader", "ord").alias("leader"))


def group_names(names: DataFrame, threshold: float = THRESHOLD, k: int = BEST) -> DataFrame:
    """(ord, normalized_name, leader): names grouped under the first name like them."""
    names = stage(names, "distinct-names")
    matches = top_k_similar(names, k, threshold)
    edges = matches.where(F.col("match") > F.col("ord")).select(
        F.col("ord").alias("src"), F.col("match").alias("dst"))
    return elect_leaders(names, edges).join(names, "ord")


def qualify_groups(df: DataFrame, groups: DataFrame, order: str = "seq") -> DataFrame:
    """Give each listing its product_group_id.

    A group counts if it has two stores or two names; other listings each form
    their own. Ids are surrogates: even from the leader, odd from the listing.
    ``order`` must be unique per listing.
    """
    members = df.join(groups.select("normalized_name", "leader"), "normalized_name", "left")
    sizes = members.groupBy("leader").agg(
        F.count_distinct("site").alias("_sites"),
        F.count_distinct("normalized_name").alias("_names"))
    good = sizes.where((F.col("_sites") >= 2) | (F.col("_names") > 1)).select(
        "leader", F.lit(True).alias("_good"))
    return members.join(good, "leader", "left").withColumn(
        "product_group_id", F.when(F.col("_good"), F.col("leader") * 2).otherwise(
            F.col(order) * 2 + 1)).drop("leader", "_good")


def match_products(df: DataFrame, threshold: float = THRESHOLD, k: int = BEST,
                   order: str = "seq") -> DataFrame:
    """Listings with a valid price, each with its normalised name and group."""
    priced = stage(valid_price(with_normalized_name(df)).withColumn(
        "_listing", F.monotonically_increasing_id()), "priced-names")
    groups = group_names(number_names(distinct_names(priced, order)), threshold, k)
    return qualify_groups(priced, groups, "_listing").drop("_listing")
