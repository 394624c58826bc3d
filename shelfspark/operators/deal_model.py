"""Deal scores learned from price statistics of a training table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null
from shelfspark.operators.stats import RANGE_ROWS, one_row, quantiles, value_counts
from shelfspark.session import stage

# Component weights and the offset that keeps divisors positive.
WEIGHTS = {"overall": 0.4, "brand": 0.2, "category": 0.2, "unit": 0.1, "keywords": 0.1}
OFFSET = 0.01
KEYWORD_SCALE = 5
DIMENSIONS = ["brand", "category", "site"]
TOP_COLUMNS = ["title", "brand", "category", "price", "site", "deal_score", "price_per_unit"]
CONTAMINATION = 0.1
TREE_ROWS, TREES = 256, 100


def global_price_stats(df: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row: mean, sample deviation, ends, median and count of the price."""
    counts = value_counts(df, "price", range_rows=range_rows)
    middle = quantiles(counts, "price", {"median_price": 0.5})
    return df.agg(
        F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("std_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.count("price").alias("n_rows"),
    ).withColumn("median_price", middle.scalar())


def price_stats_by(df: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """Mean, sample deviation and count for each value of each dimension."""
    keys = [F.col(d) for d in dimensions]
    clean = df.select("price", *[blank_to_null(F.col(d)).alias(d) for d in dimensions])
    name = F.coalesce(*[F.when(F.grouping(F.col(d)) == 0, F.lit(d)) for d in dimensions])
    return clean.groupingSets([[k] for k in keys], *keys).agg(
        name.alias("dimension"), F.coalesce(*keys).alias("key"),
        F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("std_price"),
        F.count("price").alias("n_rows"),
    ).where(F.col("key").isNotNull()).select(
        "dimension", "key", "mean_price", "std_price", "n_rows")


@dataclass
class DealModel:
    """Learned statistics as tables: overall, per key, and the raw score range."""

    overall: DataFrame
    by_key: DataFrame
    score_range: DataFrame

    def save(self, path: str) -> None:
        for name in ("overall", "by_key", "score_range"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> DealModel:
        return DealModel(*[spark.read.parquet(f"{path}/{name}")
                           for name in ("overall", "by_key", "score_range")])


def _key_component(df: DataFrame, by_key: DataFrame, dimension: str) -> DataFrame:
    """Add the z component of one dimension: 0 for unknown keys, null if the
    key was seen once and so has no deviation."""
    stats = by_key.where(F.col("dimension") == dimension).select(
        F.col("key").alias(dimension), F.col("mean_price").alias("_mean"),
        F.col("std_price").alias("_std"), F.lit(True).alias("_known"))
    z = (F.col("_mean") - F.col("price")) / (F.col("_std") + OFFSET)
    return df.join(stats, dimension, "left").withColumn(
        f"_{dimension}", F.when(F.col("_known"), z * WEIGHTS[dimension]).otherwise(0.0)
    ).drop("_mean", "_std", "_known")


def _stat(overall: DataFrame, *names: str) -> Column:
    return one_row(overall, *[F.first(n).alias(n) for n in names])


def raw_deal_score(df: DataFrame, overall: DataFrame, by_key: DataFrame) -> DataFrame:
    """Weighted sum of the distances below the overall, brand and category mean,
    the unit-price component and the keyword component."""
    names = ["mean_price", "std_price"]
    has_unit = "unit_price" in df.columns
    if has_unit:
        names.append("max_unit_price")
    known = _stat(overall, *names)
    rows = _key_component(_key_component(df, by_key, "brand"), by_key, "category")
    total = (known["mean_price"] - F.col("price")) / (known["std_price"] + OFFSET) * WEIGHTS["overall"]
    total = total + F.col("_brand") + F.col("_category")
    if has_unit:
        total = total + F.when(
            F.col("unit_price") > 0,
            (1 - F.col("unit_price") / known["max_unit_price"]) * WEIGHTS["unit"]).otherwise(0.0)
    total = total + F.col("value_score") / KEYWORD_SCALE * WEIGHTS["keywords"]
    return rows.withColumn("raw_deal_score", total).drop("_brand", "_category")


def _scaled(score: Column, ends: Column) -> Column:
    return 100 * ((score - ends["low"]) / (ends["high"] - ends["low"] + OFFSET))


def score_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("raw_deal_score").alias("low"), F.max("raw_deal_score").alias("high"))


def scale_0_100(df: DataFrame) -> DataFrame:
    ends = _stat(score_range(df), "low", "high")
    return df.withColumn("deal_score", _scaled(F.col("raw_deal_score"), ends))


def train(df: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DealModel, DataFrame]:
    """Learn from listings with a price; returns the model and the scored table.

    The table needs price, brand, category, site, value_score and may have
    unit_price.
    """
    priced = stage(df.where(F.col("price").isNotNull()), "priced")
    overall = global_price_stats(priced, range_rows)
    if "unit_price" in df.columns:
        top = priced.agg(F.max("unit_price").alias("m")).scalar()
        overall = overall.withColumn("max_unit_price", top)
    overall, by_key = stage(overall, "overall"), stage(price_stats_by(priced), "by-key")
    scored = stage(raw_deal_score(priced, overall, by_key), "scored")
    return DealModel(overall, by_key, score_range(scored)), scale_0_100(scored)


def score_new(df: DataFrame, model: DealModel) -> DataFrame:
    """Score other listings with learned statistics, held to 0-100."""
    ends = _stat(model.score_range, "low", "high")
    rows = raw_deal_score(df, model.overall, model.by_key)
    score = _scaled(F.col("raw_deal_score"), ends)
    return rows.withColumn("deal_score", F.when(
        score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))))


def top_deals(df: DataFrame, n: int = 20, ties: tuple[str, ...] = ("title", "site", "price")
              ) -> DataFrame:
    return df.where(F.col("deal_score").isNotNull()).orderBy(
        F.desc("deal_score"), *ties).select(
        *[c for c in TOP_COLUMNS if c in df.columns]).limit(n)


# ------------------------------------------------------- price outliers

COPY_RUN = 10_000
NODE = "tree int, node int, feature int, cut double, size int"


def _grow(points: np.ndarray, seed: int) -> list[tuple]:
    """One isolation tree over at most TREE_ROWS points; node i has children 2i+1, 2i+2."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes, todo = [], [(0, 0, points)]
    while todo:
        node, depth, part = todo.pop()
        spans = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(2)
        open_features = np.flatnonzero(spans > 0)
        if depth >= limit or len(part) <= 1 or not len(open_features):
            nodes.append((node, -1, 0.0, len(part)))
            continue
        feature = int(rng.choice(open_features))
        low, high = part[:, feature].min(), part[:, feature].max()
        cut = float(rng.uniform(low, high))
        left = part[:, feature] < cut
        nodes.append((node, feature, cut, len(part)))
        todo += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]
    return nodes


def _mean_path(n):
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    full = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def isolation_trees(df: DataFrame, features: list[str], trees: int = TREES,
                    seed: int = 42) -> DataFrame:
    """Grow the trees, each in its own group on a sample of at most 256 rows.

    Sampling belongs to the method. Equal points are counted, and each copy gets a
    seeded hash of the point and its number, so that copies are drawn in proportion
    and the draw does not depend on partitioning. A pool of fixed size has the
    smallest hashes; each tree draws its rows from it, and no group exceeds 256 rows.
    """
    points = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                         for c in features])
    counts = points.groupBy(*features).agg(F.count("*").alias("_n"))
    # Copies of a hot point are numbered by many tasks, a run each.
    runs = counts.withColumn("_run", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("_n") - 1) / F.lit(COPY_RUN))))).repartition("_run", *features)
    first = F.col("_run") * COPY_RUN
    tagged = runs.withColumn("_copy", F.explode(F.sequence(
        first, F.least(first + COPY_RUN, F.col("_n")) - 1))).select(
        *features, F.xxhash64(F.lit(seed), *features, "_copy").alias("_h"))
    pool = tagged.orderBy("_h", *features).limit(trees * TREE_ROWS)
    pool = stage(pool, "pool")
    draws = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    spot = Window.partitionBy("tree").orderBy(F.xxhash64("_h", "tree"), *features)
    drawn = draws.withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= TREE_ROWS)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(features)
        rows = _grow(part[features].to_numpy(float), seed + int(key[0]))
        return pd.DataFrame([(int(key[0]), *r) for r in rows],
                            columns=["tree", "node", "feature", "cut", "size"])

    return drawn.select("tree", *features).groupBy("tree").applyInPandas(grow, NODE)


def price_outliers(df: DataFrame, features: list[str] | None = None, trees: int = TREES,
                   seed: int = 42, contamination: float = CONTAMINATION,
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """Isolation score per listing and a flag for the most isolated share."""
    features = features or ["price", "price_per_unit"]
    # The forest has at most trees * 2 * TREE_ROWS nodes, whatever the input size.
    forest = isolation_trees(df, features, trees, seed).toPandas()
    parts = [(g["node"].to_numpy(), g["feature"].to_numpy(), g["cut"].to_numpy(),
              g["size"].to_numpy()) for _, g in forest.groupby("tree")]
    largest = max((int(size.max()) for _, _, _, size in parts), default=1)

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.fillna(0.0).to_numpy(float) for c in columns])
        depth = np.zeros(len(points))
        for node, feature, cut, size in parts:
            slot = {int(n): i for i, n in enumerate(node)}
            todo = [(0, 0, np.arange(len(points)))]
            while todo:
                at, level, rows = todo.pop()
                i = slot[at]
                if feature[i] < 0 or not len(rows):
                    depth[rows] += level + _mean_path(size[i])
                    continue
                left = points[rows, feature[i]] < cut[i]
                todo += [(2 * at + 1, level + 1, rows[left]), (2 * at + 2, level + 1, rows[~left])]
        base = float(_mean_path(largest)) or 1.0
        return pd.Series(np.power(2.0, -depth / (len(parts) or 1) / base))

    scored = df.withColumn("outlier_score", isolation(
        *[F.col(c).cast("double") for c in features]))
    scored = stage(scored, "outliers")
    counts = value_counts(scored, "outlier_score", range_rows=range_rows)
    limit = quantiles(counts, "outlier_score", {"q": 1 - contamination}).scalar()
    return scored.withColumn("is_outlier", F.col("outlier_score") > limit)
