"""Deal scores and tiers of one product search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.stats import (
    RANGE_ROWS, average_rank_pct, one_row, quantiles, sorted_codes, value_counts,
)
from shelfspark.session import stage

# Score weights, tier limits and size tiers.
WEIGHTS = {"value": 0.40, "price": 0.25, "pack": 0.15, "store": 0.20}
TIERS = [("Excellent", 75), ("Good", 60), ("Fair", 40), ("Poor", None)]
SIZE_TIERS = ["Small", "Medium", "Large", "XL"]
FULL_PACK = 10
NUMERIC = ["price", "size_value", "pack_count", "normalized_quantity", "unit_price",
           "per_unit_price"]
CRITICAL = ["price", "unit_price", "normalized_quantity"]
MODEL_FEATURES = ["price", "normalized_quantity", "unit_price", "pack_count", "store_encoded"]
MIN_SCORED, MIN_PREDICTED, MIN_CLUSTERED = 5, 10, 15
# Fixed by Spark's tree learners: bins of a feature, and the rows drawn to place them.
BINS, BIN_ROWS = 32, 10_000
BIN_BITS = 6  # what a bin takes in the number of a cell; a draw of other than its mean size gives one bin more
TASK_CELLS = 50_000


def require_complete(df: DataFrame, min_rows: int = MIN_SCORED) -> DataFrame:
    """Rows with price, unit price and quantity; none at all when too few remain."""
    whole = df.dropna(subset=CRITICAL)
    return whole.where(whole.agg(F.count("*").alias("n")).scalar() >= min_rows)


def value_score(df: DataFrame) -> DataFrame:
    """Inverse unit price scaled to 0-100; null when all unit prices are equal."""
    inverse = 1 / (F.col("unit_price") + 0.0001)
    ends = one_row(df, F.min(inverse).alias("low"), F.max(inverse).alias("high"))
    return df.withColumn("value_score", F.try_divide(
        inverse - ends["low"], ends["high"] - ends["low"]) * 100)


def pack_efficiency() -> Column:
    packs = F.coalesce(F.col("pack_count"), F.lit(0))
    return F.when(packs > 0, F.least(packs / F.lit(float(FULL_PACK)), F.lit(1.0))).otherwise(0.0)


def with_size_tier(df: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Quarter of the quantity range, each tier closed on the right."""
    df = stage(df, "sizes")  # several passes, and sizes may be parsed from titles
    counts = value_counts(df, "normalized_quantity", range_rows=range_rows)
    edges = one_row(
        quantiles(counts, "normalized_quantity", {"q1": 0.25, "q2": 0.5, "q3": 0.75}),
        *[F.first(c).alias(c) for c in ("q1", "q2", "q3")])
    amount = F.col("normalized_quantity")
    return df.withColumn("size_tier", (
        F.when(amount <= edges["q1"], SIZE_TIERS[0]).when(amount <= edges["q2"], SIZE_TIERS[1])
        .when(amount <= edges["q3"], SIZE_TIERS[2])
        .when(amount.isNotNull(), SIZE_TIERS[3])))


def store_ranks(df: DataFrame) -> DataFrame:
    """Stores from cheapest to dearest mean unit price, 1 first; ties by name.

    Listings without a store rank nowhere and keep their rows.
    """
    means = df.where(F.col("site").isNotNull()).groupBy("site").agg(F.avg("unit_price").alias("avg_unit_price"))
    ordered = stage(means.select("site", F.struct("avg_unit_price", "site").alias("spot")))
    ranks = value_counts(ordered, "spot")
    # Positions run from 1 to the number of stores. Written, so that the join is planned by their size.
    return stage(ranks.select(
        F.col("spot.site").alias("site"), (F.col("n_below") + 1).cast("int").alias("store_rank"),
        (F.col("n_below") / (F.col("n_total") - 1 + 0.001)).alias("store_rank_normalized")), "store-ranks")


def with_store_rank(df: DataFrame) -> DataFrame:
    return df.join(store_ranks(df), "site", "left")


def deal_score() -> Column:
    score = (
        F.col("value_score") * WEIGHTS["value"]
        + (100 - F.col("price_percentile")) * WEIGHTS["price"]
        + F.col("pack_efficiency") * 100 * WEIGHTS["pack"]
        + (100 - F.col("store_rank_normalized") * 100) * WEIGHTS["store"]
    )
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def deal_tier(score: Column) -> Column:
    tier = F.lit(TIERS[-1][0])
    for name, limit in reversed(TIERS[:-1]):
        tier = F.when(score >= limit, name).otherwise(tier)
    return tier


def analyze_deals(df: DataFrame, min_rows: int = MIN_SCORED,
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """Percentiles, value score, store rank, deal score and tier per listing.

    The complete rows are staged once; every statistic is a narrow pass over
    the staged columns it needs and meets the listings in one join each.
    """
    rows = stage(df.dropna(subset=CRITICAL), "deals")
    inverse = 1 / (F.col("unit_price") + 0.0001)
    facts = one_row(rows, F.count("*").alias("n"), F.min(inverse).alias("low"),
                    F.max(inverse).alias("high"))
    stores = store_ranks(rows)
    by_price = _percentile(rows, "price", range_rows)
    by_unit_price = _percentile(rows, "unit_price", range_rows)
    scored = rows.where(facts["n"] >= min_rows).withColumns({
        "value_score": F.try_divide(inverse - facts["low"], facts["high"] - facts["low"]) * 100,
        "pack_efficiency": pack_efficiency(),
    })
    scored = scored.join(by_price, "price").join(by_unit_price, "unit_price").join(
        stores, "site", "left")
    return stage(scored.withColumn("deal_score", deal_score()).withColumn(
        "deal_tier", deal_tier(F.col("deal_score"))).select(
        *df.columns, "price_percentile", "unit_price_percentile", "value_score",
        "pack_efficiency", "store_rank", "store_rank_normalized", "deal_score", "deal_tier"),
        "analyzed")


def _percentile(rows: DataFrame, value: str, range_rows: int) -> DataFrame:
    return value_counts(rows, value, range_rows=range_rows).select(
        value, average_rank_pct().alias(f"{value}_percentile"))


def tier_distribution(df: DataFrame) -> DataFrame:
    """Listings per tier in count and percent, empty tiers included."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(TIERS)],
                                  "tier_order int, deal_tier string")
    counts = df.groupBy("deal_tier").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    found = F.coalesce(F.col("n"), F.lit(0))
    return names.join(counts, "deal_tier", "left").select(
        "tier_order", "deal_tier", found.alias("n_listings"),
        F.coalesce(F.try_divide(found, total) * 100, F.lit(0.0)).alias("pct"))


def top_deals(df: DataFrame, n: int = 5, ties: tuple[str, ...] = ("site", "title")) -> DataFrame:
    columns = ["site", "title", "price", "unit_price", "deal_score", "deal_tier"]
    return df.orderBy(F.desc("deal_score"), *ties).select(
        *[c for c in columns if c in df.columns]).limit(n)


def store_performance(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(
        F.avg("unit_price").alias("avg_unit_price"),
        F.avg("deal_score").alias("avg_deal_score"),
        F.count("price").alias("n_listings"),
    ).orderBy("avg_unit_price", "site")


# ------------------------------------------------------------- learners

def with_model_features(df: DataFrame) -> DataFrame:
    """Numeric model inputs; stores as codes in sorted order, nulls as 0."""
    df = stage(df, "model-input")
    codes = stage(sorted_codes(df, "site", "store_encoded"), "store-codes")
    rows = df.join(codes, "site", "left")
    return rows.withColumns({
        f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MODEL_FEATURES})


def _scaled() -> list:
    return [
        VectorAssembler(inputCols=[f"f_{c}" for c in MODEL_FEATURES], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
    ]


def bin_edges(values: np.ndarray, expected: float, bins: int = BINS) -> np.ndarray:
    """Where Spark's tree learners cut a feature, from drawn values; ``expected`` is the mean size of a draw.

    Zeros are not drawn but stand for what is missing from the expected size.
    """
    found, counts = np.unique(values[values != 0], return_counts=True)
    missing = expected - counts.sum()
    if len(found) and missing > np.finfo(float).eps * counts.sum() * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts.astype(float), at, missing)
    middle = (found[:-1] + found[1:]) / 2
    if len(found) <= bins:
        return middle
    edges, stride = [], expected / bins
    target, seen = stride, np.cumsum(counts)
    for i, before, now in zip(range(len(middle)), seen, seen[1:]):
        if abs(before - target) < abs(now - target):
            edges.append(middle[i])
            target += stride
    return np.array(edges)


def _drawn(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The rows that Spark's tree learners draw to place their bins."""
    spark = rows.sparkSession
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    drawn = rows._jdf.rdd().sample(False, fraction, draw)
    return DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark)


class BinnedModel:
    """Scaling pipeline, edges of the bins of each feature, and a learner of bins."""

    def __init__(self, scaler: PipelineModel, edges: Sequence[np.ndarray]):
        self.scaler, self.edges, self.learner = scaler, edges, None

    def binned(self, df: DataFrame) -> DataFrame:
        """Add ``cell``, the bins of a row in one number."""
        edges = self.edges

        @F.pandas_udf("long")
        def cell(*columns: pd.Series) -> pd.Series:
            return pd.Series(reduce(
                lambda code, c: (code << BIN_BITS) + np.searchsorted(c[0], c[1].to_numpy(), side="left"),
                zip(edges, columns), np.zeros(len(columns[0]), np.int64)))

        return df.withColumn("cell", cell(*scaled_cells(len(edges))))

    def features(self, df: DataFrame) -> DataFrame:
        """Replace ``cell`` by the vector of its bins."""
        names = [f"_bin{i}" for i in range(len(self.edges))]
        rows = df.withColumns({
            name: F.shiftright("cell", BIN_BITS * i).bitwiseAND((1 << BIN_BITS) - 1).cast("double")
            for i, name in enumerate(reversed(names))})
        return VectorAssembler(inputCols=names, outputCol="bins").transform(rows).drop(*names, "cell")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.learner.transform(self.features(self.binned(self.scaler.transform(df))))


def scaled_cells(n: int) -> list[Column]:
    cells = vector_to_array("features")
    return [cells[i].alias(f"_scaled{i}") for i in range(n)]


def predict_deal_score(df: DataFrame, trees: int = 100, depth: int = 4, seed: int = 42):
    """Boosted trees on the deal score; (scored table, model), no model if too few rows.

    Trees cut at the edges of bins only, so rows of equal bins are learned as one row of their mean score,
    weighted by their number. There are about BINS ** 5 such rows at most, however many listings there are.
    """
    rows = with_model_features(df)
    if rows.limit(MIN_PREDICTED).count() < MIN_PREDICTED:
        return df, None
    known = rows.where("deal_score is not null")
    scaler = Pipeline(stages=_scaled()).fit(known)
    scaled, n_rows = scaler.transform(known), known.count()
    fraction = min(1.0, BIN_ROWS / max(n_rows, 1))
    values = scaled.select(*scaled_cells(len(MODEL_FEATURES)))
    drawn = np.array((_drawn(values, fraction, seed) if fraction < 1 else values).collect())
    model = BinnedModel(scaler, [bin_edges(column, fraction * n_rows) for column in drawn.T])
    cells = stage(model.binned(scaled).groupBy("cell").agg(
        F.avg("deal_score").alias("deal_score"), F.count("*").cast("double").alias("n")), "cells")
    n_cells = cells.count()
    # With so many bins allowed no row is drawn: each cell has a say where its bins are cut.
    learner = GBTRegressor(labelCol="deal_score", predictionCol="ml_predicted_score", featuresCol="bins",
                           weightCol="n", maxBins=max(BINS, int(n_cells ** 0.5) + 1),
                           maxIter=trees, maxDepth=depth, seed=seed)
    # Hundreds of short jobs: a task for each TASK_CELLS.
    model.learner = learner.fit(model.features(cells.coalesce(n_cells // TASK_CELLS + 1)))
    inputs = ["raw", "features", "bins", "store_encoded", *[f"f_{c}" for c in MODEL_FEATURES]]
    return model.transform(rows).drop(*inputs), model


def cluster_listings(df: DataFrame, seed: int = 42) -> DataFrame:
    """At most four clusters of similar listings; unchanged below fifteen rows."""
    rows = with_model_features(df)
    n_rows = rows.limit(max(MIN_CLUSTERED, 20)).count()
    if n_rows < MIN_CLUSTERED:
        return df
    means = KMeans(k=min(4, n_rows // 5), seed=seed, featuresCol="features",
                   predictionCol="product_cluster")
    model = Pipeline(stages=[*_scaled(), means]).fit(rows)
    inputs = ["raw", "features", "store_encoded", *[f"f_{c}" for c in MODEL_FEATURES]]
    return model.transform(rows).drop(*inputs)


def cluster_profile(df: DataFrame, label: str = "product_cluster") -> DataFrame:
    """Mean price, unit price and score per cluster, with its commonest store."""
    means = df.groupBy(label).agg(
        F.avg("price").alias("avg_price"), F.avg("unit_price").alias("avg_unit_price"),
        F.avg("deal_score").alias("avg_deal_score"), F.count("*").alias("n_listings"))
    stores = df.where(F.col("site").isNotNull()).groupBy(label, "site").agg(
        F.count("*").alias("n"))
    common = stores.groupBy(label).agg(
        F.min_by("site", F.struct(-F.col("n"), "site")).alias("top_site"))
    return means.join(common, label, "left")
