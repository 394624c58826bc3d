"""Price statistics of a product group and competitiveness of stores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.stats import RANGE_ROWS, average_rank_pct, quantiles, value_counts
from shelfspark.session import short_lived, stage, staged_bytes

MIN_LISTINGS = 2
SLICE_BYTES = 1 << 30  # of written listings and statistics that are shuffled at a time to be joined
EXTREMES = ["min_price", "max_price", "avg_price"]  # distances and extremes of a listing are read from these


def group_price_stats(df: DataFrame, group: str = "product_group_id",
                      price: str = "price_numeric", counts: DataFrame | None = None,
                      range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per group. num_stores counts listings; distinct_sites counts stores."""
    if counts is None:
        counts = value_counts(df, price, [group], range_rows)
    stats = df.groupBy(group).agg(
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.avg(price).alias("avg_price"),
        F.coalesce(F.stddev_samp(price), F.lit(0.0)).alias("std_price"),
        F.count(price).alias("num_stores"),
        F.count_distinct("site").alias("distinct_sites"),
    )
    middle = quantiles(counts, price, {"median_price": 0.5}, [group])
    spread = F.col("max_price") - F.col("min_price")
    return stats.join(middle, group, "left").withColumns({
        "price_range": spread,
        "price_range_pct": F.coalesce(
            F.try_divide(spread, F.col("avg_price")) * 100, F.lit(0.0)),
    })


def with_group_features(df: DataFrame, group: str = "product_group_id",
                        price: str = "price_numeric", range_rows: int = RANGE_ROWS,
                        named: Sequence[str] | None = None) -> DataFrame:
    """Group statistics, distance from the group mean, extremes and ranks per listing.

    Statistics and ranks are first joined to each other per (group, price) and
    written, so the listings are joined once however often they are read. ``named`` are the
    statistics that the caller reads besides mean and extremes; others are not worked out.
    """
    df = stage(df, "grouped")
    with short_lived(df.sparkSession) as scope:
        # Read three times below, each time with its shuffles if it were not written.
        counts = stage(value_counts(df, price, [group], range_rows), "counts")
        stats = group_price_stats(df, group, price, counts, range_rows)
        read = stats.columns if named is None else [*EXTREMES, *named]
        facts = counts.join(stats, group).select(
            group, price, *[c for c in stats.columns if c != group and c in read],
            average_rank_pct().alias("price_percentile"),
            (F.col("n_below") + 1).cast("int").alias("store_rank"),
        )
        facts = scope.kept(stage(facts, "group-facts"))
    gap = F.col(price) - F.col("avg_price")
    return df.join(facts, [group, price]).withColumns({
        "price_vs_avg": gap,
        "price_vs_avg_pct": F.coalesce(
            F.try_divide(gap, F.col("avg_price")) * 100, F.lit(0.0)),
        "is_cheapest": (F.col(price) == F.col("min_price")).cast("int"),
        "is_most_expensive": (F.col(price) == F.col("max_price")).cast("int"),
    })


def staged_group_features(df: DataFrame, columns: Sequence[str], group: str = "product_group_id",
                          price: str = "price_numeric", named: Sequence[str] | None = None) -> DataFrame:
    """``columns`` of ``with_group_features``, written; of large tables slices of the groups are joined in turn."""
    with short_lived(df.sparkSession) as scope:
        rows = with_group_features(df, group, price, named=named)
        n = max(1, -(-staged_bytes(rows) // SLICE_BYTES))
        read = rows.select(*[c for c in columns if c in rows.columns])
        # By the group alone, as a condition on a price is not carried to the other side of the join.
        spot = F.pmod(F.xxhash64(F.lit("slice"), group), F.lit(n))
        return reduce(DataFrame.unionByName, [
            scope.kept(stage(read.where(spot == i) if n > 1 else read, "compared")) for i in range(n)])


def store_competitiveness(df: DataFrame, group: str = "product_group_id") -> DataFrame:
    """How often each store is cheapest among products with several listings."""
    compared = df.where(F.col("num_stores") >= MIN_LISTINGS)
    return compared.groupBy("site").agg(
        F.sum("is_cheapest").alias("times_cheapest"),
        F.avg("price_vs_avg_pct").alias("avg_price_vs_market"),
        F.count(group).alias("products_compared"),
    ).withColumn("cheapest_rate", F.try_divide(
        F.col("times_cheapest"), F.col("products_compared")) * 100)


def with_store_competitiveness(df: DataFrame, group: str = "product_group_id") -> DataFrame:
    """Store figures per listing; null for stores that were never compared."""
    # Written, so that the join is planned by their size and few stores do not shuffle the listings.
    stores = stage(store_competitiveness(df, group).select(
        "site", "avg_price_vs_market", "cheapest_rate"), "stores")
    return df.join(stores, "site", "left")


def matching_summary(df: DataFrame, group: str = "product_group_id") -> DataFrame:
    """Listings in compared groups and the mean spread over groups."""
    groups = df.groupBy(group).agg(
        F.first("num_stores").alias("num_stores"),
        F.first("price_range").alias("price_range"),
        F.first("price_range_pct").alias("price_range_pct"),
    )
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("num_stores") >= MIN_LISTINGS, F.col("num_stores"))),
                   F.lit(0)).alias("multi_store_listings"),
        F.avg("price_range").alias("avg_price_range"),
        F.avg("price_range_pct").alias("avg_price_range_pct"),
    )
