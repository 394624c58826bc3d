"""Tables behind a price dashboard. Values are not rounded here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.stats import RANGE_ROWS, one_row, quantiles, value_counts

# Columns of the detail table and columns it can be sorted by.
DETAIL_COLUMNS = ["site", "title", "price", "size_value", "size_unit", "pack_count",
                  "unit_price", "unit_price_unit", "per_unit_price", "product_url"]
SORT_COLUMNS = ["price", "unit_price", "per_unit_price", "normalized_quantity", "site"]
BEST_COLUMNS = ["site", "title", "price", "size_value", "size_unit", "unit_price",
                "unit_price_unit", "per_unit_price"]
TIES = ("site", "title", "seq", "price")


def _ties(df: DataFrame, ties=TIES) -> list[str]:
    return [c for c in ties if c in df.columns]


def filter_bounds(df: DataFrame) -> DataFrame:
    """Ends of price and size and the number of stores for the filter widgets."""
    return df.agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min("normalized_quantity").alias("min_size"),
        F.max("normalized_quantity").alias("max_size"),
        F.count_distinct("site").alias("n_sites"))


def distinct_sites(df: DataFrame) -> DataFrame:
    return df.select("site").distinct()


def key_metrics(df: DataFrame) -> DataFrame:
    """Cheapest listing, best unit price, store with most listings, totals."""
    ties = _ties(df)
    row = F.struct("price", "site", "title", "unit_price", "unit_price_unit")
    best = df.agg(
        F.min_by(row, F.struct(F.col("price").isNull(), "price", *ties)).alias("cheap"),
        F.min_by(row, F.struct(F.col("unit_price").isNull(), "unit_price", *ties)).alias("unit"),
        F.count("*").alias("n_listings"))
    stores = df.groupBy("site").agg(F.count("*").alias("n"))
    most = one_row(stores, F.min_by("site", F.struct(-F.col("n"), "site")).alias("site"),
                   F.max("n").alias("n"), F.count("*").alias("n_sites"))
    return best.select(
        F.col("cheap.price").alias("cheapest_price"), F.col("cheap.site").alias("cheapest_site"),
        F.col("unit.unit_price").alias("best_unit_price"),
        F.col("unit.unit_price_unit").alias("best_unit"), F.col("unit.site").alias("best_unit_site"),
        most["site"].alias("top_site"), most["n"].alias("top_site_listings"),
        "n_listings", most["n_sites"].alias("n_sites"))


def best_value(df: DataFrame, n: int = 5) -> DataFrame:
    """Lowest unit prices; listings without one are left out."""
    return df.where(F.col("unit_price").isNotNull()).orderBy("unit_price", *_ties(df)).select(
        *[c for c in BEST_COLUMNS if c in df.columns]).limit(n)


def price_box_by_store(df: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    counts = value_counts(df, "price", ["site"], range_rows)
    probs = {"min_price": 0.0, "q1": 0.25, "median_price": 0.5, "q3": 0.75, "max_price": 1.0}
    return quantiles(counts, "price", probs, ["site"])


def price_vs_size(df: DataFrame) -> DataFrame:
    return df.where(F.col("price").isNotNull() & F.col("normalized_quantity").isNotNull()).select(
        "site", "title", "normalized_quantity", "price", "unit_price", "pack_count",
        "per_unit_price")


def pack_deals(df: DataFrame, n: int = 10) -> DataFrame:
    """Packs with the lowest price per item."""
    packs = df.where((F.col("pack_count") > 0) & F.col("price").isNotNull())
    return packs.withColumn("savings_per_pack", F.col("price") / F.col("pack_count")).orderBy(
        "savings_per_pack", *_ties(df)).select(
        "site", "title", "pack_count", "price", "savings_per_pack").limit(n)


def store_table(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(
        F.avg("price").alias("avg_price"), F.min("price").alias("min_price"),
        F.count("price").alias("n_listings"), F.avg("unit_price").alias("avg_unit_price"),
    ).orderBy(F.asc_nulls_last("avg_unit_price"), "site")


def detail_table(df: DataFrame, sort_by: str = "price", ascending: bool = True) -> DataFrame:
    """Display columns in sorted order; nulls come last both ways."""
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {sort_by!r}")
    order = F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by)
    return df.orderBy(order, *[c for c in _ties(df) if c != sort_by]).select(
        *[c for c in DETAIL_COLUMNS if c in df.columns])


def highlight_min(df: DataFrame, columns=("price", "unit_price")) -> DataFrame:
    """Flag the smallest value of each column."""
    low = one_row(df, *[F.min(c).alias(c) for c in columns])
    return df.withColumns({
        f"{c}_is_min": F.coalesce(F.col(c) == low[c], F.lit(False)) for c in columns})


def score_histogram(df: DataFrame, column: str = "deal_score", bins: int = 10) -> DataFrame:
    """Equal-width bins between the ends; the last bin includes its upper end."""
    ends = one_row(df, F.min(column).alias("low"), F.max(column).alias("high"))
    width = (ends["high"] - ends["low"]) / bins
    spot = F.coalesce(F.floor(F.try_divide(F.col(column) - ends["low"], width)), F.lit(0))
    rows = df.where(F.col(column).isNotNull()).select(
        F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"),
        ends["low"].alias("low"), width.alias("width"))
    return rows.groupBy("bin", "low", "width").agg(F.count("*").alias("n_listings")).select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "n_listings")


def score_band(score: Column) -> Column:
    return F.when(score >= 95, "green").when(score >= 90, "yellow").otherwise("red")


def record_counts(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total_records"),
                  F.count_if(condition).alias("filtered_records"))
