"""Ranks, quantiles and sorted codes without an unbounded window.

Rows are first counted per distinct value, which also collapses hot values.
The distinct values are then cut into ranges of about ``range_rows`` rows and
running counts are summed range by range, so no task sorts more than one range
of one key, however many rows a key has. Small inputs need a single range and
use the plain window; more ranges than the sample has values are cut by Spark's
range partitioning and written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from shelfspark.session import shuffles_removed, stage

RANGE_ROWS = 1_000_000
SAMPLE_ROWS = 1_024
HASH_SPAN = float(2 ** 64)


def one_row(df: DataFrame, *columns: Column) -> Column:
    """Aggregate ``df`` to one struct and use it as a scalar subquery column."""
    return df.agg(F.struct(*columns).alias("s")).scalar()


def _literal(value) -> Column:
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(n) for n, v in value.asDict(recursive=False).items()])
    return F.lit(value)


def _sample(values: DataFrame, value: str, key: Sequence[str], range_rows: int) -> tuple[int, list]:
    """How many ranges are needed, and the sorted values of the rows with the smallest hashes.

    The sample has a fixed size, does not depend on partitioning, and its
    largest hash tells how many rows there are.
    """
    hashed = F.xxhash64(*[F.col(k) for k in key], F.col(value))
    with shuffles_removed(values.sparkSession):
        sample = (
            values.select(F.col(value).alias("v"), hashed.alias("h"))
            .orderBy("h").limit(SAMPLE_ROWS).collect()
        )
    if len(sample) < SAMPLE_ROWS:
        rows = len(sample)
    else:
        rows = (SAMPLE_ROWS - 1) / ((sample[-1]["h"] + HASH_SPAN / 2) / HASH_SPAN)
    return int(-(-rows // range_rows)), sorted(r["v"] for r in sample)


def _with_range(counts: DataFrame, value: str, ranges: int, sample: list) -> DataFrame:
    """Add ``_range``, which never falls as the value grows."""
    if ranges <= len(sample):
        points = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})
        return counts.withColumn("_range", _range_of(F.col(value), points))
    # written once, as a partition's number holds for one run of the partitioning only
    return stage(counts.repartitionByRange(ranges, value).withColumn("_range", F.spark_partition_id()),
                 "ranges")


def _range_of(value: Column, points: list, low: int = 0) -> Column:
    """Number of split points at or below the value, as a binary search."""
    if not points:
        return F.lit(low)
    mid = len(points) // 2
    return F.when(value < _literal(points[mid]), _range_of(value, points[:mid], low)).otherwise(
        _range_of(value, points[mid + 1:], low + mid + 1))


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = (),
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per (keys, value): n_equal, n_below and n_total within the keys.

    Null keys and null values are left out, as in a grouped rank.
    """
    keys = list(keys)
    present = df.dropna(subset=[*keys, value]) if keys else df.where(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("n_equal"))
    ranges, sample = _sample(counts, value, keys, range_rows)
    before = (Window.unboundedPreceding, -1)
    if ranges <= 1:
        inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(*before)
        return counts.withColumns({
            "n_below": F.coalesce(F.sum("n_equal").over(inside), F.lit(0)),
            "n_total": F.sum("n_equal").over(Window.partitionBy(*keys)),
        })
    ranged = _with_range(counts, value, ranges, sample)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(*before)
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*before)
    starts = (
        ranged.groupBy(*keys, "_range").agg(F.sum("n_equal").alias("_rows"))
        .select(*keys, "_range",
                F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_start"),
                F.sum("_rows").over(Window.partitionBy(*keys)).alias("n_total"))
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
        .join(starts, [*keys, "_range"])
        .select(*keys, value, "n_equal", (F.col("_start") + F.col("_inside")).alias("n_below"),
                "n_total")
    )


def average_rank_pct() -> Column:
    """Average rank over row count in percent, from the columns of value_counts."""
    rank = F.col("n_below") + (F.col("n_equal") + 1) / F.lit(2.0)
    return rank / F.col("n_total") * 100


def with_rank_pct(df: DataFrame, value: str, out: str,
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the percentile of ``value`` over the whole table."""
    ranks = value_counts(df, value, range_rows=range_rows).select(
        value, average_rank_pct().alias(out))
    return df.join(ranks, value, "left")


def quantiles(counts: DataFrame, value: str, probs: dict[str, float],
              keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles from the output of value_counts.

    One row per key; ``probs`` maps output names to probabilities.
    """
    below, upto = F.col("n_below"), F.col("n_below") + F.col("n_equal")
    cells = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("n_total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        cells += [
            F.max(F.when((below <= low) & (low < upto), F.col(value))).alias(f"{name}_lo"),
            F.max(F.when((below <= high) & (high < upto), F.col(value))).alias(f"{name}_hi"),
            F.max(spot - low).alias(f"{name}_part"),
        ]
    wide = counts.groupBy(*keys).agg(*cells)
    return wide.select(*keys, *[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n)
        for n in probs])


def sorted_codes(df: DataFrame, value: str, code: str,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct values with their 0-based position in sorted order."""
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    return value_counts(distinct, value, range_rows=range_rows).select(
        value, F.col("n_below").cast("int").alias(code))
