import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", float(rng.randrange(400))) for i in range(3000)]
    rows += [("hot", None), (None, 1.0)]
    return spark.createDataFrame(rows, "k string, v double").cache()


@pytest.mark.parametrize("range_rows", [10, 100, 10 ** 6])
def test_ranges_equal_window(skewed, range_rows):
    got = stats.value_counts(skewed, "v", ["k"], range_rows)
    want = stats.value_counts(skewed, "v", ["k"])
    assert got.select(*want.columns).exceptAll(want).isEmpty()
    assert got.count() == want.count()


@pytest.mark.parametrize("range_rows", [7, 10 ** 6])
def test_global_percentile(skewed, range_rows):
    got = stats.with_rank_pct(skewed.where("v is not null"), "v", "p", range_rows).toPandas()
    want = got["v"].rank(pct=True) * 100
    assert np.allclose(got["p"], want)


@pytest.mark.parametrize("range_rows", [9, 10 ** 6])
def test_quantiles(skewed, range_rows):
    counts = stats.value_counts(skewed, "v", ["k"], range_rows)
    got = stats.quantiles(counts, "v", {"q1": 0.25, "m": 0.5, "top": 1.0}, ["k"]).toPandas()
    raw = skewed.dropna().toPandas()
    for row in got.itertuples():
        v = raw[raw["k"] == row.k]["v"]
        assert np.allclose([row.q1, row.m, row.top], [v.quantile(0.25), v.median(), v.max()])


@pytest.mark.parametrize("range_rows", [2, 10 ** 6])
def test_sorted_codes(spark, range_rows):
    words = [f"w{i * 37 % 101:03d}" for i in range(101)]
    df = spark.createDataFrame([(w,) for w in words * 3 + [None]], "w string")
    got = {r["w"]: r["c"] for r in stats.sorted_codes(df, "w", "c", range_rows).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def test_partitioning_does_not_matter(skewed):
    a = stats.value_counts(skewed.repartition(1), "v", ["k"], 20)
    b = stats.value_counts(skewed.repartition(13), "v", ["k"], 20)
    assert a.exceptAll(b.select(*a.columns)).isEmpty()


def test_more_ranges_than_sampled_values(spark):
    wide = spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("k").alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7).alias("v"))
    distinct = wide.select("k", "v").distinct().count()
    got = stats.value_counts(wide, "v", ["k"], 4)
    assert got.inputFiles()  # ranges were written
    want = stats.value_counts(wide, "v", ["k"])
    assert got.count() == distinct
    assert got.select(*want.columns).exceptAll(want).isEmpty()
    ranges, sample = stats._sample(wide.select("v").distinct(), "v", [], 1)
    assert ranges > 5_000 and len(sample) == stats.SAMPLE_ROWS


def test_empty_table(spark):
    empty = spark.createDataFrame([], "v double")
    assert stats.value_counts(empty, "v").count() == 0
    assert stats.one_row(empty, F.max("v").alias("m")) is not None
