"""Titles are parsed once, statistics of groups are worked out once, and passes write what is read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import quantity as q
from shelfspark.operators import cross_store, deals, features, pricing
from shelfspark.session import stage
from shelfspark.suite import learning_q

PATTERN = "milli?lit"


@pytest.fixture
def listed(spark):
    """Titles put together from both sides of a join, as in the view of offers."""
    left = spark.createDataFrame([(i, f"tea {i + 1}0 ml", str(i + 1.5)) for i in range(8)], "seq long, t string, price string")
    right = spark.createDataFrame([(i, " pack of 3", "a" if i % 2 else "b") for i in range(8)], "seq long, p string, site string")
    return left.join(right, "seq").select("seq", "site", "price", F.concat("t", "p").alias("title"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def spy(monkeypatch, module):
    written = []
    monkeypatch.setattr(module, "stage", lambda df, name="stage": written.append(df) or stage(df, name))
    return written


def test_size_is_not_parsed_again_in_the_join(listed, monkeypatch):
    written = spy(monkeypatch, features)
    rows = features.quantity_table(listed)
    assert [plan(df).count(PATTERN) for df in written] == [1]
    assert {(r["normalized_quantity"], r["pack_count"]) for r in rows.collect()} == {(10.0 * (i + 1), 3) for i in range(8)}


def test_columns_nobody_reads_are_not_written(listed, monkeypatch):
    written = spy(monkeypatch, features)
    whole = features.quantity_table(listed)
    part = features.quantity_table(listed, ["seq", "price", "size_value", "size_unit", "pack_count", "normalized_quantity"])
    assert "brand" in written[0].columns and "brand" not in written[1].columns
    assert sorted(part.collect()) == sorted(whole.select(part.columns).collect())


def test_size_tiers_parse_titles_once(listed):
    rows = deals.with_size_tier(features.with_quantity(listed))
    assert PATTERN not in plan(rows)
    tiers = [r["size_tier"] for r in rows.orderBy("seq").collect()]
    assert tiers == ["Small"] * 2 + ["Medium"] * 2 + ["Large"] * 2 + ["XL"] * 2


def test_group_statistics_are_written(listed):
    rows = cross_store.with_group_features(listed.select(
        "seq", "site", (F.col("seq") % 3).alias("product_group_id"), F.col("price").cast("double").alias("price_numeric")))
    assert "Aggregate" not in plan(rows)
    assert {(r["seq"], r["store_rank"], r["num_stores"]) for r in rows.collect()} == {
        (i, i // 3 + 1, 2 if i % 3 == 2 else 3) for i in range(8)}


def test_hints_leave_no_hit_out():
    pick = random.Random(7)
    words = ["1", "25", ".5", ",3", " ", "\t", "ml", "millilitre", "milliters", "l", "ltr", "litres", "g", "gm", "grams",
             "kg", "kgs", "kilograms", "pc", "pcs", "pc.", "pieces", "pack", "pk", "pkt", "of", "(", ")", "x"]
    for _ in range(20_000):
        title = "".join(pick.choice(words) for _ in range(8))
        for (_, rule), hints in zip(q.SIZE_RULES, q.SIZE_HINTS, strict=True):
            assert not re.search(rule, title) or any(h in title for h in hints), title
        for (rule, _), hint in zip(q.PACK_RULES, q.PACK_HINTS, strict=True):
            assert not re.search(rule, title) or hint in title, title


def test_first_word_and_hard_spaces(cell):
    for title, brand in (("O'Neil&Co-7 tea", "Oneil&Co-7"), ("\tBrand#12 x", "Brand12"), ("## tea", "Unknown"),
                         ("peek freans x", "Peek Freans"), ("tea leaf", "Tea")):
        assert cell(q.brand("x"), x=title) == brand
    got = cell(q.size("x"), x="Tea\u00a05\u00a0ml")
    assert (got["size_value"], got["size_unit"]) == (5.0, "ml")


def test_model_table_joins_once_and_writes_what_the_learners_read(spark, monkeypatch):
    r = random.Random(6)
    rows = spark.createDataFrame(
        [(i, r.choice("abc"), f"tea {i}", r.choice([1.5, 2.0, 4.25]), i % 9, 1.0, 2.0, i % 3, 3.0, r.choice(["x", None]), "ml", "b", "b_x")
         for i in range(200)],
        "seq long, site string, title string, price_numeric double, product_group_id long, size_value double, "
        "normalized_quantity double, pack_count int, total_volume double, category string, size_unit string, "
        "brand string, brand_category string")
    whole = pricing.prepare(cross_store.with_store_competitiveness(cross_store.with_group_features(rows)))
    inputs = pricing.feature_columns(whole)
    want = [{tuple(round(float(x), 6) for x in row) for row in part.select("seq", "price_numeric", *inputs).collect()}
            for part in pricing.split(whole)]
    names = {}
    for module in (cross_store, pricing, learning_q):
        monkeypatch.setattr(module, "stage", lambda df, name="stage": names.setdefault(name, df) is None or stage(df, name))
    monkeypatch.setattr(learning_q, "grouped_rows", lambda spark, folder, columns: rows)
    train, test, read = learning_q.model_table(spark, "")
    assert read == inputs and train.columns == test.columns == ["seq", "price_numeric", *inputs]
    assert [{tuple(round(float(x), 6) for x in row) for row in part.collect()} for part in (train, test)] == want
    assert "title" not in names["grouped"].columns and "model-table" not in names
    assert not {"std_price", "distinct_sites"} & set(names["group-facts"].columns)
    assert "distinct" not in plan(names["group-facts"]).lower() and "Expand" not in plan(names["group-facts"])
    assert plan(names["compared"]).count("Join") == 1 and "Join" not in plan(names["stores"])
