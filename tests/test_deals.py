import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shelfspark.operators import deal_model, deals, listings, views

SCHEMA = ("site string, title string, price double, unit_price double, "
          "normalized_quantity double, pack_count int")


def search(spark, n=8):
    return spark.createDataFrame(
        [(f"S{i % 3}", f"t{i}", 10.0 + i, 0.1 * (i + 1), 100.0, i % 4 * 5) for i in range(n)], SCHEMA)


def test_too_few_rows_give_none(spark):
    assert deals.analyze_deals(search(spark, 4)).count() == 0
    assert deals.require_complete(search(spark, 4)).count() == 0


@pytest.mark.parametrize("range_rows", [3, 10 ** 6])
def test_deal_scores(spark, range_rows):
    got = deals.analyze_deals(search(spark), range_rows=range_rows).toPandas().sort_values("price")
    assert got["price_percentile"].tolist() == pytest.approx([12.5 * (i + 1) for i in range(8)])
    assert got["value_score"].iloc[0] == pytest.approx(100) and got["value_score"].iloc[-1] == 0
    assert got["pack_efficiency"].tolist() == [0.0, 0.5, 1.0, 1.0] * 2
    assert set(zip(got["site"], got["store_rank"])) == {("S0", 1), ("S1", 3), ("S2", 2)} or set(
        got["store_rank"]) == {1, 2, 3}
    first = got.iloc[0]
    by_hand = (first["value_score"] * .4 + (100 - first["price_percentile"]) * .25
               + first["pack_efficiency"] * 15 + (100 - 100 * first["store_rank_normalized"]) * .2)
    assert first["deal_score"] == pytest.approx(min(100, max(0, by_hand)))


@pytest.mark.parametrize("score, tier", [
    (75.0, "Excellent"), (74.99, "Good"), (60.0, "Good"), (40.0, "Fair"), (39.99, "Poor")])
def test_tiers(cell, score, tier):
    assert cell(deals.deal_tier(F.col("x")), x=score) == tier


def test_equal_unit_prices_leave_no_score(spark):
    rows = search(spark).withColumn("unit_price", F.lit(2.0))
    assert deals.analyze_deals(rows).where("value_score is not null").count() == 0


def test_all_tiers_are_listed(spark):
    rows = spark.createDataFrame([("Good",), ("Good",), ("Poor",)], "deal_tier string")
    got = {r["deal_tier"]: r["n_listings"] for r in deals.tier_distribution(rows).collect()}
    assert got == {"Excellent": 0, "Good": 2, "Fair": 0, "Poor": 1}


def test_learners(spark):
    rows = deals.analyze_deals(search(spark, 30))
    clustered = deals.cluster_listings(rows)
    assert clustered.count() == 30 and clustered.select("product_cluster").distinct().count() <= 4
    scored, model = deals.predict_deal_score(rows, trees=5)
    assert model is not None and scored.where("ml_predicted_score is null").count() == 0
    assert deals.cluster_listings(search(spark, 6)).columns == search(spark).columns


def test_deal_scores_are_learned_from_cells_of_equal_bins(spark, monkeypatch):
    """More rows than Spark draws to place bins: its own learner on all rows predicts the same."""
    rows = spark.range(24_000).select(
        F.col("id").alias("seq"), F.concat(F.lit("S"), F.col("id") % 7).alias("site"),
        (100 + F.col("id") * 7919 % 10_007 / 10).alias("price"),
        (F.col("id") % 3 * 250.0).alias("normalized_quantity"), (F.col("id") % 4).alias("pack_count"),
    ).withColumn("unit_price", F.col("price") / (F.col("pack_count") + 1)).withColumn(
        "deal_score", F.sqrt("unit_price") * (F.col("pack_count") + 1) + F.col("price") / 40)
    sizes, fit = [], GBTRegressor.fit

    def counted(self, df, *more):
        sizes.append(df.count())
        return fit(self, df, *more)
    monkeypatch.setattr(GBTRegressor, "fit", counted)
    got, _ = deals.predict_deal_score(rows, trees=6)
    assert len(sizes) == 1 and sizes[0] < 12_000
    plain = deals.with_model_features(rows)
    learner = GBTRegressor(labelCol="deal_score", predictionCol="want", maxIter=6, maxDepth=4, seed=42)
    want = Pipeline(stages=[*deals._scaled(), learner]).fit(plain).transform(plain).select("seq", "want")
    gap = got.join(want, "seq").agg(F.count("*"), F.max(F.abs(F.col("ml_predicted_score") - F.col("want")))).first()
    assert gap[0] == 24_000 and gap[1] < 1e-9


def test_bins_of_equal_and_of_few_values():
    assert list(deals.bin_edges(np.full(5, 2.0), 5)) == []
    assert list(deals.bin_edges(np.array([1.0, 3.0, 3.0, 0.0]), 4)) == [0.5, 2.0]
    assert len(deals.bin_edges(np.arange(1, 1001) / 7, 1000)) == deals.BINS - 1


def training(spark):
    return spark.createDataFrame(
        [("t1", "X", "c", "A", 10.0, 1.0, 1), ("t2", "X", "c", "A", 20.0, 2.0, 0),
         ("t3", "Y", "c", "B", 40.0, 4.0, 0), ("t4", " ", "c", "B", 30.0, 3.0, -1)],
        "title string, brand string, category string, site string, price double, "
        "unit_price double, value_score int")


def test_learned_score(spark, tmp_path):
    model, scored = deal_model.train(training(spark))
    keys = {(r["dimension"], r["key"]): r["n_rows"] for r in model.by_key.collect()}
    assert keys == {("brand", "X"): 2, ("brand", "Y"): 1, ("category", "c"): 4, ("site", "A"): 2,
                    ("site", "B"): 2}
    got = {r["title"]: r["raw_deal_score"] for r in scored.collect()}
    # A brand seen once has no deviation, so its score is unknown.
    assert got["t3"] is None
    mean, std = 25.0, 12.909944487358056
    by_hand = ((mean - 10) / (std + .01) * .4 + (15 - 10) / (7.0710678118654755 + .01) * .2
               + (mean - 10) / (std + .01) * .2 + (1 - 1 / 4) * .1 + 1 / 5 * .1)
    assert got["t1"] == pytest.approx(by_hand)
    model.save(str(tmp_path / "m"))
    again = deal_model.DealModel.load(spark, str(tmp_path / "m"))
    fresh = spark.createDataFrame(
        [("n1", "Z", "zz", "A", 1.0, None, 0), ("n2", "Z", "zz", "A", 900.0, None, 0)],
        training(spark).schema)
    new = {r["title"]: r["deal_score"] for r in deal_model.score_new(fresh, again).collect()}
    assert new["n2"] == 0.0 and 0 < new["n1"] <= 100
    assert [r["title"] for r in deal_model.top_deals(scored, 2).collect()] == ["t1", "t2"]


def test_outliers_stand_out(spark):
    rows = spark.createDataFrame(
        [(float(100 + i % 7), float(10 + i % 5)) for i in range(190)] + [(9000.0, 900.0)] * 10,
        "price double, price_per_unit double")
    got = deal_model.price_outliers(rows, trees=20, contamination=0.06).toPandas()
    assert got[got["price"] > 1000]["is_outlier"].all()
    assert got["outlier_score"].between(0, 1).all()


def test_copies_do_not_take_over_the_sample(spark):
    rows = spark.createDataFrame(
        [(50.0, 5.0)] * 400 + [(float(i), float(i % 9)) for i in range(400)],
        "price double, price_per_unit double")
    trees = deal_model.isolation_trees(rows, ["price", "price_per_unit"], trees=3).toPandas()
    sizes = trees[trees["node"] == 0]["size"]
    assert len(sizes) == 3 and sizes.eq(256).all()
    assert trees.groupby("tree")["node"].count().min() > 50


def test_outliers_do_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame(
        [(i, float(100 + i * 37 % 91), float(10 + i % 5)) for i in range(900)],
        "seq long, price double, price_per_unit double")
    scores = [sorted(deal_model.price_outliers(rows.repartition(n), trees=5).select(
        "seq", "outlier_score", "is_outlier").collect()) for n in (2, 7)]
    assert scores[0] == scores[1]


def test_copies_beyond_a_run_are_all_drawn_from(spark, monkeypatch):
    monkeypatch.setattr(deal_model, "COPY_RUN", 7)
    rows = spark.createDataFrame([(50.0, 5.0)] * 30 + [(1.0, 2.0)] * 5,
                                 "price double, price_per_unit double")
    trees = deal_model.isolation_trees(rows, ["price", "price_per_unit"], trees=2).toPandas()
    assert trees[trees["node"] == 0]["size"].eq(35).all()


def test_first_arrival_wins(spark):
    rows = spark.createDataFrame(
        [(1, "A", "c", "7", "Tea", "u1"), (2, "A", "c", "7", "Tea 2", "u2"),
         (3, "B", "c", "7", "Tea", "u1"), (4, "A", "d", "", "Oil", ""), (5, "A", "d", "", "OIL", ""),
         (6, "A", "d", None, None, None), (7, "A", "d", None, None, None)],
        "seq long, site string, category string, product_id string, title string, product_url string")
    def kept(fn):
        return sorted(r["seq"] for r in fn(rows, ["seq"]).collect())
    assert kept(listings.dedupe_page) == [1, 2, 4, 6, 7]
    assert kept(listings.dedupe_category) == [1, 3, 4, 6, 7]
    assert kept(listings.dedupe_global) == [1, 3, 4, 5, 6, 7]


def test_policy_and_rejects(spark):
    rows = spark.createDataFrame(
        [(1, "Naheed", "Diet Pepsi", "u"), (2, "Naheed", "xpepsi", "v"), (3, "Metro", "xpepsi", "u"),
         (4, "Metro", "xpepsi", "u"), (5, "Carrefour", "tea", "u"), (6, "Carrefour", "tea", "u")],
        "seq long, site string, title string, product_url string").withColumn("product_id", F.lit(None).cast("string"))
    got = listings.search_policy(rows, "pepsi", ["seq"])
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 5, 6]
    yes, no = listings.split_accepted(rows, F.when(F.col("seq") < 3, True))
    assert (yes.count(), no.count()) == (2, 4)


def test_views(spark):
    rows = spark.createDataFrame(
        [("A", "x", 10.0, None, 2), ("B", "y", 8.0, 0.5, 0), ("B", "z", None, 0.2, 4)],
        "site string, title string, price double, unit_price double, pack_count int").withColumn(
            "unit_price_unit", F.lit("PKR/g"))
    m = views.key_metrics(rows).first()
    assert (m["cheapest_price"], m["best_unit_price"], m["top_site"], m["n_sites"]) == (8.0, 0.2, "B", 2)
    order = [r["title"] for r in views.detail_table(rows, "unit_price", False).collect()]
    assert order == ["y", "z", "x"]
    with pytest.raises(ValueError):
        views.detail_table(rows, "title")
    assert [r["title"] for r in views.pack_deals(rows).collect()] == ["x"]
    flags = {r["title"]: r["price_is_min"] for r in views.highlight_min(rows).collect()}
    assert flags == {"x": False, "y": True, "z": False}
    same = spark.createDataFrame([(5.0,)] * 3, "deal_score double")
    assert [(r["bin"], r["n_listings"]) for r in views.score_histogram(same).collect()] == [(0, 3)]
    kept = listings.filter_listings(rows.withColumn("normalized_quantity", F.col("price")),
                                    ["B"], (0, 9), (0, 9))
    assert kept.count() == 1


def test_listings_without_a_store_stay_and_rank_nowhere(spark):
    rows = spark.createDataFrame(
        [(s, float(u)) for s, u in (("a", 1), ("a", 3), ("b", 9), (None, 5), (None, 0))],
        "site string, unit_price double")
    got = deals.with_store_rank(rows).collect()
    assert len(got) == 5
    assert {(r["site"], r["store_rank"]) for r in got} == {("a", 1), ("b", 2), (None, None)}
    assert max(r["store_rank_normalized"] or 0 for r in got) > 0.99
