import pytest
from pyspark.sql import functions as F

from shelfspark.operators import pricing
from shelfspark.operators.listings import union_loaded
from shelfspark.plans import pipelines
from shelfspark.session import cut_lineage, shared_dir, stage
from shelfspark.sources import listings as io
from shelfspark.sources.models import load_model, save_model


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('site,title,price\nA,"Tea, ""best"" \n250g",10\nB,  ,\n')
    rows = io.read_listings(spark, str(tmp_path / "a.csv")).orderBy("site").collect()
    assert rows[0]["title"] == 'Tea, "best" \n250g' and rows[1]["title"] is None
    assert rows[1]["price"] is None


def test_read_many_skips_bad_files(spark, tmp_path):
    (tmp_path / "a_features.csv").write_text("site,title,price\nA,Tea,10\n")
    (tmp_path / "b_features.csv").write_text("site,name,price,page\nB,Oil,20,1\n")
    (tmp_path / "c_features.csv").write_text("site,price\nC,20\n")
    (tmp_path / "unified_features.csv").write_text("site,title,price\nD,Tea,10\n")
    names = ["a", "b", "c", "unified", "missing"]
    rows = io.read_many(spark, [str(tmp_path / f"{n}_features.csv") for n in names], "unified")
    got = {(r["site"], r["title"], r["source_file"]) for r in rows.collect()}
    assert got == {("A", "Tea", "a_features.csv"), ("B", "Oil", "b_features.csv")}
    with pytest.raises(io.MissingColumns):
        io.read_many(spark, [str(tmp_path / "c_features.csv")])


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("site,title,price\nA,Tea,10\n")
    (tmp_path / "b.csv").write_text("title,site,size\nOil,B,1 l\n")
    (tmp_path / "c.csv.gz").write_bytes(b"not packed")
    (tmp_path / "d.csv").write_text("")
    rows = io.read_listings(spark, str(tmp_path))
    got = {(r["site"], r["title"], r["price"], r["size"]) for r in rows.collect()}
    assert got == {("A", "Tea", "10", None), ("B", "Oil", None, "1 l")}
    many = io.read_many(spark, [str(tmp_path / "*.csv*")], required=["site", "title"])
    assert {(r["title"], r["source_file"]) for r in many.collect()} == {
        ("Tea", "a b.csv"), ("Oil", "b.csv")}


def test_one_failing_store_does_not_stop_the_rest(spark):
    good = spark.createDataFrame([("A", "Tea")], "site string, title string")
    rows, failed = union_loaded({"A": lambda: good, "B": lambda: spark.read.parquet("/absent/b")})
    assert rows.count() == 1 and failed == ["B"]


def test_layers(spark, tmp_path):
    rows = spark.createDataFrame([("A", "Tea", "10")], "site string, title string, price string")
    io.write_table(rows, str(tmp_path / "t"), io.LISTING_RAW, partition_by=["site"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert set(back.columns) == set(io.LISTING_RAW) and back.first()["image_url"] is None
    assert len(io.UNIFIED) == 32
    assert io.available(rows, ["price", "brand"]).columns == ["price"]
    assert stage(rows).collect() == rows.collect() == cut_lineage(rows).collect()


def test_shared_folder_comes_from_the_session():
    class Conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.checkpoint.dir": "/shared/work"}.get(key, default)

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "/shared/work"


def listings(spark, n=120):
    rows = [(i, f"S{i % 4}", "drinks", f"Cola No{i % 15} {250 + i % 15 * 10} ml", str(50 + i % 15 * 3 + i % 4))
            for i in range(n)]
    return spark.createDataFrame(rows, "seq long, site string, category string, title string, price string")


def test_catalogue_to_model(spark, tmp_path):
    unified = stage(pipelines.catalogue_to_unified(listings(spark)))
    assert unified.columns == [*io.UNIFIED, "seq"] and unified.count() == 120
    package, predicted = pipelines.train_price_model(
        unified, pricing.boosted_trees, trees=5, depth=3)
    assert predicted.where("predicted is null").count() == 0
    save_model(package, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"), list(package.labels))
    assert again.features == package.features
    assert again.metrics.first() is not None
    importance = pricing.feature_importance(package.model, package.features, spark).collect()
    assert importance[0]["importance"] >= importance[-1]["importance"]
    fresh = listings(spark, 8).withColumn("price", F.col("price").cast("double"))
    ready = pricing.prepare_for_scoring(fresh, again.labels, again.features)
    priced = pricing.price_gap(again.model.transform(ready))
    assert priced.where("price_status is null").count() == 0
    assert pricing.gap_summary(priced).first()["n_listings"] == 8


def test_search_to_deals(spark):
    got = pipelines.search_to_deals(listings(spark), learners=True)
    assert set(got.columns) >= {"deal_score", "deal_tier", "ml_predicted_score", "product_cluster"}
    assert got.count() == 120
