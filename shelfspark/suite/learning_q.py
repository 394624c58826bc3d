"""Queries over recommendation, price prediction and the listing stream."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfspark.operators import cross_store, pricing, recommend
from shelfspark.plans import pipelines
from shelfspark.session import short_lived, stage
from shelfspark.sources import tables
from shelfspark.streaming import dedupe
from shelfspark.suite.base import (
    NUDGE, catalog_rows, define, feature_rows, grouped_rows, query, rounded, sql,
)

# ----------------------------------------------------------- recommendation

define("doc_text", r"""
SELECT seq, regexp_replace(lower(title || ' ' || brand || ' ' || category || ' ' || brand_category),
 '[^a-z0-9\s]', ' ', 'g') AS text FROM cat_feat""", ["cat_feat"])
_STOPS = ", ".join(f"'{w}'" for w in recommend.STOP_WORDS)
define("doc_words", rf"""
SELECT seq, list_filter(string_split_regex(text, '\s+'),
 lambda x: length(x) >= 2 AND NOT list_contains([{_STOPS}], x)) AS w FROM doc_text""", ["doc_text"])
define("doc_terms", """
SELECT seq, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term
FROM doc_words""", ["doc_words"])
define("vocabulary", """
SELECT term, count(DISTINCT seq) AS df, count(*) AS total FROM doc_terms GROUP BY term
ORDER BY total DESC, term LIMIT 500""", ["doc_terms"])
define("doc_weights", """
SELECT seq, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY seq)) AS weight
FROM (SELECT seq, term, count(*) * (ln((1.0 + (SELECT count(*) FROM cat_feat))
  / (1.0 + any_value(df))) + 1) AS raw FROM doc_terms JOIN vocabulary USING (term) GROUP BY seq, term)""",
       ["doc_terms", "vocabulary", "cat_feat"])
define("doc_pairs", """
SELECT a.seq AS a, b.seq AS b, round(sum(a.weight * b.weight), 9) AS similarity
FROM doc_weights a JOIN doc_weights b ON a.term = b.term AND a.seq <> b.seq GROUP BY 1, 2""",
       ["doc_weights"])
define("neighbours", """
SELECT a AS seq, b AS match, similarity, row_number() OVER (
 PARTITION BY a ORDER BY similarity DESC, b) AS place FROM doc_pairs""", ["doc_pairs"])


def documents(spark, folder):
    return catalog_rows(spark, folder).select("seq", recommend.product_text().alias("text"))


@query("r01_product_text", sql("SELECT seq, text FROM doc_text", "doc_text"))
def r01(spark, folder):
    return documents(spark, folder)


def _weights(spark, folder):
    docs = stage(documents(spark, folder), "docs")
    texts = recommend.distinct_texts(docs)
    return docs, recommend.tfidf(texts)


@query("r02_tfidf", sql("""
SELECT seq, term, round(weight + 1e-8, 6) AS weight FROM doc_weights""", "doc_weights"))
def r02(spark, folder):
    docs, weights = _weights(spark, folder)
    owners = docs.join(recommend.distinct_texts(docs), "text").select("seq", "tid")
    return rounded(owners.join(weights, "tid").select("seq", "term", "weight"))


@query("r03_cosine_pairs", sql("""
SELECT a, b, similarity FROM doc_pairs
WHERE a < b AND similarity >= 0.5
 AND a IN (SELECT min(seq) FROM doc_text GROUP BY text)
 AND b IN (SELECT min(seq) FROM doc_text GROUP BY text)""", "doc_pairs", "doc_text"))
def r03(spark, folder):
    _, weights = _weights(spark, folder)
    return recommend.cosine_pairs(weights, 0.5)


@query("r04_similar_products", sql("""
SELECT seq, match, similarity, CAST(place AS INTEGER) AS place FROM neighbours WHERE place <= 10""",
                                   "neighbours"))
def r04(spark, folder):
    return recommend.similar_products(documents(spark, folder), 10)


@query("r05_cheapest_in_brand", sql("""
SELECT brand, title, category, price, site FROM (SELECT *, row_number() OVER (PARTITION BY brand
 ORDER BY price, seq) AS n FROM cat_feat) WHERE n <= 10""", "cat_feat"))
def r05(spark, folder):
    return recommend.cheapest_in_brand(catalog_rows(spark, folder)).select(
        "brand", "title", "category", "price", "site")


@query("r06_cheapest_in_category", sql("""
SELECT brand, title, category, price, site FROM (SELECT *, row_number() OVER (PARTITION BY category
 ORDER BY price, seq) AS n FROM cat_feat) WHERE n <= 10""", "cat_feat"))
def r06(spark, folder):
    return recommend.cheapest_in_category(catalog_rows(spark, folder)).select(
        "brand", "title", "category", "price", "site")


@query("r07_recommend_for_listings", sql("""
SELECT title, seq, match, similarity, CAST(place AS INTEGER) AS place
FROM (SELECT o.title, min(c.seq) AS seq FROM (SELECT DISTINCT title, substr(lower(title), 1, 20) AS piece
  FROM offers) o JOIN (SELECT DISTINCT p.piece, c.seq FROM (SELECT DISTINCT substr(lower(title), 1, 20)
   AS piece FROM offers) p JOIN catalog c ON contains(lower(c.title), p.piece)) c USING (piece)
 GROUP BY o.title) JOIN neighbours USING (seq) WHERE place <= 3""", "offers", "catalog", "neighbours"))
def r07(spark, folder):
    return recommend.recommend_for_listings(
        tables.offers(spark, folder), tables.catalog(spark, folder), documents(spark, folder))


@query("r08_brand_inventory", sql("""
SELECT brand, count(*) AS n_products, (SELECT count(DISTINCT brand) FROM feat) AS n_brands
FROM feat GROUP BY brand ORDER BY n_products DESC, brand LIMIT 5""", "feat"))
def r08(spark, folder):
    return recommend.brand_inventory(feature_rows(spark, folder))


@query("r09_text_classes", sql("""
SELECT seq, min(seq) OVER (PARTITION BY text) AS class FROM doc_text""", "doc_text"))
def r09(spark, folder):
    """The text class of every listing; r03 and r10 pair the classes."""
    return recommend.text_classes(documents(spark, folder))


@query("r10_all_cosine_pairs", sql("""
SELECT a, b, similarity FROM doc_pairs
WHERE a < b
 AND a IN (SELECT min(seq) FROM doc_text GROUP BY text)
 AND b IN (SELECT min(seq) FROM doc_text GROUP BY text)""", "doc_pairs", "doc_text"))
def r10(spark, folder):
    _, weights = _weights(spark, folder)
    return recommend.cosine_pairs(weights)


# --------------------------------------------------------------- prediction

SIZES = ["size_value", "normalized_quantity", "pack_count", "total_volume"]


def unified_rows(spark, folder, columns):
    return cross_store.with_store_competitiveness(
        cross_store.with_group_features(grouped_rows(spark, folder, columns)))


def _near(*columns: str) -> str:
    return ", ".join(f"round({c} + {NUDGE}, 4) AS {c}" for c in columns)


_NUMERIC = ", ".join(
    f"round(COALESCE(CAST({c} AS DOUBLE), 0) + {NUDGE}, 4) AS {c}" for c in pricing.NUMERIC)


@query("p01_numeric_features", sql(f"SELECT seq, title, {_NUMERIC} FROM unified", "unified"))
def p01(spark, folder):
    rows = pricing.numeric_features(unified_rows(spark, folder, SIZES))
    return rounded(rows.select("seq", "title", *pricing.NUMERIC), 4, NUDGE)


@query("p02_binary_features", sql(
    "SELECT seq, title, is_cheapest, is_most_expensive FROM unified", "unified"))
def p02(spark, folder):
    return pricing.binary_features(unified_rows(spark, folder, [])).select(
        "seq", "title", "is_cheapest", "is_most_expensive")


_CODES = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY encode(COALESCE({c}, 'nan'))) - 1 AS INTEGER) AS {c}_encoded"
    for c in pricing.CATEGORICAL)


@query("p03_label_encode", sql(f"SELECT seq, title, {_CODES} FROM feat", "feat"))
def p03(spark, folder):
    rows = stage(feature_rows(spark, folder), "labels")
    return pricing.label_encode(rows).select(
        "seq", "title", *[f"{c}_encoded" for c in pricing.CATEGORICAL])


_TRAIN = "('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 100 < 80"


@query("p05_split", sql(
    f"SELECT seq, title, {_TRAIN.format(k='seq')} AS is_train FROM feat WHERE price > 0", "feat"))
def p05(spark, folder):
    train, test = pricing.split(feature_rows(spark, folder).where("price > 0"))
    return train.select("seq", "title", F.lit(True).alias("is_train")).unionByName(
        test.select("seq", "title", F.lit(False).alias("is_train")))


define("learn", f"SELECT *, price AS price_numeric FROM feat WHERE price > 0 AND "
       f"{_TRAIN.format(k='seq')}", ["feat"])
define("held_out", f"SELECT *, price AS price_numeric FROM feat WHERE price > 0 AND NOT "
       f"({_TRAIN.format(k='seq')})", ["feat"])
for _key in ("product_id", "category"):
    define(f"by_{_key}", f"""
SELECT h.*, COALESCE(m, (SELECT avg(price) FROM learn)) AS predicted FROM held_out h
LEFT JOIN (SELECT {_key}, avg(price) AS m FROM learn GROUP BY 1) USING ({_key})""",
           ["learn", "held_out"])


def predictions(spark, folder, key="product_id"):
    rows = feature_rows(spark, folder).where("price > 0").withColumn(
        "price_numeric", F.col("price"))
    rows = rows.select("seq", "site", "title", "category", "product_id", "price", "price_numeric")
    train, test = pricing.split(stage(rows, "priced"))
    return pricing.group_mean_predictor(train, test, key)


def _metrics_sql(source: str) -> str:
    within = ", ".join(
        f"round(avg(CAST(abs(e) <= y * {p / 100.0} AS INT)) * 100 + {NUDGE}, 4) AS acc_{p}"
        for p in pricing.TOLERANCES)
    return f"""
SELECT count(*) AS n_rows, round(avg(abs(e)) + {NUDGE}, 4) AS mae, round(avg(e*e) + {NUDGE}, 4) AS mse,
 round(sqrt(avg(e*e)) + {NUDGE}, 4) AS rmse,
 round(1 - sum(e*e) / (var_pop(y) * count(*)) + {NUDGE}, 4) AS r2,
 round(avg(abs(e / NULLIF(y, 0))) * 100 + {NUDGE}, 4) AS mape, {within}
FROM (SELECT price AS y, price - predicted AS e FROM {source})"""


@query("p10_regression_metrics", sql(_metrics_sql("by_product_id"), "by_product_id"))
def p10(spark, folder):
    return rounded(pricing.regression_metrics(predictions(spark, folder)), 4, NUDGE)


@query("p11_error_distribution", sql(f"""
SELECT round(min(price - predicted) + {NUDGE}, 4) AS min_error,
 round(max(price - predicted) + {NUDGE}, 4) AS max_error,
 round(avg(price - predicted) + {NUDGE}, 4) AS mean_error,
 round(stddev_pop(price - predicted) + {NUDGE}, 4) AS std_error FROM by_product_id""", "by_product_id"))
def p11(spark, folder):
    return rounded(pricing.error_distribution(predictions(spark, folder)), 4, NUDGE)


@query("p13_quality_label", sql("""
SELECT category, CASE WHEN r2 >= 0.8 THEN 'Excellent' WHEN r2 >= 0.6 THEN 'Good'
 WHEN r2 >= 0.4 THEN 'Fair' ELSE 'Needs Improvement' END AS quality
FROM (SELECT category, 1 - sum((price - predicted) * (price - predicted)) / (var_pop(price) * count(*))
 AS r2 FROM by_product_id GROUP BY category)""", "by_product_id"))
def p13(spark, folder):
    metrics = pricing.regression_metrics(predictions(spark, folder), keys=["category"])
    return metrics.select("category", pricing.quality_label(F.col("r2")).alias("quality"))


@query("p14_prediction_sample", sql(f"""
SELECT seq, title, site, {_near('actual', 'predicted', 'error', 'error_pct')} FROM (
 SELECT seq, title, site, price AS actual, predicted, price - predicted AS error,
  (price - predicted) / price * 100 AS error_pct FROM by_product_id
 ORDER BY seq, title, site, price LIMIT 10)""", "by_product_id"))
def p14(spark, folder):
    return rounded(pricing.prediction_sample(
        predictions(spark, folder), 10, order=("seq", "title", "site")), 4, NUDGE)


@query("p15_prepare_for_scoring", sql(f"""
SELECT seq, title, {_near('pack_count', 'avg_price', 'median_price', 'num_stores', 'price_percentile',
 'size_value')}, COALESCE(c.code, 0) AS category_encoded
FROM (SELECT seq, title, category, CAST(pack_count AS DOUBLE) AS pack_count,
  (SELECT avg(price) FROM feat) AS avg_price, (SELECT median(price) FROM feat) AS median_price,
  1.0 AS num_stores, 50.0 AS price_percentile, COALESCE(size_value, 0) AS size_value FROM feat)
LEFT JOIN (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code
 FROM (SELECT DISTINCT category FROM feat WHERE category <> 'PROMO')) c USING (category)""", "feat"))
def p15(spark, folder):
    rows = stage(feature_rows(spark, folder), "scoring")
    labels = pricing.label_tables(rows.where("category <> 'PROMO'"), ["category"])
    ready = pricing.prepare_for_scoring(rows, labels, ["pack_count", "site_encoded"])
    return rounded(ready.select(
        "seq", "title", "pack_count", "avg_price", "median_price", "num_stores",
        "price_percentile", "size_value", "category_encoded"), 4, NUDGE)


@query("p16_price_gap", sql(f"""
SELECT seq, title, price, {_near('price_difference', 'price_diff_pct')}, CASE
 WHEN price_diff_pct < -5 THEN 'good deal' WHEN price_diff_pct > 5 THEN 'overpriced' ELSE 'fair' END
 AS price_status FROM (SELECT *, price - predicted AS price_difference,
  (price - predicted) / predicted * 100 AS price_diff_pct FROM by_product_id)""", "by_product_id"))
def p16(spark, folder):
    rows = pricing.price_gap(predictions(spark, folder)).withColumn("price", F.col("price"))
    out = rows.select("seq", "title", "price", "price_difference", "price_diff_pct", "price_status")
    return rounded(out.withColumn("price", F.col("price").cast("string")), 4, NUDGE).withColumn(
        "price", F.col("price").cast("double"))


@query("p17_gap_summary", sql("""
SELECT count(*) AS n_listings, count(*) FILTER (pct < -5) AS n_good_deals,
 arg_min(title, (pct, title, site, seq)) FILTER (pct < -5) AS best_deal
FROM (SELECT *, (price - predicted) / predicted * 100 AS pct FROM by_product_id)""", "by_product_id"))
def p17(spark, folder):
    return pricing.gap_summary(pricing.price_gap(predictions(spark, folder)))


_METRICS = ["mae", "mse", "rmse", "r2", "mape", *[f"acc_{p}" for p in pricing.TOLERANCES]]


@query("p18_compare_models", sql(f"""
SELECT *, CAST(wins = max(wins) OVER () AND model_no = min(model_no) FILTER (wins = top) OVER () AS INT)
 AS is_winner FROM (SELECT *, max(wins) OVER () AS top FROM (SELECT *, best_r2 + best_mae + best_acc_10
 AS wins FROM (SELECT *, CAST(r2 = max(r2) OVER () AS INT) AS best_r2,
  CAST(mae = min(mae) OVER () AS INT) AS best_mae, CAST(acc_10 = max(acc_10) OVER () AS INT)
  AS best_acc_10 FROM (SELECT 0 AS model_no, 'product mean' AS model, * FROM
   ({_metrics_sql('by_product_id')}) UNION ALL SELECT 1, 'category mean', * FROM
   ({_metrics_sql('by_category')})))))""".replace("SELECT *, CAST(wins = max", "SELECT * EXCLUDE (top), CAST(wins = max", 1),
                                 "by_product_id", "by_category"))
def p18(spark, folder):
    compared = pricing.compare_models({
        "product mean": predictions(spark, folder),
        "category mean": predictions(spark, folder, "category")})
    return rounded(compared, 4, NUDGE)


@query("p19_residuals", sql(f"""
SELECT seq, title, {_near('price_numeric', 'predicted', 'residual')} FROM (SELECT *,
 price - predicted AS residual FROM by_product_id)""", "by_product_id"))
def p19(spark, folder):
    return rounded(pricing.residuals(predictions(spark, folder)).select(
        "seq", "title", "price_numeric", "predicted", "residual"), 4, NUDGE)


# ----------------------------------------------------------------- learners

def model_table(spark, folder):
    """Training rows, test rows and inputs; listings and their group's figures are joined and written once."""
    listed = grouped_rows(spark, folder, [*SIZES, *[c for c in pricing.CATEGORICAL if c != "site"]])
    # Each table goes once the next one is written.
    with short_lived(spark) as scope:
        compared = cross_store.staged_group_features(
            listed.drop("title"), ["seq", "price_numeric", "product_group_id", "price_vs_avg_pct",
                                   *pricing.NUMERIC, *pricing.BINARY, *pricing.CATEGORICAL],
            named=[c for c in pricing.NUMERIC if c not in SIZES])
        rows = pricing.prepare(cross_store.with_store_competitiveness(compared), written=True)
        inputs = pricing.feature_columns(rows)
        rows = scope.kept(stage(rows.select(
            "seq", "price_numeric", *inputs, pricing.is_train(F.col("seq")).alias("is_train")), "prepared"))
    return rows.where("is_train").drop("is_train"), rows.where("NOT is_train").drop("is_train"), inputs


_INPUTS = [*pricing.NUMERIC, *pricing.BINARY, *[f"{c}_encoded" for c in pricing.CATEGORICAL]]
define("model_table", f"""
SELECT seq, price_numeric, {", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}"
                                      for c in [*pricing.NUMERIC, *pricing.BINARY])},
 {_CODES}, {_TRAIN.format(k="seq")} AS is_train FROM unified""", ["unified"])


def _unpacked(rows):
    """The feature vector as columns, named after the inputs."""
    cells = vector_to_array("features")
    return rounded(rows.select("seq", "price_numeric", *[
        cells[i].alias(c) for i, c in enumerate(_INPUTS)]), 4, NUDGE)


@query("p04_assemble", sql(
    f"SELECT seq, {_near('price_numeric', *_INPUTS)} FROM model_table WHERE is_train", "model_table"))
def p04(spark, folder):
    train, _, inputs = model_table(spark, folder)
    return _unpacked(pricing.assemble(inputs).transform(train))


_SCALED = ", ".join(
    f"round(COALESCE(({c} - (SELECT avg({c}) FROM model_table WHERE is_train)) / NULLIF((SELECT "
    f"stddev_pop({c}) FROM model_table WHERE is_train), 0), 0) + {NUDGE}, 4) AS {c}" for c in _INPUTS)


@query("p06_standardise", sql(
    f"SELECT seq, {_near('price_numeric')}, {_SCALED} FROM model_table WHERE NOT is_train",
    "model_table"))
def p06(spark, folder):
    train, test, inputs = model_table(spark, folder)
    scaler = Pipeline(stages=pricing.standardised(train, inputs)).fit(train)
    return _unpacked(scaler.transform(test))


@query("p07_random_forest")
def p07(spark, folder):
    train, test, inputs = model_table(spark, folder)
    model = pricing.random_forest(train, inputs, trees=20, depth=10)
    return pricing.regression_metrics(model.transform(test))


@query("p08_boosted_trees")
def p08(spark, folder):
    train, test, inputs = model_table(spark, folder)
    model = pricing.boosted_trees(train, inputs, trees=20)
    return pricing.regression_metrics(model.transform(test))


@query("p09_neural_regressor")
def p09(spark, folder):
    train, test, inputs = model_table(spark, folder)
    model = pricing.neural_regressor(train, inputs)
    return pricing.regression_metrics(model.transform(test))


@query("p12_feature_importance")
def p12(spark, folder):
    train, _, inputs = model_table(spark, folder)
    model = pricing.boosted_trees(train, inputs, trees=10, depth=5)
    return pricing.feature_importance(model, inputs, spark)


@query("t01_search_to_deals", sql("""
SELECT site, title, price, round(deal_score + 1e-8, 6) AS deal_score, deal_tier FROM deal""", "deal"))
def t01(spark, folder):
    return rounded(pipelines.search_to_deals(tables.offers(spark, folder)).select(
        "site", "title", "price", "deal_score", "deal_tier"))


@query("t02_catalogue_to_unified")
def t02(spark, folder):
    return pipelines.catalogue_to_unified(tables.catalog(spark, folder))


# ------------------------------------------------------------------- stream

@query("e01_dedupe_stream", "SELECT DISTINCT user_id, event_type FROM events")
def e01(spark, folder):
    schema = tables.table(spark, folder, "events").schema
    feed = dedupe.read_feed(spark, folder, "events.parquet", schema).select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    kept = dedupe.dedupe_stream(feed, ["user_id", "event_type"], "ts", "3650 days")
    return dedupe.run_to_table(kept, "events").select("user_id", "event_type")


@query("e02_dedupe_interval", """
SELECT DISTINCT user_id, event_type, time_bucket(INTERVAL '6 hours', ts) AS interval_start FROM events""")
def e02(spark, folder):
    """One row of each key in each six hours; what is two days behind the feed has left the state."""
    schema = tables.table(spark, folder, "events").schema
    feed = dedupe.read_feed(spark, folder, "events.parquet", schema).select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    kept = dedupe.dedupe_interval(feed, ["user_id", "event_type"], "ts", "6 hours", "2 days")
    return dedupe.run_to_table(kept, "intervals").select(
        "user_id", "event_type", F.col("interval.start").cast("timestamp_ntz").alias("interval_start"))
