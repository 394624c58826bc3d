"""Queries over cross-store statistics, deals, the learned score and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.similarity import normalize_name, sorted_tokens, token_sort_ratio
from shelfspark.operators import cross_store, deal_model, deals, features, matching, views
from shelfspark.session import work_path
from shelfspark.sources import listings as io
from shelfspark.sources import tables
from shelfspark.suite.base import (
    NUDGE, catalog_rows, deal_rows, define, feature_rows, grouped_rows, quantity_rows, query, rounded, sql,
)
from shelfspark.suite.listings_q import deal_quantity_sql, keyword_sql

# ---------------------------------------------------------------- matching


@query("m01_normalize_name", sql("SELECT seq, title, normalized_name FROM named", "named"))
def m01(spark, folder):
    return matching.with_normalized_name(feature_rows(spark, folder)).select(
        "seq", "title", "normalized_name")


@query("m02_similarity")
def m02(spark, folder):
    rows = matching.with_normalized_name(catalog_rows(spark, folder))
    return rounded(rows.select("seq", "title", token_sort_ratio(
        "normalized_name", F.lower("title")).alias("score")))


@query("m02_sorted_tokens", sql(r"""
SELECT seq, list_aggregate(list_sort(string_split_regex(normalized_name, '\s+')), 'string_agg', ' ')
 AS tokens FROM cat_named""", "cat_named"))
def m02_tokens(spark, folder):
    return catalog_rows(spark, folder).select("seq", sorted_tokens(normalize_name(
        "title", "size_value", "size_unit")).alias("tokens"))


def catalog_names(spark, folder):
    return matching.distinct_names(matching.with_normalized_name(catalog_rows(spark, folder)))


@query("m03_top_k_similar")
def m03(spark, folder):
    return rounded(matching.top_k_similar(catalog_names(spark, folder)))


@query("m04_group_products")
def m04(spark, folder):
    return matching.group_names(catalog_names(spark, folder))


@query("m04_match_products")
def m04_all(spark, folder):
    return matching.match_products(tables_features(spark, folder)).select(
        "seq", "site", "normalized_name", "product_group_id")


def tables_features(spark, folder):
    return features.feature_table(tables.catalog(spark, folder))


@query("m05_qualify_groups", sql("""
SELECT seq, normalized_name, CASE WHEN sites >= 2 OR names > 1 THEN leader * 2 ELSE seq * 2 + 1 END
 AS product_group_id
FROM (SELECT c.*, leader, count(DISTINCT site) OVER (PARTITION BY leader) AS sites,
  count(DISTINCT normalized_name) OVER (PARTITION BY leader) AS names
 FROM cat_named c JOIN (SELECT normalized_name, min(min(seq)) OVER (PARTITION BY
   substr(normalized_name, 1, 16)) AS leader FROM cat_named GROUP BY normalized_name)
 USING (normalized_name))""", "cat_named"))
def m05(spark, folder):
    rows = matching.with_normalized_name(catalog_rows(spark, folder))
    names = matching.distinct_names(rows)
    head = F.substring("normalized_name", 1, 16)
    leaders = names.groupBy(head.alias("head")).agg(F.min("ord").alias("leader"))
    groups = names.withColumn("head", head).join(leaders, "head")
    return matching.qualify_groups(rows, groups).select(
        "seq", "normalized_name", "product_group_id")


# ------------------------------------------------------------- cross store

def _near(*columns: str) -> str:
    return ", ".join(f"round({c} + {NUDGE}, 4) AS {c}" for c in columns)


_FACTS = ["min_price", "max_price", "avg_price", "median_price", "std_price", "price_range",
          "price_range_pct"]


@query("m06_group_price_stats", sql(
    f"SELECT product_group_id, num_stores, distinct_sites, {_near(*_FACTS)} FROM group_facts",
    "group_facts"))
def m06(spark, folder):
    return rounded(cross_store.group_price_stats(grouped_rows(spark, folder, [])), 4, NUDGE)


def _group_query(name: str, *picked: str):
    exact = [c for c in picked if c in ("is_cheapest", "is_most_expensive", "store_rank")]
    columns = ", ".join([*exact, *[_near(c) for c in picked if c not in exact]])
    check = sql(f"SELECT seq, title, product_group_id, {_near('price_numeric')}, {columns} "
                "FROM grouped_stats", "grouped_stats")

    @query(name, check)
    def run(spark, folder):
        rows = cross_store.with_group_features(grouped_rows(spark, folder, []))
        return rounded(rows.select("seq", "title", "product_group_id", "price_numeric", *picked),
                       4, NUDGE)
    return run


m07 = _group_query("m07_price_vs_avg", "price_vs_avg", "price_vs_avg_pct")
m08 = _group_query("m08_price_extremes", "is_cheapest", "is_most_expensive")
m09 = _group_query("m09_price_percentile", "price_percentile")
m10 = _group_query("m10_store_rank", "store_rank")


@query("m11_store_competitiveness", sql("""
SELECT seq, title, site, round(avg_price_vs_market + 1e-8, 6) AS avg_price_vs_market,
 round(cheapest_rate + 1e-8, 6) AS cheapest_rate FROM unified""", "unified"))
def m11(spark, folder):
    rows = cross_store.with_group_features(grouped_rows(spark, folder, []))
    return rounded(cross_store.with_store_competitiveness(rows).select(
        "seq", "title", "site", "avg_price_vs_market", "cheapest_rate"))


@query("m11_store_table", sql("""
SELECT site, times_cheapest, round(avg_price_vs_market + 1e-8, 6) AS avg_price_vs_market, products_compared,
 round(cheapest_rate + 1e-8, 6) AS cheapest_rate FROM stores""", "stores"))
def m11_stores(spark, folder):
    return rounded(cross_store.store_competitiveness(
        cross_store.with_group_features(grouped_rows(spark, folder, []))))


@query("m12_matching_summary", sql("""
SELECT CAST(sum(num_stores) FILTER (num_stores >= 2) AS BIGINT) AS multi_store_listings,
 round(avg(price_range) + 1e-8, 6) AS avg_price_range, round(avg(price_range_pct) + 1e-8, 6) AS avg_price_range_pct
FROM group_facts""", "group_facts"))
def m12(spark, folder):
    return rounded(cross_store.matching_summary(
        cross_store.group_price_stats(grouped_rows(spark, folder, []))))


# ------------------------------------------------------------------- deals

@query("d01_require_complete", sql("SELECT seq, title, price FROM complete", "complete"))
def d01(spark, folder):
    return deals.require_complete(quantity_rows(spark, folder)).select("seq", "title", "price")


def _deal_query(name: str, columns: str, *picked: str):
    @query(name, sql(f"SELECT seq, title, {columns} FROM deal", "deal"))
    def run(spark, folder):
        return rounded(deal_rows(spark, folder).select("seq", "title", *picked))
    return run


d02 = _deal_query(
    "d02_price_percentile", "round(price_percentile + 1e-8, 6) AS price_percentile, "
    "round(unit_price_percentile + 1e-8, 6) AS unit_price_percentile",
    "price_percentile", "unit_price_percentile")
d03 = _deal_query("d03_value_score", "round(value_score + 1e-8, 6) AS value_score", "value_score")
d04 = _deal_query("d04_pack_efficiency", "round(pack_efficiency::DOUBLE + 1e-8, 6) AS pack_efficiency",
                  "pack_efficiency")
d06 = _deal_query("d06_store_rank", "CAST(store_rank AS INTEGER) AS store_rank, "
                  "round(store_rank_normalized + 1e-8, 6) AS store_rank_normalized",
                  "store_rank", "store_rank_normalized")
d07 = _deal_query("d07_deal_score", "round(deal_score + 1e-8, 6) AS deal_score", "deal_score")
d08 = _deal_query("d08_deal_tier", "deal_tier", "deal_tier")


@query("d05_size_tier", sql("""
SELECT seq, title, CASE WHEN normalized_quantity <= q[1] THEN 'Small'
 WHEN normalized_quantity <= q[2] THEN 'Medium' WHEN normalized_quantity <= q[3] THEN 'Large'
 WHEN normalized_quantity IS NOT NULL THEN 'XL' END AS size_tier
FROM feat, (SELECT quantile_cont(normalized_quantity, [0.25, 0.5, 0.75]) AS q FROM feat)""", "feat"))
def d05(spark, folder):
    return deals.with_size_tier(feature_rows(spark, folder).select(
        "seq", "title", "normalized_quantity")).select("seq", "title", "size_tier")


@query("d09_tier_distribution", sql("""
SELECT CAST(tier_order AS INTEGER) AS tier_order, t.deal_tier, count(seq) AS n_listings,
 round(count(seq) / (SELECT count(*) FROM deal) * 100 + 1e-8, 6) AS pct
FROM (VALUES (0,'Excellent'),(1,'Good'),(2,'Fair'),(3,'Poor')) t(tier_order, deal_tier)
LEFT JOIN deal USING (deal_tier) GROUP BY ALL""", "deal"))
def d09(spark, folder):
    return rounded(deals.tier_distribution(deal_rows(spark, folder)))


@query("d10_top_deals", sql("""
SELECT site, title, price, round(unit_price + 1e-8, 6) AS unit_price, round(deal_score + 1e-8, 6) AS deal_score,
 deal_tier FROM deal ORDER BY deal.deal_score DESC, site, title, price LIMIT 5""", "deal"))
def d10(spark, folder):
    return rounded(deals.top_deals(deal_rows(spark, folder), 5, ("site", "title", "price")))


@query("d11_store_performance", sql("""
SELECT site, round(avg(unit_price) + 1e-8, 6) AS avg_unit_price, round(avg(deal_score) + 1e-8, 6) AS avg_deal_score,
 count(price) AS n_listings FROM deal GROUP BY site""", "deal"))
def d11(spark, folder):
    return rounded(deals.store_performance(deal_rows(spark, folder)))


@query("d12_cluster_listings")
def d12(spark, folder):
    return deals.cluster_listings(deal_rows(spark, folder)).select(
        "seq", "title", "product_cluster")


@query("d13_cluster_profile", sql("""
SELECT a.product_cluster, avg_price, avg_unit_price, avg_deal_score, n_listings, top_site
FROM (SELECT CAST(seq % 4 AS INTEGER) AS product_cluster, round(avg(price) + 1e-8, 6) AS avg_price,
  round(avg(unit_price) + 1e-8, 6) AS avg_unit_price, round(avg(deal_score) + 1e-8, 6) AS avg_deal_score,
  count(*) AS n_listings FROM deal GROUP BY 1) a
JOIN (SELECT product_cluster, site AS top_site FROM (SELECT CAST(seq % 4 AS INTEGER) AS product_cluster,
  site, row_number() OVER (PARTITION BY seq % 4 ORDER BY count(*) DESC, site) AS n FROM deal
  GROUP BY seq % 4, site) WHERE n = 1) b USING (product_cluster)""", "deal"))
def d13(spark, folder):
    rows = deal_rows(spark, folder).withColumn("product_cluster", (F.col("seq") % 4).cast("int"))
    return rounded(deals.cluster_profile(rows))


@query("d14_predict_deal_score")
def d14(spark, folder):
    scored, _ = deals.predict_deal_score(deal_rows(spark, folder))
    return scored.select("seq", "title", "deal_score", "ml_predicted_score")


# ------------------------------------------------------------ learned score

define("priced", f"""
SELECT *, price / NULLIF(quantity_value, 0) AS price_per_unit FROM (SELECT *,
  COALESCE(normalized_quantity, {deal_quantity_sql("lower(title)")}) AS quantity_value,
  {keyword_sql("lower(title)")} AS value_score FROM feat WHERE price IS NOT NULL)""", ["feat"])
define("overall", """
SELECT avg(price) AS mean_price, stddev_samp(price) AS std_price, min(price) AS min_price,
 max(price) AS max_price, median(price) AS median_price, count(*) AS n_rows,
 max(unit_price) AS max_unit_price FROM priced""", ["priced"])


def _raw_score(source: str, train: str) -> str:
    return f"""
SELECT p.*, (o.mean_price - p.price) / (o.std_price + 0.01) * 0.4
 + CASE WHEN b.brand IS NULL THEN 0 ELSE (b.m - p.price) / (b.s + 0.01) * 0.2 END
 + CASE WHEN c.category IS NULL THEN 0 ELSE (c.m - p.price) / (c.s + 0.01) * 0.2 END
 + CASE WHEN p.unit_price > 0 THEN (1 - p.unit_price / o.max_unit_price) * 0.1 ELSE 0 END
 + p.value_score / 5 * 0.1 AS raw_deal_score
FROM {source} p
CROSS JOIN (SELECT avg(price) AS mean_price, stddev_samp(price) AS std_price,
 max(unit_price) AS max_unit_price FROM {train}) o
LEFT JOIN (SELECT brand, avg(price) AS m, stddev_samp(price) AS s FROM {train} GROUP BY 1) b USING (brand)
LEFT JOIN (SELECT category, avg(price) AS m, stddev_samp(price) AS s FROM {train} GROUP BY 1) c
 USING (category)"""


define("raw_scores", _raw_score("priced", "priced"), ["priced"])
define("learned", """
SELECT *, 100 * ((raw_deal_score - min(raw_deal_score) OVER ())
 / (max(raw_deal_score) OVER () - min(raw_deal_score) OVER () + 0.01)) AS deal_score
FROM raw_scores""", ["raw_scores"])
define("past", "SELECT * FROM priced WHERE seq % 2 = 0", ["priced"])
define("coming", "SELECT * FROM priced WHERE seq % 2 = 1", ["priced"])
define("past_raw", _raw_score("past", "past"), ["past"])
define("coming_raw", _raw_score("coming", "past"), ["past", "coming"])


def model_rows(spark, folder):
    return features.with_deal_quantity(feature_rows(spark, folder))


@query("b01_global_price_stats", sql("""
SELECT round(mean_price + 1e-8, 6) AS mean_price, round(std_price + 1e-8, 6) AS std_price, min_price, max_price, n_rows,
 round(median_price + 1e-8, 6) AS median_price FROM overall""", "overall"))
def b01(spark, folder):
    return rounded(deal_model.global_price_stats(feature_rows(spark, folder)))


@query("b02_price_stats_by", sql("""
SELECT 'brand' AS dimension, brand AS key, round(avg(price) + 1e-8, 6) AS mean_price,
 round(stddev_samp(price) + 1e-8, 6) AS std_price, count(price) AS n_rows FROM priced GROUP BY brand
UNION ALL SELECT 'category', category, round(avg(price) + 1e-8, 6), round(stddev_samp(price) + 1e-8, 6), count(price)
FROM priced GROUP BY category
UNION ALL SELECT 'site', site, round(avg(price) + 1e-8, 6), round(stddev_samp(price) + 1e-8, 6), count(price)
FROM priced GROUP BY site""", "priced"))
def b02(spark, folder):
    return rounded(deal_model.price_stats_by(feature_rows(spark, folder)))


@query("b03_price_per_unit", sql("""
SELECT seq, title, CAST(quantity_value AS DOUBLE) AS quantity_value,
 CAST(price_per_unit AS DOUBLE) AS price_per_unit FROM priced""", "priced"))
def b03(spark, folder):
    return model_rows(spark, folder).where("price is not null").select(
        "seq", "title", "quantity_value", "price_per_unit")


@query("b04_raw_deal_score", sql("""
SELECT seq, title, price, round(raw_deal_score + 1e-8, 6) AS raw_deal_score FROM raw_scores""", "raw_scores"))
def b04(spark, folder):
    _, scored = deal_model.train(model_rows(spark, folder))
    return rounded(scored.select("seq", "title", "price", "raw_deal_score"))


@query("b05_scale_0_100", sql("""
SELECT seq, title, price, round(deal_score + 1e-8, 6) AS deal_score FROM learned""", "learned"))
def b05(spark, folder):
    _, scored = deal_model.train(model_rows(spark, folder))
    return rounded(scored.select("seq", "title", "price", "deal_score"))


@query("b06_score_new", sql("""
SELECT seq, title, price, round(greatest(0, least(100, 100 * ((raw_deal_score - low)
 / (high - low + 0.01)))) + 1e-8, 6) AS deal_score
FROM coming_raw, (SELECT min(raw_deal_score) AS low, max(raw_deal_score) AS high FROM past_raw)""",
                            "past_raw", "coming_raw"))
def b06(spark, folder):
    rows = model_rows(spark, folder).where("price is not null")
    past, coming = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    model, _ = deal_model.train(past)
    return rounded(deal_model.score_new(coming, model).select("seq", "title", "price", "deal_score"))


@query("b07_top_deals", sql("""
SELECT title, brand, category, price, site, round(deal_score + 1e-8, 6) AS deal_score,
 CAST(round(price_per_unit + 1e-8, 6) AS DOUBLE) AS price_per_unit
FROM learned ORDER BY learned.deal_score DESC, title, site, price LIMIT 20""", "learned"))
def b07(spark, folder):
    _, scored = deal_model.train(model_rows(spark, folder))
    return rounded(deal_model.top_deals(scored, 20))


@query("b08_price_outliers")
def b08(spark, folder):
    return deal_model.price_outliers(model_rows(spark, folder)).select(
        "seq", "title", "price", "price_per_unit", "outlier_score", "is_outlier")


# ------------------------------------------------------------------- views

@query("v01_filter_bounds", sql("""
SELECT min(price) AS min_price, max(price) AS max_price, min(normalized_quantity) AS min_size,
 max(normalized_quantity) AS max_size, count(DISTINCT site) AS n_sites FROM feat""", "feat"))
def v01(spark, folder):
    return views.filter_bounds(feature_rows(spark, folder))


@query("v02_key_metrics", sql("""
SELECT c.price AS cheapest_price, c.site AS cheapest_site, round(u.unit_price + 1e-8, 6) AS best_unit_price,
 u.unit_price_unit AS best_unit, u.site AS best_unit_site, m.site AS top_site, m.n AS top_site_listings,
 (SELECT count(*) FROM feat) AS n_listings, (SELECT count(DISTINCT site) FROM feat) AS n_sites
FROM (SELECT * FROM feat WHERE price IS NOT NULL ORDER BY price, site, title, seq LIMIT 1) c,
 (SELECT * FROM feat WHERE unit_price IS NOT NULL ORDER BY unit_price, site, title, seq LIMIT 1) u,
 (SELECT site, count(*) AS n FROM feat GROUP BY site ORDER BY n DESC, site LIMIT 1) m""", "feat"))
def v02(spark, folder):
    return rounded(views.key_metrics(feature_rows(spark, folder)))


@query("v03_best_value", sql("""
SELECT site, title, price, size_value, size_unit, round(unit_price + 1e-8, 6) AS unit_price, unit_price_unit,
 round(per_unit_price + 1e-8, 6) AS per_unit_price FROM feat WHERE feat.unit_price IS NOT NULL
ORDER BY feat.unit_price, site, title, seq, price LIMIT 20""", "feat"))
def v03(spark, folder):
    return rounded(views.best_value(feature_rows(spark, folder), 20))


@query("v04_price_box_by_store", sql("""
SELECT site, min(price) AS min_price, round(quantile_cont(price, 0.25) + 1e-8, 6) AS q1,
 round(quantile_cont(price, 0.5) + 1e-8, 6) AS median_price, round(quantile_cont(price, 0.75) + 1e-8, 6) AS q3,
 max(price) AS max_price FROM feat GROUP BY site""", "feat"))
def v04(spark, folder):
    return rounded(views.price_box_by_store(feature_rows(spark, folder)))


@query("v05_price_vs_size", sql("""
SELECT site, title, normalized_quantity, price, unit_price, pack_count, per_unit_price FROM feat
WHERE price IS NOT NULL AND normalized_quantity IS NOT NULL""", "feat"))
def v05(spark, folder):
    return views.price_vs_size(feature_rows(spark, folder))


@query("v06_pack_deals", sql("""
SELECT site, title, pack_count, price, price / pack_count AS savings_per_pack FROM feat
WHERE pack_count > 0 AND price IS NOT NULL ORDER BY savings_per_pack, site, title, seq LIMIT 10""",
                             "feat"))
def v06(spark, folder):
    return views.pack_deals(feature_rows(spark, folder), 10)


@query("v07_store_table", sql("""
SELECT site, round(avg(price) + 1e-8, 6) AS avg_price, min(price) AS min_price, count(price) AS n_listings,
 round(avg(unit_price) + 1e-8, 6) AS avg_unit_price FROM feat GROUP BY site""", "feat"))
def v07(spark, folder):
    return rounded(views.store_table(feature_rows(spark, folder)))


@query("v08_detail_table", sql("""
SELECT site, title, price, size_value, size_unit, pack_count, unit_price, unit_price_unit,
 per_unit_price, product_url FROM feat ORDER BY unit_price DESC NULLS LAST""", "feat"))
def v08(spark, folder):
    return views.detail_table(feature_rows(spark, folder), "unit_price", ascending=False)


@query("v09_highlight_min", sql("""
SELECT seq, title, price, COALESCE(price = (SELECT min(price) FROM feat), false) AS price_is_min,
 COALESCE(unit_price = (SELECT min(unit_price) FROM feat), false) AS unit_price_is_min FROM feat""",
                                "feat"))
def v09(spark, folder):
    return views.highlight_min(feature_rows(spark, folder)).select(
        "seq", "title", "price", "price_is_min", "unit_price_is_min")


@query("v10_score_histogram", sql("""
SELECT CAST(bin AS INTEGER) AS bin, round(low + bin * width + 1e-8, 6) AS bin_start,
 round(low + (bin + 1) * width + 1e-8, 6) AS bin_end, count(*) AS n_listings
FROM (SELECT least(9, floor((deal_score - low) / width)) AS bin, low, width FROM deal,
 (SELECT min(deal_score) AS low, (max(deal_score) - min(deal_score)) / 10 AS width FROM deal))
GROUP BY bin, low, width""", "deal"))
def v10(spark, folder):
    return rounded(views.score_histogram(deal_rows(spark, folder)))


@query("v11_score_band", sql("""
SELECT seq, title, price, CASE WHEN deal_score >= 95 THEN 'green' WHEN deal_score >= 90 THEN 'yellow'
 ELSE 'red' END AS band FROM learned""", "learned"))
def v11(spark, folder):
    _, scored = deal_model.train(model_rows(spark, folder))
    return scored.select("seq", "title", "price", views.score_band(F.col("deal_score")).alias("band"))


@query("v12_export_filtered", sql("""
SELECT site, title, price FROM feat WHERE price BETWEEN 2000 AND 40000""", "feat"))
def v12(spark, folder):
    path = work_path(spark, "export")
    rows = feature_rows(spark, folder).where("price between 2000 and 40000")
    io.write_table(rows, path, ["site", "title", "price"], fmt="csv")
    return features.coerce_numeric(io.read_listings(spark, path), ["price"])


@query("v13_record_counts", sql("""
SELECT count(*) AS total_records, count(*) FILTER (price BETWEEN 2000 AND 40000) AS filtered_records
FROM feat""", "feat"))
def v13(spark, folder):
    return views.record_counts(feature_rows(spark, folder), F.col("price").between(2000, 40000))
