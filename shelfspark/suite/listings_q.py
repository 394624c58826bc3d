"""Queries over listing filters, duplicates and quantity features."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import quantity as q
from shelfspark.functions import text as t
from shelfspark.functions.similarity import match_fuzzy
from shelfspark.operators import features, listings
from shelfspark.sources import tables
from shelfspark.suite.base import (
    brand_sql, feature_rows, pack_sql, quantity_rows, query, size_sql, sql,
)

ORDER = ["seq", "title", "price", "site"]


@query("f01_match_all_tokens", sql(r"""
SELECT seq, title, list_contains(w, 'peek') AND list_contains(w, 'freans') AND list_contains(w, 'pcs')
 AS hit FROM (SELECT *, string_split_regex(regexp_replace(lower(title), '[^a-z0-9_\s]', ' ', 'g'),
  '\s+') AS w FROM offers)""", "offers"))
def f01(spark, folder):
    return tables.offers(spark, folder).select(
        "seq", "title", t.match_all_tokens("title", "Peek FREANS pcs").alias("hit"))


@query("f02_match_substring", sql(
    "SELECT seq, title, site FROM offers WHERE contains(lower(title), 'cola fresh')", "offers"))
def f02(spark, folder):
    return listings.filter_by_query(
        tables.offers(spark, folder), "Cola Fresh", "substring").select("seq", "title", "site")


@query("f03_match_fuzzy")
def f03(spark, folder):
    rows = tables.offers(spark, folder)
    return rows.where(match_fuzzy("title", "coca-cola fresh widgets")).select("seq", "title", "site")


@query("f04_drop_blank_titles", sql("""
SELECT seq, title FROM offers WHERE seq % 5 <> 0""", "offers"))
def f04(spark, folder):
    rows = tables.offers(spark, folder).withColumn(
        "title", F.when(F.col("seq") % 10 == 0, "  ").when(
            F.col("seq") % 10 == 5, F.lit(None)).otherwise(F.col("title")))
    return listings.drop_blank_titles(rows).select("seq", "title")


_FIRST = """
SELECT seq, site, category, product_id, title, price, product_url FROM (SELECT *, row_number() OVER (
 PARTITION BY {key} ORDER BY seq, title, price, site) AS n FROM {src}) WHERE n = 1"""
_VARIED = """(SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN '' ELSE product_id END AS product_id,
 CASE WHEN seq % 2 = 0 THEN '' ELSE product_url END AS product_url) FROM offers)"""


def varied(spark, folder):
    """Offers with some ids and links blanked, so that every key fallback occurs."""
    return tables.offers(spark, folder).withColumns({
        "product_id": F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("product_id")),
        "product_url": F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("product_url"))})


@query("f05_dedupe_page", sql(_FIRST.format(
    key="COALESCE(NULLIF(product_url, ''), lower(title))", src=_VARIED), "offers"))
def f05(spark, folder):
    return listings.dedupe_page(varied(spark, folder), ORDER)


_ID = "COALESCE(NULLIF(product_id, ''), NULLIF(product_url, ''), {title})"


@query("f06_dedupe_category", sql(_FIRST.format(
    key="site, category, " + _ID.format(title="lower(title)"), src=_VARIED), "offers"))
def f06(spark, folder):
    return listings.dedupe_category(varied(spark, folder), ORDER)


@query("f07_dedupe_global", sql(_FIRST.format(
    key="site, " + _ID.format(title="title"), src=_VARIED), "offers"))
def f07(spark, folder):
    return listings.dedupe_global(varied(spark, folder), ORDER)


@query("f07_search_policy", sql("""
WITH p AS (SELECT * REPLACE (CASE seq % 5 WHEN 0 THEN 'Naheed' WHEN 1 THEN 'Alfatah' WHEN 2 THEN 'Metro'
  WHEN 3 THEN 'Imtiaz' ELSE 'Carrefour' END AS site) FROM offers),
k AS (SELECT *, CASE WHEN site IN ('Naheed','Alfatah','Metro') THEN product_url
  WHEN site = 'Imtiaz' THEN product_id END AS key FROM p
 WHERE CASE WHEN site = 'Naheed' THEN regexp_matches(lower(title), '(^|[^a-z0-9_])fresh($|[^a-z0-9_])')
  WHEN site IN ('Alfatah','Metro') THEN contains(lower(title), 'fresh') ELSE true END)
SELECT seq, site, category, product_id, title, price, product_url FROM (SELECT *, row_number() OVER (
 PARTITION BY site, key ORDER BY seq, title, price) AS n FROM k) WHERE n = 1 OR key IS NULL
""".replace("WITH p AS", "SELECT * FROM (WITH p AS") + ")", "offers"))
def f07_policy(spark, folder):
    number = F.col("seq") % 5
    site = (F.when(number == 0, "Naheed").when(number == 1, "Alfatah").when(number == 2, "Metro")
            .when(number == 3, "Imtiaz").otherwise("Carrefour"))
    rows = tables.offers(spark, folder).withColumn("site", site)
    return listings.search_policy(rows, "fresh", ["seq", "title", "price"])


@query("f08_union_sites", sql("""
SELECT seq, site, title, product_id, price FROM offers
UNION ALL SELECT seq, site, title, NULL, price FROM catalog""", "offers", "catalog"))
def f08(spark, folder):
    return listings.union_sites([
        tables.offers(spark, folder).select("seq", "site", "title", "product_id", "price"),
        tables.catalog(spark, folder).select("seq", "site", "title", "price")])


@query("f09_count_by", sql("SELECT site, count(*) AS n FROM offers GROUP BY site", "offers"))
def f09(spark, folder):
    return listings.count_by(tables.offers(spark, folder), "site")


@query("f09_top_counts", sql("""
SELECT title, count(*) AS n FROM offers GROUP BY title ORDER BY n DESC, title LIMIT 15""", "offers"))
def f09_top(spark, folder):
    return listings.top_counts(tables.offers(spark, folder), "title", 15)


@query("f10_sample_per_group", sql("""
SELECT site, category, seq, title, price FROM (SELECT *, row_number() OVER (PARTITION BY site, category
 ORDER BY seq, title, price) AS n FROM offers) WHERE n <= 2""", "offers"))
def f10(spark, folder):
    return listings.sample_per_group(
        tables.offers(spark, folder), ["site", "category"], ["seq", "title", "price"]).select(
        "site", "category", "seq", "title", "price")


@query("f11_filter_listings", sql("""
SELECT seq, site, title, price, normalized_quantity FROM feat WHERE site IN ('NATION_1', 'NATION_7')
 AND price BETWEEN 1000 AND 60000 AND normalized_quantity BETWEEN 100 AND 5000""", "feat"))
def f11(spark, folder):
    return listings.filter_listings(
        feature_rows(spark, folder), ["NATION_1", "NATION_7"], (1000.0, 60000.0), (100.0, 5000.0)
    ).select("seq", "site", "title", "price", "normalized_quantity")


@query("f12_search_titles", sql("""
SELECT seq, title FROM offers WHERE regexp_matches(title, '(?i)(GEAR|bolt) .*pack of [1-3]')""",
                                "offers"))
def f12(spark, folder):
    return listings.search_titles(
        tables.offers(spark, folder), "(GEAR|bolt) .*pack of [1-3]").select("seq", "title")


@query("f13_valid_price", sql("""
SELECT seq, title, TRY_CAST(price AS DOUBLE) AS price_numeric FROM offers
WHERE TRY_CAST(price AS DOUBLE) > 0""", "offers"))
def f13(spark, folder):
    return listings.valid_price(tables.offers(spark, folder)).select("seq", "title", "price_numeric")


# ---------------------------------------------------------------- features

def _sizes(table: str, extra: str = "") -> str:
    value, unit = size_sql("lt")
    return (f"SELECT seq, title, {value} AS size_value, {unit} AS size_unit{extra} "
            f"FROM (SELECT *, lower(title) AS lt FROM {table})")


@query("c01_size", sql(_sizes("offers"), "offers"))
def c01(spark, folder):
    return tables.offers(spark, folder).withColumn("s", q.size("title")).select(
        "seq", "title", "s.size_value", "s.size_unit")


@query("c02_canonical_unit", sql("""
SELECT seq, title, CASE seq % 7 WHEN 0 THEN 'l' WHEN 1 THEN 'ml' WHEN 2 THEN 'kg' WHEN 3 THEN 'g'
 WHEN 4 THEN 'pc' WHEN 5 THEN 'l' ELSE 'box' END AS unit FROM offers""", "offers"))
def c02(spark, folder):
    raw = F.element_at(F.array(*[F.lit(u) for u in
                                 ["Ltr", "ml", "KGs", "gm", "packnum", "litre", "BOX"]]),
                       (F.col("seq") % 7 + 1).cast("int"))
    return tables.offers(spark, folder).select("seq", "title", q.canonical_unit(raw).alias("unit"))


@query("c03_pack_count", sql(
    f"SELECT seq, title, {pack_sql('lt')} AS pack_count "
    "FROM (SELECT *, lower(title) AS lt FROM offers_skip)", "offers_skip"))
def c03(spark, folder):
    return tables.offers(spark, folder, pack_skip=True).select(
        "seq", "title", q.pack_count("title").alias("pack_count"))


@query("c04_normalized_quantity", sql(
    "SELECT seq, title, size_unit, normalized_quantity FROM feat", "feat"))
def c04(spark, folder):
    return features.with_quantity(tables.offers(spark, folder)).select(
        "seq", "title", "size_unit", "normalized_quantity")


@query("c05_notes", sql("SELECT seq, title, notes FROM feat", "feat"))
def c05(spark, folder):
    return features.with_quantity(tables.offers(spark, folder)).select("seq", "title", "notes")


@query("c06_brand", sql(
    f"SELECT seq, title, {brand_sql(q.BRANDS)} AS brand, {brand_sql(q.CATALOGUE_BRANDS)} "
    "AS catalogue_brand FROM (SELECT seq, lower(t) AS lt, t AS title FROM (SELECT seq, CASE seq % 4 "
    "WHEN 0 THEN title || ' 7up' WHEN 1 THEN 'super ' || title WHEN 2 THEN title ELSE '(' || title "
    "END AS t FROM offers))", "offers"))
def c06(spark, folder):
    number = F.col("seq") % 4
    title = (F.when(number == 0, F.concat("title", F.lit(" 7up")))
             .when(number == 1, F.concat(F.lit("super "), "title"))
             .when(number == 2, F.col("title")).otherwise(F.concat(F.lit("("), "title")))
    return tables.offers(spark, folder).withColumn("title", title).select(
        "seq", "title", q.brand("title", q.BRANDS).alias("brand"),
        q.brand("title", q.CATALOGUE_BRANDS).alias("catalogue_brand"))


@query("c07_brand_category", sql("SELECT seq, title, brand_category FROM feat", "feat"))
def c07(spark, folder):
    return features.with_brand_category(features.with_brand(tables.offers(spark, folder))).select(
        "seq", "title", "brand_category")


_V2, _U2 = size_sql("lower(quantity)")
_V1, _U1 = size_sql("lt")


@query("c08_size_from_quantity", sql(
    f"SELECT seq, title, CASE WHEN {_U2} IS NULL THEN {_V1} ELSE {_V2} END AS size_value, "
    f"CASE WHEN {_U2} IS NULL THEN {_U1} ELSE {_U2} END AS size_unit FROM (SELECT seq, title, "
    "lower(title) AS lt, CASE seq % 4 WHEN 0 THEN seq || ' ml' WHEN 1 THEN '2.5Kg' WHEN 2 THEN '' "
    "ELSE '6 pack' END AS quantity FROM offers)", "offers"))
def c08(spark, folder):
    number = F.col("seq") % 4
    amount = (F.when(number == 0, F.concat(F.col("seq").cast("string"), F.lit(" ml")))
              .when(number == 1, "2.5Kg").when(number == 2, "").otherwise("6 pack"))
    rows = tables.offers(spark, folder).withColumn("quantity", amount)
    return features.with_quantity(rows, quantity="quantity").select(
        "seq", "title", "size_value", "size_unit")


@query("c09_total_volume", sql("SELECT seq, title, total_volume FROM feat", "feat"))
def c09(spark, folder):
    return feature_rows(spark, folder).select("seq", "title", "total_volume")


@query("c10_drop_no_size", sql("SELECT seq, title FROM feat WHERE size_value IS NOT NULL", "feat"))
def c10(spark, folder):
    return features.drop_no_size(features.with_quantity(tables.offers(spark, folder))).select(
        "seq", "title")


@query("c11_keep_majority_unit_family", sql(
    "SELECT seq, title, size_unit, brand, brand_category, category FROM qty", "qty"))
def c11(spark, folder):
    return quantity_rows(spark, folder).select(
        "seq", "title", "size_unit", "brand", "brand_category", "category")


@query("c12_unit_price", sql(
    "SELECT seq, title, unit_price, unit_price_unit FROM feat", "feat"))
def c12(spark, folder):
    return feature_rows(spark, folder).select("seq", "title", "unit_price", "unit_price_unit")


@query("c13_per_unit_price", sql("SELECT seq, title, pack_count, per_unit_price FROM feat", "feat"))
def c13(spark, folder):
    return feature_rows(spark, folder).select("seq", "title", "pack_count", "per_unit_price")


@query("c14_feature_coverage", sql("""
SELECT count(*) AS n_rows, count(size_value) AS with_size,
 count(*) FILTER (pack_count > 0) AS with_pack, count(*) FILTER (brand <> 'Unknown') AS with_brand,
 count(unit_price) AS with_unit_price, count(per_unit_price) AS with_per_unit_price FROM feat""",
                                  "feat"))
def c14(spark, folder):
    return features.feature_coverage(feature_rows(spark, folder))


def deal_quantity_sql(text: str) -> str:
    tries = [f"TRY_CAST(NULLIF(regexp_extract({text}, '{p}', 1), '') AS DOUBLE) * {k}"
             for p, k in q.DEAL_QUANTITY_RULES]
    return "COALESCE(" + ", ".join(tries) + ", 1.0)"


@query("c15_deal_quantity", sql(
    f"SELECT seq, title, CAST({deal_quantity_sql('lower(title)')} AS DOUBLE) AS quantity FROM offers",
    "offers"))
def c15(spark, folder):
    return tables.offers(spark, folder).select("seq", "title", q.deal_quantity("title").alias("quantity"))


def keyword_sql(text: str) -> str:
    plus = [f"CAST(contains({text}, '{w}') AS INT)" for w in q.PREMIUM_WORDS]
    minus = [f"CAST(contains({text}, '{w}') AS INT)" for w in q.BUDGET_WORDS]
    return " + ".join(plus) + " - " + " - ".join(minus)


@query("c16_value_keyword_score", sql(
    f"SELECT seq, title, {keyword_sql('lower(title)')} AS score FROM (SELECT seq, title || CASE seq % 5 "
    "WHEN 0 THEN ' Value Saver' WHEN 1 THEN ' purebasic' ELSE '' END AS title FROM offers)", "offers"))
def c16(spark, folder):
    number = F.col("seq") % 5
    tail = F.when(number == 0, " Value Saver").when(number == 1, " purebasic").otherwise("")
    return tables.offers(spark, folder).withColumn("title", F.concat("title", tail)).select(
        "seq", "title", q.value_keyword_score("title").alias("score"))
