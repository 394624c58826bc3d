"""Queries over readers, writers and page extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import deal_model, features, pages
from shelfspark.operators.listings import split_accepted
from shelfspark.session import work_path
from shelfspark.sources import listings as io
from shelfspark.sources import tables
from shelfspark.suite.base import define, feature_rows, query, rounded, sql

RAW = ["site", "title", "price", "product_url"]


@query("s01_read_listings", sql("SELECT site, title, price, product_url FROM offers", "offers"))
def s01(spark, folder):
    path = work_path(spark, "csv")
    io.write_table(tables.offers(spark, folder), path, RAW, fmt="csv")
    return io.read_listings(spark, path)


@query("s02_read_many", sql("""
SELECT site, title, price, NULL::VARCHAR AS product_id, 'offers_features' AS source_file FROM offers
UNION ALL SELECT site, title, price, product_id, 'catalog_features' FROM catalog""",
                            "offers", "catalog"))
def s02(spark, folder):
    base = work_path(spark, "many")
    offers, catalog = tables.offers(spark, folder), tables.catalog(spark, folder)
    io.write_table(offers, f"{base}/offers_features", ["site", "title", "price"], fmt="csv")
    io.write_table(catalog.withColumnRenamed("title", "name"), f"{base}/catalog_features",
                   ["site", "name", "price", "product_id"], fmt="csv")
    io.write_table(catalog, f"{base}/unified_features", ["site", "title", "price"], fmt="csv")
    io.write_table(catalog, f"{base}/untitled_features", ["site", "price"], fmt="csv")
    names = ["offers_features", "catalog_features", "unified_features", "untitled_features",
             "absent_features"]
    rows = io.read_many(spark, [f"{base}/{n}" for n in names], exclude="unified")
    return rows.select("site", "title", "price", "product_id", "source_file")


@query("s03_require_columns", sql(
    "SELECT site, count(*) AS n FROM offers GROUP BY site", "offers"))
def s03(spark, folder):
    rows = io.require_columns(tables.offers(spark, folder))
    return rows.groupBy("site").agg(F.count("*").alias("n"))


@query("s04_coerce_numeric", sql(
    "SELECT seq, title, TRY_CAST(price AS DOUBLE) AS price FROM offers", "offers"))
def s04(spark, folder):
    return features.coerce_numeric(tables.offers(spark, folder), ["price"]).select(
        "seq", "title", "price")


@query("s05_harmonise", sql("""
SELECT seq, title, product_id AS subcategory, length(title) * 1.0::DOUBLE AS normalized_quantity
FROM offers""", "offers"))
def s05(spark, folder):
    rows = tables.offers(spark, folder).select(
        "seq", F.col("title").alias("name"), F.col("product_id").alias("section"),
        (F.length("title") * F.lit(1.0)).alias("normalized_volume_ml"))
    return io.harmonise(rows).select("seq", "title", "subcategory", "normalized_quantity")


@query("s06_write_table", sql("""
SELECT site, category, NULL::VARCHAR AS subcategory, product_id, title, price,
 NULL::VARCHAR AS quantity, NULL::VARCHAR AS image_url, product_url FROM offers""", "offers"))
def s06(spark, folder):
    path = work_path(spark, "crawl")
    io.write_table(tables.offers(spark, folder), path, io.LISTING_CRAWL)
    return spark.read.parquet(path)


@query("s07_split_accepted_rejected", sql("""
SELECT seq, title, TRY_CAST(price AS DOUBLE) > 50000 IS TRUE AS accepted FROM offers""", "offers"))
def s07(spark, folder):
    path = work_path(spark, "split")
    rows = tables.offers(spark, folder).select("seq", "title", "price")
    accepted, rejected = split_accepted(rows, t.number("price") > 50000)
    io.write_accepted_rejected(accepted, rejected, path)
    back = [spark.read.parquet(f"{path}/{n}").withColumn("accepted", F.lit(n == "accepted"))
            for n in ("accepted", "rejected")]
    return back[0].unionByName(back[1]).select("seq", "title", "accepted")


_BY_KEY = """
SELECT 'brand' AS dimension, brand AS key, round(avg(price) + 1e-8, 6) AS mean_price,
 round(stddev_samp(price) + 1e-8, 6) AS std_price, count(price) AS n_rows
FROM feat WHERE price IS NOT NULL GROUP BY brand
UNION ALL SELECT 'category', category, round(avg(price) + 1e-8, 6), round(stddev_samp(price) + 1e-8, 6), count(price)
FROM feat WHERE price IS NOT NULL GROUP BY category
UNION ALL SELECT 'site', site, round(avg(price) + 1e-8, 6), round(stddev_samp(price) + 1e-8, 6), count(price)
FROM feat WHERE price IS NOT NULL GROUP BY site"""


@query("s08_save_load_model", sql(_BY_KEY, "feat"))
def s08(spark, folder):
    model, _ = deal_model.train(features.with_deal_quantity(feature_rows(spark, folder)))
    path = work_path(spark, "model")
    model.save(path)
    return rounded(deal_model.DealModel.load(spark, path).by_key)


# ------------------------------------------------------------------- pages

@query("x01_page_fields", r"""
SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
 regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
 CAST(len(regexp_extract_all(html, '(?s)<a\b([^>]*)>(.*?)</a>')) AS INTEGER) AS n_links FROM pages""")
def x01(spark, folder):
    return pages.page_fields(tables.pages(spark, folder))


_CARDS = """
SELECT seq - seq % 18 + seq % 6 AS page_id,
 CAST(row_number() OVER (PARTITION BY seq - seq % 18 + seq % 6 ORDER BY seq) - 1 AS INTEGER) AS card_no, store AS site, product_id, title, CAST(price AS DOUBLE) AS price,
 quantity, image_url, product_url
FROM (SELECT seq, title, price, CASE seq % 6 WHEN 0 THEN 'Naheed' WHEN 1 THEN 'Alfatah'
   WHEN 2 THEN 'Metro' WHEN 3 THEN 'Imtiaz' WHEN 4 THEN 'Rainbow' ELSE 'Carrefour' END AS store,
  CASE seq % 6 WHEN 1 THEN CAST(100000 + seq AS VARCHAR) ELSE CAST(seq AS VARCHAR) END AS product_id,
  CASE seq % 6 WHEN 4 THEN seq || ' g' END AS quantity,
  CASE seq % 6 WHEN 0 THEN 'https://www.naheed.pk' WHEN 1 THEN 'https://alfatah.pk'
   WHEN 2 THEN 'https://www.metro-online.pk' WHEN 3 THEN 'https://shop.imtiaz.com.pk'
   WHEN 4 THEN 'https://rainbowcc.com.pk' ELSE 'https://www.carrefour.pk' END
   || '/img/' || seq || '.jpg' AS image_url,
  CASE seq % 6 WHEN 0 THEN 'https://www.naheed.pk/x/' || seq
   WHEN 1 THEN 'https://alfatah.pk/products/p-' || (100000 + seq)
   WHEN 2 THEN 'https://www.metro-online.pk/detail/x/' || seq
   WHEN 3 THEN 'https://shop.imtiaz.com.pk/product/' || seq
   WHEN 4 THEN 'https://rainbowcc.com.pk/product/' || seq
   ELSE 'https://www.carrefour.pk/mafpak/en/x/p/' || seq END AS product_url FROM catalog)"""


def store_pages(spark, folder):
    """Stored pages in the markup of one of six stores, each with up to three catalogue products.

    The first word of a shown title has an element of its own; the later cards of a page stand inside the
    first one, which a store does for products that go with another.
    """
    rows = tables.catalog(spark, folder)
    seq, price = F.col("seq").cast("string"), F.col("price")
    money = F.format_number(price.cast("double"), 2)
    whole, cents = F.substring_index(money, ".", 1), F.substring_index(money, ".", -1)
    image = F.concat(F.lit('<img src="/img/'), seq, F.lit('.jpg" alt="x">'))
    key = (F.col("seq") + 100000).cast("string")
    number = F.col("seq") % 6
    words = F.split("title", " ", 2)
    marked = F.concat(F.lit("<b>"), words[0], F.lit("</b>"), F.when(F.size(words) > 1, F.concat(
        F.lit(" "), words[1])).otherwise(""))
    shapes = {
        0: ("Naheed", ['<li class="item product product-item"><a class="product-item-photo" href="/x/',
                       seq, '">', image, '</a><h2 class="product name product-item-name">'
                       '<a class="product-item-link" href="/x/', seq, '">  ', marked,
                       ' </a></h2><span class="price">Rs. ', money, "</span></li>"]),
        1: ("Alfatah", ['<div class="product-card card-border">', image,
                        '<a class="product-title-ellipsis" href="/products/p-', key, '">', marked,
                        '</a><p class="product-price">Rs.', money, "</p></div>"]),
        2: ("Metro", ['<div class="CategoryGrid_product_nameAndPricing_div__FwOEW">'
                      '<p class="CategoryGrid_product_name__3nYsN" title="', "title",
                      '">..</p><p class="CategoryGrid_product_price__Svf8T">Rs. ', money,
                      '</p><a href="/detail/x/', seq, '">', image, "</a></div>"]),
        3: ("Imtiaz", ['<div id="product-item-', seq, '"><a href="/product/', seq, '">', image,
                       '</a><h4 title="', "title", '">..</h4><div class="hazle-product-item_product'
                       '_item_price_label__ET_we"><span>Rs. ', money, "</span></div></div>"]),
        4: ("Rainbow", ['<div id="product-item-', seq, '"><a href="/product/', seq, '">', image,
                        "</a><h4>", marked, '</h4><div class="hazle-product-item_product_item_'
                        'price_label__ET_we"><span>PKR ', money, '</span></div><p class="hazle-'
                        'product-item_product_item_description__ejRDa" title="', seq,
                        ' g">..</p></div>']),
        5: ("Carrefour", ['<div class="relative w-[134px] max-w-[134px] sm:w-[215px] flex">'
                          '<a href="/mafpak/en/x/p/', seq, '">', image, '</a><div class="text-sm '
                          'leading-4 font-medium"><span>', marked, '</span></div><div class="text-lg '
                          'leading-5 font-bold">', whole, '</div><div class="text-2xs">.', cents,
                          "</div></div>"]),
    }

    def build(parts):
        cells = [p if not isinstance(p, str) else F.col(p) if p == "title" else F.lit(p)
                 for p in parts]
        return F.concat(*cells)

    site = reduce(lambda c, n: F.when(number == n, shapes[n][0]).otherwise(c), shapes,
                  F.lit(None).cast("string"))
    html = reduce(lambda c, n: F.when(number == n, build(shapes[n][1])).otherwise(c), shapes,
                  F.lit(None).cast("string"))
    cards = rows.select((F.col("seq") - F.col("seq") % 18 + number).alias("page_id"), site.alias("site"),
                        F.struct("seq", html.alias("html")).alias("card"))
    held = cards.groupBy("page_id", "site").agg(F.array_sort(F.collect_list("card")).alias("c")).select(
        "page_id", "site", F.col("c.html").alias("c"))
    closing = F.regexp_extract(F.col("c")[0], r"(</\w+>)$", 1)
    outer = F.substring(F.col("c")[0], F.lit(1), F.length(F.col("c")[0]) - F.length(closing))
    return held.select("page_id", "site", F.concat(
        F.lit("<html><body><div class='grid'>"), outer,
        F.array_join(F.slice("c", F.lit(2), F.size("c")), ""), closing,
        F.lit("</div><footer>end</footer></body></html>")).alias("html"))


@query("x01_extract_cards", sql(_CARDS, "catalog"))
def x01_cards(spark, folder):
    return pages.extract_cards(store_pages(spark, folder))


@query("x02_parse_price", sql(r"""
SELECT seq, title, TRY_CAST(regexp_extract(replace(shown, ',', ''), '(\d+(?:\.\d+)?)', 1) AS DOUBLE)
  AS plain, TRY_CAST(replace(regexp_extract(shown,
  '(?i)(?:(?:Rs\.?|PKR)\s*)?(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)', 1), ',', '') AS DOUBLE)
  AS grouped, TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) AS digits,
 TRY_CAST(price AS DOUBLE) AS parts
FROM (SELECT *, 'Rs. ' || CASE WHEN price = 'N/A' THEN price
  ELSE format('{:,.2f}', CAST(price AS DOUBLE)) END || ' only' AS shown FROM offers)""", "offers"))
def x02(spark, folder):
    rows = tables.offers(spark, folder)
    value = t.number("price")
    shown = F.concat(F.lit("Rs. "), F.coalesce(F.format_number(value, 2), "price"), F.lit(" only"))
    return rows.withColumn("shown", shown).select(
        "seq", "title", t.parse_price("shown").alias("plain"),
        t.parse_price("shown", "grouped").alias("grouped"),
        t.parse_price("price", "digits").alias("digits"),
        F.when(value.isNotNull(), t.parse_price_parts(
            F.substring_index("price", ".", 1), F.substring_index("price", ".", -1))).alias("parts"))


@query("x03_price_from_markup", sql(
    "SELECT seq, title, TRY_CAST(price AS DOUBLE) AS price FROM offers", "offers"))
def x03(spark, folder):
    rows = tables.offers(spark, folder)
    html = (
        F.when(F.col("seq") % 3 == 0, F.concat(
            F.lit('<div><span data-price-amount="'), "price", F.lit('"></span>7</div>')))
        .when(F.col("seq") % 3 == 1, F.concat(
            F.lit('<div><input type="hidden" name="price" value="'), "price", F.lit('"></div>')))
        .otherwise(F.concat(F.lit("<div><b>Pack 7</b> <i>PKR "), "price", F.lit("</i></div>"))))
    return rows.withColumn("html", html).select(
        "seq", "title", t.price_from_markup("html").alias("price"))


@query("x04_product_id", sql("""
SELECT seq, title, 'p-' || product_id AS slug, product_id AS p_number, product_id AS trailing_number,
 CASE WHEN seq % 2 = 0 THEN product_id ELSE 'x-' || product_id END AS product_number,
 product_id AS digit_segment, CAST(100000 + CAST(product_id AS BIGINT) AS VARCHAR) AS long_number,
 product_id AS dom_suffix FROM offers""", "offers"))
def x04(spark, folder):
    rows = tables.offers(spark, folder)
    key, long_key = F.col("product_id"), (F.col("product_id").cast("long") + 100000).cast("string")
    host = F.lit("https://store.example")

    def link(*parts):
        return F.concat(host, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    return rows.select(
        "seq", "title",
        t.product_id(link("/products/p-", key, "?variant=1"), "slug").alias("slug"),
        t.product_id("product_url", "p_number").alias("p_number"),
        t.product_id(link("/detail/x/", key, "/"), "trailing_number").alias("trailing_number"),
        t.product_id(F.when(F.col("seq") % 2 == 0, link("/product/", key, "/info")).otherwise(
            link("/x-", key)), "product_number").alias("product_number"),
        t.product_id(link("/a/", key, "/view?p=9"), "digit_segment").alias("digit_segment"),
        t.product_id(link("/products/p-", long_key, "/12"), "long_number").alias("long_number"),
        t.product_id(F.concat(F.lit("product-item-"), key), "dom_suffix").alias("dom_suffix"))


_ANCHOR = r"(?s)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"
define("links", rf"""
SELECT page_id, url, unnest(range(len(h))) AS link_no, unnest(h) AS href, unnest(b) AS body
FROM (SELECT page_id, url, regexp_extract_all(html, '{_ANCHOR}', 1) AS h,
  regexp_extract_all(html, '{_ANCHOR}', 2) AS b FROM pages)""", [])
define("full_links", r"""
SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)
 || replace(href, '&amp;', '&') AS link FROM links WHERE href <> ''""", ["links"])


@query("x05_absolute_url", sql("SELECT page_id, link_no, link FROM full_links", "full_links"))
def x05(spark, folder):
    links = pages.anchors(tables.pages(spark, folder)).where("href is not null")
    return links.select("page_id", F.col("link_no").cast("long").alias("link_no"),
                        t.absolute_url(F.col("url"), F.col("href")).alias("link"))


@query("x06_squash_title", sql(r"""
SELECT seq, trim(regexp_replace(replace('  ' || title || chr(160) || '  x', chr(160), ' '),
 '\s+', ' ', 'g')) AS title FROM offers""", "offers"))
def x06(spark, folder):
    messy = F.concat(F.lit("  "), "title", F.lit("\u00a0  x"))
    return tables.offers(spark, folder).select("seq", t.squash_title(messy).alias("title"))


@query("x07_category_links", sql(r"""
SELECT page_id, link, min(link_no) AS link_no,
 arg_min(trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), link_no)
  AS name FROM full_links GROUP BY page_id, link""", "full_links"))
def x07(spark, folder):
    return pages.category_links(tables.pages(spark, folder)).select(
        "page_id", "link", F.col("link_no").cast("long").alias("link_no"), "name")


@query("x08_next_page_link", r"""
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/list?page=' || page_id
 || CASE page_id % 3 WHEN 0 THEN '&m=1' ELSE '' END AS next_link FROM pages WHERE page_id % 3 < 2""")
def x08(spark, folder):
    key = F.col("page_id").cast("string")
    plain = F.concat(F.lit('<a href="/list?page='), key, F.lit('">Next Page</a>'))
    marked = F.concat(F.lit('<a rel="next" href="/list?page='), key, F.lit('&amp;m=1">next ›</a>'))
    more = (F.when(F.col("page_id") % 3 == 0, F.concat(plain, marked))
            .when(F.col("page_id") % 3 == 1, plain).otherwise(F.lit('<a class="next" href="/a">x</a>')))
    rows = tables.pages(spark, folder).withColumn("html", F.concat("html", more))
    return pages.next_page_link(rows)


@query("x08_page_url", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN
  regexp_replace(url, '([?&]page=)[^&#]*', '\1' || (page_id + 1), 'g')
 ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || (page_id + 1) END
 AS next_url FROM pages""")
def x08_url(spark, folder):
    return tables.pages(spark, folder).select(
        "page_id", t.page_url("url", F.col("page_id") + 1, "page").alias("next_url"))


@query("x09_is_no_results", """
SELECT page_id, page_id % 4 < 2 OR contains(lower(html), 'no results found')
 OR contains(html, 'ProductNotFound') AS no_results FROM pages""")
def x09(spark, folder):
    note = (F.when(F.col("page_id") % 4 == 0, "<p>No Results Found for tea</p>")
            .when(F.col("page_id") % 4 == 1, "<div class='ProductNotFound'></div>").otherwise(""))
    return tables.pages(spark, folder).select(
        "page_id", t.is_no_results(F.concat("html", note)).alias("no_results"))


@query("x10_category_label", r"""
SELECT page_id, label FROM (SELECT page_id, list_filter(string_split(regexp_replace(
  regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '') AS s, url,
 CASE WHEN len(s) = 0 THEN url ELSE list_aggregate(list_transform(regexp_extract_all(lower(
  replace(s[-1], '-', ' ')), '[a-z]+|[^a-z]'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '')
  END AS label FROM pages)""")
def x10(spark, folder):
    return tables.pages(spark, folder).select("page_id", t.category_label("url").alias("label"))
