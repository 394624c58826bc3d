"""Shared inputs of the query suite and the SQL text that checks them.

``cte`` holds named common table expressions for DuckDB; ``sql`` prepends those
a check needs. They restate the rules on their own, so that both sides can be
compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import quantity as q
from shelfspark.functions.similarity import FILLER_WORDS
from shelfspark.operators import deals, features, listings
from shelfspark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL text that must give the same rows."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6, nudge: float = 1e-8) -> DataFrame:
    """Round double columns; summation order may differ between runs.

    Means of prices in cents often end in an exact half, which engines round
    either way; a nudge far below the kept digits settles those.
    """
    return df.select(*[
        F.round(F.col(f.name) + F.lit(nudge), digits).alias(f.name)
        if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


NUDGE = 1e-7


# ------------------------------------------------------------- Spark inputs

def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Offers with catalogue features and a numeric price."""
    return features.coerce_numeric(features.feature_table(tables.offers(spark, folder)), ["price"])


# Every pass writes what it is handed, so the queries hand on the columns that they read.
DEAL_COLUMNS = ["seq", "site", "title", "price", "size_value", "size_unit", "pack_count", "normalized_quantity"]


def quantity_rows(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Offers with search features and a numeric price."""
    return features.coerce_numeric(features.quantity_table(tables.offers(spark, folder), columns), ["price"])


def deal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return deals.analyze_deals(quantity_rows(spark, folder, DEAL_COLUMNS))


def grouped_rows(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Priced offers whose product group is the product itself; all columns, or the named besides these."""
    rows = features.feature_table(tables.offers(spark, folder))
    rows = listings.valid_price(rows).withColumn(
        "product_group_id", F.col("product_id").cast("long"))
    return rows.select("seq", "site", "title", "price_numeric", "product_group_id", *columns) \
        if columns is not None else rows


def catalog_rows(spark: SparkSession, folder: str) -> DataFrame:
    return features.coerce_numeric(features.feature_table(tables.catalog(spark, folder)), ["price"])


# --------------------------------------------------------------- SQL inputs

_TITLE = """
 CASE p.p_partkey % 5 WHEN 0 THEN 'NESTLE' WHEN 1 THEN 'coca-cola' WHEN 2 THEN 'Peek Freans'
  ELSE p.p_brand END
 || CASE p.p_size % 3 WHEN 0 THEN ' Premium ' WHEN 1 THEN ' Fresh ' ELSE ' ' END || p.p_name
 || CASE p.p_partkey % 6 WHEN 0 THEN ' ' || p.p_size || '0ml' WHEN 1 THEN ' ' || p.p_size || '.5 Ltr'
  WHEN 2 THEN ' ' || p.p_size || '0 g' WHEN 3 THEN ', ' || p.p_size || 'Kg'
  WHEN 4 THEN ' ' || p.p_size || '00 Gm' ELSE '' END"""


def _offers(extra: str = "") -> str:
    return f"""
SELECT l.l_orderkey*10+l.l_linenumber AS seq, n.n_name AS site, p.p_type AS category,
 CAST(p.p_partkey AS VARCHAR) AS product_id, {_TITLE}
 || CASE l.l_linenumber % 4 WHEN 1 THEN ' (Pack of ' || CAST(l.l_quantity AS INT) || ')'
  WHEN 2 THEN ' ' || CAST(l.l_quantity AS INT) || ' pcs'{extra} ELSE '' END AS title,
 CASE WHEN l.l_orderkey % 97 = 0 THEN 'N/A' ELSE CAST(l.l_extendedprice AS VARCHAR) END AS price,
 'https://' || lower(n.n_name) || '.example/p/' || p.p_partkey AS product_url
FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey
JOIN supplier s ON l.l_suppkey=s.s_suppkey JOIN nation n ON s.s_nationkey=n.n_nationkey"""


_CATALOG = f"""
SELECT p.p_partkey AS seq, n.n_name AS site, p.p_type AS category,
 CAST(p.p_partkey AS VARCHAR) AS product_id, {_TITLE} AS title,
 CAST(p.p_retailprice AS VARCHAR) AS price,
 'https://' || lower(n.n_name) || '.example/p/' || p.p_partkey AS product_url
FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey % (SELECT count(*) FROM supplier)
JOIN nation n ON s.s_nationkey=n.n_nationkey"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def size_sql(text: str) -> tuple[str, str]:
    """(value, unit) expressions over a lower-case text."""
    hits = [(u, f"regexp_extract({text}, {_quote(p)}, 1)") for u, p in q.SIZE_RULES]
    unit = "CASE " + " ".join(f"WHEN {h} <> '' THEN '{u}'" for u, h in hits) + " END"
    value = "CASE " + " ".join(f"WHEN {h} <> '' THEN {h}" for _, h in hits) + " END"
    return f"CAST(replace({value}, ',', '.') AS DOUBLE)", unit


def pack_sql(text: str) -> str:
    tries = []
    for pattern, last in q.PACK_RULES:
        hit = f"regexp_extract({text}, {_quote(pattern)}, 1)"
        ok = f"{hit} <> '' AND TRY_CAST({hit} AS INTEGER) > 0"
        if last:
            rest = f"regexp_extract({text}, {_quote('(?s)' + pattern + '(.*)$')}, 2)"
            ok += (f" AND NOT regexp_matches(substr({hit} || {rest}, 1, {q.UNIT_WINDOW}), "
                   f"{_quote(q.UNIT_AFTER_NUMBER)})")
        tries.append(f"CASE WHEN {ok} THEN CAST({hit} AS INTEGER) END")
    return "COALESCE(" + ",\n  ".join(tries) + ", 0)"


def title_case_sql(text: str) -> str:
    return (f"list_aggregate(list_transform(regexp_extract_all(lower({text}), '[a-z]+|[^a-z]'), "
            "lambda x: upper(x[1]) || x[2:]), 'string_agg', '')")


def brand_sql(known: list[str]) -> str:
    cases = " ".join(f"WHEN regexp_matches(lt, {_quote(chr(92) + 'b' + b + chr(92) + 'b')}) "
                     f"THEN {_quote(b.title())}" for b in known)
    word = r"regexp_replace(regexp_extract(title, '(\S+)', 1), '[^a-zA-Z0-9&\-]', '', 'g')"
    return f"CASE {cases} WHEN {word} <> '' THEN {title_case_sql(word)} ELSE 'Unknown' END"


_VALUE, _UNIT = size_sql("lt")
_PARSED = f"""
SELECT *, CASE WHEN size_unit IN ('l','kg') THEN size_value*1000 WHEN size_unit IN ('ml','g')
  THEN size_value END AS normalized_quantity,
 CASE WHEN size_value IS NULL AND pack_count = 0 THEN 'no-size-no-pack'
  WHEN size_value IS NULL THEN 'no-size' WHEN pack_count = 0 THEN 'no-pack' ELSE '' END AS notes
FROM (SELECT *, {_VALUE} AS size_value, {_UNIT} AS size_unit, {pack_sql('lt')} AS pack_count
 FROM (SELECT *, lower(title) AS lt, TRY_CAST(price AS DOUBLE) AS num FROM {{src}}))"""

_PRICES = """
 CASE WHEN normalized_quantity > 0 THEN num / normalized_quantity END AS unit_price,
 CASE WHEN normalized_quantity > 0 AND num IS NOT NULL THEN
  CASE WHEN size_unit IN ('ml','l') THEN 'PKR/ml' WHEN size_unit IN ('g','kg') THEN 'PKR/g'
  ELSE '' END ELSE '' END AS unit_price_unit,
 CASE WHEN pack_count > 0 THEN num / pack_count ELSE num END AS per_unit_price"""


def _features(src: str) -> str:
    return f"""
SELECT * EXCLUDE (lt, num, price), num AS price,
 brand || '_' || COALESCE(category, '') AS brand_category,
 size_value * CASE WHEN pack_count > 0 THEN pack_count ELSE 1 END AS total_volume, {_PRICES}
FROM (SELECT *, {brand_sql(q.CATALOGUE_BRANDS)} AS brand FROM ({_PARSED.replace("{src}", src)}))"""


def _quantity(src: str) -> str:
    return f"""
SELECT * EXCLUDE (lt, num, price, category, n_liquid, n_solid), num AS price,
 'Grocery' AS category, brand || '_Grocery' AS brand_category, {_PRICES}
FROM (SELECT *, {brand_sql(q.BRANDS)} AS brand,
  count(*) FILTER (size_unit IN ('ml','l')) OVER () AS n_liquid,
  count(*) FILTER (size_unit IN ('g','kg')) OVER () AS n_solid
 FROM ({_PARSED.replace("{src}", src)}) WHERE size_value IS NOT NULL)
WHERE n_liquid = 0 OR n_solid = 0 OR (CASE WHEN n_liquid > n_solid
  THEN size_unit IN ('ml','l') ELSE size_unit IN ('g','kg') END)"""


_DEAL = """
SELECT *, CASE WHEN deal_score >= 75 THEN 'Excellent' WHEN deal_score >= 60 THEN 'Good'
  WHEN deal_score >= 40 THEN 'Fair' ELSE 'Poor' END AS deal_tier
FROM (SELECT *, greatest(0, least(100, value_score * 0.40 + (100 - price_percentile) * 0.25
   + pack_efficiency * 100 * 0.15 + (100 - store_rank_normalized * 100) * 0.20)) AS deal_score
 FROM (SELECT c.*,
   (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0)
     / count(*) OVER () * 100 AS price_percentile,
   (rank() OVER (ORDER BY unit_price) + (count(*) OVER (PARTITION BY unit_price) - 1) / 2.0)
     / count(*) OVER () * 100 AS unit_price_percentile,
   (1/(unit_price+0.0001) - min(1/(unit_price+0.0001)) OVER ())
     / (max(1/(unit_price+0.0001)) OVER () - min(1/(unit_price+0.0001)) OVER ()) * 100 AS value_score,
   CASE WHEN pack_count > 0 THEN least(pack_count / 10.0::DOUBLE, 1) ELSE 0 END AS pack_efficiency,
   store_rank, (store_rank - 1) / ((SELECT count(*) FROM store_order) - 1 + 0.001)
     AS store_rank_normalized
  FROM complete c JOIN store_order USING (site)))"""

_NAME = f"""trim(regexp_replace(regexp_replace(lower(title),
  '\\b({"|".join(FILLER_WORDS)})\\b', '', 'g'), '\\s+', ' ', 'g'))
 || CASE WHEN size_unit IN ('kg','g') THEN ' ' || CAST(trunc(CASE WHEN size_unit='kg'
    THEN size_value*1000 ELSE size_value END) AS BIGINT) || 'g'
  WHEN size_unit IN ('l','ml') THEN ' ' || CAST(trunc(CASE WHEN size_unit='l'
    THEN size_value*1000 ELSE size_value END) AS BIGINT) || 'ml'
  WHEN size_unit IS NOT NULL THEN ' ' || CAST(size_value AS VARCHAR) || size_unit ELSE '' END"""

CTE = {
    "offers": _offers(),
    "offers_skip": _offers(" WHEN 3 THEN ' pack ' || CAST(l.l_quantity AS INT) || ' ml'"),
    "catalog": _CATALOG,
    "feat": _features("offers"),
    "cat_feat": _features("catalog"),
    "qty": _quantity("offers"),
    "complete": """
SELECT * FROM (SELECT *, count(*) OVER () AS n_complete FROM qty WHERE price IS NOT NULL
 AND unit_price IS NOT NULL AND normalized_quantity IS NOT NULL) WHERE n_complete >= 5""",
    "store_order": """
SELECT site, row_number() OVER (ORDER BY m, site) AS store_rank
FROM (SELECT site, avg(unit_price) AS m FROM complete GROUP BY site)""",
    "deal": _DEAL,
    "grouped": """
SELECT *, price AS price_numeric, CAST(product_id AS BIGINT) AS product_group_id
FROM feat WHERE price > 0""",
    "grouped_stats": """
SELECT g.*, min_price, max_price, avg_price, median_price, std_price, num_stores, distinct_sites,
 price_range, price_range_pct, price_numeric - avg_price AS price_vs_avg,
 (price_numeric - avg_price) / avg_price * 100 AS price_vs_avg_pct,
 CAST(price_numeric = min_price AS INT) AS is_cheapest,
 CAST(price_numeric = max_price AS INT) AS is_most_expensive,
 (rank() OVER (PARTITION BY product_group_id ORDER BY price_numeric)
  + (count(*) OVER (PARTITION BY product_group_id, price_numeric) - 1) / 2.0)
  / count(*) OVER (PARTITION BY product_group_id) * 100 AS price_percentile,
 rank() OVER (PARTITION BY product_group_id ORDER BY price_numeric) AS store_rank
FROM grouped g JOIN group_facts USING (product_group_id)""",
    "group_facts": """
SELECT *, max_price - min_price AS price_range,
 COALESCE((max_price - min_price) / avg_price * 100, 0) AS price_range_pct
FROM (SELECT product_group_id, min(price_numeric) AS min_price, max(price_numeric) AS max_price,
  avg(price_numeric) AS avg_price, median(price_numeric) AS median_price,
  COALESCE(stddev_samp(price_numeric), 0) AS std_price, count(*) AS num_stores,
  count(DISTINCT site) AS distinct_sites FROM grouped GROUP BY 1)""",
    "stores": """
SELECT *, times_cheapest / products_compared * 100 AS cheapest_rate
FROM (SELECT site, CAST(sum(is_cheapest) AS BIGINT) AS times_cheapest,
  avg(price_vs_avg_pct) AS avg_price_vs_market, count(*) AS products_compared
 FROM grouped_stats WHERE num_stores >= 2 GROUP BY site)""",
    "unified": """
SELECT g.*, s.avg_price_vs_market, s.cheapest_rate FROM grouped_stats g LEFT JOIN stores s
USING (site)""",
    "named": f"SELECT *, {_NAME} AS normalized_name FROM feat",
    "cat_named": f"SELECT *, {_NAME} AS normalized_name FROM cat_feat",
}
NEEDS = {
    "feat": ["offers"], "cat_feat": ["catalog"], "qty": ["offers"], "complete": ["qty"],
    "store_order": ["complete"], "deal": ["complete", "store_order"], "grouped": ["feat"],
    "group_facts": ["grouped"], "grouped_stats": ["grouped", "group_facts"],
    "stores": ["grouped_stats"], "unified": ["grouped_stats", "stores"], "named": ["feat"],
    "cat_named": ["cat_feat"],
}


def define(name: str, text: str, needs: list[str]) -> None:
    """Add a named table expression for checks of one section."""
    CTE[name], NEEDS[name] = text, needs


def sql(body: str, *needs: str) -> str:
    """``body`` with the table expressions it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body
