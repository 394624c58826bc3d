"""Row filters, duplicate removal, unions and counts over listings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import (
    blank_to_null, match_all_tokens, match_pattern, match_substring, number,
)

# Query filter and duplicate key of each store in a combined search.
SEARCH_POLICY = {
    "Naheed": ("tokens", "link"),
    "Alfatah": ("substring", "link"),
    "Metro": ("substring", "link"),
    "Imtiaz": (None, "id"),
    "Carrefour": (None, None),
}


def drop_blank_titles(df: DataFrame) -> DataFrame:
    return df.where(F.trim("title") != "")


def valid_price(df: DataFrame, price: str = "price") -> DataFrame:
    """Rows whose price is a positive number, with it as price_numeric."""
    return df.withColumn("price_numeric", number(F.col(price))).where(F.col("price_numeric") > 0)


def filter_by_query(df: DataFrame, query: str, rule: str = "tokens") -> DataFrame:
    match = match_all_tokens if rule == "tokens" else match_substring
    return df.where(match(F.col("title"), query))


def search_titles(df: DataFrame, term: str) -> DataFrame:
    return df.where(match_pattern("title", term))


def filter_listings(df: DataFrame, sites: Sequence[str] | None = None,
                    price: tuple[float, float] | None = None,
                    size: tuple[float, float] | None = None) -> DataFrame:
    """Inclusive bounds; rows with a null price or size fail their bound."""
    if sites is not None:
        df = df.where(F.col("site").isin(list(sites)))
    if price is not None:
        df = df.where(F.col("price").between(*price))
    if size is not None:
        df = df.where(F.col("normalized_quantity").between(*size))
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order.

    A minimum over structs is combined before the shuffle, so a hot key sends
    one row per task instead of all its rows. ``order`` must tell rows apart.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    lead = [c for c in order if c not in keys]
    first = F.min_by(F.struct(*lead, *rest), F.struct(*lead)).alias("r")
    return df.groupBy(*keys).agg(first).select(*keys, "r.*").select(*df.columns)


def _lower_title() -> Column:
    return F.lower("title")


def page_key() -> Column:
    """Link, else lower-case title."""
    return F.coalesce(blank_to_null("product_url"), _lower_title())


def category_key() -> Column:
    """Product id, else link, else lower-case title."""
    return F.coalesce(blank_to_null("product_id"), blank_to_null("product_url"), _lower_title())


def global_key() -> Column:
    """Product id, else link, else the title as it stands."""
    return F.coalesce(blank_to_null("product_id"), blank_to_null("product_url"), F.col("title"))


def _dedupe(df: DataFrame, key: Column, within: Sequence[str], order: Sequence[str],
            keyless: Column | None = None) -> DataFrame:
    """First row per key; rows without a key all stay.

    ``keyless`` is a plain condition every row without a key meets, so that the
    scan for those rows can skip most of the table.
    """
    keyed = df.withColumn("_key", key)
    kept = first_per_key(keyed.where(F.col("_key").isNotNull()), [*within, "_key"], order)
    loose = keyed if keyless is None else df.where(keyless).withColumn("_key", key)
    return kept.unionByName(loose.where(F.col("_key").isNull())).select(*df.columns)


def dedupe_page(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return _dedupe(df, page_key(), [], order, F.col("title").isNull())


def dedupe_category(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return _dedupe(df, category_key(), ["site", "category"], order, F.col("title").isNull())


def dedupe_global(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return _dedupe(df, global_key(), ["site"], order, F.col("title").isNull())


def search_policy(df: DataFrame, query: str, order: Sequence[str],
                  policy: dict = SEARCH_POLICY) -> DataFrame:
    """Combined search: each store's own query filter and duplicate key."""
    by_rule = {
        "tokens": match_all_tokens("title", query),
        "substring": match_substring("title", query),
        None: F.lit(True),
    }
    by_key = {"link": page_key(), "id": blank_to_null("product_id"),
              None: F.lit(None).cast("string")}
    keep, key = F.lit(True), F.lit(None).cast("string")
    for site, (rule, dedupe) in policy.items():
        here = F.col("site") == site
        blank = (F.trim("title") != "") if rule == "substring" else F.lit(True)
        keep = F.when(here, by_rule[rule] & blank).otherwise(keep)
        key = F.when(here, by_key[dedupe]).otherwise(key)
    return _dedupe(df.where(keep), key, ["site"], order)


def split_accepted(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the rest; a null condition counts as rejected."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)


def union_sites(tables: Sequence[DataFrame]) -> DataFrame:
    """All stores in one table; columns a store lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_loaded(loaders: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, list[str]]:
    """Union of the stores that load, and the names of those that do not."""
    tables, failed = [], []
    for name, load in loaders.items():
        try:
            tables.append(load())
        except (AnalysisException, ValueError):
            failed.append(name)
    if not tables:
        raise ValueError("no store could be loaded")
    return union_sites(tables), failed


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, key: str, k: int = 15) -> DataFrame:
    return count_by(df, key).orderBy(F.desc("n"), F.asc(key)).limit(k)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows of each group.

    Spark prunes each task's rows to ``n`` per group before the shuffle, so a
    hot group stays small.
    """
    spot = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= n).drop("_n")


def sample_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 2) -> DataFrame:
    return top_per_group(df, keys, order, n)
