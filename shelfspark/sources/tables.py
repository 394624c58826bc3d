"""Listings views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _base_title() -> list[Column]:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    brand = (
        F.when(key % 5 == 0, "NESTLE").when(key % 5 == 1, "coca-cola")
        .when(key % 5 == 2, "Peek Freans").otherwise(F.col("p_brand"))
    )
    filler = (
        F.when(F.col("p_size") % 3 == 0, " Premium ").when(F.col("p_size") % 3 == 1, " Fresh ")
        .otherwise(" ")
    )
    amount = (
        F.when(key % 6 == 0, F.concat(F.lit(" "), size, F.lit("0ml")))
        .when(key % 6 == 1, F.concat(F.lit(" "), size, F.lit(".5 Ltr")))
        .when(key % 6 == 2, F.concat(F.lit(" "), size, F.lit("0 g")))
        .when(key % 6 == 3, F.concat(F.lit(", "), size, F.lit("Kg")))
        .when(key % 6 == 4, F.concat(F.lit(" "), size, F.lit("00 Gm"))).otherwise("")
    )
    return [brand, filler, F.col("p_name"), amount]


def _store_url() -> Column:
    return F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/p/"),
                    F.col("p_partkey").cast("string"))


def offers(spark: SparkSession, folder: str, pack_skip: bool = False) -> DataFrame:
    """One listing per line item: a store sells a part at a price."""
    packs = F.col("l_quantity").cast("int").cast("string")
    line = F.col("l_linenumber") % 4
    pack = (
        F.when(line == 1, F.concat(F.lit(" (Pack of "), packs, F.lit(")")))
        .when(line == 2, F.concat(F.lit(" "), packs, F.lit(" pcs")))
    )
    if pack_skip:
        pack = pack.when(line == 3, F.concat(F.lit(" pack "), packs, F.lit(" ml")))
    price = F.when(F.col("l_orderkey") % 97 == 0, "N/A").otherwise(
        F.col("l_extendedprice").cast("string"))
    return (
        spread(table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
            F.col("n_name").alias("site"),
            F.col("p_type").alias("category"),
            F.col("p_partkey").cast("string").alias("product_id"),
            F.concat(*_base_title(), pack.otherwise("")).alias("title"),
            price.alias("price"),
            _store_url().alias("product_url"),
        )
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One listing per part; seq is unique."""
    suppliers = table(spark, folder, "supplier")
    n_suppliers = suppliers.agg(F.count("*").alias("n")).scalar()
    return (
        spread(table(spark, folder, "part"))
        .withColumn("_supplier", F.col("p_partkey") % n_suppliers)
        .join(suppliers, F.col("_supplier") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("p_partkey").alias("seq"),
            F.col("n_name").alias("site"),
            F.col("p_type").alias("category"),
            F.col("p_partkey").cast("string").alias("product_id"),
            F.concat(*_base_title()).alias("title"),
            F.col("p_retailprice").cast("string").alias("price"),
            _store_url().alias("product_url"),
        )
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stored raw pages: page_id, url, html."""
    return spread(table(spark, folder, "pages"))
