"""Quantity, brand and unit-price features of a listings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import quantity as q
from shelfspark.functions.text import blank_to_null, number
from shelfspark.operators.stats import one_row
from shelfspark.session import stage


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named columns to double; text that is no number becomes null."""
    return df.withColumns({c: number(F.col(c)) for c in columns if c in df.columns})


def with_quantity(df: DataFrame, title: str = "title", quantity: str | None = None) -> DataFrame:
    """Add size, pack count, normalised quantity and notes.

    With ``quantity`` the size is read from that column first and from the
    title where the column gives none; packs and notes come from the title.
    """
    parsed = df.withColumns({
        "_title_size": q.size(F.col(title)), "pack_count": q.pack_count(F.col(title))})
    if quantity and quantity in df.columns:
        parsed = parsed.withColumn("_size", F.coalesce(q.size(F.col(quantity)),
                                                       F.col("_title_size")))
    else:
        parsed = parsed.withColumn("_size", F.col("_title_size"))
    value, unit = F.col("_size.size_value"), F.col("_size.size_unit")
    return parsed.withColumns({
        "size_value": value,
        "size_unit": unit,
        "normalized_quantity": q.normalized_quantity(value, unit),
        "notes": q.notes(F.col("_title_size.size_value"), "pack_count"),
    }).drop("_title_size", "_size")


def with_brand(df: DataFrame, known: list[str] = q.CATALOGUE_BRANDS,
               title: str = "title") -> DataFrame:
    return df.withColumn("brand", q.brand(F.col(title), known))


def with_brand_category(df: DataFrame) -> DataFrame:
    """brand_category; only the brand when the table has no category column."""
    if "category" not in df.columns:
        return df.withColumn("brand_category", F.col("brand"))
    return df.withColumn("brand_category", F.concat(
        F.col("brand"), F.lit("_"), F.coalesce(F.col("category"), F.lit(""))))


def with_unit_prices(df: DataFrame, price: str = "price") -> DataFrame:
    """Add unit_price, unit_price_unit and per_unit_price."""
    cost = number(F.col(price))
    return df.withColumns({
        "unit_price": q.unit_price(cost, "normalized_quantity"),
        "unit_price_unit": q.unit_price_unit(cost, "normalized_quantity", "size_unit"),
        "per_unit_price": q.per_unit_price(cost, "pack_count"),
    })


def drop_no_size(df: DataFrame) -> DataFrame:
    return df.where(F.col("size_value").isNotNull())


def keep_majority_unit_family(df: DataFrame) -> DataFrame:
    """Keep liquid or solid rows, whichever are more; a tie keeps the solids.

    Rows in other units stay unless both families are present.
    """
    liquid, solid = F.col("size_unit").isin(q.LIQUID_UNITS), F.col("size_unit").isin(q.SOLID_UNITS)
    seen = one_row(df, F.count_if(liquid).alias("liquid"), F.count_if(solid).alias("solid"))
    n_liquid, n_solid = seen["liquid"], seen["solid"]
    return df.where(F.coalesce(
        F.when((n_liquid == 0) | (n_solid == 0), F.lit(True))
        .when(n_liquid > n_solid, liquid).otherwise(solid), F.lit(False)))


def quantity_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Search-result features: rows without a size and the minor family go.

    ``columns`` names those that the caller reads, besides the unit prices; others are not written.
    """
    rows = with_quantity(df)
    rows = with_brand(rows, q.BRANDS).withColumn("category", F.lit("Grocery"))
    # Parsing costs more than a write, and the family vote needs a second pass. Rows without a size go
    # after the write: before it, their test becomes a part of the join below and parses each title again.
    rows = with_brand_category(rows)
    rows = drop_no_size(stage(rows.select(*columns) if columns else rows, "sized"))
    return with_unit_prices(keep_majority_unit_family(rows))


def feature_table(df: DataFrame) -> DataFrame:
    """Catalogue features: every row stays, total_volume is added."""
    rows = with_quantity(df, quantity="quantity")
    rows = with_brand_category(with_brand(rows, q.CATALOGUE_BRANDS))
    rows = rows.withColumn("total_volume", q.total_volume("size_value", "pack_count"))
    return with_unit_prices(rows)


def feature_coverage(df: DataFrame) -> DataFrame:
    """How many rows have a size, a pack, a brand and a unit price."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count("size_value").alias("with_size"),
        F.count_if(F.col("pack_count") > 0).alias("with_pack"),
        F.count_if(F.col("brand") != "Unknown").alias("with_brand"),
        F.count("unit_price").alias("with_unit_price"),
        F.count("per_unit_price").alias("with_per_unit_price"),
    )


def with_deal_quantity(df: DataFrame) -> DataFrame:
    """Quantity for the learned deal score and price per unit of it."""
    loose = q.deal_quantity("title")
    if "normalized_quantity" in df.columns:
        loose = F.coalesce(F.col("normalized_quantity"), loose)
    rows = df.withColumn("quantity_value", loose)
    return rows.withColumns({
        "price_per_unit": F.try_divide(F.col("price"), F.col("quantity_value")),
        "value_score": q.value_keyword_score("title"),
    })


def blank_cells_to_null(df: DataFrame) -> DataFrame:
    """Empty or blank text cells become null."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: blank_to_null(F.col(c)) for c in text})
