"""Readers, schemas and writers for listing tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.features import blank_cells_to_null

# Columns of each layer, in output order.
LISTING_RAW = ["site", "title", "price", "image_url", "product_url"]
LISTING_CRAWL = ["site", "category", "subcategory", "product_id", "title", "price", "quantity",
                 "image_url", "product_url"]
LISTING_QTY = [*LISTING_RAW, "size_value", "size_unit", "pack_count", "normalized_quantity",
               "notes", "brand", "category", "brand_category", "unit_price", "unit_price_unit",
               "per_unit_price"]
ANALYZED = ["site", "title", "price", "image_url", "product_url", "size_value", "size_unit",
            "pack_count", "normalized_quantity", "notes", "unit_price", "unit_price_unit",
            "per_unit_price", "deal_score", "deal_tier", "price_percentile", "value_score",
            "store_rank", "ml_predicted_score", "product_cluster"]
UNIFIED = ["product_group_id", "site", "category", "title", "normalized_name", "price",
           "price_numeric", "brand", "size_value", "size_unit", "normalized_quantity",
           "pack_count", "total_volume", "min_price", "max_price", "avg_price", "median_price",
           "std_price", "price_range", "price_range_pct", "num_stores", "price_vs_avg",
           "price_vs_avg_pct", "is_cheapest", "is_most_expensive", "price_percentile",
           "store_rank", "avg_price_vs_market", "cheapest_rate", "brand_category", "unit_price",
           "per_unit_price"]
REQUIRED = ["title", "price", "site"]
# Other names under which stores publish a column.
ALIASES = {"title": ["name"], "subcategory": ["section"],
           "normalized_quantity": ["normalized_volume_ml"]}
# How compressed files begin, by the end of their name, and what codecs say of bad ones.
COMPRESSED = {"gz": b"\x1f\x8b", "bz2": b"BZh", "zst": b"\x28\xb5\x2f\xfd"}
BAD_FORMAT = ["not a gzip file", "not in gzip format", "incorrect header check", "incorrect data check",
              "stream crc", "stream size", "invalid", "unexpected end", "bad block header", "crc error",
              "unknown frame descriptor", "corrupt"]


class MissingColumns(ValueError):
    """An input lacks columns an operator needs."""


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def matching_paths(spark: SparkSession, path: str) -> list[str]:
    """Files and folders that a path or glob names; none if there are none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [found.getPath().toString() for found in system.globStatus(where) or []]


def data_files(spark: SparkSession, path: str) -> list[str]:
    return [unquote(p) for p in spark.read.text(path).inputFiles()]


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        got = [stream.read() for _ in range(n)]
    finally:
        stream.close()
    return bytes(x for x in got if x >= 0)


def mislabelled(spark: SparkSession, path: str) -> bool:
    """Whether a file with a name of a compressed one does not begin as one; not so for empty files."""
    begins = COMPRESSED.get(path.rsplit(".", 1)[-1])
    got = first_bytes(spark, path, len(begins)) if begins else b""
    return bool(got) and got != begins


def bad_format(error: Exception) -> bool:
    """Whether a read failed by what the file holds, and not by a passing error of the store."""
    cause = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while cause is not None:
        name, said = cause.getClass().getName(), str(cause.getMessage()).lower()
        if name.endswith(("ZipException", "DataFormatException", "EOFException")) or (
                name == "java.io.IOException" and any(w in said for w in BAD_FORMAT)):
            return True
        cause = cause.getCause()
    return False


def corrupt_files(spark: SparkSession, path: str) -> list[str]:
    """Compressed files below ``path`` that cannot be unpacked to their end.

    All are unpacked by one job, and one by one only if it fails. A read error of another kind is raised.
    """
    def sound(files: list[str]) -> bool:
        try:
            spark.read.option("ignoreCorruptFiles", False).text(files).agg(F.sum(F.length("value"))).collect()
        except Exception as error:
            if not bad_format(error):
                raise
            return False
        return True

    packed = [f for f in data_files(spark, path) if f.rsplit(".", 1)[-1] in COMPRESSED]
    if not packed or sound(packed):
        return []
    return [f for f in packed if not sound([f])]


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """Files below ``path`` grouped by their first line; empty files are left out.

    One pass over the text, of which one line a file leaves the tasks. A read error fails.
    """
    lines = spark.read.option("ignoreCorruptFiles", False).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return [[unquote(p) for p in g["paths"]] for g in groups.orderBy("header").collect()]


def read_listings(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None,
                  multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column text, blank cells null.

    Files of a folder are read by the names in their own headers; ``columns`` says that all files have
    these columns in this order, which saves the pass over the headers. ``multi_line`` allows line
    breaks inside cells and reads each file in one task.

    A read error fails, so that Spark tries the task again and no file is read in part. Without
    ``columns``, a file that is named as compressed and does not begin as one is left out whole.
    """
    reader = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
              .option("ignoreCorruptFiles", False))

    def read(names: Sequence[str], paths: str | list[str]) -> DataFrame:
        return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(paths)

    if columns:
        return blank_cells_to_null(read(columns, path))
    try:
        groups = files_by_header(spark, path)
    except Exception as error:
        if not bad_format(error):
            raise
        files = data_files(spark, path)
        sound = [f for f in files if not mislabelled(spark, f)]
        if len(sound) == len(files):
            raise
        groups = files_by_header(spark, sound) if sound else []
    if not groups:
        raise MissingColumns(f"no header in {path}")
    if len(groups) == 1:
        return blank_cells_to_null(read(csv_header(spark, groups[0][0]), groups[0]))
    tables = [read(csv_header(spark, files[0]), files) for files in groups]
    return blank_cells_to_null(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables))


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def read_many_checked(spark: SparkSession, paths: Sequence[str], exclude: str | None = None,
                      required: Sequence[str] = REQUIRED) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Union of store files, folders and globs by column name, with source_file; and what was left out.

    A compressed file that cannot be unpacked to its end is left out whole, as are paths that are not
    there or lack a required column: (path, reason) each. Other read errors fail.
    """
    tables, left_out = [], []
    for given in paths:
        matching = matching_paths(spark, given)
        if not matching:
            left_out.append((given, "not found"))
        for path in matching:
            name = path.rstrip("/").rsplit("/", 1)[-1]
            if exclude and exclude in name:
                continue
            try:
                bad = corrupt_files(spark, path)
                left_out += [(f, "corrupt") for f in bad]
                files = [f for f in data_files(spark, path) if f not in bad] if bad else path
                if not files:
                    continue
                table = harmonise(read_listings(spark, files))
                require_columns(table, required)
            except (AnalysisException, MissingColumns) as error:
                left_out.append((path, str(error)))
                continue
            tables.append(table.withColumn("source_file", F.lit(name)))
    if not tables:
        raise MissingColumns("no readable listing file")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), left_out


def read_many(spark: SparkSession, paths: Sequence[str], exclude: str | None = None,
              required: Sequence[str] = REQUIRED) -> DataFrame:
    """The rows of ``read_many_checked``."""
    return read_many_checked(spark, paths, exclude, required)[0]


def harmonise(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Store column names to one schema; a missing column takes its alias."""
    for name, others in aliases.items():
        found = [o for o in others if o in df.columns]
        if not found:
            continue
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), *[F.col(o) for o in found]))
        else:
            df = df.withColumn(name, F.coalesce(*[F.col(o) for o in found]))
        df = df.drop(*found)
    return df


def in_order(df: DataFrame, columns: Sequence[str], fill: Column | None = None) -> DataFrame:
    """Exactly these columns in this order; missing ones are filled."""
    blank = F.lit(None).cast("string") if fill is None else fill
    return df.select(*[F.col(c) if c in df.columns else blank.alias(c) for c in columns])


def available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that the table has, in this order."""
    return df.select(*[c for c in columns if c in df.columns])


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None,
                fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    rows = in_order(df, columns) if columns else df
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_accepted_rejected(accepted: DataFrame, rejected: DataFrame, path: str,
                            fmt: str = "parquet") -> None:
    write_table(accepted, f"{path}/accepted", fmt=fmt)
    write_table(rejected, f"{path}/rejected", fmt=fmt)
