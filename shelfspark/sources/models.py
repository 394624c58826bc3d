"""Saved price models: pipeline, label tables, input list and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


@dataclass
class PriceModel:
    model: PipelineModel
    labels: dict[str, DataFrame]
    features: list[str]
    metrics: DataFrame
    version: str = "1"


def save_model(package: PriceModel, path: str) -> None:
    spark = package.metrics.sparkSession
    package.model.write().overwrite().save(f"{path}/model")
    for name, table in package.labels.items():
        table.write.mode("overwrite").parquet(f"{path}/labels/{name}")
    package.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    spark.createDataFrame(
        [(i, f, package.version) for i, f in enumerate(package.features)],
        "position int, feature string, version string",
    ).write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str, labels: list[str]) -> PriceModel:
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return PriceModel(
        PipelineModel.load(f"{path}/model"),
        {name: spark.read.parquet(f"{path}/labels/{name}") for name in labels},
        [r["feature"] for r in rows],
        spark.read.parquet(f"{path}/metrics"),
        rows[0]["version"] if rows else "1",
    )
