"""Multi-step jobs: search results to deals, catalogue to unified table and model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfspark.operators import cross_store, deals, features, matching, pricing
from shelfspark.sources.listings import ANALYZED, UNIFIED, available
from shelfspark.sources.models import PriceModel


def search_to_deals(raw: DataFrame, min_rows: int = deals.MIN_SCORED,
                    learners: bool = False) -> DataFrame:
    """Raw listings of one search to scored deals in the published column order."""
    quantity = features.coerce_numeric(features.quantity_table(raw), deals.NUMERIC)
    scored = deals.analyze_deals(quantity, min_rows)
    if learners:
        scored, _ = deals.predict_deal_score(scored)
        scored = deals.cluster_listings(scored)
    return available(scored, ANALYZED)


def catalogue_to_unified(raw: DataFrame, threshold: float = matching.THRESHOLD,
                         order: str = "seq") -> DataFrame:
    """Raw catalogue listings to the unified cross-store table."""
    table = features.feature_table(raw)
    grouped = matching.match_products(table, threshold, order=order)
    compared = cross_store.with_group_features(grouped)
    return cross_store.with_store_competitiveness(compared).select(
        *[c for c in [*UNIFIED, order] if c != order], order)


def train_price_model(unified: DataFrame, learner=pricing.random_forest, key: str = "seq",
                      **options) -> tuple[PriceModel, DataFrame]:
    """Fit a learner on the training share; returns the package and the test predictions."""
    table = pricing.prepare(unified)
    inputs = pricing.feature_columns(table)
    train, test = pricing.split(table, key)
    model = learner(train, inputs, **options)
    predicted = model.transform(test)
    labels = pricing.label_tables(unified.where("price_numeric > 0"))
    metrics = pricing.regression_metrics(predicted)
    return PriceModel(model, labels, inputs, metrics), predicted
