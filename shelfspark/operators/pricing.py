"""Price prediction: features, split, learners, metrics and comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import number
from shelfspark.operators.stats import (
    RANGE_ROWS, one_row, quantiles, sorted_codes, value_counts,
)
from shelfspark.session import stage

# Model inputs, and what stands in for a missing one when scoring.
NUMERIC = ["size_value", "normalized_quantity", "pack_count", "total_volume", "avg_price",
           "median_price", "price_range", "price_range_pct", "num_stores", "price_percentile",
           "store_rank", "avg_price_vs_market", "cheapest_rate"]
BINARY = ["is_cheapest", "is_most_expensive"]
CATEGORICAL = ["site", "category", "size_unit", "brand", "brand_category"]
SCORING_DEFAULTS = {"num_stores": 1.0, "price_percentile": 50.0, "store_rank": 1.0}
TOLERANCES = [5, 10, 15, 20]
QUALITY = [("Excellent", 0.8), ("Good", 0.6), ("Fair", 0.4)]
LOWEST_QUALITY = "Needs Improvement"
GAP_LIMIT = 5
MISSING_LABEL = "nan"
CLUSTER_ROWS = 1_000_000  # a forest over more rows lays them out by the leaves of one tree
CLUSTER_SAMPLE, CLUSTER_DEPTH = 100_000, 10  # rows and levels of that tree, which changes the layout only
BLOCK_ROWS = 4_096  # rows of one local pass of the network
FIXED_POINT = float(2 ** 44)  # weights are summed as integers, so that no order of summing shows
ERROR_POINT = float(2 ** 20)
SUMS = 16  # tasks of the last step of a sum; the driver gets so many rows


def numeric_features(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Numeric inputs as doubles; missing or bad values become 0."""
    return df.withColumns({
        c: F.coalesce(number(F.col(c)), F.lit(0.0)) for c in columns if c in df.columns})


def binary_features(df: DataFrame, columns: Sequence[str] = BINARY) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(number(F.col(c)), F.lit(0.0)).cast("int")
        for c in columns if c in df.columns})


def label_tables(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> dict[str, DataFrame]:
    """Sorted distinct labels of each column with their code; null is a label too."""
    labelled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias(c)
                           for c in columns if c in df.columns])
    # Written, so that joins are planned by their size and few labels do not shuffle the rows.
    return {c: stage(sorted_codes(labelled, c, f"{c}_encoded"), "labels") for c in labelled.columns}


def label_encode(df: DataFrame, labels: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add a code per categorical column; labels not in the tables get code 0."""
    labels = label_tables(df) if labels is None else labels
    for c, codes in labels.items():
        code = f"{c}_encoded"
        if c not in df.columns:
            df = df.withColumn(code, F.lit(0))
            continue
        keys = codes.select(F.col(c).alias("_label"), code)
        df = df.withColumn("_label", F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)))
        df = df.join(keys, "_label", "left").drop("_label").withColumn(
            code, F.coalesce(F.col(code), F.lit(0)))
    return df


def feature_columns(df: DataFrame) -> list[str]:
    wanted = [*NUMERIC, *BINARY, *[f"{c}_encoded" for c in CATEGORICAL]]
    return [c for c in wanted if c in df.columns]


def prepare(df: DataFrame, price: str = "price_numeric", written: bool = False) -> DataFrame:
    """Model table: positive price, numeric, binary and encoded inputs.

    Each label column takes passes of its own, so the rows are written unless ``df`` reads ``written`` ones.
    """
    rows = df.withColumn(price, number(F.col(price))).where(F.col(price) > 0)
    rows = binary_features(numeric_features(rows))
    return label_encode(rows if written else stage(rows, "model-table"))


def assemble(features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep")


def is_train(key: Column, share: int = 80) -> Column:
    """Reproducible split: a fixed share of rows by the hash of their key."""
    head = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return head % 100 < share


def split(df: DataFrame, key: str = "seq", share: int = 80) -> tuple[DataFrame, DataFrame]:
    train = is_train(F.col(key), share)
    return df.where(train), df.where(~train)


def standardised(train: DataFrame, features: Sequence[str]) -> list:
    """Stages that centre and scale by the population deviation of the training rows."""
    n = train.count()
    whole = [(n / (n - 1)) ** 0.5 if n > 1 else 1.0] * len(features)
    return [assemble(features, "raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="sample_scaled", withMean=True),
            ElementwiseProduct(inputCol="sample_scaled", outputCol="features",
                               scalingVec=Vectors.dense(whole))]


# ------------------------------------------------------------- learners

def clustered(train: DataFrame, features: Sequence[str], label: str = "price_numeric",
              seed: int = 42) -> DataFrame:
    """All rows of ``train``, written so that rows of one leaf of a tree lie side by side within a partition.

    A level of a forest adds each row to the statistics of one node in every tree. With many nodes these
    do not fit a core's cache; neighbours that share their nodes find them there. The tree is learned from a
    sample of fixed size.
    """
    n = train.count()
    if n <= CLUSTER_ROWS:
        return train
    tree = Pipeline(stages=[assemble(features, "_features"), DecisionTreeRegressor(
        labelCol=label, featuresCol="_features", predictionCol="_predicted", leafCol="_leaf",
        maxDepth=CLUSTER_DEPTH, minInstancesPerNode=2, seed=seed)]).fit(train.sample(CLUSTER_SAMPLE / n, seed))
    return stage(tree.transform(train).select(*train.columns, "_leaf").sortWithinPartitions("_leaf").drop("_leaf"),
                 "clustered")


def random_forest(train: DataFrame, features: Sequence[str], label: str = "price_numeric",
                  trees: int = 150, depth: int = 25, seed: int = 42) -> PipelineModel:
    """Forest with at least two rows per leaf; 150 x 25 unified, 100 x 20 basic.

    As with any partitioning, the rows drawn for a tree follow the layout.
    """
    forest = RandomForestRegressor(
        labelCol=label, featuresCol="features", predictionCol="predicted", numTrees=trees,
        maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="all", seed=seed)
    return Pipeline(stages=[assemble(features), forest]).fit(clustered(train, features, label, seed))


def boosted_trees(train: DataFrame, features: Sequence[str], label: str = "price_numeric",
                  trees: int = 200, depth: int = 8, rate: float = 0.1, rows: float = 0.8,
                  columns: float = 0.8, seed: int = 42) -> PipelineModel:
    """Gradient boosting with row and column sampling."""
    boosted = GBTRegressor(
        labelCol=label, featuresCol="features", predictionCol="predicted", maxIter=trees,
        maxDepth=depth, stepSize=rate, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), seed=seed)
    return Pipeline(stages=[assemble(features), boosted]).fit(train)


def _forward(weights: list, x: np.ndarray) -> list:
    layers = [x]
    for i in range(0, len(weights), 2):
        z = layers[-1] @ weights[i] + weights[i + 1]
        layers.append(z if i == len(weights) - 2 else np.maximum(z, 0.0))
    return layers


def _gradients(weights: list, x: np.ndarray, y: np.ndarray, out: list) -> None:
    """Gradients of the squared error, without the penalty, into the arrays of ``out``."""
    layers = _forward(weights, x)
    delta = (layers[-1] - y[:, None]) / len(y)
    for i in range(len(weights) - 2, -1, -2):
        below = layers[i // 2]
        np.matmul(below.T, delta, out=out[i])
        np.add.reduce(delta, axis=0, out=out[i + 1])
        if i:
            delta = (delta @ weights[i].T) * (below > 0)


def _local_epoch(state: list, steps: int, x: np.ndarray, y: np.ndarray, rate: float,
                 penalty: float, batch: int, seed: int) -> list:
    """One pass of Adam over a block; ``state`` is weights, first and second moments in turn.

    The arrays of a kind lie one after the other in one vector, so that a step updates them all at once.
    """
    k = len(state) // 3
    ends = np.cumsum([w.size for w in state[:k]])[:-1]

    def arrays(flat: np.ndarray) -> list:
        return [part.reshape(w.shape) for part, w in zip(np.split(flat, ends), state)]
    weight, first, second = (np.concatenate([w.ravel() for w in state[i * k:(i + 1) * k]]) for i in range(3))
    # Offsets are not penalised.
    cost = np.concatenate([np.full(w.size, 0.0 if i % 2 else penalty) for i, w in enumerate(state[:k])])
    grad, change, root = (np.empty_like(weight) for _ in range(3))
    weights, grads = arrays(weight), arrays(grad)
    order = np.random.default_rng(seed).permutation(len(y))
    x, y = x[order], y[order]
    for step, at in enumerate(range(0, len(y), batch), start=steps + 1):
        rows = y[at:at + batch]
        _gradients(weights, x[at:at + batch], rows, grads)
        np.multiply(cost, weight, out=change)
        change /= len(rows)
        grad += change
        first *= 0.9
        first += np.multiply(grad, 0.1, out=change)
        second *= 0.999
        np.multiply(grad, 0.001, out=change)
        change *= grad
        second += change
        np.divide(first, 1 - 0.9 ** step, out=change)
        change *= rate
        np.divide(second, 1 - 0.999 ** step, out=root)
        np.sqrt(root, out=root)
        root += 1e-8
        change /= root
        weight -= change
    return [*weights, *arrays(first), *arrays(second)]


class NeuralModel:
    """Scaling pipeline and network weights; weights are a table when saved."""

    def __init__(self, scaler: PipelineModel, weights: list, mean: float, scale: float):
        self.scaler, self.weights, self.mean, self.scale = scaler, weights, mean, scale

    def transform(self, df: DataFrame) -> DataFrame:
        weights, mean, scale = self.weights, self.mean, self.scale

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(_forward(weights, np.stack(x))[-1][:, 0] * scale + mean)

        rows = self.scaler.transform(df)
        return rows.withColumn("predicted", predict(vector_to_array("features"))).drop(
            "raw_features", "sample_scaled", "features")

    def save(self, spark, path: str) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        rows = [(i, list(map(int, w.shape)), [float(v) for v in w.ravel()])
                for i, w in enumerate(self.weights)]
        rows.append((len(self.weights), [2], [self.mean, self.scale]))
        spark.createDataFrame(rows, "layer int, shape array<int>, cells array<double>"
                              ).write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(spark, path: str) -> NeuralModel:
        rows = spark.read.parquet(f"{path}/weights").orderBy("layer").collect()
        cells = [np.array(r["cells"]).reshape(r["shape"]) for r in rows]
        mean, scale = cells.pop()
        return NeuralModel(PipelineModel.load(f"{path}/scaler"), cells, float(mean), float(scale))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (spot, x, y, fit) as matrices of about BLOCK_ROWS rows, dealt and ordered by ``spot``.

    A block holds the same rows in the same order however the table was partitioned.
    """
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))

    def pack(at: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("spot")
        return pd.DataFrame({"block": [at[0]], "fit": [at[1]], "n": [len(part)],
                             "x": [np.stack(part["x"]).astype(float).tobytes()],
                             "y": [part["y"].to_numpy(float).tobytes()]})

    dealt = rows.withColumn("block", F.pmod("spot", F.lit(n_blocks)))
    return dealt.groupBy("block", "fit").applyInPandas(
        pack, "block long, fit boolean, n long, x binary, y binary")


def _matrices(pdf: pd.DataFrame):
    for block, fit, n, x, y in zip(pdf["block"], pdf["fit"], pdf["n"], pdf["x"], pdf["y"]):
        yield int(block), fit, np.frombuffer(x).reshape(n, -1), np.frombuffer(y)


def _summed(parts: DataFrame, n_parts: int) -> np.ndarray:
    """Sum of the integer vectors of ``parts``, within SUMS tasks where there are more, then here."""
    def add(batches):
        whole = None
        for pdf in batches:
            for w in pdf["w"]:
                whole = np.array(w) if whole is None else whole + w
        if whole is not None:
            yield pd.DataFrame({"w": [whole.tolist()]})

    if n_parts > SUMS:
        parts = parts.repartition(SUMS).mapInPandas(add, "w array<long>")
    return np.sum([np.array(r["w"]) for r in parts.collect()], axis=0)


def neural_regressor(train: DataFrame, features: Sequence[str], label: str = "price_numeric",
                     key: str = "seq", hidden: Sequence[int] = (128, 64, 32),
                     rate: float = 0.001, penalty: float = 0.001, batch: int = 32,
                     rounds: int = 500, patience: int = 20, seed: int = 42) -> NeuralModel:
    """ReLU network trained in parallel.

    The rows are dealt into blocks by a hash of key, label and features. In each round every block runs one pass of
    mini-batch Adam from the shared weights and moments, and the results are averaged by row count;
    up to one block this is the sequential method. A tenth of the rows, chosen by key, is held out;
    training stops when its error has not improved for ``patience`` rounds. The model does not
    depend on the partitioning of ``train``.
    """
    scaler = Pipeline(stages=standardised(train, features)).fit(train)
    facts = train.agg(F.avg(label).alias("m"), F.stddev_pop(label).alias("s")).first()
    mean, scale = float(facts["m"]), float(facts["s"] or 1.0) or 1.0
    # Hashed before scaling: sums of doubles differ in their last bits between partitionings.
    spot = F.xxhash64(key, label, *[c for c in features if c not in (key, label)])
    rows = stage(scaler.transform(train).select(
        spot.alias("spot"), vector_to_array("features").alias("x"),
        ((F.col(label) - mean) / scale).alias("y"),
        is_train(F.concat(F.lit("held-out-"), F.col(key).cast("string")), 90).alias("fit")), "net")
    blocks = stage(_blocks(rows), "blocks")
    n_parts = blocks.rdd.getNumPartitions()
    learned = blocks.where("fit").agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    total, steps_a_round = int(learned["n"] or 0), -(-int(learned["most"] or 0) // batch)
    rng = np.random.default_rng(seed)
    sizes = [len(features), *hidden, 1]
    weights: list = []
    for a, b in zip(sizes, sizes[1:]):
        limit = np.sqrt(6.0 / (a + b))
        weights += [rng.uniform(-limit, limit, (a, b)), rng.uniform(-limit, limit, b)]
    state = weights + [np.zeros_like(w) for w in weights] * 2
    cuts = np.cumsum([w.size for w in state])
    best, best_error, stale = weights, np.inf, 0
    for turn in range(rounds + 1 if total else 0):
        def one_pass(batches, state=state, turn=turn):
            """Sums over the blocks: new state, then held-out error and rows of the old one."""
            whole, layers = np.zeros(cuts[-1] + 2, np.int64), state[:len(state) // 3]
            for pdf in batches:
                for block, fit, x, y in _matrices(pdf):
                    if not fit:
                        error = float(((_forward(layers, x)[-1][:, 0] - y) ** 2).sum())
                        whole[-2:] += [round(error * ERROR_POINT), len(y)]
                    elif turn < rounds:
                        local = _local_epoch(state, turn * steps_a_round, x, y, rate, penalty,
                                             batch, [seed, turn, block])
                        flat = np.concatenate([w.ravel() for w in local]) * (len(y) / total)
                        whole[:-2] += np.rint(flat * FIXED_POINT).astype(np.int64)
            yield pd.DataFrame({"w": [whole.tolist()]})

        # The driver holds the model only: one number per weight and moment.
        sums = _summed(blocks.mapInPandas(one_pass, "w array<long>"), n_parts)
        if turn:
            error = sums[-2] / ERROR_POINT / sums[-1] if sums[-1] else np.inf
            if error < best_error - 1e-6:
                best, best_error, stale = state[:len(weights)], error, 0
            else:
                stale += 1
                if stale >= patience:
                    break
        state = [p.reshape(w.shape) for p, w in zip(np.split(sums[:-2] / FIXED_POINT, cuts), state)]
    return NeuralModel(scaler, best, mean, scale)


def group_mean_predictor(train: DataFrame, df: DataFrame, key: str,
                         label: str = "price_numeric") -> DataFrame:
    """Mean training price of the key; the overall mean for unseen keys."""
    overall = train.agg(F.avg(label).alias("m")).scalar()
    means = train.groupBy(key).agg(F.avg(label).alias("_mean"))
    return df.join(means, key, "left").withColumn(
        "predicted", F.coalesce(F.col("_mean"), overall)).drop("_mean")


# -------------------------------------------------------------- evaluation

def regression_metrics(df: DataFrame, actual: str = "price_numeric",
                       predicted: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, R2, MAPE over non-zero actuals, and share within tolerances."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    n = F.count(error)
    var = F.var_pop(F.when(error.isNotNull(), y)) * n
    within = [
        (F.avg((F.abs(error) <= y * (p / 100.0)).cast("double")) * 100).alias(f"acc_{p}")
        for p in TOLERANCES]
    return df.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), var)).alias("r2"),
        (F.avg(F.when(y != 0, F.abs(error / F.nullif(y, F.lit(0.0))))) * 100).alias("mape"),
        *within)


def error_distribution(df: DataFrame, actual: str = "price_numeric",
                       predicted: str = "predicted") -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.agg(F.min(error).alias("min_error"), F.max(error).alias("max_error"),
                  F.avg(error).alias("mean_error"), F.stddev_pop(error).alias("std_error"))


def residuals(df: DataFrame, actual: str = "price_numeric",
              predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def prediction_sample(df: DataFrame, n: int = 10, actual: str = "price_numeric",
                      predicted: str = "predicted", order: Sequence[str] = ("seq",)) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.orderBy(*order).limit(n).select(
        *order, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
        error.alias("error"), (F.try_divide(error, F.col(actual)) * 100).alias("error_pct"))


def quality_label(r2: Column) -> Column:
    label = F.lit(LOWEST_QUALITY)
    for name, limit in reversed(QUALITY):
        label = F.when(r2 >= limit, name).otherwise(label)
    return label


def feature_importance(model: PipelineModel, features: Sequence[str], spark,
                       n: int | None = 10) -> DataFrame:
    """One row per model input, most important first."""
    scores = model.stages[-1].featureImportances
    rows = [(f, float(scores[i])) for i, f in enumerate(features)]
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
    return table if n is None else table.limit(n)


def compare_models(predictions: dict[str, DataFrame], actual: str = "price_numeric") -> DataFrame:
    """Metrics per model, best flags, wins, and the overall winner."""
    scored = reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(i).alias("model_no"), F.lit(name).alias("model"), actual, "predicted")
        for i, (name, df) in enumerate(predictions.items())])
    metrics = stage(regression_metrics(scored, actual, keys=["model_no", "model"]), "metrics")
    best = one_row(
        metrics,
        F.min_by("model", F.struct(-F.col("r2"), "model_no")).alias("r2"),
        F.min_by("model", F.struct("mae", "model_no")).alias("mae"),
        F.min_by("model", F.struct(-F.col("acc_10"), "model_no")).alias("acc_10"))
    flags = metrics.withColumns({
        f"best_{m}": (F.col("model") == best[m]).cast("int") for m in ("r2", "mae", "acc_10")})
    flags = flags.withColumn(
        "wins", F.col("best_r2") + F.col("best_mae") + F.col("best_acc_10"))
    winner = flags.agg(F.min_by("model", F.struct(-F.col("wins"), "model_no")).alias("w")).scalar()
    return flags.withColumn("is_winner", (F.col("model") == winner).cast("int"))


# ----------------------------------------------------------------- scoring

def prepare_for_scoring(df: DataFrame, labels: dict[str, DataFrame], features: Sequence[str],
                        price: str = "price", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Model inputs for new listings; missing ones take a default, unseen labels code 0."""
    counts = value_counts(df, price, range_rows=range_rows)
    mean = df.agg(F.avg(price).alias("m")).scalar()
    middle = quantiles(counts, price, {"m": 0.5}).scalar()
    defaults = {**{c: F.lit(0.0) for c in [*NUMERIC, *BINARY]},
                **{c: F.lit(v) for c, v in SCORING_DEFAULTS.items()},
                "avg_price": mean, "median_price": middle}
    rows = df.withColumns({
        c: F.coalesce(number(F.col(c)), d) if c in df.columns else d
        for c, d in defaults.items()})
    rows = label_encode(rows, labels)
    return rows.withColumns({c: F.lit(0.0) for c in features if c not in rows.columns})


def price_gap(df: DataFrame, actual: str = "price", predicted: str = "predicted") -> DataFrame:
    """Difference to the prediction in price and percent, and what it means."""
    gap = F.col(actual) - F.col(predicted)
    share = F.try_divide(gap, F.col(predicted)) * 100
    return df.withColumns({
        "price_difference": gap,
        "price_diff_pct": share,
        "price_status": F.when(share < -GAP_LIMIT, "good deal").when(
            share > GAP_LIMIT, "overpriced").otherwise("fair"),
    })


def gap_summary(df: DataFrame, ties: Sequence[str] = ("title", "site", "seq")) -> DataFrame:
    good = F.col("price_diff_pct") < -GAP_LIMIT
    return df.agg(
        F.count("*").alias("n_listings"), F.count_if(good).alias("n_good_deals"),
        F.min_by(F.when(good, F.col("title")), F.when(good, F.struct(
            "price_diff_pct", *[t for t in ties if t in df.columns]))).alias("best_deal"))
