import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from shelfspark.operators import neighbours, pricing, recommend


def corpus(seed=2, n=70):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["the", "a"]
    texts = [" ".join(rng.choices(words, weights=[40] + [1 + i % 5 for i in range(26)], k=6))
             for _ in range(n)]
    return texts + [texts[0]] * 30  # a third of all documents are copies


def by_hand(texts, top=500):
    stop = set(recommend.STOP_WORDS)
    docs = []
    for text in texts:
        words = [w for w in text.split() if len(w) >= 2 and w not in stop]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    total, df = Counter(), Counter()
    for d in docs:
        total.update(d)
        df.update(d.keys())
    vocabulary = set(sorted(total, key=lambda t: (-total[t], t))[:top])
    out = []
    for d in docs:
        raw = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items() if t in vocabulary}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        out.append({t: v / norm for t, v in raw.items()})
    return out


def dot(a, b):
    return round(sum(w * b.get(t, 0.0) for t, w in a.items()), 9)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(corpus())), "seq long, text string")


def test_weights(docs):
    want = by_hand(corpus(), 40)
    texts = recommend.distinct_texts(docs)
    got = recommend.tfidf(texts, max_features=40).collect()
    for r in got:
        assert r["weight"] == pytest.approx(want[r["tid"]][r["term"]])


@pytest.mark.parametrize("block, load", [(256, 20_000), (7, 5), (1, 1)])
def test_similar_products_equal_brute_force(docs, block, load, monkeypatch):
    for name, value in {"BLOCK": block, "LOAD": load, "GROUP": 3, "SUMMARIES": 4}.items():
        monkeypatch.setattr(neighbours, name, value)
    vectors = by_hand(corpus())
    want = {}
    for i, v in enumerate(vectors):
        near = sorted((-dot(v, u), j) for j, u in enumerate(vectors) if j != i and dot(v, u) > 0)
        want[i] = [j for _, j in near[:5]]
    got = {}
    for r in recommend.similar_products(docs, 5).orderBy("seq", "place").collect():
        got.setdefault(r["seq"], []).append(r["match"])
    assert got == {i: m for i, m in want.items() if m}


@pytest.mark.parametrize("level, chunk", [(0.0, 2_000), (0.4, 7), (0.8, 2_000)])
def test_cosine_pairs_equal_brute_force(docs, level, chunk, monkeypatch):
    monkeypatch.setattr(recommend, "CHUNK", chunk)
    vectors, firsts = by_hand(corpus()), {}
    for i, text in enumerate(corpus()):
        firsts.setdefault(text, i)
    ids = sorted(firsts.values())
    want = {(a, b) for a in ids for b in ids if a < b and dot(vectors[a], vectors[b]) >= max(level, 1e-9)}
    weights = recommend.tfidf(recommend.distinct_texts(docs))
    got = {(r["a"], r["b"]) for r in recommend.cosine_pairs(weights, level).collect()}
    assert got == want


def test_found_pairs_are_not_shuffled(docs):
    pairs = recommend.cosine_pairs(recommend.tfidf(recommend.distinct_texts(docs)), 0.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("FlatMapCoGroupsInPandas")[0]
    rows = pairs.select("a", "b").collect()
    assert len(rows) == len(set(rows)) > 0


def test_locate_by_prefix(spark):
    catalog = spark.createDataFrame([(3, "Big Pepsi Cola Bottle 500ml"), (1, "pepsi cola bottle 1L"),
                                     (2, "tea (green)")], "seq long, title string")
    new = spark.createDataFrame([("PEPSI Cola Bottle 500ml x6",), ("Tea (",), ("none",), ("",)],
                                "title string")
    got = {r["title"]: r["seq"] for r in recommend.locate(new, catalog).collect()}
    assert got == {"PEPSI Cola Bottle 500ml x6": 3, "Tea (": 2}


def table(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x, g = rng.uniform(0, 10), rng.choice("abc")
        rows.append((i, x, g, 20 + 7 * x + {"a": 0, "b": 15, "c": 40}[g]))
    return spark.createDataFrame(rows, "seq long, x double, g string, price_numeric double")


def test_labels_and_unknowns(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "site string")
    labels = pricing.label_tables(rows, ["site"])
    got = {r["site"]: r["site_encoded"] for r in pricing.label_encode(rows, labels).collect()}
    assert got == {"a": 0, "b": 1, None: 2}
    new = spark.createDataFrame([("zz",)], "site string")
    assert pricing.label_encode(new, labels).first()["site_encoded"] == 0


def test_split_is_reproducible(spark):
    rows = table(spark)
    train, test = pricing.split(rows)
    again, _ = pricing.split(rows.repartition(7))
    assert train.exceptAll(again).isEmpty() and train.count() + test.count() == 600
    assert 420 < train.count() < 540


def test_metrics(spark):
    rows = spark.createDataFrame([(100.0, 96.0), (200.0, 230.0), (0.0, 1.0)],
                                 "price_numeric double, predicted double")
    m = pricing.regression_metrics(rows).first()
    assert m["mae"] == pytest.approx(35 / 3) and m["mse"] == pytest.approx(917 / 3)
    assert m["mape"] == pytest.approx((4 + 15) / 2) and m["acc_5"] == pytest.approx(100 / 3)
    assert m["r2"] == pytest.approx(1 - 917 / 20000)


@pytest.mark.parametrize("r2, label", [(0.8, "Excellent"), (0.7, "Good"), (0.4, "Fair"),
                                       (0.1, "Needs Improvement")])
def test_quality(cell, r2, label):
    assert cell(pricing.quality_label(F.col("x")), x=r2) == label


@pytest.mark.parametrize("price, status", [(94.0, "good deal"), (105.0, "fair"), (106.0, "overpriced")])
def test_gap(spark, price, status):
    rows = spark.createDataFrame([(price, 100.0)], "price double, predicted double")
    assert pricing.price_gap(rows).first()["price_status"] == status


def test_learners_beat_the_mean(spark, tmp_path):
    rows = pricing.label_encode(table(spark), {
        "g": pricing.label_tables(table(spark), ["g"])["g"]})
    train, test = pricing.split(rows)
    inputs = ["x", "g_encoded"]
    net = pricing.neural_regressor(train, inputs, hidden=(16, 8), rate=0.02, rounds=25, patience=25)
    net.save(spark, str(tmp_path / "net"))
    again = pricing.NeuralModel.load(spark, str(tmp_path / "net"))
    predictions = {
        "mean": pricing.group_mean_predictor(train, test, "g").select("price_numeric", "predicted"),
        "forest": pricing.random_forest(train, inputs, trees=10, depth=8).transform(test),
        "boosted": pricing.boosted_trees(train, inputs, trees=20, depth=4).transform(test),
        "net": again.transform(test),
    }
    got = {r["model"]: r for r in pricing.compare_models(predictions).collect()}
    for name in ("forest", "boosted", "net"):
        assert got[name]["r2"] > got["mean"]["r2"]
    assert sum(r["is_winner"] for r in got.values()) == 1


def test_network_does_not_depend_on_partitioning(spark, monkeypatch):
    monkeypatch.setattr(pricing, "BLOCK_ROWS", 50)
    rows = table(spark)
    nets = [pricing.neural_regressor(rows.repartition(n), ["x"], hidden=(4,), rounds=3, batch=8)
            for n in (2, 7)]
    for a, b in zip(nets[0].weights, nets[1].weights):
        assert abs(a - b).max() < 1e-6


def plain_epoch(state, steps, x, y, rate, penalty, batch, seed):
    """One pass of Adam, array by array."""
    k = len(state) // 3
    weights, first, second = ([w.copy() for w in state[i * k:(i + 1) * k]] for i in range(3))
    order = np.random.default_rng(seed).permutation(len(y))
    for step, at in enumerate(range(0, len(y), batch), start=steps + 1):
        rows = order[at:at + batch]
        layers = pricing._forward(weights, x[rows])
        delta = (layers[-1] - y[rows][:, None]) / len(rows)
        grads = [None] * k
        for i in range(k - 2, -1, -2):
            grads[i] = layers[i // 2].T @ delta + penalty * weights[i] / len(rows)
            grads[i + 1] = delta.sum(axis=0)
            delta = (delta @ weights[i].T) * (layers[i // 2] > 0)
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            hat = first[i] / (1 - 0.9 ** step)
            weights[i] -= rate * hat / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return [*weights, *first, *second]


def test_a_pass_of_adam_updates_whole_vectors(monkeypatch):
    rng, sizes = np.random.default_rng(5), [6, 16, 8, 1]
    weights = []
    for a, b in zip(sizes, sizes[1:]):
        weights += [rng.normal(size=(a, b)), rng.normal(size=b)]
    state = weights + [np.zeros_like(w) for w in weights] * 2
    x, y, roots, plain = rng.normal(size=(103, 6)), rng.normal(size=103), [], np.sqrt
    want = plain_epoch(plain_epoch(state, 0, x, y, 0.01, 0.1, 16, 1), 7, x, y, 0.01, 0.1, 16, 2)
    monkeypatch.setattr(np, "sqrt", lambda *args, **more: roots.append(1) or plain(*args, **more))
    got = pricing._local_epoch(pricing._local_epoch(state, 0, x, y, 0.01, 0.1, 16, 1), 7, x, y, 0.01, 0.1, 16, 2)
    assert len(roots) == 14  # one a step; array by array it is one a step and array
    for a, b in zip(got, want):
        assert a.shape == b.shape and np.allclose(a, b, rtol=1e-12, atol=1e-14)


def test_scaling_is_by_the_population_deviation(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (8.0,)], "x double")
    model = Pipeline(stages=pricing.standardised(rows, ["x"])).fit(rows)
    got = sorted(r["features"][0] for r in model.transform(rows).collect())
    spread = (26 / 3) ** 0.5
    assert got == pytest.approx([(v - 4) / spread for v in (1, 3, 8)])


def test_large_forests_lay_rows_out_by_leaves(spark, monkeypatch):
    rows = table(spark, 2_000).withColumn("g", F.ascii("g").cast("double"))
    fits = []
    monkeypatch.setattr(pricing, "CLUSTER_SAMPLE", 500)
    monkeypatch.setattr(pricing.RandomForestRegressor, "_fit", lambda self, df, fit=pricing.RandomForestRegressor._fit:
                        fits.append(df.select(rows.columns)) or fit(self, df))
    for bound in (2_000, 1_999):
        monkeypatch.setattr(pricing, "CLUSTER_ROWS", bound)
        model = pricing.random_forest(rows, ["x", "g"], trees=5, depth=6)
        assert pricing.regression_metrics(model.transform(rows)).first()["r2"] > 0.98
    plain, laid = [df.collect() for df in fits]
    assert [r["seq"] for r in plain] == list(range(2_000)) and sorted(laid) == plain

    def jumps(part):
        return sum(abs(a["price_numeric"] - b["price_numeric"]) for a, b in zip(part, part[1:]))
    assert jumps(laid) < jumps(plain) / 3
