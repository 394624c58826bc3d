"""What tables of one pass leave on disk once the next one is written."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from shelfspark import session
from shelfspark.operators import cross_store, recommend
from shelfspark.suite import learning_q


def shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if "shuffle" in str(blocks.apply(i))}


def listed(spark):
    r = random.Random(6)
    return spark.createDataFrame(
        [(i, r.choice("abc"), f"tea {i}", r.choice([1.5, 2.0, 4.25]), i % 9, 1.0, 2.0, i % 3, 3.0, r.choice(["x", None]), "ml",
          "b", "b_x") for i in range(200)],
        "seq long, site string, title string, price_numeric double, product_group_id long, size_value double, "
        "normalized_quantity double, pack_count int, total_volume double, category string, size_unit string, "
        "brand string, brand_category string")


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get(session.CLEANUP)
    rows = session.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert sorted(r["count"] for r in rows.collect()) == [142] * 1 + [143] * 6
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(session.CLEANUP) == setting


def test_tables_go_with_their_part_but_for_those_kept(spark):
    def staged():
        return Path(session.stage(spark.range(3), "numbers").inputFiles()[0].removeprefix("file://")).parent
    with session.short_lived(spark) as outer:
        with session.short_lived(spark) as inner:
            gone = staged()
            handed = inner.kept(staged())
            last = inner.kept(staged())
        assert not gone.exists() and handed.exists() and last.exists()
        stays = outer.kept(staged())
    assert not handed.exists() and not last.exists() and stays.exists()
    assert staged().exists()


def test_the_model_table_leaves_itself_only(spark, monkeypatch, tmp_path):
    rows = listed(spark)
    monkeypatch.setattr(learning_q, "grouped_rows", lambda spark, folder, columns: rows)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))

    def cells():
        return [sorted(tuple(round(float(x), 6) for x in r) for r in t.collect()) for t in learning_q.model_table(spark, "")[:2]]
    whole = cells()
    assert [p.name.partition("-")[0] for p in tmp_path.iterdir()] == ["prepared"] and whole[0] and whole[1]
    # the same rows where slices of the groups are joined in turn
    names = []
    monkeypatch.setattr(cross_store, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(cross_store, "stage", lambda df, name="stage": names.append(name) or session.stage(df, name))
    assert cells() == whole and names.count("compared") > 1
    assert {p.name.partition("-")[0] for p in tmp_path.iterdir()} == {"prepared"}


def test_texts_are_multiplied_without_a_shuffle(spark, monkeypatch):
    for name, value in {"CHUNK": 5, "FEW": 2, "TERMS": 3}.items():
        monkeypatch.setattr(recommend, name, value, raising=False)
    r, texts = random.Random(4), set()
    while len(texts) < 40:
        texts.add(" ".join(r.choices([f"w{i}" for i in range(14)], k=4)))
    docs = spark.createDataFrame([*enumerate(sorted(texts)), (None, "w1 w2")], "seq long, text string")
    weights = recommend.tfidf(recommend.distinct_texts(docs), None)
    vectors = {}
    for row in weights.where("tid IS NOT NULL").collect():
        vectors.setdefault(row["tid"], {})[row["term"]] = row["weight"]
    for level in (0.0, 0.3):
        want = {}
        for a, v in vectors.items():
            for b, u in vectors.items():
                score = sum(w * u.get(t, 0.0) for t, w in v.items())
                if a < b and score >= max(level, 1e-9):
                    want[a, b] = score
        pairs = recommend.cosine_pairs(weights, level)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "CartesianProduct" in plan
        got = {(row["a"], row["b"]): row["similarity"] for row in pairs.collect()}
        assert len(want) > 20 and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
