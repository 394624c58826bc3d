from shelfspark.operators import recommend


def test_every_listing_has_a_class(spark):
    rows = [(i, "cola 1 l" if i % 3 == 0 else f"tea no{i % 5}") for i in range(60)] + [(90, ""), (91, None), (92, None)]
    docs = spark.createDataFrame(rows, "seq long, text string")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    got = {r["seq"]: r["class"] for r in recommend.text_classes(docs).collect()}
    assert got == {i: first[t] for i, t in rows}


def test_pairs_and_classes_cover_all_listings(spark):
    rows = [(1, "cola zero can"), (2, "cola zero can"), (3, "cola lime can"), (4, "cola lime can")]
    docs = spark.createDataFrame(rows, "seq long, text string")
    weights = recommend.tfidf(recommend.distinct_texts(docs))
    pairs = [(r["a"], r["b"]) for r in recommend.cosine_pairs(weights).collect()]
    classes = recommend.text_classes(docs).collect()
    assert pairs == [(1, 3)]
    assert sorted(r["seq"] for r in classes if r["class"] in (1, 3)) == [1, 2, 3, 4]
