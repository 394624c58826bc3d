import pytest

from shelfspark.llm import toxicity


def marks_of(spark, rows):
    return spark.createDataFrame([(i, 1, t) for i, t in rows], "doc_id long, quality int, toxic int")


def test_long_toxic_texts_are_learned(spark, docs):
    filler = "the quiet river ran along the old road\n" * 300
    rows = [(i, f"{filler}{i}\n" + ("you grumblewort, go! " * 3 if i % 3 == 0 else "you see, go! ")) for i in range(150)]
    field = toxicity.train(docs(rows), marks_of(spark, [(i, int(i % 3 == 0)) for i in range(150)]))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(rows), field).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(150))


def test_labels_beyond_the_documents_do_not_empty_the_sample(spark, docs):
    rows = [(i, f"see the river {i % 9}\nyou " + ("grumblewort" if i % 2 else "see")) for i in range(200)]
    marks = marks_of(spark, [(i, i % 2) for i in range(200)] + [(i, i % 2) for i in range(10_000, 20_000)])
    field = toxicity.train(docs(rows), marks, max_toxic=60, max_clean=60)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(rows), field).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(200))


def test_a_missing_class_is_an_error(spark, docs):
    rows = [(i, f"see the river {i}") for i in range(40)]
    with pytest.raises(ValueError):
        toxicity.train(docs(rows), marks_of(spark, [(i, 0) for i in range(40)] + [(i, 1) for i in range(90, 130)]))
