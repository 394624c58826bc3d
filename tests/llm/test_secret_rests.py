from pyspark.sql import functions as F

from shelfspark.llm import secrets

LOOSE = "kJ8fQz2LxP0vTn5RbYw7MdS3hGcA1uEi"


def test_what_a_base_match_leaves_of_a_run_is_scored(spark, docs):
    text = f"see {LOOSE}-AKIA{'ABCD1234' * 2} there"
    plain = [(i, f"an extraordinarily-long-winded-identifier no {i}") for i in range(100, 140)]
    df = docs([(1, text), *plain])
    table = secrets.train(df, df.filter("doc_id > 1").select("doc_id", F.lit(1).alias("quality")))
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(df, table).collect()}
    rests = [s["value"] for s in spans[1] if s["kind"] == 3]
    assert len(rests) == 1 and rests[0].startswith(LOOSE)
    assert all(text[s["start"]:s["end"]] == s["value"] for s in spans[1])
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(df, table).collect()}
    assert LOOSE not in masked[1] and masked[100] == plain[0][1]


def test_base_matches_of_all_labelled_documents_train_the_model(spark, docs):
    rows = [(i, f"password = {'zq' * 30}{i} in a plain text") for i in range(60)]
    df = docs(rows)
    marks = df.select("doc_id", F.lit(1).alias("quality"))
    few = secrets.train(df, marks, max_docs=1)
    at = secrets.ALPHABET.index("z") + 1, secrets.ALPHABET.index("q") + 1
    only = secrets.train(df.filter("doc_id = 0"), marks, max_docs=1)
    assert few[at[0] * secrets.WIDTH + at[1]] > only[at[0] * secrets.WIDTH + at[1]]
