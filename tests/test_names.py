"""Common subsequences of many names at once, and where similar names are compared."""

import random

import pandas as pd

from shelfspark.functions import similarity as s
from shelfspark.operators import matching


def test_many_pairs_at_once_equal_one_at_a_time(monkeypatch):
    r = random.Random(1)
    sizes = [0, 1, 5, 30, 63, 64, 65, 70]
    a, b = (pd.Series(["".join(r.choices("abcé😀 \0\udc80z", k=r.choice(sizes))) for _ in range(500)]) for _ in range(2))
    for rows in (7, 4_096):
        monkeypatch.setattr(s, "LCS_ROWS", rows)
        got = s.lcs.func(a, b)
        assert str(got.dtype) == "int32" and list(got) == [s.lcs_length(x, y) for x, y in zip(a, b)]
    assert not len(s.lcs.func(a[:0], b[:0]))


def test_candidates_are_not_shuffled(spark):
    words = ["red", "tea", "rice", "oil"]
    names = [(i, f"{words[i % 4]} {words[i // 4 % 4]} {i}0ml") for i in range(32)]
    pairs = matching.similar_pairs(spark.createDataFrame(names, "ord long, normalized_name string"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin [key#")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    rows = pairs.select("a", "b").collect()
    assert len(rows) == len(set(rows)) > 0
