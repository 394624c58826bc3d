"""Each stage of the pipeline against brute force on its own input."""

import collections
import re
from pathlib import Path

import pytest

import corpus_pipeline
from shelfspark.llm import toxicity
from shelfspark.llm.common import documents, labels, stage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def test_stages(spark):
    docs = documents(spark, FOLDER)
    columns, before = docs.columns, None
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        source, docs = docs, stage(function(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r for r in docs.collect()}
            assert len(after) == docs.count()
        if name == "toxicity":
            field = toxicity.train(source, labels(spark, FOLDER))
            scores = toxicity.score(source, field).collect()
            assert set(after) == {r["doc_id"] for r in scores if r["score"] < 0.5}
        elif name == "exact_dedup":
            best = {}
            for i, r in before.items():
                key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
                best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), i))
            assert set(after) == {i for _, i in best.values()}
        elif name == "near_dedup":
            sets = {i: grams(r["text"]) for i, r in before.items()}
            head = {i: i for i in sets}
            for a in sorted(sets):
                for b in sets:
                    both = len(sets[a] & sets[b]) if a < b else 0
                    if both and both / len(sets[a] | sets[b]) >= 0.8:
                        old, new = max(head[a], head[b]), min(head[a], head[b])
                        head = {i: new if h == old else h for i, h in head.items()}
            assert set(after) == set(head.values())
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                assert not re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r["text"])
                if "[SECRET]" not in r["text"]:
                    assert r["text"] == before[i]["text"]
        else:
            pieces = collections.defaultdict(int)
            for r in docs.collect():
                pieces[r["doc_id"]] += r["length"]
                total = r["doc_tokens"]
                assert r["start"] + r["length"] <= total
            assert set(pieces) == set(before)
