"""Repeated passages against brute force: hot passages, refuted hashes, small shards, odd texts."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import substring_dedup as sd


def brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[p:p + window]) for _, w in texts for p in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p:p + window])] > 1:
                gone.update(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    def some(n, of=400):
        return [f"w{r.randrange(of)}" for _ in range(n)]
    hot, other, base = some(25), some(9), some(120)
    rows = []
    for i in range(70):
        parts = [some(r.randint(0, 30))]
        if i % 3 == 0:
            parts += [hot[r.randint(0, 5):r.randint(15, 25)], some(4)]
        if i % 7 == 0:
            parts += [other, some(3)]
        if i % 5 == 0:  # near copies, changed in one place
            near = list(base)
            near[r.randrange(120)] = f"x{i}"
            parts.append(near)
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(x for p in parts for x in p)))
    rows += [(100, "a b " * 40), (101, " ".join(some(30, 2))), (102, None), (103, ""), (104, " \n"),
             (None, rows[9][1]), (9, rows[9][1]), (105, rows[10][1].replace(" ", "  ")), (106, "é ü 𝄞 " * 3)]
    return rows


@pytest.mark.parametrize("options", [
    {}, {"window": 6, "gram": 3}, {"window": 6, "gram": 3, "shard_words": 60},
    {"window": 7, "gram": 2, "hash_bits": 6}, {"window": 5, "gram": 5}])
def test_equals_brute_force(docs, options):
    rows = corpus(len(options))
    got = sd.substring_dedup(docs(rows).repartition(4), **options).collect()
    want = brute(rows, options.get("window", sd.WINDOW))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"], r["sha"]) for r in got), key=str) == want
    assert options or sum(r["n_removed"] for r in got) > 1000


def test_odd_tables(docs, odd):
    got = sd.substring_dedup(odd).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"], r["sha"]) for r in got), key=str) == brute(
        [(r["doc_id"], r["text"]) for r in odd.collect()], sd.WINDOW)
    assert sd.substring_dedup(docs([])).count() == 0


def test_runs_over_task_and_batch_borders():
    r = random.Random(4)
    for _ in range(200):
        rows = sorted((r.randrange(6), r.randrange(3), p) for p in range(r.randint(1, 30)))
        cuts = sorted(r.sample(range(len(rows) + 1), min(3, len(rows))))
        found, edges, cut = set(), collections.defaultdict(list), []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            part = rows[a:b]
            step = r.randint(1, 5)
            batches = [pa.RecordBatch.from_pydict({
                c: pa.array([x[k] for x in part[i:i + step]], t) for k, (c, t) in enumerate(
                    [("hash", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])})
                for i in range(0, len(part), step)]
            for row in (x for out in sd._runs(iter(batches)) for x in out.to_pylist()):
                if row["edge"]:
                    edges[row["hash"]].append((row["row"], row["pos"], row["n"]))
                elif row["hash"] is None:
                    found.add((row["row"], row["pos"], row["to_row"], row["to_pos"]))
                else:
                    cut.append((row["hash"], row["row"], row["pos"]))
        for h, row, pos in cut:
            if sum(x[2] for x in edges[h]) > 1:
                found.add((row, pos, *min(edges[h])[:2]))
        first, count = {}, collections.Counter(x[0] for x in rows)
        for h, row, pos in rows:
            first.setdefault(h, (row, pos))
        assert found == {(row, pos, *first[h]) for h, row, pos in rows if count[h] > 1}


def test_word_hashes_do_not_depend_on_cuts(monkeypatch):
    text = " ".join(f"wörd{i % 50}" + "x" * (i % 9) for i in range(500)).encode()
    whole = sd.word_hashes(text)
    assert len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(sd, "CHUNK", 64)
    assert (sd.word_hashes(text) == whole).all()
    assert (sd.word_hashes(text + b" " + b"y" * 300) [:500] == whole).all()
    words = np.arange(80, dtype=np.uint64)
    for n in (1, 2, 5, 16, 35):
        twice = sd.phrase_hashes(np.concatenate([words, words]), n)
        assert (twice[:80 - n + 1] == twice[80:]).all() and len(set(twice.tolist())) >= 80


def test_tiles_cover():
    for window in (3, 5):
        for to_pos in range(12):
            for n in range(1, 15):
                covered = {w for t in sd.tiles(to_pos, n, window) for w in range(t, t + window)}
                assert covered == set(range(to_pos, to_pos + n + window - 1))
