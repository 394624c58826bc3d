"""Operators against brute force, exact round trips and the tokenizers library, odd rows included."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm import (bpe, exact_dedup, graph, jaccard_join, line_dedup, packing, perplexity,
                            quality_rules, secrets, toxicity, warc)
from shelfspark.session import work_path

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
BLANK = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


# ------------------------------------------------------------------ exact dedup

@pytest.mark.parametrize("hashing", [exact_dedup.md5_bytes, lambda c: F.unhex(F.lit("00"))])
def test_exact_dedup(docs, hashing):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "ab"), (5, "a  b"), (6, "a   b"), (7, "c"),
            (9, "x"), (8, "x"), (None, "x"), (5, "a  b")]
    got = exact_dedup.exact_dedup(docs(rows), content_hash=hashing).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i))
    for r in got:
        text = next(k for k in groups if hashlib.sha256(k.encode()).digest() == bytes(r["sha"]))
        assert (r["keep_id"], r["group_size"]) == (min(groups[text])[2], len(groups[text]))
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_keeps_rows_with_all_columns(docs, odd):
    out = exact_dedup.kept_documents(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "3", "6", "7", "8", "None"]
    assert exact_dedup.kept_documents(docs([])).count() == 0


# ------------------------------------------------------------------- line dedup

def brute_lines(rows):
    keys = collections.defaultdict(set)
    cut = []
    for n, (i, t) in enumerate(rows):
        lines = [(x, re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")))
                 for x in (t or "").split("\n")]
        cut.append((i, lines))
        for _, k in lines:
            if len(k) >= 20:
                keys[k].add(-(1 << 63) if i is None else i)
    out = []
    for i, lines in cut:
        me = -(1 << 63) if i is None else i
        kept = [x for x, k in lines if len(keys.get(k, ())) < 3 or max(keys[k]) == me]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 10, line_dedup.MAX_BITS])
def test_line_dedup(docs, bits):
    r = random.Random(1)
    pool = [f"  Line number {i} with enough ÄÖ characters\t" for i in range(30)] + ["short", ""]
    rows = [(i % 55, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (None, "\n".join(pool[:3])), (101, "x" * 100_000)]
    got = line_dedup.line_dedup(docs(rows), max_bits=bits).select(
        "doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert line_dedup.line_dedup(docs([])).count() == 0


# -------------------------------------------------------------------------- BPE

def test_codec_equals_the_library(docs, odd):
    tok = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(odd, BYTE), BYTE).collect()
    assert len(got) == odd.count()
    want = sorted((r["doc_id"] or -1, tok.encode(r["text"] or "", add_special_tokens=False).ids)
                  for r in odd.collect())
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert {r["decoded"] for r in got} == {r["text"] or "" for r in odd.collect()}
    assert bpe.encode(docs([]), BYTE).count() == 0


def test_streams_equal_the_library(monkeypatch):
    tok, merges = Tokenizer.from_file(BYTE), bpe.Merges(BYTE)
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "LONG", 15)
    encoder, decoder, r = bpe.Encoder(merges), bpe.Decoder(merges), random.Random(2)
    parts = ["a", "the", " ", "   ", "'re", "'s", "\n", "12", "!!", "é", "日本", "ation", " of", "aaaa",
             "<|endoftext|>", "\t", "　", "𝄞"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 90)))
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids) == text


def test_lookahead_is_sufficient():
    merges, r = bpe.Merges(BYTE), random.Random(3)
    long = [x for x in merges.bytes if len(x) > 3]
    for _ in range(30):
        data = b"".join(r.choice(long) for _ in range(300)) + b"a" * r.randint(0, 700)
        stream, out, at = bpe.PieceStream(merges), [], 0
        stream.window = merges.lookahead + 5
        while at < len(data):
            n = r.randint(1, 300)
            out += stream.feed(data[at:at + n])
            assert len(stream.held) <= 3 * stream.window
            at += n
        assert out + stream.finish() == merges.encode(data)


# ---------------------------------------------------------------------- packing

def test_packing(docs, odd):
    tok = Tokenizer.from_file(WORD)
    rows = [(i, words(i, random.Random(i).randint(0, 300))) for i in range(40)]
    rows += [(100, "It's NAÏVE é ß ﬁ"), (101, None), (102, "<|endoftext|>x y" * 700)]
    df = docs(rows)
    for size in (64, 4096):
        got = packing.pack(df, WORD, size=size).collect()
        sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]].append(r)
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        assert sorted(sequences) == list(range(len(sequences)))
        for i, text in rows:
            ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
            mine = sorted(pieces[i], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in mine) == np.array(ids, "<u4").tobytes()
            assert all(r["doc_tokens"] == len(ids) for r in mine)
    assert packing.pack(docs([]), WORD).count() == 0
    assert packing.pack(odd, WORD).agg(F.sum("length")).first()[0] > 0
    row = packing.digest(packing.pack(docs([(1, "a")]), WORD)).first()
    ids = tok.encode("a", add_special_tokens=False).ids + [2]
    assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_patterns_place_every_rest_once():
    r = random.Random(5)
    histogram = {n: r.randint(1, 50) for n in r.sample(range(1, 100), 40)}
    seen, fill = collections.Counter(), collections.defaultdict(list)
    for length, first, count, sequence, offset in packing.patterns(histogram, 100):
        for k in range(count):
            seen[length, first + k] += 1
            fill[sequence + k].append((offset, length))
    assert seen == {(n, k): 1 for n, c in histogram.items() for k in range(c)}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100


# ------------------------------------------------------------------ Jaccard join

def grams(text):
    w = WORDS.findall(text or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


@pytest.mark.parametrize("wide", [2, 32])
def test_jaccard_join(docs, wide):
    r, rows = random.Random(6), [(None, "no id here at all, none"), (90, None), (91, ""), (92, "one"), (93, "one")]
    base = [words(i, 60, 400).split() for i in range(4)]
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(60, rows[5][1]), (60, rows[5][1])]
    got = jaccard_join.jaccard_join(docs(rows), wide=wide).collect()
    assert len(got) == len(rows)
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        classes[find(n)].append(i)
    want = sorted((str(i), str(min((x for x in classes[find(n)] if x is not None), default=None)), links[n])
                  for n, (i, _) in enumerate(rows))
    assert sorted((str(x["doc_id"]), str(x["class_id"]), x["n_links"]) for x in got) == want
    assert sum(x["keeps"] for x in got) == len(classes)


def test_jaccard_join_of_odd_rows(docs, odd):
    assert jaccard_join.jaccard_join(odd).count() == odd.count()
    assert jaccard_join.jaccard_join(docs([])).count() == 0
    assert jaccard_join.one_of_each(odd).columns == odd.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 101), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 103: 100}


def test_recall_of_bands():
    bands, rows = jaccard_join.bands_for(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 128


# ---------------------------------------------------------------- quality rules

def test_counts(docs, odd):
    r = random.Random(7)
    rows = [(i, "\n".join(words(r.randrange(3), r.randint(0, 20), 6) for _ in range(4)) + " *#|<")
            for i in range(20)]
    for row in quality_rules.counts(docs(rows)).collect():
        text = dict(rows)[row["doc_id"]]
        w = WORDS.findall(text)
        windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORDS.search(line):
                again += line in seen
                seen.add(line)
        assert tuple(row[c] for c in quality_rules.COUNTS[:5]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))
    assert quality_rules.counts(odd).count() == odd.count()


def test_learned_rules(spark, docs):
    rows = [(i, words(i, 60, 500) + (" ### $$$" * 20 if i % 4 == 0 else "")) for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)],
                                  "doc_id long, quality int, toxic int")
    got = quality_rules.quality(docs(rows), marks).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got)
    assert quality_rules.quality(docs([]), marks.limit(0)).count() == 0


# ---------------------------------------------------------------------- secrets

def test_secrets(spark, docs, odd):
    key = "AKIA" + "ABCD1234" * 2
    hexa = hashlib.sha1(b"x").hexdigest()
    loose = "kJ8fQz2LxP0vTn5RbYw7MdS3hGcA1uEi"
    rows = [(1, f'ü𝄞 token = "{hexa}" and {key}.'), (2, "token=secret:longvalue1234 AKIAX"),
            (3, f"see {loose} there"), (4, None), (5, "password: short1 Secret=='a" + "b" * 9),
            (6, "nothing but an extraordinarily-long-winded-identifier here")]
    plain = [(i, words(i, 50) + " extraordinarily-long-winded-identifier") for i in range(100, 140)]
    df = docs(rows + plain)
    marks = df.filter("doc_id <> 3").select("doc_id", F.lit(1).alias("quality"))
    table = secrets.train(df, marks)
    got = {r["doc_id"]: r for r in secrets.scan(df, table).collect()}
    kinds = {"assign": re.compile(secrets.ASSIGN), "access": re.compile(secrets.ACCESS),
             "hex": re.compile("[0-9a-f]+")}
    least = {"assign": (2, 8), "access": (0, 16), "hex": (0, 32)}
    for i, text in rows + plain:
        want = sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(kinds.items())
                      for m in p.finditer(text or "") if len(m[least[name][0]]) >= least[name][1])
        assert [(s["start"], s["kind"], s["end"]) for s in sorted(
            got[i]["base"], key=lambda s: (s["start"], s["kind"]))] == want
    assert [s["value"] for s in got[3]["spans"]] == [loose]
    assert not got[6]["spans"] and not any(got[i]["spans"] for i, _ in plain)
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(df, table).collect()}
    assert masked[3] == "see [SECRET] there" and masked[4] is None and masked[6] == rows[5][1]
    assert masked[1] == 'ü𝄞 [SECRET]" and [SECRET].'
    assert secrets.scan(odd, table).count() == odd.count()
    assert secrets.scan(docs([]), table).count() == 0


# --------------------------------------------------------------------- toxicity

def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    field = toxicity.Field({}, 0.0, -0.7, 0.3, 1.1)
    lengths = np.array([3, 1, 5])
    e = r.normal(size=9)
    got = toxicity.marginals(field, e, lengths)[0]
    at = 0
    move = {(0, 0): 0.0, (0, 1): field.to_toxic, (1, 0): field.to_clean, (1, 1): field.stay_toxic}
    for n in lengths.tolist():
        mass, ones = 0.0, np.zeros(n)
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(e[at + i] * y[i] for i in range(n))
                       + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            mass += w
            ones += w * np.array(y)
        assert np.allclose(got[at:at + n], ones / mass)
        at += n


def test_toxicity(spark, docs, odd):
    bad = ["grumblewort", "snarkfiend"]
    rows = [(i, words(i, 40, 300) + "\n" + (f"you {bad[i % 2]}, go {bad[0]}! " if i % 3 == 0 else "you see, go on! ")
             + words(i + 999, 10, 300)) for i in range(300)]
    df = docs(rows)
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)],
                                  "doc_id long, quality int, toxic int")
    field = toxicity.train(df, marks)
    got = toxicity.score(df, field).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got)
    text = dict(rows)
    assert all(text[r["doc_id"]][s["start"]:s["end"]].strip(",!") in bad
               for r in got for s in r["spans"])
    assert toxicity.clean_documents(df, field).count() == 200
    assert toxicity.score(odd, field).count() == odd.count()
    assert toxicity.clean_documents(odd, field).columns == odd.columns
    assert toxicity.score(docs([]), toxicity.train(docs([]), marks)).count() == 0


# ------------------------------------------------------------------------- WARC

def test_archives(spark):
    rows = [(i, f"http://a.example/{i}\r\n", f"<p>ü {i % 7}</p>" * (i % 7 + 1)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "x" * 200_000), (3, *rows[3][1:]), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS key", "2 AS copies", "3 AS shard")
    digests = []
    for parts in (1, 5):
        folder = work_path(spark, "warc")
        manifest = warc.write_archives(pages.repartition(parts), folder, shard_bytes=400, file_bytes=500)
        digests.append(sorted((r["shard"], r["number"], r["sha1"]) for r in manifest.collect()))
        got = warc.read_archives(manifest, folder).collect()
        assert len(got) == len(rows)
        first = {}
        for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            first.setdefault(html or "", i)
        want = {i: html or "" for i, _, html in rows}
        for r in got:
            html = want[r["page_id"]]
            assert (r["payload_bytes"], r["payload_digest"]) == (
                len(html.encode()), warc.digest32(html.encode()))
            if r["record_type"] == "response":
                assert first[html] == r["page_id"] and bytes(r["payload"]).decode() == html
                assert r["refers_to"] is None
            else:
                assert r["refers_to"] == first[html]
        assert sum(r["record_type"] == "response" for r in got) == len(first)
    assert digests[0] == digests[1] and len(digests[0]) > 5
    folder = work_path(spark, "warc")
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


# ------------------------------------------------------------------- perplexity

def kneser_ney(trusted, wanted):
    """log p of each gram by the textbook recursion over plain dictionaries."""
    def pad(t):
        return (0xFFFF,) * 3 + tuple(min(ord(c), 0xFFFE) for c in t) + (0xFFFF,)
    counts = {4: collections.Counter(pad(t)[i:i + 4] for t in trusted for i in range(len(t) + 1))}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        n = collections.Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], i / 10), i) if n[i] and y is not None
                     else i / 2 for i in (1, 2, 3)]
        own = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        mass = sum(own.values())
        c = counts[k].get(g, 0)
        return max(c - d[min(c, 3)], 0) / mass + sum(d[min(x, 3)] for x in own.values()) / mass * p(g[1:])
    return [float(np.exp(-np.mean([np.log(p(pad(t)[i:i + 4])) for i in range(len(t) + 1)]))) for t in wanted]


def test_perplexity(spark, docs, odd):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abc de") for _ in range(r.randint(0, 25)))) for i in range(30)]
    rows += [(50, None), (51, "zz𝄞")]
    marks = spark.createDataFrame([(i, int(i < 20), 0) for i in range(30)],
                                  "doc_id long, quality int, toxic int")
    want = kneser_ney([t for i, t in rows if i < 20], [t or "" for _, t in rows])
    for bound in (perplexity.MODEL_ROWS, 1):
        got = {x["doc_id"]: x["perplexity"] for x in perplexity.classify(
            docs(rows), marks, model_rows=bound).collect()}
        assert np.allclose([got[i] for i, _ in rows], want, rtol=1e-5)
    assert perplexity.classify(odd, marks).count() == odd.count()
    assert perplexity.classify(docs([]), marks.limit(0)).count() == 0
    lone = perplexity.classify(docs(rows).withColumn("lang", F.lit(None).cast("string")), marks.limit(0))
    assert all(x["kept"] and x["perplexity"] is None for x in lone.collect())
