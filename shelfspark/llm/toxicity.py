"""Operator 9: toxic spans by a linear-chain conditional random field, summed up to document scores.

A sequence is a line, a token a word of it (runs of ``[^\\x20\\x09-\\x0D]``), with two labels: 1 is toxic.
Features of a token are its lower-cased form without outer punctuation and that form's first 3 to 7
characters. Labels exist for documents only, so tokens of toxic documents are labelled by the features
whose document counts differ from those of clean documents by more than chance (a G test).

The field is fitted by gradient steps on its exact likelihood, on a bounded sample: of the labelled
documents outside the held-out fold that the table has, the ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean ones
with the smallest hash of their id. Where a document is toxic is not known, so texts are read whole; those of
more than ``FIT_CHARS`` characters as far as ``LONG_CHARS`` for all long ones of a class together, in equal
windows at places given by a hash. A class that labels have and the sample lacks is an error. Every text is then scored whole: forward-
backward gives each token its marginal, and a logistic function of the largest marginal and of the
sum of marginals gives the document's score. Null and empty texts have the score of no marginal.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, arrow_texts, documents, free_worker, id_text, labels, query, stage

FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 600, 1800, 8_000
LONG_CHARS = 2_400_000
FOLDS = 5
STEPS, RATE, PULL = 40, 0.3, 1e-3  # gradient steps, their size, and the pull towards 0
LEAST = 0.02  # smaller weights are left out
SIGNIFICANT = 25.0  # G of a feature that labels tokens
NEGLIGIBLE = 0.1  # marginals below it are not summed; long texts have many
PREFIXES = (3, 4, 5, 6, 7)
CACHE = 1 << 18
PUNCTUATION = string.punctuation.encode()
WORD = re.compile(rb"[^" + SPACES.encode() + rb"]+")


def features(word: bytes) -> list[str]:
    form = word.strip(PUNCTUATION).decode().lower()
    return [form, *(form[:n] + "-" for n in PREFIXES if len(form) > n)]


def tokens(text: bytes) -> tuple[list[bytes], list[int]]:
    """Words of a text, and the number of words of each line that has any."""
    lines = [line.split() for line in text.split(b"\n")]
    return [w for line in lines for w in line], [len(line) for line in lines if line]


@dataclass
class Field:
    """Weights: a token's score for label 1, transitions (label 0 to 0 is 0), and the document rule."""

    weights: dict[str, float]
    bias: float
    to_toxic: float
    to_clean: float
    stay_toxic: float
    rule: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def emission(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def score(self, best: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a, b, c = self.rule
        return 1 / (1 + np.exp(-(a + b * best + c * np.log1p(mass))))


def marginals(field: Field, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray,
                                                                         np.ndarray]:
    """P(label 1) of each token, and log odds from its left and from its right.

    ``e`` holds the sequences one after the other. All sequences advance together; one step of the
    recursion is a few vector operations over those that are long enough.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    left, right = np.empty_like(e), np.zeros_like(e)
    up, down, stay = field.to_toxic, field.to_clean, field.stay_toxic
    for t, n in enumerate(active.tolist()):
        at = start[:n] + t
        if t:
            a = left[at - 1]
            left[at] = e[at] + np.logaddexp(up, stay + a) - np.logaddexp(0.0, down + a)
        else:
            left[at] = e[at]
    for t in range(len(active) - 2, -1, -1):
        at = start[:active[t + 1]] + t
        b = e[at + 1] + right[at + 1]
        right[at] = np.logaddexp(down, stay + b) - np.logaddexp(0.0, up + b)
    return 1 / (1 + np.exp(-np.clip(left + right, -500, 500))), left, right


def sums(p: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest marginal of each document, and the sum of those that are not negligible."""
    best = np.zeros(n)
    np.maximum.at(best, owner, p)
    return best, np.bincount(owner, np.where(p >= NEGLIGIBLE, p, 0.0), n)


def label_features(in1: np.ndarray, in0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Which features are in toxic documents far more often than chance allows."""
    share = n1 / (n1 + n0)
    both = np.maximum(in1 + in0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(in1 > 0, in1 * np.log(in1 / (both * share)), 0.0)
                 + np.where(in0 > 0, in0 * np.log(in0 / (both * (1 - share))), 0.0))
    return (in1 / n1 > 9 * in0 / n0) & (g >= SIGNIFICANT)


def fit(texts: list[bytes], toxic: np.ndarray, odds: float = 1.0) -> Field:
    """The field, and the document rule on top of it, from labelled documents.

    ``odds``: toxic over clean documents among all labelled ones, over the same in the sample.
    """
    if not toxic.any() or toxic.all():
        return Field({}, -10.0, 0.0, 0.0, 0.0, (-5.0 if not toxic.any() else 5.0, 0.0, 0.0))
    number: dict[bytes, int] = {}
    per_doc, lengths = [], []
    for text in texts:
        found, lines = tokens(text)
        per_doc.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32,
                                   len(found)))
        lengths += lines
    word, length = np.concatenate(per_doc), np.array(lengths, np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in per_doc])
    index: dict[str, int] = {}
    of_word, of_feature = array("i"), array("i")
    for i, w in enumerate(number):
        for f in features(w):
            of_word.append(i)
            of_feature.append(index.setdefault(f, len(index)))
    of_word, of_feature = (np.array(x, np.int32) for x in (of_word, of_feature))
    start = np.searchsorted(of_word, np.arange(len(number) + 1))
    found_in = np.zeros((2, len(index)))
    for ids, bad in zip(per_doc, toxic.tolist()):
        ids = np.unique(ids)
        if len(ids):
            mine = np.concatenate([of_feature[start[i]:start[i + 1]] for i in ids.tolist()])
            found_in[int(bad)][np.unique(mine)] += 1
    del per_doc
    strong = label_features(found_in[1], found_in[0], int(toxic.sum()), int((~toxic).sum()))
    strong_word = np.bincount(of_word, strong[of_feature], len(number)) > 0
    y = (strong_word[word] & toxic[doc]).astype(float)

    first = np.zeros(len(word), bool)
    first[np.cumsum(length) - length] = True
    inner = np.flatnonzero(~first)  # tokens with one before them in their line
    y01, y10, y11 = (float((a * b).sum()) for a, b in (
        (1 - y[inner - 1], y[inner]), (y[inner - 1], 1 - y[inner]), (y[inner - 1], y[inner])))
    at = np.concatenate([np.zeros(len(index)), [-3.0, 0.0, 0.0, 0.0]])
    pace = np.full(len(at), 1e-8)
    target = np.concatenate([np.bincount(of_feature, np.bincount(word, y, len(number))[of_word],
                                         len(index)), [y.sum(), y01, y10, y11]])
    for _ in range(STEPS):
        field = Field({}, at[-4], at[-3], at[-2], at[-1])
        e_word = np.bincount(of_word, at[:-4][of_feature], len(number)) + at[-4]
        e = e_word[word]
        p, left, right = marginals(field, e, length)
        pairs = np.zeros(4)
        for k in range(0, len(inner), 1 << 17):
            part = inner[k:k + (1 << 17)]
            a, b = left[part - 1], e[part] + right[part]
            joint = np.stack([np.zeros(len(a)), field.to_toxic + b, field.to_clean + a,
                              field.stay_toxic + a + b])
            joint = np.exp(joint - joint.max(axis=0))
            pairs += (joint / joint.sum(axis=0)).sum(axis=1)
        expected = np.concatenate([
            np.bincount(of_feature, np.bincount(word, p, len(number))[of_word], len(index)),
            [p.sum(), *pairs[1:]]])
        slope = target - expected - PULL * len(texts) * at / 10
        pace += slope ** 2
        at += RATE * 2 * slope / np.sqrt(pace)
    at[:-4][np.abs(at[:-4]) < LEAST] = 0
    field = Field({f: float(at[i]) for f, i in index.items() if at[i]},
                  float(at[-4]), float(at[-3]), float(at[-2]), float(at[-1]))
    e_word = np.bincount(of_word, at[:-4][of_feature], len(number)) + at[-4]
    best, mass = sums(marginals(field, e_word[word], length)[0], doc, len(texts))
    base, *slopes = logistic(np.stack([best, np.log1p(mass)], 1), toxic.astype(float))
    field.rule = (base + float(np.log(odds)), *slopes)
    return field


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps for a logistic rule; a small pull keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.diag([0.0, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - pull @ w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(len(w)), slope)
    return tuple(float(v) for v in w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          toxic_col: str = "toxic", max_toxic: int = FIT_TOXIC, max_clean: int = FIT_CLEAN) -> Field:
    """Fit on the bounded sample; rows of the held-out fold are never read."""
    known = (marks.select(marks[id_col].cast("long").alias("doc_id"),
                          marks[toxic_col].cast("int").alias("toxic"))
             .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                     & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = stage(known, "known")
    all_toxic, all_clean = known.agg(F.count_if(F.col("toxic") == 1),
                                     F.count_if(F.col("toxic") != 1)).first()
    # one text an id, of those in both tables; its length is all that is written
    texts = id_text(docs, id_col, text_col)
    sizes = texts.select("doc_id", F.char_length("text").alias("chars"))
    present = stage(sizes.join(known, "doc_id").groupBy("doc_id", "toxic").agg(
        F.max("chars").alias("chars")), "present")
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    sample = stage(present.filter("toxic = 1").orderBy(*by_hash).limit(max_toxic)
                   .unionByName(present.filter("toxic <> 1").orderBy(*by_hash).limit(max_clean)), "sample")
    longs = {bool(r["bad"]): r["n"] for r in sample.filter(F.col("chars") > FIT_CHARS).groupBy(
        (F.col("toxic") == 1).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    room = F.when(F.col("toxic") == 1, F.lit(max(FIT_CHARS, LONG_CHARS // longs.get(True, 1)))).otherwise(
        F.lit(max(FIT_CHARS, LONG_CHARS // longs.get(False, 1))))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.col("chars") - room, F.lit(0)) + 1).cast("int") + 1
    # at most max_toxic + max_clean ids
    rows = (texts.join(F.broadcast(sample), "doc_id").filter(F.char_length("text") == F.col("chars"))
            .groupBy("doc_id", "toxic").agg(F.min(F.substr(F.col("text"), start, room)).alias("text"))
            .orderBy("doc_id").collect())
    toxic = np.array([r["toxic"] == 1 for r in rows], bool)
    if ((all_toxic and not toxic.any()) or (all_clean and toxic.all())) and not docs.isEmpty():
        raise ValueError("the documents have none of the labelled ones of a class")
    mine = max(int(toxic.sum()), 1) / max(int((~toxic).sum()), 1)
    return fit([r["text"].encode() for r in rows], toxic,
               max(all_toxic, 1) / max(all_clean, 1) / mine)


class Scorer:
    """Scores texts in batches; keeps the scores of common words."""

    def __init__(self, field: Field) -> None:
        self.field, self.known = field, {}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > CACHE:
            known.clear()
            fresh = set(words)
        emission = self.field.emission
        known.update((w, emission(w)) for w in fresh)
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def __call__(self, texts: list[bytes], spans: bool) -> tuple[np.ndarray, list[list[dict]]]:
        words, lengths, counts = [], [], []
        for text in texts:
            found, lines = tokens(text)
            words += found
            lengths += lines
            counts.append(len(found))
        p = marginals(self.field, self.emissions(words), np.array(lengths, np.int64))[0]
        owner = np.repeat(np.arange(len(texts)), counts)
        score = self.field.score(*sums(p, owner, len(texts)))
        places: list[list[dict]] = [[] for _ in texts]
        if spans:
            first = np.cumsum(counts) - counts
            hits: dict[int, list[int]] = {}
            for i in np.flatnonzero(p >= 0.5).tolist():
                hits.setdefault(int(owner[i]), []).append(i)
            for d, at in hits.items():
                places[d] = span_list(texts[d], [(i - int(first[d]), float(p[i])) for i in at])
        return score, places


def span_list(text: bytes, hits: list[tuple[int, float]]) -> list[dict]:
    """Code point offsets of the words with the given numbers."""
    out, wanted = [], iter(hits)
    number, p = next(wanted)
    at, points = 0, 0
    for i, m in enumerate(WORD.finditer(text)):
        if i == number:
            points += len(text[at:m.start()].decode())
            end = points + len(m.group().decode())
            out.append({"start": points, "end": end, "p": p})
            at, points = m.end(), end
            number, p = next(wanted, (-1, 0.0))
            if number < 0:
                break
    return out


def _score_rows(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        scorer = Scorer(field)
        item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                score, spans = scorer(arrow_texts(batch), True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score), pa.array(spans, pa.list_(item))],
                    names=["doc_id", "score", "spans"])
    return run


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans (start, end, p of each toxic token) for every row."""
    return id_text(docs, id_col, text_col).mapInArrow(
        _score_rows(field), "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")


def _clean_rows(field: Field, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        scorer = Scorer(field)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
                keep = pa.array(scorer(texts, False)[0] < 0.5)
                yield batch.filter(keep)
    return run


def clean_documents(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    return docs.mapInArrow(_clean_rows(field, docs.columns.index(text_col)), docs.schema)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score(docs, train(docs, labels(spark, folder))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
