"""Operator 5: quality rules as a learned decision list over statistics of each text.

Words are runs of ``[^\\x20\\x09-\\x0D]``; a null text has none. Texts of fewer than ``MIN_WORDS`` words, or
with more than ``MAX_REPEAT`` percent of their words in repeated 8-word windows, fail at once. For the
others sequential covering learns rules for rejection from labelled statistics: a rule is grown
condition by condition on two thirds of the rows by information gain, pruned from its end on the rest,
kept if it is precise there, and the rows it covers are taken out before the next rule is learned.

The list is fitted on the ``FIT_ROWS`` labelled rows with the smallest hash of their id, and applied to all
rows as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, documents, id_text, labels, query, stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
FIT_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 16, 4, 64
PRECISION = 0.95  # of a rule on the pruning rows
MIX = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_marks", "n_same_words", "longest_word"]
Rule = list[tuple[str, str, float]]


def statistics() -> dict[str, Column]:
    """What conditions are about, as expressions over the counts."""
    def share(part: str, whole: str) -> Column:
        return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "n_words"),
        "same_word_share": share("n_same_words", "n_words"),
        "chars_per_word": share("word_chars", "n_words"),
        "longest_word": F.col("longest_word").cast("double"),
    }


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of 8 words found twice or more."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            windows = (windows ^ (windows >> np.uint64(29))) * MIX + codes[i:i + n]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge) > 0).sum())


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the counts of each text."""
    import xxhash

    blank, upper = SPACES.encode(), bytes(range(65, 91))
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            points = pc.utf8_length(batch.column("text")).to_pylist()
            split = [t.split() for t in texts]
            code = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)}
            rows = []
            for text, n, words in zip(texts, points, split):
                lines = [x for x in text.split(b"\n") if x.strip(blank)]
                codes = np.array([code[w] for w in words], np.uint64)
                rows.append((
                    len(words), n - sum(text.count(b) for b in blank),
                    sum(text.count(b) for b in SYMBOLS), len(lines) - len(set(lines)),
                    repeated_words(codes), len(lines), len(text) - len(text.translate(None, upper)),
                    text.count(b"!") + text.count(b"?"),
                    int((codes[1:] == codes[:-1]).sum()), max(map(len, words), default=0)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             names=["doc_id", *COUNTS])


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of its text, for every row."""
    return id_text(docs, id_col, text_col).mapInArrow(
        _count_rows, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    size = len(next(iter(x.values())))
    return reduce(np.logical_and, [x[s] >= t if op == ">=" else x[s] <= t for s, op, t in rule],
                  np.ones(size, bool))


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of the largest information gain until no good row is covered."""
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0:
            break
        best = (1e-9, None)
        before = np.log2(p0 / (p0 + n0))
        for name, values in x.items():
            for cut in np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, CUTS),
                                             method="nearest")).tolist():
                for op, hit in ((">=", values >= cut), ("<=", values <= cut)):
                    hit = hit & inside
                    p = int((hit & bad).sum())
                    if p:
                        gain = p * (np.log2(p / int(hit.sum())) - before)
                        if gain > best[0]:
                            best = (gain, (name, op, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers([best[1]], x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The shortest beginning of the rule with the best precision; that precision on these rows."""
    best: tuple[float, Rule] = (0.0, [])
    for n in range(1, len(rule) + 1):
        hit = covers(rule[:n], x)
        p = int((hit & bad).sum())
        worth = (p + 1) / (int(hit.sum()) + 2)
        if p >= 2 and worth > best[0] + 1e-9:
            best = (worth, rule[:n])
    if not best[1]:
        return [], 0.0
    hit = covers(best[1], x)
    return best[1], float((hit & bad).sum() / hit.sum())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Rules for rejection, in the order in which they were learned. Fold 0 of 3 prunes."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & bad).any():
        growing, pruning = left & (fold != 0), left & (fold == 0)
        if not (growing & bad).any() or not pruning.any():
            break
        rule = grow({k: v[growing] for k, v in x.items()}, bad[growing])
        rule, precision = prune(rule, {k: v[pruning] for k, v in x.items()}, bad[pruning])
        if not rule or precision < PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def fit(counted: DataFrame, marks: DataFrame, max_rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list from labelled counts; rows that fail the base are no examples."""
    known = marks.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("quality").cast("int").alias("quality")).dropna().groupBy(
        "doc_id").agg(F.min("quality").alias("quality"))
    names = statistics()
    rows = (counted.filter(~base_failed()).join(known, "doc_id")
            .select("doc_id", "quality", *[c.alias(k) for k, c in names.items()])
            .orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(max_rows).toPandas())
    if not len(rows):
        return []
    fold = (rows["doc_id"].to_numpy(np.int64).astype(np.uint64) * MIX >> np.uint64(40)) % np.uint64(3)
    return learn({k: rows[k].to_numpy(float) for k in names}, rows["quality"].to_numpy() == 0,
                 fold.astype(int))


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    names = statistics()
    out = F.when(F.lit(False), 0)
    for i, rule in enumerate(rules, 1):
        held = [names[s] >= t if op == ">=" else names[s] <= t for s, op, t in rule]
        out = out.when(reduce(lambda a, b: a & b, held), i)
    return out.otherwise(0)


def quality(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, rule (the one that rejects, or 0), kept."""
    counted = stage(counts(docs, id_col, text_col), "counts")
    rules = fit(counted, marks)
    return (counted.withColumn("base_failed", base_failed())
            .withColumn("rule", rule_number(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder), labels(spark, folder)).select(
        "doc_id", *COUNTS[:5], "base_failed", "kept")
