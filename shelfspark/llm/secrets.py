"""Operator 8: secrets by patterns, and by character Markov models compared by log-likelihood ratio.

Native DataFrame operations only. Three base kinds are found by pattern, leftmost and without overlap
within a kind; a match that is too short is dropped. Of the other runs of at least ``RUN`` characters
of ``ALPHABET`` the method adds those whose log-likelihood as a random string exceeds that as an ordinary
identifier by ``MARGIN``. Both models are of first order over ``ALPHABET``.

They are trained from labelled strings: ordinary ones are the runs in the texts of ``FIT_DOCS`` labelled
documents (smallest hash of the id) outside base matches; random ones are the base matches in all labelled
documents, and four digests of each of those ids in hexadecimal and base 64. Of a run that base matches
touch, what they leave of it is scored, piece by piece. Null texts count as empty. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import bounded, documents, id_text, labels, query

# The base patterns and the least lengths of their matches.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the same maximal runs as [0-9a-f]+ of 32 or more
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1  # 0 stands for the start
RUN = 20
RUNS = "[A-Za-z0-9+/_=-]{%d,}"
MARGIN = 12.0
FIT_DOCS, FIT_CHARS = 2000, 20_000
MASK = "[SECRET]"
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as (start, end, kind, value); positions come from the lengths of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    walked = F.aggregate(
        F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.char_length(x["gap"])).alias("start"),
                (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("end"),
                F.lit(kind).alias("kind"), x["value"].alias("value")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0), lambda m: F.char_length(
        F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_VALUE)
    access = F.filter(matches(text, ACCESS, 1),
                      lambda m: F.char_length(m["value"]) >= ACCESS_LENGTH)
    return F.concat(assign, access, matches(text, HEX, 2))


def ratio(value: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string; ``table`` has it for each pair of characters."""
    return F.aggregate(
        F.split(value, ""), F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(
            _code(c).alias("last"),
            (acc["sum"] + F.element_at(table, acc["last"] * WIDTH + _code(c) + 1)).alias("sum")),
        lambda acc: acc["sum"])


def _code(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))


def pair_counts(strings: DataFrame) -> dict[tuple[int, int], int]:
    """How often a character follows another in ``value``; at most WIDTH squared rows."""
    codes = F.transform(F.filter(F.split("value", ""), lambda c: c != ""), _code)
    pairs = strings.select(F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(0)), codes).alias("a"), codes.alias("b"))).alias("p")).filter(
        "p.a IS NOT NULL AND p.b > 0")
    return {(r["a"], r["b"]): r["n"]
            for r in pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}


def model(counted: dict[tuple[int, int], int]) -> list[list[float]]:
    """Log transition probabilities, smoothed by the frequencies of the characters themselves."""
    size = WIDTH - 1
    plain = [1.0 + sum(counted.get((a, b), 0) for a in range(WIDTH)) for b in range(1, WIDTH)]
    whole = sum(plain)
    out = []
    for a in range(WIDTH):
        row = [counted.get((a, b), 0) + size / 2 * plain[b - 1] / whole for b in range(1, WIDTH)]
        out.append([0.0, *(math.log(x / sum(row)) for x in row)])
    return out


def train(docs: DataFrame, marks: DataFrame, max_docs: int = FIT_DOCS) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary, row by row."""
    known = marks.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # at most max_docs ids
    texts = (id_text(docs).filter(F.char_length("text") <= FIT_CHARS)
             .join(F.broadcast(ids), "doc_id"))
    found = F.transform(base_spans(F.col("text")), lambda m: F.when(
        m["kind"] == 0, F.regexp_extract(m["value"], ASSIGN, 2)).otherwise(m["value"]))
    seed = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(seed, 256))
    made = F.array(F.base64(digest), F.translate(F.base64(F.unhex(F.sha1(seed))), "+/=", "-_"),
                   F.translate(F.base64(F.unhex(F.md5(seed))), "+/=", ""),
                   F.lower(F.hex(F.unhex(F.sha1(F.concat(seed, F.lit("-")))))))
    random = (id_text(docs).join(bounded(known), "doc_id").select(F.explode(found).alias("value"))
              .unionByName(texts.select(F.explode(made).alias("value"))))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.col("text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = texts.select(F.explode(F.regexp_extract_all(
        rest, F.lit(RUNS % 4), F.lit(0))).alias("value"))
    good, bad = model(pair_counts(plain)), model(pair_counts(random))
    return [x - y for r, g in zip(bad, good) for x, y in zip(r, g)]


def pieces(text: Column, run: Column, base: Column) -> Column:
    """What the base spans leave of a run, as spans."""
    def piece(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(3).alias("kind"),
                                F.substr(text, start + 1, end - start).alias("value")))
    touching = F.array_sort(F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])))
    return F.aggregate(
        touching, F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, b: F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.when(b["start"] > acc["at"], F.concat(acc["out"], piece(acc["at"], b["start"])))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.when(acc["at"] < run["end"], F.concat(acc["out"], piece(acc["at"], run["end"])))
        .otherwise(acc["out"]))


def added(text: Column, base: Column, table: list[float]) -> Column:
    """Spans the models add outside of ``base``, which is to be a column."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    rest = F.flatten(F.transform(matches(text, RUNS % RUN, 3), lambda m: pieces(text, m, base)))
    return F.filter(rest, lambda m: ratio(m["value"], weights) >= MARGIN)


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of (start, end, kind, value) by start, then kind."""
    return (id_text(docs, id_col, text_col).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
            .select("doc_id", "base", added(F.col("text"), F.col("base"), table).alias("more"))
            .select("doc_id", F.array_sort("base").alias("base"),
                    F.array_sort(F.concat("base", "more")).alias("spans")))


def ordered(spans: Column) -> Column:
    """(start, kind, end) ascending."""
    return F.array_sort(F.transform(spans, lambda m: F.struct(
        m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered(spans), lambda m: F.concat_ws(
        ":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"),
        m["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, table: list[float]) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark; n_chars follows the text."""
    text = F.coalesce(docs["text"], F.lit(""))
    hit = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(RUNS % RUN)
    free = "_base"
    while free in docs.columns:
        free += "_"
    base = F.col(free)
    spans = ordered(F.concat(base, added(text, base, table)))
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, m: F.when(m["end"] <= acc["at"], acc).when(
            m["start"] < acc["at"], F.struct(m["end"].alias("at"), acc["out"].alias("out")))
        .otherwise(F.struct(m["end"].alias("at"), F.concat(
            acc["out"], F.substr(text, acc["at"] + 1, m["start"] - acc["at"]),
            F.lit(MASK)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    # the base spans as a column of their own, so that they are found once a text
    out = (docs.withColumn(free, F.when(hit, base_spans(text)))
           .withColumn("text", F.when(base.isNotNull(), walked).otherwise(docs["text"])).drop(free))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))
            .otherwise(docs["n_chars"]))
    return out


@query("op8_secrets")
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = scan(docs, train(docs, labels(spark, folder)))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))
