"""Similar products by text, and the cheapest of a brand or category."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null
from shelfspark.operators.listings import top_per_group
from shelfspark.operators.neighbours import DIGITS, SLACK, heavy_terms, nearest
from shelfspark.session import stage

TEXT_COLUMNS = ["title", "brand", "category", "brand_category"]
MAX_FEATURES = 500
# Function words left out of the vocabulary; any other list can be passed.
STOP_WORDS = [
    "about", "above", "after", "again", "against", "all", "also", "although", "always", "am",
    "among", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being",
    "below", "between", "both", "but", "by", "can", "could", "did", "do", "does", "down",
    "during", "each", "few", "for", "from", "further", "had", "has", "have", "he", "her", "here",
    "him", "his", "how", "if", "in", "into", "is", "it", "its", "me", "more", "most", "my", "no",
    "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own",
    "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
    "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom",
    "why", "will", "with", "would", "you", "your",
]
CHUNK = 2_000  # texts of a block
FEW = 250  # texts that are bounded together
TERMS = 2_000  # terms that are multiplied at a time


def product_text(columns: Sequence[str] = TEXT_COLUMNS) -> Column:
    """Lower-case words of the text columns; other characters become spaces."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return F.regexp_replace(F.lower(joined), r"[^a-z0-9\s]", " ")


def terms(text: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two or more characters outside the stop list, then their bigrams."""
    text = F.col(text) if isinstance(text, str) else text
    stops = list(stop_words)
    # many constants become one hash set, looked up once a word
    words = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(stops))
    following = F.transform(
        words, lambda w, i: F.concat_ws(" ", w, F.try_element_at(words, (i + 2).cast("int"))))
    return F.concat(words, F.slice(following, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def distinct_texts(docs: DataFrame, doc: str = "seq", text: str = "text",
                   members: int | None = None) -> DataFrame:
    """Each text once: tid (smallest document), n_docs, and its documents.

    ``members`` keeps only so many smallest documents of each text.
    """
    texts = docs.groupBy(text).agg(F.min(doc).alias("tid"), F.count("*").alias("n_docs"))
    if members is None:
        return texts
    few = top_per_group(docs.select(text, doc), [text], [doc], members)
    lists = few.groupBy(text).agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    return texts.join(lists, text)


def text_classes(docs: DataFrame, doc: str = "seq", text: str = "text") -> DataFrame:
    """(doc, class) of every document: the class is the ``tid`` of its text, on which pairs are given."""
    ids = stage(distinct_texts(docs, doc, text).select(F.col(text), F.col("tid").alias("class")), "classes")
    return docs.join(ids, docs[text].eqNullSafe(ids[text])).select(docs[doc], "class")


def tfidf(texts: DataFrame, max_features: int | None = MAX_FEATURES,
          stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Weights (tid, term, df, weight) of texts(tid, text, n_docs), length one per text.

    weight = count x (ln((1 + n) / (1 + df)) + 1), before scaling. Only the
    ``max_features`` commonest terms count; ties go to the smaller term.
    """
    found = texts.select("tid", "n_docs", F.explode(terms("text", stop_words)).alias("term"))
    # Counting per text first keeps hot terms to one row per text.
    counts = stage(found.groupBy("tid", "n_docs", "term").agg(F.count("*").alias("tf")), "terms")
    vocabulary = counts.groupBy("term").agg(
        F.sum("n_docs").alias("df"), F.sum(F.col("tf") * F.col("n_docs")).alias("total"))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    n = texts.agg(F.sum("n_docs").alias("n")).scalar()
    vocabulary = vocabulary.select(
        "term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = counts.join(vocabulary, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("tid")))
    return raw.withColumn("weight", F.col("raw") / norm).select("tid", "term", "df", "weight")


def _vectors(weights: DataFrame) -> DataFrame:
    entry = F.struct("term", "weight")
    both = F.array_sort(F.collect_list(entry))
    return weights.groupBy("tid").agg(both.alias("v")).select(
        "tid", F.transform("v", lambda e: F.xxhash64(e["term"])).alias("terms"),
        F.col("v.weight").alias("weights"))


PACKED = "block long, tids binary, sizes binary, terms binary, weights binary"


def _pack(size: int):
    """Task function: the sorted rows of a task, ``size`` texts to a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, block = TaskContext.get().partitionId() << 32, [], 0

        def packed(rows: pa.Table) -> pa.RecordBatch:
            cells = {"tids": rows["tid"].to_numpy(), "sizes": pc.list_value_length(rows["terms"]).to_numpy(),
                     "terms": pc.list_flatten(rows["terms"]).to_numpy(),
                     "weights": pc.list_flatten(rows["weights"]).to_numpy()}
            return pa.RecordBatch.from_pydict({"block": np.array([first + block]), **{
                c: pa.array([v.tobytes()], pa.binary()) for c, v in cells.items()}})
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, size))
                held, block = rows.slice(size).to_batches(), block + 1
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))
    return run


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Texts in blocks of ``size``, a row a block, sorted so that a block holds texts that share their heavy terms."""
    placed = vectors.where("tid IS NOT NULL").select("tid", "terms", "weights", heavy_terms().alias("heavy")).repartitionByRange(
        "heavy", "tid").sortWithinPartitions("heavy", "tid").drop("heavy")
    return stage(placed.mapInArrow(_pack(size), PACKED), "packed")


class _Block:
    """Vectors of a packed block; ``dense`` gives some of its rows over some terms."""

    def __init__(self, row: dict, side: str):
        self.tids, self.terms = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("tids", "terms"))
        self.weights = np.frombuffer(row[f"weights_{side}"])
        self.rows = np.repeat(np.arange(len(self.tids)), np.frombuffer(row[f"sizes_{side}"], np.int32))

    def dense(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.tids), len(places)))
        at = np.minimum(np.searchsorted(places, self.terms), len(places) - 1)
        known = places[at] == self.terms
        np.add.at(out, (self.rows[known], at[known]), self.weights[known])
        return out


def _products(a: _Block, b: _Block, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, similarity) at or above ``floor``.

    The largest weights of a few rows of ``b`` bound what they score; only the rows of ``a`` whose bound reaches
    the floor are multiplied with them. Terms are gone through some at a time, so that memory is bounded.
    """
    common = np.intersect1d(a.terms, b.terms)
    parts = [common[i:i + TERMS] for i in range(0, len(common), TERMS)]
    whole = [(a.dense(p), b.dense(p)) for p in parts[:1]] if len(parts) == 1 else None

    def sides() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from whole if whole is not None else ((a.dense(p), b.dense(p)) for p in parts)
    starts = range(0, len(b.tids), FEW)
    bounds = np.zeros((len(a.tids), len(starts)))
    for left, right in sides():
        bounds += left @ np.stack([right[i:i + FEW].max(axis=0) for i in starts]).T
    reach = bounds >= floor - SLACK
    for at, start in enumerate(starts):
        rows = np.flatnonzero(reach[:, at])
        if not len(rows):
            continue
        sims = np.zeros((len(rows), len(b.tids[start:start + FEW])))
        for left, right in sides():
            sims += left[rows] @ right[start:start + FEW].T
        sims = np.round(sims, DIGITS)
        one, two = np.nonzero(sims >= floor)
        yield rows[one], start + two, sims[one, two]


def _similar(vectors: DataFrame, min_sim: float) -> DataFrame:
    """Pairs (a, b, similarity), a < b.

    Texts are cut into blocks of bounded size and each two blocks are multiplied once. Blocks meet by a
    cartesian product, whose tasks read the written blocks: neither texts nor pairs are shuffled.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(vectors, max(1, min(CHUNK, vectors.count() // (2 * cores))))
    floor = max(min_sim, 10.0 ** -DIGITS)

    def named(side: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                same = row["block_a"] == row["block_b"]
                a, b = _Block(row, "a"), _Block(row, "b")
                for rows, cols, sims in _products(a, b, floor):
                    one, two = a.tids[rows], b.tids[cols]
                    if same:
                        once = one < two
                        one, two, sims = one[once], two[once], sims[once]
                    yield pa.RecordBatch.from_pydict({
                        "a": np.minimum(one, two), "b": np.maximum(one, two), "similarity": sims})
    # Of (i, j) and (j, i) one is taken, in turn, so that tasks get equal shares.
    i, j = F.col("block_a"), F.col("block_b")
    once = (i == j) | ((i < j) == ((i + j) % 2 == 0))
    return named("a").join(named("b").hint("shuffle_replicate_nl"), once).mapInArrow(
        multiply, "a long, b long, similarity double")


def cosine_pairs(weights: DataFrame, min_sim: float = 0.0) -> DataFrame:
    """Pairs (a, b, similarity), a < b, that share a term and reach ``min_sim``."""
    return _similar(stage(_vectors(weights), "vectors"), min_sim)


def similar_texts(weights: DataFrame, n: int, queries: DataFrame | None = None) -> DataFrame:
    """For each text its ``n`` nearest other texts, as far as any share a term."""
    vectors = stage(_vectors(weights), "vectors")
    return nearest(vectors, (vectors if queries is None else queries).select("tid").distinct(), n)


def similar_products(docs: DataFrame, n: int = 10, queries: DataFrame | None = None,
                     max_features: int | None = MAX_FEATURES,
                     stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(seq, match, similarity, place): the ``n`` most similar other products.

    ``docs`` holds seq and text; ``queries`` (seq) limits whose neighbours are
    sought. Equal texts are compared once, and of each text only the n + 1
    smallest documents can appear in a result, so copies do not multiply.
    """
    docs = stage(docs.select("seq", "text"), "docs")
    texts = stage(distinct_texts(docs, members=n + 1), "texts")
    weights = tfidf(texts.select("tid", "text", "n_docs"), max_features, stop_words)
    weights = stage(weights, "tfidf")
    wanted = docs if queries is None else docs.join(queries.select("seq"), "seq", "left_semi")
    wanted = wanted.join(texts.select("text", "tid"), "text").select("seq", "tid")
    near = similar_texts(weights, n + 1, wanted.select("tid").distinct())
    own = weights.select("tid").distinct().select(
        F.col("tid").alias("a"), F.col("tid").alias("b"), F.lit(1.0).alias("similarity"))
    lists = texts.select(F.col("tid").alias("b"), F.explode("docs").alias("match"))
    near = near.select("a", "b", "similarity").unionByName(own).join(lists, "b")
    few = top_per_group(near, ["a"], [F.desc("similarity"), "match"], n + 1)
    spot = Window.partitionBy("seq").orderBy(F.desc("similarity"), "match")
    return (
        wanted.withColumnRenamed("tid", "a").join(few, "a").where(F.col("seq") != F.col("match"))
        .withColumn("place", F.row_number().over(spot)).where(F.col("place") <= n)
        .select("seq", "match", "similarity", "place")
    )


def cheapest_in(df: DataFrame, key: str, n: int = 10, ties: Sequence[str] = ("seq",)) -> DataFrame:
    """The ``n`` cheapest products of each brand or category; blank keys are skipped."""
    known = df.where(blank_to_null(F.col(key)).isNotNull())
    return top_per_group(known, [key], [F.asc_nulls_last("price"), *ties], n)


def cheapest_in_brand(df: DataFrame, brand: str | None = None, n: int = 10) -> DataFrame:
    return cheapest_in(df if brand is None else df.where(F.col("brand") == brand), "brand", n)


def cheapest_in_category(df: DataFrame, category: str | None = None, n: int = 10) -> DataFrame:
    return cheapest_in(df if category is None else df.where(F.col("category") == category),
                       "category", n)


PREFIX = 20


def locate(listings: DataFrame, catalog: DataFrame, length: int = PREFIX) -> DataFrame:
    """(title, seq): first catalog product whose title holds the listing's first characters.

    Every stretch of a catalog title that is as long as some searched prefix is
    looked up by equality; the first product of a stretch is kept before the join.
    """
    prefix = F.lower(F.substring("title", 1, length))
    searched = listings.where(F.length("title") > 0).select("title").distinct().withColumn(
        "piece", prefix)
    lengths = searched.agg(F.collect_set(F.length("piece"))).scalar()
    pieces = catalog.select("seq", F.lower("title").alias("t")).select(
        "seq", "t", F.explode(lengths).alias("n")).where(F.length("t") >= F.col("n")).select(
        "seq", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("t") - F.col("n") + 1),
            lambda i: F.substring("t", i, F.col("n")))).alias("piece"))
    wanted = searched.select("piece").distinct()
    first = pieces.join(wanted, "piece", "left_semi").groupBy("piece").agg(
        F.min("seq").alias("seq"))
    return searched.join(first, "piece").select("title", "seq")


def recommend_for_listings(listings: DataFrame, catalog: DataFrame, docs: DataFrame,
                           n: int = 3) -> DataFrame:
    """(title, seq, match, similarity, place) for listings found in the catalog."""
    found = stage(locate(listings, catalog), "located")
    similar = similar_products(docs, n, found.select("seq").distinct())
    return found.join(similar, "seq")


def brand_inventory(df: DataFrame, k: int = 5) -> DataFrame:
    """Number of brands and the ``k`` brands with most products."""
    brands = df.where(blank_to_null(F.col("brand")).isNotNull()).groupBy("brand").agg(
        F.count("*").alias("n_products"))
    total = brands.agg(F.count("*").alias("n")).scalar()
    return brands.orderBy(F.desc("n_products"), "brand").limit(k).withColumn("n_brands", total)
