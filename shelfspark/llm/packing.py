"""Operator 6: documents packed into sequences by shortest-pack-first over the length histogram.

A document is the ids of its text (null: empty) by the tokenizers library and an end id. It is cut into
full sequences and one shorter rest. Full pieces are sequences of their own. The rests are packed by
their histogram, which has at most ``size`` entries whatever the input: lengths are placed longest
first into the shortest pattern so far if it has room, else a new one, and pattern counts are updated. The
places of a length are intervals of ranks, joined back to the rests by their rank among all rests of
that length. Ranks come from counts by (task, length), so no length is gathered in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import documents, id_text, per_worker, query, stage

SIZE = 4096
END = 2
CACHE, KEEP = 1 << 18, 48  # parts of words whose ids are kept, and the longest that is kept
SLICE = 1 << 22  # bytes of text encoded at once, or those of one text
STEM = "^(?P<stem>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(?P<tail>[!-&(-/:-@[-`{-~]*)$"

PIECE = ("doc_id long, start long, length long, doc_tokens long, ids binary, "
         "task long, rank long")


class Words:
    """Ids of a text by words between ASCII white space, which the vocabulary never crosses.

    A word that is a stem of plain Latin letters and a tail of ASCII marks (no apostrophe) has the ids
    of the lower-cased stem and of the tail: normalisation leaves both as they are, and the
    vocabulary's pattern always parts letters from marks.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a stem or a tail
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.parts: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in codes]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of stems and tails not met before: many in one text, parted where an id ends a word."""
        for at in range(0, len(fresh), 4096):
            some = fresh[at:at + 4096]
            whole = self._encode([" ".join(some)])[0]
            stops = (np.flatnonzero(self.ends[np.frombuffer(whole, "<u4")]) + 1) * 4
            if len(stops) == len(some):
                cuts = [0, *stops.tolist()]
                self.parts.update(zip(some, [whole[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                self.parts.update(zip(some, self._encode(some)))

    def _ids(self, texts: pa.Array) -> pa.Array:
        """Ids of each of the stems, tails or odd words, all of them looked up once."""
        coded = texts.dictionary_encode()
        distinct, parts = coded.dictionary.to_pylist(), self.parts
        fresh = [x for x in distinct if x not in parts]
        self._learn(fresh)
        found = pa.array([parts[x] for x in distinct], pa.large_binary())
        for text in fresh:
            if len(text) > KEEP:
                del parts[text]
        return found.take(coded.indices)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if len(self.parts) > CACHE:
            self.parts = {"": b""}
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        found = pc.extract_regex(words.dictionary, STEM)
        stem, tail = found.flatten()
        stem, odd = pc.utf8_lower(stem), found.is_null()
        heads = self._ids(pc.if_else(odd, "", stem))
        tails = self._ids(pc.if_else(odd, "", tail))
        ids = pc.binary_join_element_wise(heads, tails, pa.scalar(b"", pa.large_binary()))
        if found.null_count:
            ids = pc.replace_with_mask(ids, odd, pa.array(
                self._encode(words.dictionary.filter(odd).to_pylist()), pa.large_binary()))
        ids = ids.take(words.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        count = np.diff(bounds[np.asarray(split.offsets)]) // 4
        total = int(count.sum())
        return (np.frombuffer(ids.buffers()[2], "<u4", total) if total else np.empty(0, "<u4")), count


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, rows) of runs of texts of at most SLICE bytes, or of one longer text."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = upto[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(upto, before + SLICE, "right")))
        yield first, after - first
        first = after


def _cut(path: str, size: int, end: int):
    """Task function: pieces, with the rank of each rest among the task's rests of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        words = per_worker(f"words {path}", lambda: Words(path))
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for first, rows in _slices(texts):
                ids, count = words.encode(texts.slice(first, rows))
                yield _pieces(batch.column("doc_id").slice(first, rows), ids, count, end, size, task, seen)
        pa.default_memory_pool().release_unused()  # the worker may wait long for its next task
    return run


def _pieces(doc_ids: pa.Array, ids: np.ndarray, count: np.ndarray, end: int, size: int, task: int,
            seen: np.ndarray) -> pa.RecordBatch:
    """The pieces of documents, cut in one buffer of all their ids; ``seen`` counts rests by length."""
    n = count + 1
    closing = np.cumsum(n) - 1
    inside = np.ones(int(n.sum()), bool)
    inside[closing] = False
    whole = np.empty(len(inside), "<u4")
    whole[inside], whole[closing] = ids, end
    cuts = -(-n // size)
    owner = np.repeat(np.arange(len(n)), cuts)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
    length = np.minimum(size, n[owner] - start)
    # rank among the pieces of a length, in order of appearance
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[first, len(ordered)])
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(ordered)) - np.repeat(first, counts) + seen[ordered]
    seen[ordered[first]] += counts
    offsets = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(n[owner]),
         pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]),
         pa.array(np.full(len(owner), task, np.int64)), pa.array(rank)],
        names=["doc_id", "start", "length", "doc_tokens", "ids", "task", "rank"])


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all rests: (length, first rank, count, first sequence, offset).

    ``count`` rests of ``length`` from ``first rank`` on go to as many consecutive sequences, at
    ``offset`` each.
    """
    open_: dict[int, list[list]] = {}  # by free space: [count, [(length, first rank, offset)]]
    done: list[list] = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            free = max(open_, default=0)
            if free < length:
                free, take, parts = size, left, []
            else:
                count, parts = open_[free][-1]
                take = min(left, count)
                if take == count:
                    open_[free].pop()
                    if not open_[free]:
                        del open_[free]
                else:
                    # the first ``take`` of the pattern's sequences go on; the others stay open
                    open_[free][-1] = [count - take, [(a, r + take, o) for a, r, o in parts]]
            made = [take, [*parts, (length, rank, size - free)]]
            rank, left, free = rank + take, left - take, free - length
            if free:
                open_.setdefault(free, []).append(made)
            else:
                done.append(made)
    out, sequence = [], 0
    for count, parts in [*done, *(x for y in open_.values() for x in y)]:
        out += [(a, r, count, sequence, o) for a, r, o in parts]
        sequence += count
    return out


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stage(id_text(docs, id_col, text_col).mapInArrow(_cut(path, size, end), PIECE),
                   "pieces")
    by_task = stage(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"]
                 for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(size, 0)
    places = patterns(histogram, size)
    places = [(length, first, count, sequence + full, offset)
              for length, first, count, sequence, offset in places]
    if full:
        places.append((size, 0, full, 0, 0))
    # its size depends on ``size``, not on the number of documents
    table = spark.createDataFrame(
        places, "length long, first long, count long, sequence long, offset long")
    before = by_task.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    # every (task, length) is cut where a place begins, so each rest finds its place by equality
    # of (length, task) and the range of ranks
    spans = (by_task.join(before, ["length", "task"]).join(table, "length")
             .filter("first < base + n AND base < first + count"))
    return (pieces.join(spans.select("length", "task", "base", "first", "count", "sequence",
                                     "offset"), ["length", "task"])
            .filter("rank + base >= first AND rank + base < first + count")
            .select("doc_id", "start", "length", "doc_tokens", "ids",
                    (F.col("sequence") + F.col("rank") + F.col("base") - F.col("first"))
                    .alias("sequence_id"), "offset"))


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json")))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


__all__ = ["PIECE", "digest", "op6_packing", "pack", "patterns"]
