"""Operator 10: repeated lines by two Bloom filters, exact confirmation of the suspects.

A text is split at ``\\n`` (null or empty: one empty line). A line's key is the line stripped of
``[\\x20\\x09-\\x0D]`` at both ends with A-Z in lower case. Keys of at least ``min_points`` code points
found in at least ``min_docs`` documents lose their lines except in the document with the largest id.
Rows that share an id are one document; a null id is one document below all others.

1. Every task sets bits for the hashes of its lines in a filter of lines seen once, and in a second
   one those it saw twice. Filters merge bit by bit: a bit is twice-seen if any part has it twice or
   two parts have it once. No line seen twice is ever missed.
2. Only lines whose bits are all in the merged second filter are suspects. Their keys are grouped
   exactly; nothing else about a line is shuffled.
3. Documents with suspects are rebuilt; the others pass through.

The filter holds ``BITS_PER_LINE`` bits a line up to ``MAX_BITS``, the bound of what is broadcast.
Beyond that more lines are suspected, and the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, arrow_texts, documents, id_text, query, stage, total

MIN_POINTS, MIN_DOCS = 20, 3
BITS_PER_LINE = 16
MAX_BITS = 1 << 30
SEGMENT = 1 << 20  # bits of a filter that are merged together
BLANK = SPACES.encode()


def line_key(line: bytes, min_points: int) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < min_points or len(key) < 4 * min_points and len(key.decode()) < min_points:
        return None
    return key


def probes(hashes: np.ndarray, bits: int, count: int) -> np.ndarray:
    """(count, n) bit positions, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        rows = [hashes + step * np.uint64(i) for i in range(count)]
    return np.stack(rows) & np.uint64(bits - 1)


def _partial(bits: int, count: int, min_points: int):
    """Task function: both filters of the task's own lines, by segment, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = np.empty(0, np.uint64)
        again = np.empty(0, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = [xxhash.xxh3_64_intdigest(key)
                        for text in arrow_texts(batch.slice(start, 1000))
                        for line in text.split(b"\n")
                        if (key := line_key(line, min_points)) is not None]
                new, times = np.unique(np.array(part, np.uint64), return_counts=True)
                again = np.union1d(again, np.union1d(new[times > 1], np.intersect1d(
                    seen, new, assume_unique=True)))
                seen = np.union1d(seen, new)
        marks = [np.unique(probes(x, bits, count)) for x in (seen, again)]
        for segment in np.unique(marks[0] // np.uint64(SEGMENT)).tolist():
            packed = []
            for positions in marks:
                low, high = np.searchsorted(
                    positions, np.array([segment, segment + 1], np.uint64) * np.uint64(SEGMENT))
                flags = np.zeros(min(SEGMENT, bits), np.uint8)
                flags[(positions[low:high] % np.uint64(SEGMENT)).astype(np.int64)] = 1
                packed.append(zlib.compress(np.packbits(flags).tobytes(), 1))
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()),
                                              "once": pa.array([packed[0]], pa.binary()),
                                              "twice": pa.array([packed[1]], pa.binary())})
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: twice-seen bits of each segment over all parts, as they stream in."""
    merged: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for segment, *packed in zip(*[c.to_pylist() for c in batch.columns]):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
            if segment in merged:
                old = merged[segment]
                old[1] |= twice | (old[0] & once)
                old[0] |= once
            else:
                merged[segment] = [once.copy(), twice.copy()]
    for segment, (_, twice) in merged.items():
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([segment], pa.int32()),
            "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})


def _suspect(shipped, bits: int, count: int, min_points: int):
    """Task function: each text with its number of lines and its suspected lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        twice = np.zeros(max(bits // 8, 1), np.uint8)
        for segment, packed in shipped.value.items():
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            twice[segment * SEGMENT // 8:segment * SEGMENT // 8 + len(part)] = part
        item = pa.struct([("line", pa.int32()), ("key", pa.string())])
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                where, keys, lines = [], [], []
                for row, text in enumerate(arrow_texts(batch)):
                    parts = text.split(b"\n")
                    lines.append(len(parts))
                    for number, line in enumerate(parts):
                        if (key := line_key(line, min_points)) is not None:
                            where.append((row, number))
                            keys.append(key)
                found = probes(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64),
                               bits, count)
                hit = np.ones(len(keys), bool)
                for positions in found:
                    at = positions.astype(np.int64)
                    hit &= (twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                suspects: list[list] = [[] for _ in lines]
                for i in np.flatnonzero(hit).tolist():
                    row, number = where[i]
                    suspects[row].append({"line": number, "key": keys[i].decode()})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(lines, pa.int64()),
                     pa.array(suspects, pa.list_(item))],
                    names=["doc_id", "text", "n_lines", "suspects"])
    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: texts without their dropped lines."""
    for batch in batches:
        kept = []
        for text, dropped in zip(arrow_texts(batch), batch.column("dropped").to_pylist()):
            gone = set(dropped or ())
            kept.append(b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone)
                        if gone else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_lines"),
             pa.array([len(x or ()) for x in batch.column("dropped").to_pylist()], pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS,
               max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text without the dropped lines."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    lines = total(texts, F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1)
    bits = 1 << max(10, min(max_bits.bit_length() - 1, (BITS_PER_LINE * lines - 1).bit_length()))
    count = 4 if bits >= 12 * lines else 3 if bits >= 6 * lines else 2
    merged = (
        texts.mapInArrow(_partial(bits, count, min_points),
                         "segment int, once binary, twice binary")
        .repartition("segment").mapInArrow(_merge, "segment int, twice binary").collect())
    shipped = spark.sparkContext.broadcast({r["segment"]: bytes(r["twice"]) for r in merged})
    marked = texts.mapInArrow(
        _suspect(shipped, bits, count, min_points),
        "doc_id long, text string, n_lines long, suspects array<struct<line:int,key:string>>")
    marked = stage(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    shipped.unpersist()

    found = marked.filter(F.size("suspects") > 0).select(
        "row", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.inline("suspects"))
    # written, so that the join on it stands on two plain exchanges and a hot key can be split
    repeated = stage(found.groupBy("key").agg(F.count_distinct("doc").alias("docs"),
                                              F.max("doc").alias("last"))
                     .filter(F.col("docs") >= min_docs).select("key", "last"), "repeated")
    dropped = (found.join(repeated, "key").filter("doc <> last")
               .groupBy("row").agg(F.collect_list("line").alias("dropped")))
    rebuilt = (marked.filter(F.size("suspects") > 0).select("row", "doc_id", "text", "n_lines")
               .join(dropped, "row", "left").drop("row")
               .mapInArrow(_rebuild, "doc_id long, n_lines long, n_dropped long, text string"))
    untouched = marked.filter(F.size("suspects") == 0).select(
        "doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "text")
    return untouched.unionByName(rebuilt)


@query("op10_line_dedup", r"""
WITH l AS (
 SELECT doc_id, u.n AS n, u.line AS line,
  translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
 FROM (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)),
   range(len(string_split(coalesce(text, ''), chr(10)))))) AS z FROM documents) d,
  LATERAL (SELECT z[1] AS line, z[2] AS n) u),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20
 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.n, l.line, k.key IS NOT NULL AND l.doc_id <> k.last AS gone
 FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(documents(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
