"""Operator 13: repeated passages by repeated-phrase automata.

Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``WINDOW`` consecutive words of one text. A word goes if a window
that covers it starts anywhere else too, in the same text or another. A null text has no words.

1. Texts of equal words are one passage each: all their words go, and one of them stands for the others below.
2. *Candidates.* Of the phrases of ``GRAM`` words inside a window, the one of the least hash is its anchor, so
   equal windows have equal anchors. Anchors (about one in ten words) are range-sorted by (hash, place),
   which spreads a hot hash over many tasks; the hashes that come twice are kept.
3. *Confirm.* Only windows whose anchor recurs are hashed as a whole and range-sorted in the same way. A window
   that recurs points to its first place. Neighbouring windows that point to neighbouring windows form a
   passage: a stretch of one text equal to a stretch of an earlier one.
4. *Automata.* The earlier text lends windows that tile the stretch: its first, its last, and those at
   multiples of ``WINDOW``. They are compiled into Aho-Corasick automata over word numbers, in shards of bounded
   size; a text that lends to very many is dealt to several automata.
5. *Stream.* Every stretch is run through the automaton of its shard, which locates the phrases word by word.
   A stretch whose tiles are all found is repeated, and so is the stretch it points to. Windows refuted here
   (equal hashes of other words) are hashed anew with another seed and confirmed again, until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import Scratch, arrow_texts, bounded, documents, id_text, query

WINDOW = 35
GRAM = 16
#: Words run through one automaton, about.
SHARD_WORDS = 500_000
CHUNK = 1 << 18  # bytes hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------------- hashes

def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text with single spaces, by prefix sums over its bytes."""
    if not text:
        return np.empty(0, np.uint64)
    if len(text) > CHUNK:
        parts, at = [], 0
        while at < len(text):
            cut = text.rfind(b" ", at + 1, at + CHUNK) if at + CHUNK < len(text) else len(text)
            cut = cut if cut > 0 else text.find(b" ", at + CHUNK) % (len(text) + 1)
            parts.append(_chunk_hashes(text[at:cut]))
            at = cut + 1
        return np.concatenate(parts)
    return _chunk_hashes(text)


def _chunk_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(data == 32)
    start, end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    power = _powers(len(data), int(BASE))
    inverse = _powers(len(data), int(INVERSE))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64), 7) * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


_KNOWN: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    known = _KNOWN.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK)
        known = np.full(size, np.uint64(base))
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size == CHUNK:
            _KNOWN[base] = known
    return known[:n]


def phrase_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``n`` consecutive words, joined from lengths that are powers of two."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out, length, part, span = None, 0, words, 1
    while True:
        weight = np.uint64(pow(int(BASE), span, 1 << 64))
        if n & span:
            if out is None:
                out, length = part, span
            else:
                size = len(words) - length - span + 1
                out = out[:size] * weight + part[length:length + size]
                length += span
        if length == n:
            return mix(out, seed)
        part = part[:-span] * weight + part[span:]
        span *= 2


def sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``n`` consecutive values."""
    span = 1
    while span * 2 <= n:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = n - span
    return best(values[:-rest], values[rest:]) if rest else values


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text, and the anchor's hash of each of its windows."""
    phrases, reach = phrase_hashes(words, gram), window - gram + 1
    least = sliding(phrases, reach, np.minimum)
    edge = np.zeros(reach - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), reach, np.maximum) == phrases)
    return at, phrases[at], least


# ------------------------------------------------------------------- task steps

def _prepare(window: int, gram: int):
    """Task function: texts with single spaces, their counts and digests, and their anchors."""
    item = pa.struct([("hash", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts, counts, shas, places, hashes, sizes = [], [], [], [], [], []
                for text in arrow_texts(batch):
                    words = text.split()
                    text = b" ".join(words)
                    texts.append(text)
                    counts.append(len(words))
                    shas.append(hashlib.sha256(text).digest())
                    sizes.append(0)
                    if len(words) >= window:
                        at, found, _ = anchors(word_hashes(text), window, gram)
                        places.append(at.astype(np.int32))
                        hashes.append(found.view(np.int64))
                        sizes[-1] = len(at)
                parts = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([np.empty(0, np.int64), *hashes])),
                     pa.array(np.concatenate([np.empty(0, np.int32), *places]).astype(np.int32))],
                    fields=list(item))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()),
                     pa.array(counts, pa.int64()), pa.array(shas, pa.binary()), lists],
                    names=["doc_id", "text", "n_words", "sha", "anchors"])
    return run


RUNS = "hash long, row long, pos int, to_row long, to_pos int, n long, edge boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over rows sorted by (hash, row, pos): those whose hash comes twice, with its first place.

    The first and the last hash of a task may go on in its neighbours. Rows of the first, and the last row
    if it stands alone, carry their hash; one more row (``edge``) counts each of the two.
    """
    first_hash = None  # of the task
    hash_, head, size = None, (0, 0), 0  # the run that is open
    alone = False  # its only row is not written yet

    def out(hashes, rows, places, to_rows, to_places, n=0, edge=False):
        count = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32()),
             pa.array(to_rows, pa.int64()), pa.array(to_places, pa.int32()),
             pa.array([n] * count, pa.int64()), pa.array([edge] * count, pa.bool_())],
            names=["hash", "row", "pos", "to_row", "to_pos", "n", "edge"])
    for batch in batches:
        if not batch.num_rows:
            continue
        h, row, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "row", "pos"))
        if first_hash is None:
            first_hash = int(h[0])
        if alone and h[0] == hash_:  # a second one: the first is written after all
            yield out([None], [head[0]], [head[1]], [head[0]], [head[1]])
        if h[0] != hash_ and size and hash_ == first_hash:
            yield out([hash_], [head[0]], [head[1]], [head[0]], [head[1]], size, True)
        start = np.flatnonzero(np.r_[h[0] != hash_, h[1:] != h[:-1]])
        length = np.diff(np.r_[start, len(h)])
        lead = int(start[0]) if len(start) else len(h)  # rows that belong to the open run
        run = np.repeat(np.arange(len(start)), length)
        to_row = np.concatenate([np.full(lead, head[0], np.int64), row[start][run]])
        to_pos = np.concatenate([np.full(lead, head[1], np.int64), pos[start][run]])
        keep = np.concatenate([np.ones(lead, bool), (length >= 2)[run]])
        in_first = h == first_hash
        keep |= in_first
        at = np.flatnonzero(keep)
        if len(at):
            tags = pa.array(h[at], mask=~in_first[at])
            yield out(tags, row[at], pos[at], to_row[at], to_pos[at])
        if len(start):
            if len(start) > 1 and h[start[0]] == first_hash:
                yield out([first_hash], [int(row[start[0]])], [int(pos[start[0]])], [int(row[start[0]])],
                          [int(pos[start[0]])], int(length[0]), True)
            elif lead and hash_ == first_hash:
                yield out([first_hash], [head[0]], [head[1]], [head[0]], [head[1]], size + lead, True)
            last = start[-1]
            hash_, head, size = int(h[last]), (int(row[last]), int(pos[last])), int(length[-1])
        else:
            size += lead
        alone = size == 1 and hash_ != first_hash
    if hash_ is not None:
        if alone:
            yield out([hash_], [head[0]], [head[1]], [head[0]], [head[1]])
        yield out([hash_], [head[0]], [head[1]], [head[0]], [head[1]], size, True)


def recurring(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The ``rows`` (hash, row, pos) whose hash comes twice, with the first place of it (to_row, to_pos)."""
    keys = ["hash", "row", "pos"]
    found = scratch.keep(rows.select(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .mapInArrow(_runs, RUNS), name)
    # two rows a task at most
    edges = found.filter("edge").groupBy("hash").agg(
        F.sum("n").alias("total"), F.min(F.struct("row", "pos")).alias("head")).filter("total > 1")
    return (found.filter("NOT edge").join(F.broadcast(edges.select("hash", "head")), "hash", "left")
            .filter("hash IS NULL OR head IS NOT NULL")
            .select("row", "pos", F.coalesce("head.row", "to_row").alias("to_row"),
                    F.coalesce("head.pos", "to_pos").alias("to_pos")))


def _windows(window: int, gram: int, bits: int):
    """Task function: hashes of the windows whose anchor is among those at the given places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for row, text, places in zip(rows, arrow_texts(batch), batch.column("places").to_pylist()):
                words = word_hashes(text)
                at, hashes, least = anchors(words, window, gram)
                wanted = hashes[np.isin(at, places)]
                found = np.flatnonzero(np.isin(least, wanted))
                hashes = (phrase_hashes(words, window)[found] >> np.uint64(64 - bits)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(np.full(len(found), row, np.int64)),
                     pa.array(found.astype(np.int32))], names=["hash", "row", "pos"])
    return run


def _again(window: int, seed: int):
    """Task function: hashes of given windows with another seed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for row, text, places in zip(rows, arrow_texts(batch), batch.column("places").to_pylist()):
                found = np.unique(np.array(places, np.int64))
                hashes = phrase_hashes(mix(word_hashes(text), seed), window, seed)[found].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(np.full(len(found), row, np.int64)),
                     pa.array(found.astype(np.int32))], names=["hash", "row", "pos"])
    return run


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over windows sorted by (row, pos): stretches of windows that point to a stretch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, pos, to_row, to_pos = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                    for c in ("row", "pos", "to_row", "to_pos"))
        new = np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
                    | (to_row[1:] != to_row[:-1]) | (to_pos[1:] != to_pos[:-1] + 1)]
        start = np.flatnonzero(new)
        n = np.diff(np.r_[start, len(row)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (row[start], pos[start], n, to_row[start], to_pos[start])],
            names=["row", "pos", "n", "to_row", "to_pos"])


def tiles(to_pos: int, n: int, window: int) -> list[int]:
    """Places of the windows that tile a stretch of ``n`` windows: first, multiples of ``window``, last."""
    inner = range(to_pos // window * window + window, to_pos + n - 1, window)
    return sorted({to_pos, *inner, to_pos + n - 1})


def _cut_words(window: int):
    """Task function: the words of each wanted stretch (``n`` windows from ``pos``) of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, wants in zip(batch.column("row").to_pylist(), arrow_texts(batch),
                                        batch.column("wants").to_pylist()):
                words = text.split(b" ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(wants), pa.int64()), pa.array([w["pos"] for w in wants], pa.int64()),
                     pa.array([w["n"] for w in wants], pa.int64()),
                     pa.array([b" ".join(words[w["pos"]:w["pos"] + w["n"] + window - 1]) for w in wants],
                              pa.binary()).cast(pa.string())], names=["row", "pos", "n", "words"])
    return run


def _locate(window: int):
    """Task function: run the stretches of a shard through the automaton of its phrases."""
    def run(table: pa.Table) -> pa.Table:
        import ahocorasick

        tile = table.filter(pa.compute.equal(table.column("kind"), 1))
        stretch = table.filter(pa.compute.equal(table.column("kind"), 0))
        numbers: dict[str, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for row, pos, words in zip(*(tile.column(c).to_pylist() for c in ("row", "pos", "words"))):
            phrase = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words.split(" "))
            known = automaton.get(phrase, None)
            if known is None:
                automaton.add_word(phrase, {(row, pos)})
            else:
                known.add((row, pos))
        sound = []
        if len(automaton):
            automaton.make_automaton()
            number = numbers.get
            for words, to_row, to_pos, n in zip(*(stretch.column(c).to_pylist() for c in (
                    "words", "to_row", "to_pos", "n"))):
                hits = {(place, end - window + 1) for end, places in automaton.iter(
                    tuple(number(w, 0) for w in words.split(" "))) for place in places}
                sound.append(all(((to_row, at), at - to_pos) in hits for at in tiles(to_pos, n, window)))
        else:
            sound = [False] * stretch.num_rows
        return stretch.select(["row", "pos", "n", "to_row", "to_pos"]).append_column(
            "sound", pa.array(sound, pa.bool_()))
    return run


def _confirmed(stretches: DataFrame, texts: DataFrame, scratch: Scratch, window: int, shard_words: int,
               name: str) -> DataFrame:
    """The stretches with ``sound``: whether the automata found all their phrases."""
    stretches = stretches.withColumn("words", F.col("n") + window - 1)
    sums = scratch.keep(stretches.groupBy("to_row").agg(F.sum("words").alias("words")), name + "_sums")
    shards = max(1, int(sums.agg(F.sum("words")).first()[0] or 0) // shard_words + 1)
    # texts with many stretches are dealt to automata of their own
    deals = sums.withColumn("parts", F.ceil(F.col("words") * 4 / shard_words)).drop("words")
    shard = F.struct(
        F.when(F.col("parts") > 1, F.col("to_row")).otherwise(-1 - F.pmod(F.xxhash64("to_row"), F.lit(shards)))
        .alias("group"), F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row", "pos"), F.col("parts")))
        .otherwise(0).alias("part"))
    dealt = scratch.keep(stretches.drop("words").join(deals, "to_row").withColumn("shard", shard)
                         .drop("parts"), name + "_dealt")
    inner = F.sequence((F.floor(F.col("to_pos") / window) + 1) * window, F.col("to_pos") + F.col("n") - 2,
                       F.lit(window).cast("long"))
    tile = dealt.select("to_row", "shard", F.explode(F.array_distinct(F.concat(
        F.array("to_pos", F.col("to_pos") + F.col("n") - 1),
        F.when((F.floor(F.col("to_pos") / window) + 1) * window <= F.col("to_pos") + F.col("n") - 2, inner)
        .otherwise(F.array().cast("array<long>"))))).alias("pos")).distinct()
    wants = (dealt.select("row", "pos", "n")
             .unionByName(tile.select(F.col("to_row").alias("row"), "pos", F.lit(1).cast("long").alias("n")))
             .distinct().groupBy("row").agg(F.collect_list(F.struct("pos", "n")).alias("wants")))
    cut = scratch.keep(
        with_lists(texts, scratch.keep(wants, name + "_wants")).mapInArrow(
            _cut_words(window), "row long, pos long, n long, words string"), name + "_cut")
    none = F.lit(None).cast("long")
    hay = dealt.join(cut, ["row", "pos", "n"]).select(
        "shard", F.lit(0).alias("kind"), "row", "pos", "n", "to_row", "to_pos", "words")
    phrases = tile.join(cut.filter("n = 1").withColumnRenamed("row", "to_row"), ["to_row", "pos"]).select(
        "shard", F.lit(1).alias("kind"), F.col("to_row").alias("row"), "pos", "n", none.alias("to_row"),
        none.alias("to_pos"), "words")
    out = scratch.keep(hay.unionByName(phrases).groupBy("shard").applyInArrow(
        _locate(window), "row long, pos long, n long, to_row long, to_pos long, sound boolean"), name + "_found")
    scratch.drop(*(name + x for x in ("_sums", "_dealt", "_wants", "_cut")))
    return out


def with_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``row``, ``text`` and the list of each row of ``lists``; other texts are left before the shuffle if
    the ids are counted to be few enough to be sent to all tasks."""
    return (texts.select("row", "text").join(bounded(lists.select("row")), "row", "left_semi")
            .join(lists, "row"))


# -------------------------------------------------------------------- operators

def prepared(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
             window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row (a number), doc_id, text (words joined by one space), n_words, sha, anchors; written once."""
    return scratch.keep(
        id_text(docs, id_col, text_col).mapInArrow(
            _prepare(window, gram), "doc_id long, text string, n_words long, sha binary, "
            "anchors array<struct<hash:long,pos:int>>")
        .withColumn("row", F.monotonically_increasing_id()), "texts")


def repeats(texts: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM,
            shard_words: int = SHARD_WORDS, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Of ``prepared`` texts: ``row`` of those whose words all go as copies of another; ``row`` and ``spans``
    (pos, n: windows from pos to pos + n - 1 are repeated) of the others that have some."""
    long = texts.filter(F.col("n_words") >= window)
    classes = scratch.keep(long.groupBy("sha").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("n"))
                           .filter("n > 1"), "classes")
    copies = scratch.keep(long.select("row", "sha").join(classes, "sha").select(
        "row", (F.col("row") == F.col("kept")).alias("stands")), "copies")
    gone = bounded(copies.filter("NOT stands").select("row"))
    marks = long.select("row", F.explode("anchors").alias("a")).select("a.hash", "row", "a.pos").join(
        gone, "row", "left_anti")
    places = scratch.keep(recurring(marks, scratch, "anchor_runs").groupBy("row").agg(
        F.collect_list("pos").alias("places")), "places")
    rows = scratch.keep(with_lists(texts, places).mapInArrow(
        _windows(window, gram, hash_bits), "hash long, row long, pos int"), "windows")
    scratch.drop("anchor_runs", "places", "classes")

    spans, turn, current = None, 0, "windows"
    while True:
        name = f"turn{turn}"
        pairs = recurring(rows, scratch, name + "_runs").filter("row <> to_row OR pos <> to_pos")
        stretches = scratch.keep(pairs.repartition("row").sortWithinPartitions("row", "pos").mapInArrow(
            _join_up, "row long, pos long, n long, to_row long, to_pos long"), name + "_stretches")
        scratch.drop(current, name + "_runs")
        found = _confirmed(stretches, texts, scratch, window, shard_words, name)
        scratch.drop(name + "_stretches")
        sound = found.filter("sound")
        here = sound.select("row", "pos", "n").unionByName(
            sound.select(F.col("to_row").alias("row"), F.col("to_pos").alias("pos"), "n"))
        spans = here if spans is None else spans.unionByName(here)
        refuted = found.filter("NOT sound")
        if refuted.isEmpty():
            break
        turn, current = turn + 1, f"again{turn}"
        both = refuted.select("row", "pos", "n").unionByName(
            refuted.select(F.col("to_row").alias("row"), F.col("to_pos").alias("pos"), "n"))
        lists = scratch.keep(both.select("row", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1))
                                         .alias("pos")).distinct().groupBy("row").agg(
            F.collect_list("pos").alias("places")), f"lists{turn}")
        rows = scratch.keep(with_lists(texts, lists).mapInArrow(
            _again(window, turn), "hash long, row long, pos int"), current)
        scratch.drop(f"lists{turn}")
    longest = spans.groupBy("row", "pos").agg(F.max("n").alias("n"))  # one row a place before lists are made
    spans = (longest.groupBy("row").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
             .join(bounded(copies.select("row")), "row", "left_anti"))
    return copies.select("row"), scratch.keep(spans, "spans")


def _rebuild(window: int):
    """Task function: texts without the words that spans cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, spans in zip(arrow_texts(batch), batch.column("spans").to_pylist()):
                words = text.split(b" ")
                change = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    change[s["pos"]] += 1
                    change[s["pos"] + s["n"] + window - 1] -= 1
                stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                kept.append(b" ".join([words[i] for i in stay.tolist()]))
                removed.append(len(words) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_removed", "text"])
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM, shard_words: int = SHARD_WORDS, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (kept words joined by one space), and
    sha (of that text in UTF-8). Rows that repeat, null ids included, are texts like any other; columns
    beyond the two are left behind."""
    scratch = Scratch(docs.sparkSession)
    texts = prepared(docs, scratch, id_col, text_col, window, gram)
    copies, spans = repeats(texts, scratch, window, gram, shard_words, hash_bits)
    facts = texts.select("row", "doc_id", "n_words")
    copies = facts.join(bounded(copies), "row").select(
        "row", "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("text"),
        F.lit(EMPTY_SHA).alias("sha"))
    changed = with_lists(texts, spans).mapInArrow(
        _rebuild(window), "row long, n_removed long, text string")
    changed = facts.join(changed, "row").select(
        "row", "doc_id", "n_words", "n_removed", "text", F.sha2("text", 256).alias("sha"))
    decided = bounded(scratch.keep(copies.select("row").unionByName(spans.select("row")), "decided"))
    same = texts.join(decided, "row", "left_anti").select(
        "row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "text",
        F.lower(F.hex("sha")).alias("sha"))
    return copies.unionByName(changed).unionByName(same).drop("row")


@query("op13_substring_dedup", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
k AS (SELECT r, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
c AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, p + o.i AS p FROM k JOIN c USING (h), range(35) o(i)),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
m AS (SELECT u.r, count(g.p) AS gone, string_agg(u.word, ' ' ORDER BY u.p) FILTER (g.p IS NULL) AS kept
 FROM u LEFT JOIN g ON g.r = u.r AND g.p = u.p GROUP BY u.r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(m.gone, 0) AS n_removed,
 sha256(coalesce(m.kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (r)""")
def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"))
