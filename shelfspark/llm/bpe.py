"""Operator 3: byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding. A pre-token that is longer than the lookahead window is fed piecewise. The merge list fixes
how far to the left a byte that is not yet known can change a token border (``lookahead``): tokens
that end further left than that are stable and are emitted at once, so the state is one window.

The bound: merges act in list order. Compare two texts that agree up to some border. A merge (u, v)
moves the leftmost disagreement left, by len(u), only where its u ends at that border and a token v
starts there in one of the texts. After it, the tokens that can start at the new border are u itself or
tokens grown from u on their right. A later merge (u2, v2) can go on only if u is on the left spine of
v2's merge tree. The largest sum of len(u) over such chains in list order is a sufficient lookahead.

Null texts count as empty. Strings of added tokens in a text are encoded as those tokens.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_texts, documents, id_text, per_worker, query

#: Fixed: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same character classes, one run each.
RUNS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")
#: Longest string the pattern looks at to decide where a short pre-token ends.
LOOK = 3
CHUNK = 1 << 16  # characters fed at a time
LONG = 1 << 12  # an open pre-token beyond this many characters is fed piecewise
CACHE = 1 << 19  # pre-tokens of at most KEEP characters whose ids are kept
KEEP = 48


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge list of a tokenizer file over token ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, number in vocab.items():
            self.bytes[number] = bytes(symbols[c] for c in token)
        for token, number in added.items():
            self.bytes[number] = token.encode()
        self.single = [0] * 256
        for symbol, byte in symbols.items():
            self.single[byte] = vocab[symbol]
        self.order: dict[tuple[int, int], int] = {}  # of pairs of ids, in list order
        self.made: list[int] = []
        self.parts: dict[int, tuple[int, int]] = {}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            if made in self.parts or any(
                    x not in self.parts and len(self.bytes[x]) > 1 for x in pair):
                raise ValueError("each merge must join tokens made by earlier merges, once")
            self.order[pair] = len(self.made)
            self.made.append(made)
            self.parts[made] = pair
        self.packed = [n.to_bytes(4, "little") for n in range(self.size)]
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        reach: dict[int, int] = {}  # by u: the largest sum of a chain that ends in a merge (u, v)
        for left, right in self.order:
            best, spine = 0, right
            while True:
                best = max(best, reach.get(spine, 0))
                if spine not in self.parts:
                    break
                spine = self.parts[spine][0]
            reach[left] = max(reach.get(left, 0), best + len(self.bytes[left]))
        return max(reach.values(), default=0)

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece: the lowest-ranked pair merges first, the leftmost of equals."""
        ids = [self.single[b] for b in data]
        if len(ids) > 48:
            return self._encode_long(ids)
        get, none, made = self.order.get, len(self.made), self.made
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get((new, ids[i + 1]), none)
            if i:
                pairs[i - 1] = get((ids[i - 1], new), none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        rank, made, n = self.order, self.made, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = made[rank[left, right]], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (ids[a], ids[b]) in rank:
                    heapq.heappush(heap, (rank[ids[a], ids[b]], a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]


class PieceStream:
    """One pre-token of any length, fed in parts; holds at most a window of bytes."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, b""
        self.window = 4 * merges.lookahead + 256

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for start in range(0, len(data), self.window):
            self.held += data[start:start + self.window]
            if len(self.held) < 2 * self.window:
                continue
            stable, end = len(self.held) - self.merges.lookahead, 0
            for token in self.merges.encode(self.held):
                if end + len(self.merges.bytes[token]) > stable:
                    break
                end += len(self.merges.bytes[token])
                out.append(token)
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.encode(self.held), b""
        return out


class Encoder:
    """Text to little-endian unsigned 32-bit ids, in parts: ``feed`` any number of times, ``finish``."""

    def __init__(self, merges: Merges) -> None:
        import regex

        self.merges = merges
        self.find = regex.compile(PATTERN).findall
        self.runs = [regex.compile(x).match for x in RUNS]
        self.known: dict[str, bytes] = {}
        self.tail = ""
        self.run, self.piece = None, PieceStream(merges)

    def _pieces(self, pieces: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[x] for x in pieces])
        except KeyError:
            pass
        out = []
        for x in pieces:
            ids = known.get(x)
            if ids is None:
                ids = self.merges.pack(self.merges.encode(x.encode()))
                if len(x) <= KEEP:
                    if len(known) >= CACHE:
                        known.clear()
                    known[x] = ids
            out.append(ids)
        return b"".join(out)

    def _feed_run(self, data: str, last: bool) -> bytes:
        """Go on with the open run; the last character is held back, since a blank may leave it."""
        data = self.tail + data
        end = m.end() if (m := self.run(data)) else 0
        if end == len(data) and not last:
            self.tail = data[-1:]
            return self.merges.pack(self.piece.feed(data[:-1].encode()))
        if end < len(data) and self.run is self.runs[3]:
            end -= 1
        ids = self.piece.feed(data[:end].encode()) + self.piece.finish()
        self.run, self.tail = None, ""
        return self.merges.pack(ids) + self.feed(data[end:], last)

    def feed(self, data: str, last: bool = False) -> bytes:
        if self.run:
            return self._feed_run(data, last)
        data = self.tail + data
        if last:
            self.tail = ""
            return self._pieces(self.find(data))
        pieces, held = self.find(data), 0
        while pieces and held < LOOK:
            held += len(pieces.pop())
        self.tail = data[len(data) - held:]
        out = self._pieces(pieces)
        if held > LONG:
            first = self.find(self.tail)[0]
            run = next(x for x in self.runs if x(first[-1]))
            if len(first) == held:
                self.run = run
                out += self.merges.pack(self.piece.feed(first[:-1].encode()))
                self.tail = first[-1]
                if run is not self.runs[3]:
                    return out
        return out

    def finish(self) -> bytes:
        return self.feed("", last=True)

    def encode(self, text: str) -> bytes:
        """A whole text, cut at added tokens, in bounded parts."""
        out = []
        for part in self._split(text, list(self.merges.added.items())):
            if isinstance(part, int):
                out.append(part.to_bytes(4, "little"))
            elif len(part) <= CHUNK:
                out.append(self._pieces(self.find(part)))
            else:
                out += [self.feed(part[i:i + CHUNK]) for i in range(0, len(part), CHUNK)]
                out.append(self.finish())
        return b"".join(out)

    def _split(self, text: str, added: list[tuple[str, int]]) -> Iterator[str | int]:
        if not added:
            yield text
            return
        (token, number), *rest = added
        for i, part in enumerate(text.split(token)):
            if i:
                yield number
            if part:
                yield from self._split(part, rest)


class Decoder:
    """Ids to text, in parts: bytes of a character that is not complete yet wait in the state."""

    def __init__(self, merges: Merges) -> None:
        self.bytes = np.array([*merges.bytes, None], object)[:-1]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        return self.state.decode(b"".join(self.bytes[np.frombuffer(ids, "<u4")].tolist()), last)

    def decode(self, ids: bytes) -> str:
        step = 4 * CHUNK
        if len(ids) <= step:
            text = self.feed(ids, True)
        else:
            text = "".join([self.feed(ids[i:i + step]) for i in range(0, len(ids), step)])
            text += self.feed(b"", True)
        self.state.reset()
        return text


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"encoder {path}", lambda: Encoder(Merges(path)))
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids = [encoder.encode(x) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
    return run


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_worker(f"decoder {path}", lambda: Decoder(Merges(path)))
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [decoder.decode(x) for x in arrow_texts(batch, "ids")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_tokens"), batch.column("ids"),
                     pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit). ``path``: a tokenizer file."""
    return id_text(docs, id_col, text_col).mapInArrow(
        _encode_rows(path), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text ``decoded`` from its ids."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        _decode_rows(path), "doc_id long, n_tokens long, ids binary, decoded string")


@query("op3_bpe_codec")
def op3_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return decode(encode(documents(spark, folder), path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
