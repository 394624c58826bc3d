"""Operator 2: a deterministic, sharded WARC writer, and the reader of its archives.

1. Each page's payload is its html in UTF-8 (null: empty). Of pages with equal payloads of at least
   ``least`` bytes the one with the smallest page_id is a response; the others are revisits of it.
2. Pages are range-sorted by page_id: ranges hold about ``shard_bytes`` of payload. Split points come
   from a sample chosen by hash, so they depend on the table only. Each range is sorted and written by one
   task, which starts a new file when the compressed size reaches ``file_bytes``.
3. Record headers, ids, digests and lengths are made anew from the payload. A file is written under a
   temporary name of its own attempt; the manifest lists the attempts whose rows Spark accepted, and
   only those files are renamed to their final names. A task that is run again writes other
   temporary files. A repeated commit skips what is already in place.

Rows that share a page_id stay separate records; of those with equal payloads, one is the response.
Rows without page_id are written with an empty id, after which they sort first.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import bounded, query, shared_files, stage, total, work_path

FILE_BYTES = 8 << 20  # compressed size at which a file is closed
SHARD_BYTES = 8 * FILE_BYTES  # payload of a range, several files as pages pack to about half
SAMPLE = 64  # sampled rows a range, as expected
LEVEL = 6
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps the archives deterministic
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed: the name space of URLs

MANIFEST = ("shard int, number int, attempt string, records long, bytes long, sha1 string")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, key: int, copy: int) -> str:
    """Of the page, the hash of its id, address and content, and its number among wholly equal pages."""
    name = "" if page_id is None else str(page_id)
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}/{key}/{copy}')}>"


def record(page_id: int | None, key: int, copy: int, url: str, payload: bytes, refers_to: int | None,
           refers_key: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head of its payload and no body."""
    digest = digest32(payload)
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", record_id(page_id, key, copy)),
              ("WARC-Date", DATE),
              ("WARC-Target-URI", url),
              ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
              ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile",
                    "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers_to, refers_key, 0)),
                   ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    fields += [("X-Page-ID", "" if page_id is None else str(page_id)),
               ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member without time or name, so that equal data give equal bytes."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def file_name(shard: int, number: int) -> str:
    return f"pages-{shard:06d}-{number:05d}.warc.gz"


def _write(folder: str, file_bytes: int):
    """Task function: the sorted pages of a shard into files; one manifest row a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = shared_files(folder)
        out, state = None, {}

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([state["shard"]], pa.int32()),
                "number": pa.array([state["number"]], pa.int32()),
                "attempt": [state["attempt"]], "records": pa.array([state["records"]], pa.int64()),
                "bytes": pa.array([state["bytes"]], pa.int64()), "sha1": [state["sha"].hexdigest()]})

        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                for row in whole.slice(start, 200).to_pylist():
                    if out and (row["shard"] != state["shard"] or state["bytes"] >= file_bytes):
                        yield close()
                        out = None
                    if out is None:
                        again = state and row["shard"] == state["shard"]
                        state = {"shard": row["shard"],
                                 "number": state["number"] + 1 if again else 0,
                                 "attempt": f"_temporary/{uuid.uuid4().hex}",
                                 "records": 0, "bytes": 0, "sha": hashlib.sha1()}
                        out = files.open_output_stream(f"{root}/{state['attempt']}", compression=None)
                    # a line break in an address would end its header
                    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                    member = gzip_member(record(
                        row["page_id"], row["key"], row["copy"], url, row["payload"], row["refers_to"],
                        row["refers_key"], row["revisit"]))
                    out.write(member)
                    state["bytes"] += len(member)
                    state["records"] += 1
                    state["sha"].update(member)
        if out:
            yield close()
    return run


def sha1_of(files, path: str, size: int = 1 << 20) -> str:
    state = hashlib.sha1()
    with files.open_input_stream(path, compression=None) as stream:
        while data := stream.read(size):
            state.update(data)
    return state.hexdigest()


def _commit(folder: str):
    """Task function: rename the files of a manifest; one already in place stays if its digest agrees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = shared_files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                old = f"{root}/{row['attempt']}"
                new = f"{root}/{file_name(row['shard'], row['number'])}"
                there = files.get_file_info([old, new])
                if there[0].type == fs.FileType.File:
                    files.move(old, new)
                elif there[1].type != fs.FileType.File or sha1_of(files, new) != row["sha1"]:
                    raise FileNotFoundError(new)
            yield batch
    return run


def split_points(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Ids that part the pages into ranges of about ``shard_bytes``; from a sample chosen by hash."""
    rows, size = pages.count(), total(pages, F.col("n_bytes"))
    shards = -(-size // shard_bytes)
    if shards <= 1:
        return []
    every = max(1, rows // (shards * SAMPLE))
    sample = sorted(
        (r["page_id"], r["n_bytes"]) for r in pages.filter(
            F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0))
        .select("page_id", "n_bytes").collect())
    share, out, at = sum(n for _, n in sample) / shards, [], 0
    for page_id, n in sample:
        if at >= share * (len(out) + 1):
            out.append(page_id)
        at += n
    return sorted(set(out))


def write_archives(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = SHARD_BYTES,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``; returns the manifest as a written table."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"),
                        F.coalesce(pages["html"], F.lit("")).alias("html"))
    narrow = stage(rows.select(
        "page_id", F.octet_length("html").alias("n_bytes"), F.unhex(F.sha2("html", 256)).alias("sha"),
        F.xxhash64("page_id", "url", "html").alias("key")), "payloads")
    equal = stage(narrow.filter(F.col("n_bytes") >= least).groupBy("sha", "n_bytes").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "key")).alias("head"))
        .filter("rows > 1"), "equal")
    # one row for each page that is not a plain response; pages that are wholly equal count up
    revisits = stage(
        narrow.join(equal, ["sha", "n_bytes"])
        .select("page_id", "key", "n_bytes", F.col("head.page_id").alias("refers_to"),
                F.col("head.key").alias("refers_key"), (F.col("key") == F.col("head.key")).alias("first"))
        .groupBy("page_id", "key", "refers_to", "refers_key", "first").agg(F.count(F.lit(1)).alias("copies"))
        .filter("NOT first OR copies > 1"), "revisits")
    points = split_points(narrow, shard_bytes)
    shard = F.coalesce(F.array_size(F.filter(
        F.lit(points).cast("array<bigint>"), lambda x: x <= F.col("page_id"))), F.lit(0)) \
        if points else F.lit(0)
    merged = (
        rows.withColumn("key", F.xxhash64("page_id", "url", "html")).alias("a")
        .join(bounded(revisits).alias("b"), F.col("a.page_id").eqNullSafe(F.col("b.page_id"))
              & (F.col("a.key") == F.col("b.key")), "left")
        .select("a.page_id", "a.url", "a.key", F.col("html").cast("binary").alias("payload"),
                "refers_to", "refers_key", F.col("first"), F.coalesce("copies", F.lit(1)).alias("copies")))
    sorted_ = (merged.withColumn("shard", shard.cast("int"))
               # a range is the partition of its number; by a hash, ranges would meet in one task
               .repartitionById(len(points) + 1, "shard").sortWithinPartitions("shard", "page_id", "key"))
    files, root = shared_files(folder)
    files.create_dir(f"{root}/_temporary", recursive=True)
    manifest = stage(sorted_.mapInArrow(_number(_write(folder, file_bytes)), MANIFEST), "manifest")
    stage(manifest.mapInArrow(_commit(folder), MANIFEST), "committed")
    return manifest


def _number(write):
    """Of wholly equal rows, which stand next to each other, the first is the response."""
    names = ["page_id", "key", "url", "payload", "refers_to", "refers_key", "shard", "copy", "revisit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered():
            last, copy = None, 0
            for whole in batches:
                for start in range(0, whole.num_rows, 200):
                    batch = whole.slice(start, 200)
                    ids = list(zip(batch.column("page_id").to_pylist(),
                                   batch.column("key").to_pylist()))
                    copies, revisit = [], []
                    for at, first, refers in zip(ids, batch.column("first").to_pylist(),
                                                 batch.column("copies").to_pylist()):
                        copy = copy + 1 if at == last else 0
                        last = at
                        copies.append(copy)
                        revisit.append(first is False or first is True and copy > 0)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c) for c in names[:-2]]
                        + [pa.array(copies, pa.int64()), pa.array(revisit, pa.bool_())], names=names)
        yield from write(numbered())
    return run


RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, record_id string, payload binary")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    unpack, parts = zlib.decompressobj(31), []
    data = stream.read(size)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(size)
    if parts:
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict:
    """A record as a row; digests and lengths are checked against the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[:int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n")
                  if x.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']}")

    def number(name: str) -> int | None:
        return int(fields[name]) if fields.get(name) else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"],
            "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": number("X-Refers-To-Page"), "record_id": fields["WARC-Record-ID"],
            "payload": payload if kind == "response" else None}


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = shared_files(folder)
        names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.string(), pa.binary()]

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{file_name(row['shard'], row['number'])}"
                with files.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for data in members(stream):
                        rows.append(parse(data) if payloads else parse(data) | {"payload": None})
                        if len(rows) == 200:
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)
    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of committed archives, one task a file."""
    n = max(1, manifest.count())
    files = manifest.repartitionByRange(n, "shard", "number") if n > 1 else manifest
    return files.mapInArrow(_read(folder, payloads), RECORD)


@query("op2_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  CAST(CAST(from_hex(sha1(html)) AS BIT) AS VARCHAR) AS bits,
  min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes,
 list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT)
  + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT)
  + CAST(substr(bits, i * 5 + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> head THEN head END AS refers_to
FROM d""")
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    out = work_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{folder}/pages.parquet"), out)
    return read_archives(manifest, out, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
