"""WARC archives of web pages, compressed record by record with a Zstandard dictionary.

Each task writes one archive: it holds back its first records (up to ``Limits.sample_bytes``),
trains a dictionary on them, writes the dictionary in a leading skippable frame and then every
record in a frame of its own, so that a reader can start at any record. Of records with equal
payloads one is a response; the others are revisits that refer to it and carry no payload again.
Which one is decided beforehand from digests: groups are reduced to their smallest id before rows
meet, so a payload that a third of all pages share is not gathered anywhere.

Archives are written next to their place and moved there when they are whole; the manifest lists
those that count. A lost executor's archives are lost only with the shared folder.

Defined cases: a null payload counts as empty; payloads below ``least`` bytes are always responses;
rows that repeat the smallest id of a group are all responses; a null id is a response where its
group has no other id, else a revisit; a null or odd URL is written as the record's own name; a
task with too few records for a dictionary writes plain frames; an empty table gives no archives;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.llm.common import batches, rows_of, ship

# ---- fixed values of the formats ----
SKIPPABLE = 0x184D2A5D  # the skippable frame that holds a dictionary
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


@dataclass(frozen=True)
class Limits:
    least: int = 100  # smaller payloads are never revisits
    sample_bytes: int = 1 << 20  # records of a task that its dictionary is trained on
    dictionary_bytes: int = 32 << 10
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"  # the pages tell no date of their own


def with_references(pages: DataFrame, limits: Limits, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows (page_id, url, payload, digest, n, refers_to); refers_to is null for responses."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    groups = rows.where(F.col("n") >= limits.least).groupBy("digest")
    shared = groups.agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    # written first: its size is known when the join is planned, and a hot digest can be split
    shared = written(shared.drop("copies"), "shared_payloads")
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "digest", "n", F.when(~own, F.col("first")).alias("refers_to")
    )


def name(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def page_of(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def record(page_id, url, payload: bytes, digest: str, n: int, refers_to, date: str) -> bytes:
    """One WARC record; a revisit's block is the HTTP head alone."""
    block = HTTP_HEAD.format(n).encode() + (payload if refers_to is None else b"")
    target = url if url and url.isprintable() and " " not in url else name(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name(page_id)}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{name(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compressor(sample: list[bytes], limits: Limits):
    """A compressor and its dictionary's bytes; empty where the sample is too small for one."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(limits.dictionary_bytes, sample, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressor(level=limits.level), b""
    trained.precompute_compress(level=limits.level)
    return zstandard.ZstdCompressor(level=limits.level, dict_data=trained), trained.as_bytes()


def write_archives(
    pages: DataFrame,
    path: str,
    limits: Limits = Limits(),
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Write the pages under ``path``; returns the written manifest (file, records, bytes)."""
    ship(pages.sparkSession)
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def records():
            for part in parts:
                for row in rows_of(part, "page_id", "url", "payload", "digest", "n", "refers_to"):
                    yield record(*row, limits.date)

        rows, sample, held = records(), [], 0
        for one in rows:
            sample.append(one)
            held += len(one)
            if held >= limits.sample_bytes:
                break
        if not sample:
            return
        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        own = f"part-{task.partitionId():06d}.warc.zst"
        draft = f"{folder}/.{own}.{task.taskAttemptId()}"
        pack, dictionary = compressor(sample, limits)
        count = size = 0
        with store.open_output_stream(draft) as out:
            if dictionary:
                size += out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            for source in (sample, rows):
                for one in source:
                    size += out.write(pack.compress(one))
                    count += 1
        store.move(draft, f"{folder}/{own}")
        yield from batches([(own, count, size)], schema)

    rows = with_references(pages, limits, id_col, url_col, payload_col)
    # a revisit carries no payload, so none is sent to the writer
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    return written(rows.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block


def opened(file) -> io.BufferedIOBase:
    """The records of a compressed archive, decompressed as they are read."""
    import zstandard

    start = file.read(8)
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE:
        words = zstandard.ZstdCompressionDict(file.read(struct.unpack("<I", start[4:])[0]))
        tool = zstandard.ZstdDecompressor(dict_data=words)
    else:
        file.seek(0)
        tool = zstandard.ZstdDecompressor()
    return io.BufferedReader(tool.stream_reader(file, read_across_frames=True), 1 << 18)


def read_archives(manifest: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: its page, type, digest, length and reference, and the payload if asked for.

    Length and digest of a response are taken from the payload itself, of a revisit from its head.
    """
    ship(manifest.sparkSession)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def found():
            for part in parts:
                for file in part.column("file").to_pylist():
                    store, folder = fs.FileSystem.from_uri(path)
                    with store.open_input_file(f"{folder}/{file}") as raw:
                        for head, block in parse(opened(raw)):
                            first, _, payload = block.partition(b"\r\n\r\n")
                            page, kind, url = page_of(head["WARC-Record-ID"]), head["WARC-Type"], head["WARC-Target-URI"]
                            if kind == "response":
                                row = (page, url, len(payload), hashlib.sha256(payload).hexdigest(), kind, None)
                            else:
                                n = int(first.rpartition(b": ")[2])
                                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                                row = (page, url, n, digest, kind, page_of(head["WARC-Refers-To"]))
                            yield row + (payload,) * payloads

        yield from batches(found(), schema, 256 if payloads else 4096)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = manifest.select("file")
    return files.repartition(max(1, files.count())).mapInArrow(run, ddl + ", payload binary" * payloads)
