"""Token ids in Parquet list columns, written in document order for selective reads.

Documents are dealt out by ranges of their id and sorted within each range, so files, row groups
and pages hold consecutive ids and their statistics are narrow. Ids are dictionary encoded (16 bits
for a vocabulary of 49k) or, as an option, delta encoded. Row groups are bounded in bytes and pages
in rows; with the page index a read of a few documents, or of counts without ids, loads only the
pages and columns it needs.

Defined cases: a null text counts as empty and holds the end id only; repeated rows are written
each, ordered by a hash of the text where ids tie; null ids come first; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.llm.common import ship, texts
from authsignal.llm.encoding import encoder, in_chunks

FILE = "doc_id long, part int, before long, n_tokens long, ids array<int>"
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write them under ``path`` in ascending order of their id.

    ``part`` numbers the ranges in order; ``before`` counts the ids that precede a document in its
    range, so its place among all ids follows from the totals of the ranges alone.
    """
    ship(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64())]
        + [("ids", pa.list_(pa.int32()))]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, before = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer).encode
        for part in parts:
            names, at = part.column("doc_id"), 0
            for chunk in in_chunks(part.column("text").to_pylist()):
                encoded = [ids + end for ids in encode(chunk)]
                sizes = np.array([len(ids) // 4 for ids in encoded], dtype=np.int64)
                ends = np.cumsum(sizes)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(encoded))])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                columns = [names.slice(at, len(chunk)), pa.array(np.full(len(chunk), part_no, np.int32))]
                columns += [pa.array(before + ends - sizes), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                at += len(chunk)
                before += int(ends[-1])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    options = ENCODINGS[encoding] | {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }
    ordered.mapInArrow(run, FILE).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with ids from ``low`` to ``high``; unread columns and pages are not loaded."""
    rows = spark.read.schema(FILE).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows


def range_starts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (part, first): how many ids precede each range; one row a range, ids unread."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first")), "starts")


def digests(rows: DataFrame) -> DataFrame:
    """Rows of ``read_tokens`` with the unsigned crc32 of their ids instead of the ids."""
    ship(rows.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("ids")
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            marks = lists.offsets.to_pylist()
            sums = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(marks, marks[1:])]
            kept = [part.column(name) for name in ("doc_id", "part", "before", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids of all documents before this one."""
    return rows.join(starts, "part").withColumn("start", F.col("first") + F.col("before")).drop("part", "first", "before")
