"""Best-fit-decreasing packing of documents into windows of tokens.

Every document is encoded and cut: full windows first, then the rest. Pieces are placed by
decreasing length, each into the open window with the least room that still holds it. That window
is found by a segment tree over remaining capacities. Pieces of one length are interchangeable, so
the tree works on counts: its input is the histogram of lengths and its result says, for runs of
ranks within a length, which windows they fill and where. Both have a size that depends on the
window only, whatever the number of documents; the pieces themselves are ranked and placed by joins.

Defined cases: a null text counts as empty and is one piece of the end id; repeated rows are packed
each; ties of length go by the order of reading, which the written pieces fix; an empty table gives
no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.llm.common import batch_of, ship, texts
from authsignal.llm.encoding import encoder, in_chunks

PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, part int, nth long, ids binary"


def pieces(
    docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The written table of pieces, ids included (little-endian unsigned 32-bit).

    ``part`` and ``nth`` number the pieces of one length as they were read; since the table is
    written first, the numbers stay the same whatever is lost and run again later.
    """
    ship(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())]
        + [("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())]
    )
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * window

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        encode = encoder(tokenizer).encode
        for part in parts:
            names = iter(part.column("doc_id").to_pylist())
            for chunk in in_chunks(part.column("text").to_pylist()):
                rows = []
                for ids in encode(chunk):
                    ids += end
                    doc_id, total = next(names), len(ids) // 4
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        length = len(piece) // 4
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc_id, at // 4, length, total, zlib.crc32(piece), part_no, nth, piece))
                yield batch_of(rows, schema)

    return written(texts(docs, id_col, text_col).mapInArrow(run, PIECES), "pieces", compression="zstd")


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over runs of window numbers."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, deque] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self.runs.setdefault(room, deque()).append((first, count))
        self._change(room, count)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` windows of this room: the first number and how many."""
        first, count = self.runs[room].popleft()
        if count > most:
            self.runs[room].appendleft((first + most, count - most))
            count = most
        self._change(room, -count)
        return first, count

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open window has."""
        node = self.leaves + length
        if self.tree[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node //= 2


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, sequence, each, offset).

    The pieces of ``length`` with ranks first <= r < last go to window sequence + (r - first) / each
    at offset + length * ((r - first) mod each). After a piece is placed its window is the tightest
    one for the next of the same length, so a window takes ``each`` pieces before the next begins.
    """
    free, made, rows = OpenWindows(window), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = free.tightest(length)
            each = min((room or window) // length, left)
            if room is None:
                room, first, count = window, made, left // each
                made += count
            else:
                first, count = free.take(room, left // each)
            placed = count * each
            rows.append((length, rank, rank + placed, first, each, window - room))
            if room > each * length:
                free.add(room - each * length, first, count)
            rank, left = rank + placed, left - placed
    return rows


def assign(cut: DataFrame, window: int = 4096) -> DataFrame:
    """The pieces, without ids, each with its sequence_id and offset."""
    spark = cut.sparkSession
    narrow = cut.drop("ids")
    sizes = written(narrow.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    # at most one row for each length up to the window
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    ranked = narrow.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    rows = plan(histogram, window)
    layout = spark.createDataFrame(rows, "length long, first long, last long, sequence long, each long, offset0 long")
    # a few rows for each length up to the window, however many pieces there are
    placed = ranked.join(F.broadcast(layout), "length").where("rank >= first AND rank < last")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.expr("sequence + (rank - first) DIV each").alias("sequence_id"),
        F.expr("offset0 + length * ((rank - first) % each)").alias("offset"),
    )


def fill(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows (sequence_id, n_tokens, doc_ids, ids): the packed windows themselves.

    Needs document ids that are not repeated, since pieces are found again by id and start.
    """
    own = placed.select("doc_id", "start", "sequence_id", "offset")
    joined = cut.select("doc_id", "start", "length", "ids").join(own, ["doc_id", "start"])
    return joined.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.transform(F.sort_array(F.collect_list(F.struct("offset", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"),
        F.expr("aggregate(transform(sort_array(collect_list(struct(offset, ids))), x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))").alias("ids"),
    )


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with the sequence and offset each was given."""
    return assign(pieces(docs, tokenizer, window, end_id), window)
