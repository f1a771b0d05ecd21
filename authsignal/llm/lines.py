"""Repeated passages of whole lines, found by winnowing over line hashes.

Lines are hashed. A window begins at every line and ends with the line that brings it to
``least_words`` words; the line of least hash in it is its fingerprint. Equal windows choose equal
fingerprints, so every passage of whole lines that repeats with that many words or more has its
fingerprints in common with the earlier one. A line that several windows choose counts as one place;
fingerprints of one place in the corpus are dropped by counts alone. The windows around the others are joined, by fingerprint and content, to the first place in
the corpus where they stand. To extend a match both ways, windows are also laid backwards, one
ending at every line: the lines on either side that belong to the longer match are in one of the two
kinds. So exactly those lines are deleted that lie in a run of whole lines with ``least_words``
words or more which also stands at an earlier place. Only first places are joined, so a passage in a
third of all documents costs a row an occurrence; the first occurrence of any line stays.

Order is that of doc_id (nulls first), then of the line. Lines are compared without white space at
their ends; blank lines neither count nor break a run of lines.

Defined cases: a null text counts as empty and stays empty; rows that repeat one id and text are
one document and lose the same lines, rows that share an id but not the text go by a hash of it; a
document with fewer words has no window and stays whole; a line of any length is hashed whole; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authsignal.functions.shared import release, written
from authsignal.llm.common import batches, rows_of, ship

LEAST_WORDS = 50
WINDOWS = "doc_id long, mark long, first int, last int, fingerprint long, content long, fresh int"


def document_lines(text: str) -> tuple[list[int], list[int], list[int]]:
    """Places, hashes (signed) and word counts of the lines that are not blank."""
    places, hashes, counts = [], [], []
    for place, line in enumerate(text.split("\n")):
        line = line.strip()
        if line:
            places.append(place)
            hashes.append(line)
            counts.append(len(line.split()))
    marks = np.array([xxhash.xxh64_intdigest(line.encode(), 42) for line in hashes], dtype=np.uint64)
    return places, marks.view(np.int64).tolist(), counts


def document_windows(text: str, least_words: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first, last, fingerprint, content, fresh) of each window; lines that are blank aren't counted.

    Of equal least hashes the first line is chosen, so equal windows choose lines equally far in.
    ``fresh`` is 1 once for every line chosen, however many windows choose it.
    """
    _, hashes, counts = document_lines(text)
    if sum(counts) < least_words:
        return
    totals = np.concatenate(([0], np.cumsum(counts)))
    starts = np.arange(np.searchsorted(totals, totals[-1] - least_words, "right"))
    forwards = zip(starts.tolist(), np.searchsorted(totals, totals[starts] + least_words).tolist())
    ends = np.arange(np.searchsorted(totals, least_words), len(totals))
    backwards = zip((np.searchsorted(totals, totals[ends] - least_words, "right") - 1).tolist(), ends.tolist())
    blob = np.array(hashes, dtype="<i8").tobytes()
    chosen = set()
    for first, end in {*forwards, *backwards}:
        content = xxhash.xxh64_intdigest(blob[8 * first : 8 * end], 7)
        least = min(hashes[first:end])
        line = hashes.index(least, first)
        fresh = int(line not in chosen)
        chosen.add(line)
        yield first, end - 1, least, content - ((content >> 63) << 64), fresh


def windows(docs: DataFrame, least_words: int) -> DataFrame:
    ship(docs.sparkSession)
    kinds = {"doc_id": pa.int64(), "mark": pa.int64(), "first": pa.int32(), "last": pa.int32()}
    schema = pa.schema(list((kinds | {"fingerprint": pa.int64(), "content": pa.int64(), "fresh": pa.int32()}).items()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in parts:
                for doc_id, mark, text in rows_of(part, "doc_id", "mark", "text"):
                    for window in document_windows(text, least_words):
                        yield doc_id, mark, *window

        yield from batches(found(), schema)

    return docs.mapInArrow(run, WINDOWS)


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc_id, mark, first, last): later runs of lines that an earlier place has too.

    ``mark`` is the hash of the text; lines are counted without the blank ones.
    """
    held = written(windows(docs, least_words), "windows", compression="zstd")
    chosen = held.groupBy("fingerprint").agg(F.sum("fresh").alias("n"))
    common = written(chosen.where("n > 1").select("fingerprint"), "common")
    shared = written(held.drop("fresh").join(common, "fingerprint"), "shared_windows", compression="zstd")
    release(docs.sparkSession, held, common)
    place = F.struct("doc_id", "mark", "first")
    sources = shared.groupBy("fingerprint", "content").agg(F.min(place).alias("source"), F.count("*").alias("n"))
    sources = written(sources.where("n > 1").select("fingerprint", "content", "source"), "sources")
    pairs = shared.join(sources, ["fingerprint", "content"])
    return pairs.where(place > F.col("source")).select("doc_id", "mark", "first", "last")


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the runs, and how many lines went."""
    places, _, _ = document_lines(text)
    gone = set()
    at = 0
    for first, last in sorted(runs):
        for k in range(max(first, at), last + 1):
            gone.add(places[k])
        at = max(at, last + 1)
    kept = [line for place, line in enumerate(text.split("\n")) if place not in gone]
    return "\n".join(kept), len(gone)


def deduplicate(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, text, removed_lines, kept): each text without the later runs of repeated lines.

    ``kept`` is a struct of the columns named in ``keep``; without any it is left out.
    """
    ship(docs.sparkSession)
    held = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    ).withColumn("mark", F.xxhash64("text"))
    runs = repeated_runs(held.select("doc_id", "mark", "text"), least_words)
    # the runs of one document; rows that repeat an id and text name the same ones
    by_doc = runs.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    named = written(by_doc, "repeated_runs").withColumnsRenamed({"doc_id": "run_id", "mark": "run_mark"})
    same = F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("mark") == F.col("run_mark"))
    # the runs grow with the corpus, so they are never broadcast, at any size
    joined = held.join(named.hint("merge"), same, "left").drop("mark", "run_id", "run_mark")
    fields = [f for f in held.schema.fields if f.name != "mark"]
    schema = T.StructType([*fields, T.StructField("removed_lines", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [
                without(text, [(r["first"], r["last"]) for r in pairs]) if pairs else (text, 0)
                for text, pairs in rows_of(part, "text", "runs")
            ]
            new = {"text": pa.array([f[0] for f in found], pa.string()), "removed_lines": pa.array([f[1] for f in found], pa.int64())}
            columns = [new[name] if name in new else part.column(name) for name in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
