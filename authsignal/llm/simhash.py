"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A fingerprint takes the majority of each bit over the hashes of a document's word shingles. Distinct
fingerprints are laid out in tiles by the population counts of their four 16-bit quarters. Two
fingerprints that differ in at most ``radius`` bits have quarter counts that differ by at most
``radius`` in sum, so all other tile pairs are skipped; the rest are compared exactly with
exclusive-or and bit counts. A tile has a bounded number of fingerprints, however many share its
counts, and a tile pair reports a spanning forest of its links, never all pairs.

Defined cases: a null text counts as empty; a text with no words has fingerprint zero; copies share
one fingerprint and are compared once; a repeated row gets the same result; a null id never becomes
a component id unless its class has no other; an empty table gives no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.functions.skew import attach_by_key
from authsignal.llm.common import batches, ship, texts
from authsignal.llm.graph import LIMITS, components, flat_labels, lowest_of_class

SEED = 42
TILE = 2048
QUARTERS = 4
LEVELS = 17  # a quarter has 0 to 16 bits set
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())],
        dtype="<u8",
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    return int(sum(1 << bit for bit in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp long): the fingerprint of each whole text, as a signed long."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks.view(np.int64))], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def quarter_counts(fp: str = "fp"):
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(65535))).cast("int") for k in range(QUARTERS)]


def cell_of(counts):
    """One number for the four quarter counts; there are at most 17 ** 4 of them."""
    cell = counts[0]
    for count in counts[1:]:
        cell = cell * LEVELS + count
    return cell


def tiles(marks: DataFrame, size: int = TILE) -> DataFrame:
    """Rows (cell, sub, fps): about ``size`` distinct fingerprints of one cell at most."""
    marks = marks.withColumn("cell", cell_of(quarter_counts()))
    # one row per cell, 17 ** 4 = 83,521 at most: under 2 MB
    parts = marks.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("parts"))
    return (
        marks.join(F.broadcast(parts), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("sub"))
        .agg(F.collect_list("fp").alias("fps"))
    )


def neighbour_steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that ``radius`` allows, one of each pair of opposites."""
    steps = product(range(-radius, radius + 1), repeat=QUARTERS)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]


def tile_pairs(laid: DataFrame, radius: int) -> DataFrame:
    """Rows (cell_a, sub_a, cell_b, sub_b), each pair of tiles within the radius once."""
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{k}") for k, d in enumerate(s))) for s in neighbour_steps(radius)))
    place = laid.select(F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"))
    moved = place.withColumn("step", F.explode(steps))
    counts = [
        (F.floor(F.col("cell_a") / F.lit(LEVELS ** (QUARTERS - 1 - k))) % LEVELS).cast("int") + F.col(f"step.d{k}")
        for k in range(QUARTERS)
    ]
    inside = F.lit(True)
    for count in counts:
        inside = inside & count.between(0, LEVELS - 1)
    moved = moved.where(inside).select("cell_a", "sub_a", cell_of(counts).alias("cell_b"))
    others = laid.select(F.col("cell").alias("cell_b"), F.col("sub").alias("sub_b"))
    return moved.join(others, "cell_b").where("cell_a <> cell_b OR sub_b >= sub_a")


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest, as rows (fp, fp), of the links between two tiles, or within one (``b`` None)."""
    both = a if b is None else np.concatenate((a, b))
    right, shift = (a, 0) if b is None else (b, len(a))
    labels = np.arange(len(both))
    block = max(1, 1_000_000 // max(1, len(right)))
    for low in range(0, len(a), block):
        near = np.bitwise_count(a[low : low + block, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        labels = flat_labels(i + low, j + shift, labels)
    linked = np.flatnonzero(labels != np.arange(len(both)))
    return np.stack((both[linked], both[labels[linked]]), axis=1)


def links(marks: DataFrame, radius: int = 2, size: int = TILE) -> DataFrame:
    """Rows (a long, b long): links that connect all fingerprints within the radius."""
    ship(marks.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    laid = written(tiles(marks, size), "tiles")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in parts:
                ways = part.column("same").to_pylist()
                lefts, rights = part.column("fps_a"), part.column("fps_b")
                for k, same in enumerate(ways):
                    a = lefts[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    b = None if same else rights[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    yield from map(tuple, tile_links(a, b, radius).view(np.int64).tolist())

        yield from batches(found(), schema)

    one = laid.select(F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"), F.col("fps").alias("fps_a"))
    two = laid.select(F.col("cell").alias("cell_b"), F.col("sub").alias("sub_b"), F.col("fps").alias("fps_b"))
    loaded = tile_pairs(laid, radius).join(one, ["cell_a", "sub_a"]).join(two, ["cell_b", "sub_b"])
    same = F.expr("cell_a = cell_b AND sub_a = sub_b").alias("same")
    return loaded.select(same, "fps_a", "fps_b").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE
) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest id reachable over links of ``radius`` bits."""
    marks = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "distinct")
    roots = written(components(links(distinct.select("fp"), radius, tile)).withColumnRenamed("node", "fp"), "roots")
    classes = lowest_of_class(distinct, roots, "fp")
    final = distinct.join(classes, "fp", "left").select("fp", "copies", F.coalesce("lowest", "first_id").alias("component_id"))
    # a fingerprint that many documents share is cut into parts
    return attach_by_key(marks, final, "fp", "copies", "doc_id", LIMITS).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
