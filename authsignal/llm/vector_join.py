"""Near-duplicate vectors by an epsilon grid order join.

A cosine of at least c between two vectors is a distance of at most eps = sqrt(2 - 2c) between the
unit vectors, and projections to principal axes never lengthen a distance. Vectors of one label are
sorted by the cells, eps wide, that they fall in along the leading axes. Intervals of that order,
bounded in size, are the blocks of the join. Only block pairs whose boxes are within eps along the
axes are compared; a pair is joined by halving its intervals again and again, leaving out halves
that are too far apart, down to small squares whose cosines are computed exactly. Copies are
represented by one vector, and a pair of blocks reports a spanning forest of its links and, for each
vector, the number of others it links to, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those
without a label, link with nothing; vectors of different dimension don't link; rows that repeat a
vector and label link with each other whatever their ids; an empty table gives no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.functions.skew import attach_by_key
from authsignal.llm.common import batches, identity, rows_of, ship
from authsignal.llm.graph import LIMITS, components, flat_labels, lowest_of_class
from authsignal.llm.vectors import element, fitted_sample, units, usable

AXES = 4  # leading principal axes of the grid order
BLOCK = 1024  # vectors of a block
LEAF = 128  # intervals of this length are compared exactly
SLACK = 1e-9  # room for rounding where distances rule a pair out


def axes(sample: np.ndarray, count: int = AXES) -> np.ndarray:
    """Leading principal axes as rows; any axes give right results, good ones rule out more."""
    if not sample.size:
        return np.zeros((count, 0))
    spread = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(spread.T @ spread)
    return vectors[:, ::-1][:, :count].T


def along(rows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors on the axes; zero for vectors of another dimension."""
    found = np.zeros((len(rows), AXES))
    if rows.shape[1] == lead.shape[1]:
        found[:, : len(lead)] = rows @ lead.T
    return found


def blocks(reps: DataFrame, lead: np.ndarray, eps: float, kind: str) -> DataFrame:
    """Intervals of the grid order: rows (block, label, dim, low, high, reps, copies, vectors)."""
    cells = [f"c{k}" for k in range(AXES)]
    placed = pa.schema(
        [("rep", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("copies", pa.int64())]
        + [(c, pa.int32()) for c in cells]
        + [("vector", pa.binary())]
    )

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in parts:
                rows = list(rows_of(part, "rep", "label", "dim", "copies", "embedding"))
                for size in sorted({row[2] for row in rows}):
                    same = [row for row in rows if row[2] == size]
                    vectors = np.array([row[4] for row in same], dtype=np.float64)
                    cells_of = np.floor(along(units(vectors), lead) / eps).astype(int).tolist()
                    for row, cell, vector in zip(same, cells_of, vectors.astype(kind)):
                        yield *row[:4], *cell, vector.tobytes()

        yield from batches(found(), placed)

    out = pa.schema(
        [("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("low", pa.list_(pa.float64()))]
        + [("high", pa.list_(pa.float64())), ("reps", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())]
    )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, made = TaskContext.get().partitionId(), 0

        def block(rows: list[tuple]) -> tuple:
            nonlocal made
            made += 1
            vectors = b"".join(r[3] for r in rows)
            lines = along(units(np.frombuffer(vectors, kind).reshape(len(rows), -1).astype(np.float64)), lead)
            ids, copies = (np.array([r[k] for r in rows], dtype="<i8").tobytes() for k in (0, 4))
            number = (part_no << 32) + made
            return number, rows[0][1], rows[0][2], lines.min(axis=0).tolist(), lines.max(axis=0).tolist(), ids, copies, vectors

        def found():
            held: list[tuple] = []
            for part in parts:
                for row in rows_of(part, "rep", "label", "dim", "vector", "copies"):
                    if held and (len(held) == BLOCK or held[0][1:3] != row[1:3]):
                        yield block(held)
                        held = []
                    held.append(row)
            if held:
                yield block(held)

        yield from batches(found(), out, 8)

    ddl = "rep long, label string, dim int, copies long, " + ", ".join(f"{c} int" for c in cells) + ", vector binary"
    order = ["label", "dim", *cells, "rep"]
    source = reps.select("rep", "label", "dim", "copies", "embedding").mapInArrow(place, ddl)
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = "block long, label string, dim int, low array<double>, high array<double>, reps binary, copies binary, vectors binary"
    return written(ordered.mapInArrow(cut, ddl), "blocks")


def block_pairs(laid: DataFrame, eps: float) -> DataFrame:
    """Rows (a, b), a <= b: pairs of blocks of one label whose boxes are within eps of each other.

    Blocks meet by the cells that their boxes cover along the first two axes, so blocks that are far
    apart there never meet; the boxes decide on all axes.
    """
    cell = lambda c, k, up=0: (F.floor(F.col(c)[k] / F.lit(eps)) + up).cast("int")
    box = laid.select("block", "label", "dim", "low", "high")
    a = box.select(F.col("block").alias("a"), "label", "dim", F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                   F.explode(F.sequence(cell("low", 0, -1), cell("high", 0, 1))).alias("x"), F.sequence(cell("low", 1, -1), cell("high", 1, 1)).alias("ys"))
    b = box.select(F.col("block").alias("b"), "label", "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"),
                   F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("x"), F.sequence(cell("low", 1), cell("high", 1)).alias("ys"))
    a, b = (side.withColumn("y", F.explode("ys")).drop("ys") for side in (a, b))
    gap = F.lit(0.0)
    for k in range(AXES):
        apart = F.greatest(F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k], F.lit(0.0))
        gap = gap + apart * apart
    met = a.join(b, ["label", "dim", "x", "y"]).where((F.col("a") <= F.col("b")) & (gap <= eps * eps + SLACK))
    return met.select("a", "b").distinct()


def interval_join(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, eps: float, same: bool, compare) -> None:
    """Halve two intervals of the grid order until they are small or provably apart."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        gap = np.maximum(0.0, np.maximum(la[i:j].min(axis=0) - lb[k:m].max(axis=0), lb[k:m].min(axis=0) - la[i:j].max(axis=0)))
        if gap @ gap > eps * eps + SLACK or same and m <= i:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            compare(i, j, k, m)
            continue
        if j - i >= m - k:
            half = (i + j) // 2
            todo += [(i, half, k, m), (half, j, k, m)]
        else:
            half = (k + m) // 2
            todo += [(i, j, k, half), (i, j, half, m)]


def pair_links(a: np.ndarray, b: np.ndarray | None, na: np.ndarray, nb: np.ndarray, lead: np.ndarray, least: float):
    """Labels of the spanning forest over both blocks, and how many vectors each vector links to."""
    same = b is None
    b = a if same else b
    eps = float(np.sqrt(2 - 2 * least))
    labels = np.arange(len(a) if same else len(a) + len(b))
    count_a, count_b = np.zeros(len(a)), np.zeros(len(b))

    def compare(i: int, j: int, k: int, m: int) -> None:
        nonlocal labels
        near = a[i:j] @ b[k:m].T >= least
        if same:
            near &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if near.any():
            rows, columns = np.nonzero(near)
            labels = flat_labels(rows + i, columns + k + (0 if same else len(a)), labels)
            count_a[i:j] += near @ nb[k:m]
            count_b[k:m] += na[i:j] @ near

    interval_join(a, b, along(a, lead), along(b, lead), eps, same, compare)
    return labels, count_a + count_b if same else np.concatenate((count_a, count_b))


def block_links(laid: DataFrame, pairs: DataFrame, lead: np.ndarray, least: float, kind: str) -> DataFrame:
    """Rows (a, b, n): an edge where b is not null, else n more links of the copies of a."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in parts:
                for a, b, dim, ra, rb, na, nb, va, vb in rows_of(part, "a", "b", "dim", "ra", "rb", "na", "nb", "va", "vb"):
                    sides = [units(np.frombuffer(v, kind).reshape(-1, dim).astype(np.float64)) for v in ((va,) if a == b else (va, vb))]
                    ids = np.frombuffer(ra if a == b else ra + rb, "<i8")
                    counts = [np.frombuffer(n, "<i8").astype(np.float64) for n in (na, nb)]
                    labels, links = pair_links(sides[0], None if a == b else sides[1], *counts, lead, least)
                    for k in np.flatnonzero(labels != np.arange(len(labels))).tolist():
                        yield int(ids[k]), int(ids[labels[k]]), 0
                    for k in np.flatnonzero(links).tolist():
                        yield int(ids[k]), None, int(links[k])

        yield from batches(found(), schema)

    side = lambda s: laid.select(F.col("block").alias(s), F.col("reps").alias(f"r{s}"), F.col("copies").alias(f"n{s}"), F.col("vectors").alias(f"v{s}"), *(["dim"] if s == "a" else []))
    loaded = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "dim", "ra", "rb", "na", "nb", "va", "vb")
    return written(loaded.mapInArrow(run, "a long, b long, n long"), "links")


def near_duplicates(
    rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of the input."""
    ship(rows.sparkSession)
    own = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding")
    )
    kind, eps = element(own), float(np.sqrt(2 - 2 * least))
    own = own.withColumn("usable", usable() & F.col("label").isNotNull()).select("*", *identity("label", "embedding"))
    groups = own.where("usable").groupBy("key_a", "key_b")
    reps = groups.agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), "*", F.size("embedding").alias("dim")), "vectors")
    lead = axes(fitted_sample(reps, "rep"))
    laid = blocks(reps, lead, eps, kind)
    links = block_links(laid, written(block_pairs(laid, eps), "block_pairs"), lead, least, kind)
    more = links.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = written(components(links.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep"), "roots")
    classes = lowest_of_class(reps, roots, "rep")
    final = (
        reps.select("rep", "key_a", "key_b", "first_id", "copies")
        .join(more, "rep", "left")
        .join(classes, "rep", "left")
        .select(
            F.struct("key_a", "key_b").alias("key"),
            "copies",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("lowest", "first_id").alias("component_id"),
        )
    )
    # vectors that take no part stay out of the join; a vector with many copies is cut into parts
    asked = own.where("usable").select("vec_id", F.struct("key_a", "key_b").alias("key"))
    found = attach_by_key(asked, final, "key", "copies", "vec_id", LIMITS).select("vec_id", "n_links", "component_id")
    alone = own.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.unionAll(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept)
