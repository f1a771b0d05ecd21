"""Nearest neighbours by randomly rotated one-bit codes.

Unit vectors are taken relative to a common centre and rotated at random; the signs of the rotated
coordinates, packed to bits, are the code. With two correction scalars a vector, its distance to the
centre and the inner product of its direction with its own code, the inner product with any query
is estimated from bit counts against the bit planes of the rotated query, with an error bound that
holds with high probability. A search estimates all codes of a block, reranks exactly the few that
look best, and then every other vector whose bound still allows it among the nearest.

The index is a table of blocks in the shared folder and holds every usable vector; only the centre
is fitted on a bounded sample. Queries go through the index in blocks, so neither side is ever in
one place as a whole; what a block of queries keeps of a block of vectors is its nearest few.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and rows
without an id take no part; of rows that repeat an id the vector that sorts first counts; ties go to
the smaller id; vectors of another dimension than the query's are no candidates; with fewer
candidates than asked for all are returned; an empty table gives no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.llm.common import batches, rows_of, ship
from authsignal.llm.vectors import element, fitted_sample, units, usable


@dataclass(frozen=True)
class Settings:
    block: int = 4096  # vectors of an index block
    queries: int = 256  # queries whose estimates are made together
    together: int = 8  # blocks of queries that one copy of an index block is sent for
    most_tasks: int = 50_000  # of one search
    planes: int = 8  # bits a coordinate of a rotated query
    bound: float = 2.0  # width of the error bound, in standard deviations about
    seed: int = 42


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task, made once a worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centred(rows: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit directions from the centre, and distances to it."""
    own = units(rows) - (centre if len(centre) == rows.shape[1] else 0.0)
    far = np.sqrt((own * own).sum(axis=1))
    return own / np.where(far > 0, far, 1.0)[:, None], far


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words."""
    packed = np.packbits(bits, axis=1)
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view("<u8")


def codes(rows: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances to the centre and inner products of each direction with its code."""
    direction, far = centred(rows, centre)
    turned = direction @ turn
    own = np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1])
    return words(turned > 0), far, np.where(far > 0, own, 1.0)


class Queries:
    """A block of queries against the codes of a block of vectors."""

    def __init__(self, rows: np.ndarray, centre: np.ndarray, turn: np.ndarray, settings: Settings):
        direction, self.far = centred(rows, centre)
        turned = direction @ turn
        self.units, self.dim, self.settings = units(rows), rows.shape[1], settings
        top = (1 << settings.planes) - 1
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / top, 1e-12)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = levels.sum(axis=1)
        self.planes = [words(((levels >> k) & 1).astype(bool)) for k in range(settings.planes)]
        # rounding moves each coordinate by half a step at most
        self.rounding = self.step * np.sqrt(self.dim) / 2

    def estimates(self, code: np.ndarray, own: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of directions, one row a query, and how far they may be off."""
        dot = np.zeros((len(self.units), len(code)))
        for k, plane in enumerate(self.planes):
            for word in range(code.shape[1]):
                dot += np.bitwise_count(plane[:, word, None] & code[None, :, word]) * float(1 << k)
        low, step = self.low[:, None], self.step[:, None]
        signs = 2 * step * dot + 2 * low * ones - step * self.total[:, None] - self.dim * low
        error = self.settings.bound * np.sqrt(np.maximum(0.0, 1 - own * own)) / own / np.sqrt(max(1, self.dim - 1))
        return signs / np.sqrt(self.dim) / own, error + self.rounding[:, None] / own

    def cosines(self, code, own, ones, far) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with the queries: estimated, and bounded from above."""
        inner, error = self.estimates(code, own, ones)
        both = self.far[:, None]
        within = lambda x: 1 - (far * far + both * both - 2 * far * both * np.minimum(1.0, x)) / 2
        return within(inner), within(inner + error)


def nearest(query_ids, queries: Queries, ids, rows, code, own, ones, far, most: int) -> Iterator[tuple[int, int, float]]:
    """The nearest of one block, by query: exact scores for all whose bound allows them among the first.

    ``rows`` are unit vectors.
    """
    guesses, bounds = queries.cosines(code, own, ones, far)
    for query_id, unit, guess, bound in zip(query_ids.tolist(), queries.units, guesses, bounds):

        def exact(places: np.ndarray) -> np.ndarray:
            # summed row by row in one order, so that equal vectors score the same wherever they stand
            return np.clip((rows[places] * unit).sum(axis=1), -1.0, 1.0)

        left = np.flatnonzero(ids != query_id)
        if not len(left):
            continue
        if len(left) > most:
            first = left[np.argpartition(-guess[left], most - 1)[:most]]
            least = exact(first).min()
            left = np.union1d(left[bound[left] >= least - 1e-12], first)
        scores = exact(left)
        order = np.lexsort((ids[left], -scores))[:most]
        for vec_id, score in zip(ids[left][order].tolist(), scores[order].tolist()):
            yield query_id, vec_id, score


def candidates(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    own = own.where(usable() & F.col("vec_id").isNotNull())
    return own.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


INDEX = "block long, dim int, n long, ids binary, vectors binary, codes binary, far binary, own binary"


def build_index(vectors: DataFrame, centre: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """The written index over all rows of ``candidates``: blocks of vectors of one dimension."""
    ship(vectors.sparkSession)
    kind = element(vectors)
    names = [("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int64())]
    schema = pa.schema(names + [(c, pa.binary()) for c in ("ids", "vectors", "codes", "far", "own")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, made = TaskContext.get().partitionId(), 0

        def block(dim: int, held: list[tuple]) -> tuple:
            nonlocal made
            made += 1
            ids = np.array([r[0] for r in held], dtype="<i8")
            rows = np.array([r[1] for r in held], dtype=kind)
            code, far, own = codes(rows.astype(np.float64), centre, rotation(dim, settings.seed))
            return (part_no << 32) + made, dim, len(held), ids.tobytes(), rows.tobytes(), code.tobytes(), far.tobytes(), own.tobytes()

        def found():
            held: dict[int, list] = {}
            for part in parts:
                for vec_id, vector, dim in rows_of(part, "vec_id", "embedding", "dim"):
                    held.setdefault(dim, []).append((vec_id, vector))
                    if len(held[dim]) >= settings.block:
                        yield block(dim, held.pop(dim))
            for dim, rest in held.items():
                yield block(dim, rest)

        yield from batches(found(), schema, 4)

    return written(vectors.mapInArrow(run, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, centre: np.ndarray, most: int = 5, settings: Settings = Settings()) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the nearest indexed vectors of each of ``queries``."""
    spark = index.sparkSession
    ship(spark)
    kind = element(queries)
    names = [("query_block", pa.int64()), ("dim", pa.int32()), ("query_ids", pa.binary()), ("query_vectors", pa.binary())]
    schema = pa.schema(names)

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, made = TaskContext.get().partitionId(), 0

        def block(dim: int, held: list[tuple]) -> tuple:
            nonlocal made
            made += 1
            ids, rows = np.array([r[0] for r in held], dtype="<i8"), np.array([r[1] for r in held], dtype=kind)
            return (part_no << 32) + made, dim, ids.tobytes(), rows.tobytes()

        def found():
            held: dict[int, list] = {}
            for part in parts:
                for vec_id, vector, dim in rows_of(part, "vec_id", "embedding", "dim"):
                    held.setdefault(dim, []).append((vec_id, vector))
                    if len(held[dim]) >= settings.queries:
                        yield block(dim, held.pop(dim))
            for dim, rest in held.items():
                yield block(dim, rest)

        yield from batches(found(), schema, 4)

    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in parts:
                columns = ("dim", "ids", "vectors", "codes", "far", "own", "query_ids", "query_vectors")
                for dim, ids, rows, code, far, own, query_ids, query_rows in rows_of(part, *columns):
                    ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                    rows, query_rows = (np.frombuffer(v, kind).reshape(-1, dim).astype(np.float64) for v in (rows, query_rows))
                    code = np.frombuffer(code, "<u8").reshape(len(ids), -1)
                    far, own = np.frombuffer(far, "<f8"), np.frombuffer(own, "<f8")
                    ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
                    asked = Queries(query_rows, centre, rotation(dim, settings.seed), settings)
                    yield from nearest(query_ids, asked, ids, units(rows), code, own, ones, far, most)

        yield from batches(found(), out)

    if index.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = written(queries.select("vec_id", "embedding", "dim"), "queries")
    gathered = asked.repartition(max(1, -(-asked.count() // settings.queries)))
    asked_blocks = written(gathered.mapInArrow(gather, "query_block long, dim int, query_ids binary, query_vectors binary"), "query_blocks")
    # every block of queries meets every block of the index: blocks are dealt to cells, those of queries to
    # bunches, and each pair of a cell and a bunch is about one block against a few, so more queries or
    # vectors make more tasks, not longer ones
    bunches = max(1, -(-asked_blocks.count() // settings.together))
    cells = max(1, min(index.count(), settings.most_tasks // bunches))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys, tasks = ("dim", "cell", "bunch"), cells * bunches
    held = index.withColumn("cell", dealt("block", cells)).withColumn("bunch", every(bunches)).repartition(tasks, *keys)
    sent = asked_blocks.withColumn("bunch", dealt("query_block", bunches)).withColumn("cell", every(cells)).repartition(tasks, *keys)
    met = held.join(sent.hint("merge"), [*keys]).select(
        "dim", "ids", "vectors", "codes", "far", "own", "query_ids", "query_vectors"
    )
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(
        "query_id", "rank", "vec_id", "score"
    )


def neighbours(
    rows: DataFrame,
    asked: Column,
    most: int = 5,
    settings: Settings = Settings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The nearest vectors of every row for which ``asked``, a condition on vec_id, holds."""
    vectors = candidates(rows, id_col, vector_col)
    sample = fitted_sample(vectors, "vec_id")
    centre = sample.mean(axis=0) if len(sample) else np.zeros(0)
    index = build_index(vectors, centre, settings)
    wanted = candidates(rows.where(asked), id_col, vector_col)
    return search(index, wanted, centre, most, settings)
