"""Conversations as a prefix trie, with totals of every subtree by centroid decomposition.

Every conversation is rebuilt (``rebuilt``) as a list of turns; each distinct beginning of a list is
a node, the empty one the root. A node is named by its smallest member and its depth, so the nodes
of one name form a path and a node's row in the path table of that conversation is found by an
equality join.

Subtree totals do not climb the trie depth by depth. Node weights are the numbers of members, so
that the weight of every subtree is known beforehand from the members' lengths. Each component of
the forest (at first the whole trie) is split at its centroid, the deepest node that still carries
half the component's weight. The totals of what hangs below it, within the component, are added to
every node from the centroid up to the component's top, where that weight is taken away again. The
children of the centroid and the part above it are the next components. All lose half their weight
each round, so a chain as long as the table takes logarithmically many rounds. Components of more
than ``Limits.nodes`` nodes are split by joins over the cluster, all of them at once; smaller ones
are finished by the same method inside tasks.

Nothing is gathered by conversation or node: turns are numbered through a range sort that cuts a
long conversation into several tasks, prefixes are combined by exclusive-or of hashes of (depth,
role, text) in blocks, and the ids that end at a node reach the hash in sorted pieces of bounded
length.

Defined cases: rows without a conversation id belong to no conversation and are left out; null roles
and texts are empty; turns of equal number are ordered by role, then text, and repeated rows are
turns of their own; null turns come first; the remainder of a negative id has its sign; without any
conversation there is no node. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.functions.shared import release, written
from authsignal.functions.skew import attach_by_key
from authsignal.llm.common import batches, identity, rows_of, ship

BLOCK = 4096  # turns whose prefixes are combined in one window, and nodes of one name in one key
PIECE = 1024  # ids joined to one text before the hash


@dataclass(frozen=True)
class Limits:
    nodes: int = 20_000  # components up to this size are finished inside a task


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, part, pos, key_a, key_b, points) in turn order, and one row per conversation and part.

    The sort is by range over all columns, so one conversation may lie in many parts; the place of
    a turn is its place in the part and the number of the conversation's turns in earlier parts.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    place = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("seq"), *identity("role", "text"), F.length("text").cast("long").alias("points")
    )
    rows = written(place.withColumn("part", F.shiftright("seq", 33)), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("part")
    # a conversation has at most one row for each part of the sort
    parts = parts.select(
        "conv_id", "part", "first", "n",
        (F.sum("n").over(before) - F.col("n")).alias("earlier"),
        F.sum("n").over(W.partitionBy("conv_id")).alias("length"),
    )
    return rows, written(parts, "parts")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, depth, key_a, key_b, points, length) and conversations (conv_id, length).

    A conversation takes the first h turns of the first of its ``group`` (all if there are fewer),
    then its own after the first h; h is the checksum of its id modulo ``most``.
    """
    rows, parts = numbered(turns)
    convs = parts.where("earlier = 0").select("conv_id", "length")
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.col("length").alias("head_length"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    head = F.col("conv_id") - F.col("conv_id") % group
    plan = convs.select("conv_id", "length", h.alias("h"), head.alias("head")).join(heads, "head", "left")
    taken = F.least("h", F.coalesce("head_length", F.lit(0)))
    plan = written(
        plan.select("conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")),
        "rebuilding",
    )
    # a key of this join has the rows of one conversation in one part of the sort
    by_part = parts.join(plan.withColumnRenamed("length", "new_length"), "conv_id").select(
        "conv_id", "part", (F.col("earlier") - F.col("first")).alias("shift"), "h", "taken", F.col("new_length").alias("length")
    )
    placed = rows.join(by_part, ["conv_id", "part"]).withColumn("pos", F.col("seq") + F.col("shift"))
    placed = written(placed.select("conv_id", "pos", "key_a", "key_b", "points", "h", "taken", "length"), "placed")
    own = placed.where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "key_a", "key_b", "points", "length"
    )
    first = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(
        F.col("conv_id").alias("head"), "pos", "key_a", "key_b", "points"
    )
    shared = plan.where("taken > 0").join(first, "head").where("pos < taken").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "key_a", "key_b", "points", "length"
    )
    return own.unionByName(shared), plan.select("conv_id", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, key, points, length): equal keys are equal beginnings; depth 0 is the root."""
    lanes = [F.xxhash64("depth", "key_a", "key_b").alias("a"), F.xxhash64(F.lit("b"), "depth", "key_a", "key_b").alias("b")]
    rows = turns.select("conv_id", "depth", "points", "length", *lanes, F.expr(f"depth div {BLOCK}").alias("block"))
    rows = written(rows, "rebuilt")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.bit_xor("a").over(before).alias("a0"), F.bit_xor("b").over(before).alias("b0"))
    inside = W.partitionBy("conv_id", "block").orderBy("depth")
    rows = rows.select("conv_id", "block", "depth", "points", "length", F.bit_xor("a").over(inside).alias("a"), F.bit_xor("b").over(inside).alias("b"))
    rows = rows.join(blocks.where("block > 0"), ["conv_id", "block"], "left")
    both = [F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0))).alias(c) for c in ("a", "b")]
    rows = rows.select("conv_id", "depth", "points", "length", *both)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("points"), "length", *[F.lit(0).cast("long").alias(c) for c in "ab"])
    rows = rows.unionByName(roots)
    return rows.select("conv_id", F.struct("depth", "a", "b").alias("key"), "depth", "points", "length")


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The path table (conv_id, depth, name, length) and the nodes.

    Nodes are (name, depth, parent, n_convs, n_children, points, weight): ``weight`` counts the
    members of all nodes in the subtree.
    """
    rows = written(prefixes(turns, convs), "prefixes")
    nodes = rows.groupBy("key").agg(
        F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.sum("length").alias("lengths")
    )
    nodes = written(nodes.withColumn("depth", F.col("key.depth")), "nodes")
    # a frequent first turn is a hot key: the helper cuts it into parts
    paths = attach_by_key(rows.select("key", "conv_id", "depth", "length"), nodes.select("key", "name", "n_convs"), "key", "n_convs", "conv_id")
    paths = written(paths.select("conv_id", "depth", "name", "length"), "paths")
    above = paths.select(F.col("conv_id").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = nodes.join(above, ["name", "depth"], "left")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["name", "depth"], "left").select(
        "name", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "points",
        (F.col("lengths") - F.col("n_convs") * (F.col("depth") - 1)).alias("weight"),
    )
    return paths, written(nodes, "trie")


VALUES = ("leaves", "saved")


def rollup(nodes: DataFrame, paths: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Subtree totals of ``leaves`` and ``saved``: rows (name, depth, n_leaves, saved_tokens).

    ``nodes`` has name, depth, parent, weight (of the subtree) and the two values.
    """
    ship(nodes.sparkSession)
    # a component is named by its top; the root's is the only one at depth 0
    root = [F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("top_depth")]
    zero = [F.lit(0).cast("long").alias(f"sum_{v}") for v in VALUES]
    state = written(nodes.select("name", "depth", "parent", "weight", *VALUES, *root, *zero), "components")
    finished = []
    while True:
        comp = F.struct("top", "top_depth").alias("comp")
        sizes = state.groupBy(comp).agg(F.count("*").alias("n"), F.max("weight").alias("total"))
        large = written(sizes.where(F.col("n") > limits.nodes), "large")
        if large.isEmpty():
            break
        state, done = split(state, paths, large)
        finished.append(done)
    rest = inside(state)
    for done in finished:
        rest = rest.unionByName(done)
    return rest.select("name", "depth", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"))


def split(state: DataFrame, paths: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split every large component at its centroid: the new state, and the centroids, now finished."""
    keyed = state.withColumn("comp", F.struct("top", "top_depth")).withColumn("bucket", F.expr(f"depth div {BLOCK}"))
    # the number of large components is at most that of the nodes over the bound; their sizes weigh the join
    judged = attach_by_key(keyed, large, "comp", "n", "name", how="left")
    judged = written(judged, "judged")
    halves = judged.where("2 * weight >= total")
    centroids = halves.groupBy("comp").agg(F.min_by(F.struct("name", "depth", "weight"), "weight").alias("c"), F.min("depth").alias("from_depth"))
    centroids = centroids.select("comp", F.col("c.name").alias("c_name"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"), "from_depth")
    # where the path of a node's name meets the centroid's depth, and the child after it
    pieces = judged.where("total IS NOT NULL").groupBy("comp", "name", "bucket").agg(F.count("*").alias("n_nodes"))
    weights = pieces.groupBy("comp").agg(F.count("*").alias("n_pieces"))
    pieces = attach_by_key(pieces, centroids.join(weights, "comp"), "comp", "n_pieces", "name")
    at = paths.select(F.col("conv_id").alias("name"), F.col("depth").alias("c_depth"), F.col("name").alias("at_name"))
    child = paths.select(F.col("conv_id").alias("name"), (F.col("depth") - 1).alias("c_depth"), F.col("name").alias("child"))
    pieces = pieces.join(at, ["name", "c_depth"], "left").join(child, ["name", "c_depth"], "left")
    pieces = pieces.select("comp", "name", "bucket", "c_name", "c_depth", "at_name", "child")
    # a key holds at most BLOCK nodes
    moved = judged.join(pieces, ["comp", "name", "bucket"], "left")
    under = F.coalesce((F.col("at_name") == F.col("c_name")) & (F.col("depth") >= F.col("c_depth")), F.lit(False))
    moved = written(moved.withColumn("under", under), "moved")
    totals = moved.where("under").groupBy("comp").agg(*[F.sum(v).alias(f"add_{v}") for v in VALUES])
    # the path from the centroid to the top, found in the paths by keys of at most BLOCK rows
    steps = centroids.join(totals, "comp").drop("comp")
    steps = steps.withColumn("bucket", F.explode(F.sequence(F.expr(f"from_depth div {BLOCK}"), F.expr(f"c_depth div {BLOCK}"))))
    line = paths.select(F.col("conv_id").alias("c_name"), "depth", "name", F.expr(f"depth div {BLOCK}").alias("bucket"))
    line = line.join(steps, ["c_name", "bucket"]).where("depth BETWEEN from_depth AND c_depth")
    line = line.select("name", "depth", F.when(F.col("depth") < F.col("c_depth"), F.col("c_weight")).otherwise(0).alias("less"), *[f"add_{v}" for v in VALUES])
    after = moved.join(line, ["name", "depth"], "left").withColumns(
        {f"sum_{v}": F.col(f"sum_{v}") + F.coalesce(f"add_{v}", F.lit(0)) for v in VALUES}
    )
    centre = F.col("under") & (F.col("depth") == F.col("c_depth"))
    done = written(after.where(centre).select("name", "depth", *[f"sum_{v}" for v in VALUES]), "centroids")
    below = F.col("under")
    after = after.where(~centre).select(
        "name", "depth", "parent", (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), *VALUES,
        F.when(below, F.col("child")).otherwise(F.col("top")).alias("top"),
        F.when(below, F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        *[f"sum_{v}" for v in VALUES],
    )
    after = written(after, "components")
    release(state.sparkSession, state, judged, moved)
    return after, done


def inside(state: DataFrame) -> DataFrame:
    """Finish components inside tasks: rows (name, depth, sum_leaves, sum_saved).

    Components are dealt by name and arrive one after the other, each with at most the bound's nodes.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("name", "depth", "sum_leaves", "sum_saved")])
    columns = ["top", "top_depth", "name", "depth", "parent", "weight", *VALUES, *[f"sum_{v}" for v in VALUES]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            comp, held = None, []
            for part in parts:
                for row in rows_of(part, *columns):
                    if row[:2] != comp:
                        yield from finished(held)
                        comp, held = row[:2], []
                    held.append(row[2:])
            yield from finished(held)

        yield from batches(found(), schema)

    rows = state.select(*columns).repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "name")
    return rows.mapInArrow(run, "name long, depth long, sum_leaves long, sum_saved long")


def finished(rows: list[tuple]) -> Iterator[tuple]:
    """Totals of one component's nodes (name, depth, parent, weight, values, sums), in order of depth."""
    place = {(row[0], row[1]): k for k, row in enumerate(rows)}
    parent = [place.get((row[2], row[1] - 1), -1) if k else -1 for k, row in enumerate(rows)]
    totals = decompose(parent, [row[3] for row in rows], [row[4:6] for row in rows])
    for row, (leaves, saved) in zip(rows, totals):
        yield row[0], row[1], row[6] + leaves, row[7] + saved


def decompose(parent: list[int], weight: list[int], values: list[tuple[int, int]]) -> list[list[int]]:
    """Subtree sums of one tree by its centroids; node 0 is the top, weights are those of whole subtrees.

    A component is known by its top. Its centroid is found from the top along the children that
    carry half the weight, which is also the way the totals are added. Both kinds of parts have at
    most half the weight, so calls are nested as deep as the logarithm of it.
    """
    children: list[set[int]] = [set() for _ in parent]
    for k, p in enumerate(parent):
        if p >= 0:
            children[p].add(k)
    weight = list(weight)
    sums = [[0, 0] for _ in parent]

    def solve(top: int) -> tuple[int, int]:
        leaves = saved = 0
        while True:
            line, whole = [top], weight[top]
            while (heavy := next((k for k in children[line[-1]] if 2 * weight[k] >= whole), None)) is not None:
                line.append(heavy)
            centre = line[-1]
            found = [solve(k) for k in children[centre]]
            below = [values[centre][v] + sum(f[v] for f in found) for v in (0, 1)]
            for k in line:
                sums[k][0] += below[0]
                sums[k][1] += below[1]
            leaves, saved = leaves + below[0], saved + below[1]
            if centre == top:
                return leaves, saved
            for k in line[:-1]:
                weight[k] -= weight[centre]
            children[line[-2]].discard(centre)

    if parent:
        solve(0)
    return sums


def ends(paths: DataFrame) -> DataFrame:
    """Rows (name, depth, ends_sha256) of the nodes at which conversations end.

    The ids are joined to sorted pieces first; a task then feeds the pieces of a node to the hash
    one after the other and holds none of them.
    """
    ship(paths.sparkSession)
    pieces = (
        paths.where("depth = length")
        .groupBy("name", "depth", F.floor(F.col("conv_id") / PIECE).alias("piece"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )
    schema = pa.schema([("name", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            node, digest = None, None
            for part in parts:
                for name, depth, ids in rows_of(part, "name", "depth", "ids"):
                    if (name, depth) != node:
                        if node:
                            yield *node, digest.hexdigest()
                        node, digest = (name, depth), hashlib.sha256(ids.encode())
                    else:
                        digest.update(b"," + ids.encode())
            if node:
                yield *node, digest.hexdigest()

        yield from batches(found(), schema)

    ordered = pieces.repartition("name", "depth").sortWithinPartitions("name", "depth", "piece").select("name", "depth", "ids")
    return ordered.mapInArrow(run, "name long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, group: int = 100, most: int = 6, limits: Limits = Limits()) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    paths, nodes = trie(*rebuilt(turns, group, most))
    values = nodes.select(
        "name", "depth", "parent", "weight",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
    )
    found = nodes.join(rollup(values, paths, limits), ["name", "depth"]).join(ends(paths), ["name", "depth"], "left")
    return found.select(
        F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
