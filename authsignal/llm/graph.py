"""Connected components, within a task and over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsignal.config import ScaleLimits
from authsignal.functions.shared import written
from authsignal.functions.skew import attach_by_key

# tables of nodes grow with the corpus: only small ones are broadcast, and a hub or a large class is cut into parts early
LIMITS = ScaleLimits(broadcast_bytes=1 << 20, hot_rows=256)


def flat_labels(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Merge the labels of linked positions; every label is the smallest position of its class."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        while not np.array_equal(new, deeper := new[new]):
            new = deeper
        labels = new
        open_links = labels[a] != labels[b]
        a, b = a[open_links], b[open_links]
    return labels


def follow(rows: DataFrame, key: str, steps: DataFrame, to: str, spread_on: str, limits: ScaleLimits = LIMITS) -> DataFrame:
    """``rows`` with ``to``: where ``steps`` (node, to) leads from ``key``; null where it leads nowhere.

    A key may hold a third of the rows. Counts by key are combined before the shuffle, and the rows of
    hot keys are spread by ``spread_on``, so that no task takes all of them.
    """
    weights = rows.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("weight"))
    facts = steps.join(weights, "node").select(F.col("node").alias(key), F.col("to").alias(to), "weight")
    return attach_by_key(rows, facts, key, "weight", spread_on, limits, "left")


def components(edges: DataFrame, limits: ScaleLimits = LIMITS) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a long, b long).

    Each round every node points to the neighbour of least hash (or itself) and the edges are drawn
    anew between the nodes pointed to. Hash order is random to the ids, so chains shrink by a
    constant factor a round; a clique or a star ends in one or two. Only tables of nodes and edges
    are joined, in the shared folder; nothing is gathered, and hubs and large classes are spread.
    """
    live = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    steps = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            live.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        best = both.groupBy("node").agg(F.min(rank("other")).alias("best"))
        step = written(best.select("node", F.least(rank("node"), "best")["n"].alias("to")), "parents")
        steps.append(step)
        ends = follow(follow(live, "a", step, "to_a", "b", limits), "b", step, "to_b", "a", limits).where("to_a <> to_b")
        live = written(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        roots = follow(roots, "root", step, "next", "node", limits).select("node", F.coalesce("next", "root").alias("root"))
    return roots


def lowest_of_class(members: DataFrame, roots: DataFrame, node: str, limits: ScaleLimits = LIMITS) -> DataFrame:
    """Rows (node, lowest): the smallest ``first_id`` of the class of each node of ``roots`` (node, root).

    ``members`` has a row for every node. Minima and sizes are combined before the shuffle; members of
    large classes are spread, so a class may hold any share of the nodes.
    """
    linked = written(members.select(node, "first_id").join(roots, node), "members")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("lowest"), F.count("*").alias("members"))
    return attach_by_key(linked, lowest, "root", "members", node, limits).select(node, "lowest")
