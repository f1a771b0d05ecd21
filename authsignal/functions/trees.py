"""Fitted tree ensembles as tables of nodes, and scoring from them in plain column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.functions.shared import new_path, replace_folder

PACKED = "array<struct<feature:array<int>,threshold:array<double>,below:array<int>,above:array<int>,value:array<array<double>>>>"


def node_table(model, spark: SparkSession | None = None) -> DataFrame:
    """The nodes of a fitted ensemble of trees with continuous features, one row each.

    Columns: tree, node (0 is the root), n_rows (training rows that reached it), feature (null in a
    leaf), threshold, below and above (the children), prediction, weights (of the classes, for a
    forest of classifiers) and tree_weight. The model is stored in the shared folder and read back
    from there, so the table is as large as the model and nothing of it is parsed from text.
    """
    spark = spark or SparkSession.getActiveSession()  # threads have none of their own
    path = new_path(spark, "trees")
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "tree_weight").select("tree", "tree_weight")
    node = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    nodes = node.select(
        "tree",
        F.col("id").alias("node"),
        F.col("rawCount").alias("n_rows"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("below"),
        F.when(inner, F.col("rightChild")).alias("above"),
        "prediction",
        F.col("impurityStats").alias("weights"),
    )
    return nodes.join(weights, "tree")


def with_split_floor(model, least: int, spark: SparkSession | None = None):
    """The same ensemble with no split of fewer than ``least`` rows.

    Rows only get fewer from a node to its children, so a node below the floor becomes a leaf and all
    that hangs under it goes: the tree that never splitting it would have given. Rows count as often
    as they were drawn. The nodes are cut as a table (some hundred a tree) and loaded again.
    """
    spark = spark or SparkSession.getActiveSession()  # threads have none of their own
    path = new_path(spark, "trees")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    node = stored.select(F.col("treeID").alias("tree"), "nodeData")
    inner = node.where("nodeData.leftChild >= 0")
    children = inner.select(
        "tree", F.col("nodeData.rawCount").alias("above"), F.explode(F.array("nodeData.leftChild", "nodeData.rightChild")).alias("id")
    )
    kept = node.withColumn("id", F.col("nodeData.id")).join(children, ["tree", "id"], "left").where(F.col("above").isNull() | (F.col("above") >= least))
    # a tree has at most two to the power of its depth rows here; numbers close up in the old order
    kept = kept.withColumn("new", (F.row_number().over(W.partitionBy("tree").orderBy("id")) - 1).cast("int"))
    rows = kept.withColumn("splits", (F.col("nodeData.leftChild") >= 0) & (F.col("nodeData.rawCount") >= least))
    for side in ("left", "right"):
        number = kept.select(F.col("tree").alias("of"), F.col("id").alias("child"), F.col("new").alias(f"{side}_new"))
        here = (F.col("tree") == F.col("of")) & (F.col(f"nodeData.{side}Child") == F.col("child"))
        rows = rows.join(number, here, "left").drop("of", "child")
    leaf = F.expr("named_struct('featureIndex', -1, 'leftCategoriesOrThreshold', cast(array() AS array<double>), 'numCategories', -1)")
    data = F.struct(
        F.col("new").alias("id"),
        *[F.col(f"nodeData.{name}").alias(name) for name in ("prediction", "impurity", "impurityStats", "rawCount")],
        F.when(F.col("splits"), F.col("nodeData.gain")).otherwise(-1.0).alias("gain"),
        F.when(F.col("splits"), F.col("left_new")).otherwise(-1).alias("leftChild"),
        F.when(F.col("splits"), F.col("right_new")).otherwise(-1).alias("rightChild"),
        F.when(F.col("splits"), F.col("nodeData.split")).otherwise(leaf).alias("split"),
    )
    rows.select(F.col("tree").alias("treeID"), data.cast(stored.schema["nodeData"].dataType).alias("nodeData")).write.parquet(f"{path}/cut")
    replace_folder(spark, f"{path}/cut", f"{path}/data")
    return type(model).load(path)


def packed(nodes: DataFrame, value: Column) -> Column:
    """All trees as one constant, with ``value`` (array<double>) for every node.

    The size is that of the model, which the number of trees and their depth bound.
    """
    rows = nodes.select("tree", "node", "feature", "threshold", "below", "above", value.alias("value")).orderBy("tree", "node").collect()
    names = ("feature", "threshold", "below", "above", "value")
    trees: dict[int, dict[str, list]] = {}
    place: dict[tuple[int, int], int] = {}
    for r in rows:
        tree = trees.setdefault(r["tree"], {name: [] for name in names})
        place[r["tree"], r["node"]] = len(tree["feature"])  # nodes may have been cut away: places close up
        row = (-1 if r["feature"] is None else r["feature"], r["threshold"] or 0.0, r["below"], r["above"], list(r["value"]))
        for name, item in zip(names, row):
            tree[name].append(item)
    for number, tree in trees.items():
        for side in ("below", "above"):
            tree[side] = [0 if child is None else place[number, child] for child in tree[side]]
    return F.from_json(F.lit(json.dumps(list(trees.values()))), PACKED)


def tree_sums(trees: Column, features: Column, depth: int, width: int) -> Column:
    """Sum over all trees of the value at the leaf that ``features`` (array<double>) reaches.

    A missing feature goes the upper way, as does one above the threshold. The features are worked out
    once a row: an expression inside a lambda would be worked out again at every step of every tree.
    """

    def leaf(tree: Column, x: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], at)
            lower = F.get(x, feature) <= F.get(tree["threshold"], at)
            return F.when(feature < 0, at).when(lower, F.get(tree["below"], at)).otherwise(F.get(tree["above"], at))

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), step)

    zero = F.array(*[F.lit(0.0)] * width)

    def sums(x: Column) -> Column:
        return F.aggregate(trees, zero, lambda total, tree: F.zip_with(total, F.get(tree["value"], leaf(tree, x)), lambda a, b: a + b))

    return F.get(F.transform(F.array(features), sums), F.lit(0))
