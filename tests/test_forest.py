"""The split floor, the table of nodes and the folds."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from authsignal.functions.trees import PACKED, node_table, packed, tree_sums, with_split_floor


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select("id", (F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"), (F.rand(3) * 10).alias("c"))
    df = df.withColumn("y", (F.floor(F.col("a") / 4) + (F.col("b") * F.rand(4) > 4).cast("int")).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


@pytest.fixture(scope="module")
def grown(rows):
    return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=12, maxDepth=8, seed=3).fit(rows)


def table(model):
    return {(r.tree, r.node): r for r in node_table(model).collect()}


def scores(model, rows):
    return {r.id: r.p for r in model.transform(rows).select("id", vector_to_array("probability").alias("p")).collect()}


def test_floor_cuts_what_hangs_under_small_nodes(grown):
    before, after = table(grown), table(with_split_floor(grown, 30))
    assert any(r.feature is not None and r.n_rows < 30 for r in before.values())
    assert all(r.n_rows >= 30 for r in after.values() if r.feature is not None)

    def shape(nodes, key, floor):
        r = nodes[key]
        if r.feature is None or r.n_rows < floor:
            return (r.n_rows, r.prediction, tuple(r.weights))
        return (r.feature, r.threshold, shape(nodes, (key[0], r.below), floor), shape(nodes, (key[0], r.above), floor))

    for tree in range(12):
        assert shape(after, (tree, 0), 0) == shape(before, (tree, 0), 30)


def test_nothing_changes_where_nothing_is_cut(grown, rows):
    same = with_split_floor(grown, 0)
    assert table(same) == table(grown) and scores(same, rows) == scores(grown, rows)


@pytest.mark.parametrize("floor", [0, 5, 60])
def test_scores_from_the_table_equal_the_library(grown, rows, floor):
    model = with_split_floor(grown, floor)
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    trees = packed(node_table(model), F.transform("weights", lambda w: w / total))
    got = rows.select("id", F.transform(tree_sums(trees, F.array("a", "b", "c"), 8, model.numClasses), lambda s: s / 12).alias("p"))
    want = scores(model, rows)
    for r in got.collect():
        assert r.p == pytest.approx(want[r.id], abs=1e-12)
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)


def test_features_of_the_node_walk_are_worked_out_once_a_row(spark):
    trees = F.from_json(F.lit('[{"feature":[-1],"threshold":[0.0],"below":[0],"above":[0],"value":[[1.0]]}]'), PACKED)
    rows = spark.createDataFrame([(4.0,)], "v double").select(tree_sums(trees, F.array(F.sqrt("v")), 3, 1).alias("sums"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # what stands inside a lambda is worked out again at every step of every tree
    assert "SQRT(v" in plan and "SQRT(v" not in plan[plan.index("lambdafunction(") :]
    assert rows.first().sums == [1.0]
