"""Standardised random forest with balanced class weights and a confidence per row.

The training set is at most ``per_class`` rows per class, whatever the size of the packet tables;
prediction runs where the rows are. The library has no floor for the rows of a split: the fitted
trees are cut back to it as a table of nodes (``functions/trees.py``), which also allows scores to be
worked out a second time from that table.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from authsignal.config import MODEL_FEATURES, DetectorConfig
from authsignal.functions.shared import written
from authsignal.functions.trees import node_table, packed, tree_sums, with_split_floor
from authsignal.operators.augment import class_weights, stratified_folds


# ---- fixed values: growth of the trees ----
DEPTH, LEAST_SPLIT = 10, 5


def scaling_stages() -> list:
    return [
        VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def zscores(train: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Standardised features with mean and population deviation of ``train``, as plain columns."""
    stats = train.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"mean_{f}") for f in MODEL_FEATURES],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"sd_{f}") for f in MODEL_FEATURES],
    ).first()
    return rows.select(
        *keep,
        *[
            ((F.col(f).cast("double") - F.lit(stats[f"mean_{f}"])) / F.lit(stats[f"sd_{f}"] or 1.0)).alias(f"z_{f}")
            for f in MODEL_FEATURES
        ],
    )


def weighted_training(train: DataFrame) -> DataFrame:
    """Training rows with the balanced weight of their class, whatever classes occur."""
    return train.join(class_weights(train).select("label", F.col("weight").alias("w_class")), "label")


def classifier(trees: int = 200, cfg: DetectorConfig = DetectorConfig()) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="y",
        featuresCol="features",
        weightCol="w_class",
        numTrees=trees,
        maxDepth=DEPTH,
        featureSubsetStrategy="sqrt",
        seed=cfg.seed,
    )


def fit(train: DataFrame, trees: int = 200, cfg: DetectorConfig = DetectorConfig()) -> PipelineModel:
    """Scaler and forest on a training set with ``label`` and the model features.

    The classes are those of the data. A row without a label can't be learned from and is refused.
    """
    if not train.where(F.col("label").isNull()).isEmpty():
        raise ValueError("the training set has rows without a label")
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="error")
    weighted = weighted_training(train)
    indexer = indexer.fit(weighted)
    model = Pipeline(stages=scaling_stages() + [classifier(trees, cfg)]).fit(indexer.transform(weighted))
    forest = with_split_floor(model.stages[-1], LEAST_SPLIT, train.sparkSession)
    names = IndexToString(inputCol="y_hat", outputCol="model_class", labels=indexer.labels)
    return PipelineModel(stages=[*model.stages[:-1], forest.setPredictionCol("y_hat"), names])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``model_class`` and ``model_confidence`` (highest class probability)."""
    scored = model.transform(rows)
    return scored.withColumn("model_confidence", F.array_max(vector_to_array("probability"))).drop(
        "raw_features", "features", "rawPrediction", "probability", "y_hat"
    )


def importances(model: PipelineModel, top: int = 5) -> DataFrame:
    """The ``top`` features by importance, one row each."""
    values = model.stages[-2].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(MODEL_FEATURES, values)]
    table = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def nodes(model: PipelineModel) -> DataFrame:
    """The nodes of the fitted trees, one row each."""
    return node_table(model.stages[-2])


def table_probabilities(model: PipelineModel, rows: DataFrame, name: str = "table_probability") -> DataFrame:
    """Adds the class probabilities (alphabetic classes) worked out from the table of nodes alone.

    Each tree is walked by column expressions, without the library and without Python.
    """
    _, scaler, forest, _ = model.stages
    scaled = [
        (F.col(f).cast("double") - F.lit(float(mean))) * F.lit(1 / float(sd) if sd else 0.0)
        for f, mean, sd in zip(MODEL_FEATURES, scaler.mean, scaler.std)
    ]
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    trees = packed(nodes(model), F.transform("weights", lambda w: w / total))
    sums = tree_sums(trees, F.array(*scaled), DEPTH, forest.numClasses)
    return rows.withColumn(name, F.transform(sums, lambda share: share / forest.getNumTrees))


def fold_predictions(train: DataFrame, trees: int = 200, folds: int = 5, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Every row of a trimmed training set with the class that a forest of the other folds gives it.

    Rows (label, seq, fold, predicted), stored. The folds are fitted side by side; each fit reads a few
    hundred rows. Features are scaled once, on all rows.
    """
    data = stratified_folds(weighted_training(train), folds)
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    data = Pipeline(stages=scaling_stages()).fit(data).transform(indexer.transform(data))
    data = written(data.select("label", "seq", "fold", "y", "w_class", "features"), "folds")
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)

    def judge(fold: int) -> DataFrame:
        fitted = classifier(trees, cfg).fit(data.where(F.col("fold") != fold))
        forest = with_split_floor(fitted, LEAST_SPLIT, data.sparkSession)
        return names.transform(forest.transform(data.where(F.col("fold") == fold))).select("label", "seq", "fold", "predicted")

    with ThreadPool(folds) as pool:
        parts = pool.map(inheritable_thread_target(data.sparkSession)(judge), range(folds))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return written(rows, "fold-predictions")


def cross_validate(train: DataFrame, trees: int = 200, folds: int = 5, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Accuracy over stratified folds of a trimmed training set: mean and population deviation."""
    judged = fold_predictions(train, trees, folds, cfg)
    by_fold = judged.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return by_fold.agg(
        F.count("*").cast("int").alias("folds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("sd_accuracy")
    )
