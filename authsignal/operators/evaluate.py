"""Evaluation on rows with ``label`` and ``prediction``; everything starts from pair counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _over(part: Column, whole: Column) -> Column:
    """Ratio that is zero where the denominator is zero."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows per (label, prediction): the only step that sees all rows."""
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, method: str) -> DataFrame:
    hit = F.when(F.col("label") == F.col("prediction"), 1).otherwise(0)
    return rows.agg(
        F.lit(method).alias("method"),
        F.count("*").alias("n_rows"),
        F.sum(hit).alias("n_correct"),
        F.bround(F.coalesce(F.avg(hit), F.lit(0.0)), 6).alias("accuracy"),
    )


def method_summary(rows: DataFrame, methods: dict[str, str]) -> DataFrame:
    """Accuracy of several prediction columns, measured in one pass."""
    stacked = rows.select(
        "label",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("method"), F.col(col).alias("prediction")) for m, col in methods.items()])
        ).alias("m"),
    )
    hit = F.when(F.col("label") == F.col("m.prediction"), 1).otherwise(0)
    return stacked.groupBy(F.col("m.method").alias("method")).agg(
        F.count("*").alias("n_rows"),
        F.sum(hit).alias("n_correct"),
        F.bround(F.avg(hit), 6).alias("accuracy"),
    )


def class_scores(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs as label or prediction."""
    pairs = pair_counts(rows)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("name"), F.lit("label").alias("side")),
                F.struct(F.col("prediction").alias("name"), F.lit("prediction").alias("side")),
            )
        ).alias("s"),
        (F.col("label") == F.col("prediction")).alias("hit"),
        "n",
    )
    is_label = F.col("s.side") == "label"
    counts = sides.groupBy(F.col("s.name").alias("name")).agg(
        F.sum(F.when(is_label & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(is_label, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~is_label, F.col("n")).otherwise(0)).alias("predicted"),
    )
    scored = counts.withColumn("precision", _over(F.col("tp"), F.col("predicted"))).withColumn(
        "recall", _over(F.col("tp"), F.col("support"))
    )
    total = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", _over(2 * F.col("precision") * F.col("recall"), total))


def classification_report(rows: DataFrame) -> DataFrame:
    """Per-class rows plus ``macro avg`` and ``weighted avg``, from one pass over the rows.

    Each class feeds its own line and both averages, with weight one or its support.
    """
    lines = class_scores(rows).withColumn(
        "line",
        F.explode(
            F.array(
                F.struct(F.col("name").alias("name"), F.lit(1).cast("bigint").alias("weight")),
                F.struct(F.lit("macro avg").alias("name"), F.lit(1).cast("bigint").alias("weight")),
                F.struct(F.lit("weighted avg").alias("name"), F.col("support").alias("weight")),
            )
        ),
    )
    weight = F.col("line.weight")
    return lines.groupBy(F.col("line.name").alias("name")).agg(
        *[F.bround(_over(F.sum(F.col(m) * weight), F.sum(weight)), 6).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )


def confusion_matrix(rows: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Rows (label, prediction, n) of the classes that occur; with ``classes``, one column for each of them.

    In the wide form predictions outside the classes are counted in ``pred_other``.
    """
    pairs = pair_counts(rows)
    if classes is None:
        return pairs
    cells = [
        F.sum(F.when(F.col("prediction") == name, F.col("n")).otherwise(0)).alias(f"pred_{name}")
        for name in sorted(classes)
    ]
    known = F.coalesce(F.col("prediction").isin(*classes), F.lit(False))
    cells.append(F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("pred_other"))
    return pairs.groupBy("label").agg(*cells)
