"""Training-set oversampling: interpolation between near neighbours, noise, trimming.

All of it works on classes that are below the target, so a class never brings more than
``per_class`` rows into a group; bigger classes only pass through the trim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsignal.config import (
    BINARY_FEATURES,
    INTEGER_FEATURES,
    TRAINING_FEATURES,
    DetectorConfig,
)
from authsignal.functions.columns import uniform
from authsignal.functions.shared import written
from authsignal.operators.filters import first_n


def class_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def windows_per_label(rows: DataFrame) -> DataFrame:
    """Counts per label with a ``TOTAL`` row."""
    return (
        rows.rollup("label")
        .agg(F.count("*").alias("windows"), F.grouping("label").alias("g"))
        .select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("label")).alias("label"), "windows")
    )


def oversample_readiness(rows: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    counts = class_distribution(rows)
    return counts.withColumn(
        "status", F.when(F.col("n") >= cfg.oversample_ready, "OK").otherwise(f"need {cfg.oversample_ready}+")
    )


def class_partition(rows: DataFrame) -> DataFrame:
    """How each class is filled up: interpolation from two rows on, noise for a single one."""
    return class_distribution(rows).withColumn("route", F.when(F.col("n") >= 2, "interpolate").otherwise("noise"))


def neighbour_count(rows: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """One row ``k``: the configured neighbours, but fewer than the smallest class that interpolates."""
    smallest = class_distribution(rows).where(F.col("n") >= 2).agg(F.min("n").alias("n"))
    k = F.greatest(F.lit(1), F.least(F.lit(cfg.neighbours).cast("bigint"), F.col("n") - 1))
    return smallest.select(k.alias("k"))


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = class_distribution(rows)
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    weight = whole.select(F.col("total") / F.col("classes")).scalar()
    return counts.withColumn("weight", F.bround(weight / F.col("n"), 6))


def small_classes(rows: DataFrame, order: list[str], cfg: DetectorConfig) -> DataFrame:
    """Rows of the classes below the target, numbered by ``seq`` within the class, with class size ``n``."""
    counts = class_distribution(rows).where(F.col("n") < cfg.per_class)
    return first_n(rows.join(counts, "label"), "label", order, cfg.per_class)


def class_knn(small: DataFrame, rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Nearest rows of the same class on the raw features, rank 1 to k.

    ``small`` comes from :func:`small_classes`: fewer than ``per_class`` rows per class, so the
    pairs of a class are bounded by that constant squared.
    """
    features = list(TRAINING_FEATURES)
    left = small.select("label", "seq", *features)
    right = small.select("label", F.col("seq").alias("nn_seq"), *[F.col(f).alias(f"nn_{f}") for f in features])
    distance: Column = F.lit(0.0)
    for f in features:
        gap = F.col(f).cast("double") - F.col(f"nn_{f}").cast("double")
        distance = distance + gap * gap
    pairs = (
        left.join(right, "label")
        .where(F.col("seq") != F.col("nn_seq"))
        .select(F.concat_ws("#", "label", "seq").alias("_item"), "label", "seq", "nn_seq", distance.alias("distance2"))
    )
    k = neighbour_count(rows, cfg).scalar()
    ranked = first_n(pairs.withColumnRenamed("seq", "row_seq"), "_item", ["distance2", "nn_seq"], cfg.neighbours)
    return (
        ranked.where(F.col("seq") <= k)
        .select("label", F.col("row_seq").alias("seq"), "nn_seq", F.col("seq").alias("nn_rank"), "distance2")
    )


def restored(name: str, value: Column) -> Column:
    """Back to the kind of a feature: flag, count or four-place real."""
    if name in BINARY_FEATURES:
        return F.rint(value).cast("bigint")
    if name in INTEGER_FEATURES:
        return F.greatest(F.lit(0).cast("bigint"), F.rint(value).cast("bigint"))
    return F.bround(value, 4)


def interpolated(small: DataFrame, rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """New rows ``x + u * (neighbour - x)`` filling each small class up to the target."""
    features = list(TRAINING_FEATURES)
    eligible = small.where(F.col("n") >= 2)
    k = neighbour_count(rows, cfg).scalar()
    seed = str(cfg.seed)
    wanted = (
        eligible.where(F.col("seq") == 1)
        .select("label", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.per_class) - F.col("n") - 1)).alias("i"))
        .withColumn("seq", F.floor(uniform(seed, F.col("label"), F.col("i"), "row") * F.col("n")).cast("int") + 1)
        .withColumn("nn_rank", F.floor(uniform(seed, F.col("label"), F.col("i"), "neighbour") * k).cast("int") + 1)
        .withColumn("u", uniform(seed, F.col("label"), F.col("i"), "gap"))
        .drop("n")
    )
    near = class_knn(eligible, rows, cfg).select("label", "seq", "nn_rank", "nn_seq")
    base = eligible.select("label", "seq", *features)
    other = eligible.select("label", F.col("seq").alias("nn_seq"), *[F.col(f).alias(f"nn_{f}") for f in features])
    joined = (
        wanted.join(near, ["label", "seq", "nn_rank"])
        .join(base, ["label", "seq"])
        .join(other, ["label", "nn_seq"])
    )
    value = {f: F.col(f).cast("double") + F.col("u") * (F.col(f"nn_{f}").cast("double") - F.col(f).cast("double")) for f in features}
    return joined.select("label", "i", *[restored(f, v).alias(f) for f, v in value.items()])


def noisy(single: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """``per_class`` variations of each given row: non-zero counts and reals scaled by up to the noise."""
    spread = single.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.per_class).cast("bigint") - 1)))
    columns = []
    for f in TRAINING_FEATURES:
        raw = F.col(f).cast("double")
        if f in BINARY_FEATURES:
            columns.append(F.col(f).cast("bigint").alias(f))
            continue
        factor = F.lit(1 - cfg.noise) + F.lit(2 * cfg.noise) * uniform(str(cfg.seed), F.col("label"), F.col("i"), f)
        scaled = F.when(raw == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), raw * factor))
        columns.append(restored(f, scaled).alias(f))
    return spread.select("label", "i", *columns)


def oversample(rows: DataFrame, order: list[str], cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The training set: originals first, then made-up rows, exactly ``per_class`` rows a class."""
    typed = [F.col(f).cast("double" if f not in BINARY_FEATURES + INTEGER_FEATURES else "bigint").alias(f) for f in TRAINING_FEATURES]
    originals = first_n(rows, "label", order, cfg.per_class).select("label", "seq", *typed)
    small = written(small_classes(rows, order, cfg), "small-classes")
    made = interpolated(small, rows, cfg).withColumn("seq", F.lit(cfg.per_class) + F.col("i").cast("int")).drop("i")
    noise = (
        noisy(small.where(F.col("n") == 1), cfg)
        .withColumn("seq", F.col("i").cast("int") - F.lit(cfg.per_class))
        .drop("i")
    )
    # a class of one row is replaced by its variations, hence their place before the original
    everything = originals.unionByName(made).unionByName(noise)
    return first_n(everything.withColumnRenamed("seq", "place"), "label", ["place"], cfg.per_class).drop("place")


def stratified_folds(training: DataFrame, folds: int = 5) -> DataFrame:
    """Fold number per row of a trimmed training set, even within every class."""
    return training.withColumn("fold", F.pmod(F.col("seq") - 1, F.lit(folds)).cast("int"))


def shuffled(training: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Seeded random order for writing."""
    return training.orderBy(shuffle_key(cfg), "label", "seq")


def shuffle_key(cfg: DetectorConfig = DetectorConfig()) -> Column:
    return uniform(str(cfg.seed), F.col("label"), F.col("seq"), "order")
