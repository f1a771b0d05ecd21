"""Joining one-row-per-key facts onto rows when one key may hold a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from authsignal.config import ScaleLimits
from authsignal.functions.shared import written


def attach_by_key(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    weight: str,
    spread_on: str,
    limits: ScaleLimits = ScaleLimits(),
    how: str = "inner",
) -> DataFrame:
    """Join ``facts`` (one row per ``key``, with its row count in ``weight``) onto ``rows``.

    The facts are written once, so their size is known before the join is chosen:

    * few bytes: broadcast, the rows are not shuffled at all;
    * many keys, none hot: a plain shuffle join;
    * many keys, some hot: each hot key is cut into parts. The list of hot keys is bounded by
      ``limits.hot_keys`` because each of them holds more than that fraction of all rows.

    A null key is a key like any other: its rows meet the facts of the null key.
    """
    size = Observation()
    facts = written(
        facts.observe(
            size,
            # the key's text and eight bytes for each of the other columns, a header and two pointers
            F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 8 * len(facts.columns) + 32).alias("bytes"),
            F.sum(weight).alias("total"),
            F.max(weight).alias("top"),
        ),
        "facts",
    )
    n_bytes, total, top = (size.get[name] or 0 for name in ("bytes", "total", "top"))
    facts = facts.withColumnRenamed(key, "_key")
    plain = facts.drop(weight)
    same = F.col(key).eqNullSafe(F.col("_key"))
    if n_bytes <= limits.broadcast_bytes:
        return rows.join(F.broadcast(plain), same, how).drop("_key")
    threshold = max(limits.hot_rows, total // limits.hot_keys)
    if top <= threshold:
        return rows.join(plain, same, how).drop("_key")

    parts = F.ceil(F.col(weight) / F.lit(threshold)).cast("int")
    hot = facts.where(F.col(weight) > threshold).select(F.col("_key").alias("_hot"), parts.alias("_parts"))
    salted_rows = (
        rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.coalesce("_parts", F.lit(1))).cast("int"))
        .withColumnRenamed("_salt", "_row_salt")
        .drop("_parts", "_hot")
    )
    salted_facts = facts.withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > threshold, parts).otherwise(F.lit(1)) - 1)),
    ).drop(weight)
    return salted_rows.join(salted_facts, same & (F.col("_row_salt") == F.col("_salt")), how).drop("_salt", "_row_salt", "_key")
