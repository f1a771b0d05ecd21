"""Times of log lines that carry none, or no year: segmented scans over (source, order).

Both scans run on two levels. A source is cut into blocks of its order column; inside a block
a window carries the last stamp forward and counts changes of year; one row per block then carries
both over the blocks of the source. No source is sorted in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.functions.columns import floor_div

HALF_YEAR_US = 183 * 86_400_000_000
LEAP = "2000/"  # a year with every day, to place a stamp in its year


def _change(earlier: Column, later: Column) -> Column:
    """+1 where the day of the year falls back by more than half a year, -1 where it leaps on by as much."""
    return (
        F.when(earlier - later > HALF_YEAR_US, 1).when(later - earlier > HALF_YEAR_US, -1).otherwise(0).cast("long")
    )


def with_line_times(
    parsed: DataFrame, by: str = "source", order: str = "seq", first_year: int | Column = 2000, block: int = 65_536
) -> DataFrame:
    """Parsed lines with ``ts`` for every line, its ``year``, and ``carried`` where the stamp is another line's.

    ``first_year`` is that of the first stamped line of a source (a column must be the same for
    all lines of one). Later years follow from the stamps: from December to January the year rises,
    and it falls again for a line of the old year that was written late. A line without a readable
    stamp has the time of the last stamped line before it in its source, and lines before
    the first stamp that of the first. Sources without any stamp keep nulls; February 29 in a year
    that has none stays without a time. A null source is a source. ``order`` must be a whole number
    that is unique in a source; ``block`` is a width on its scale, so as many lines at most meet in one window.
    """
    kept = [c for c in parsed.columns if c != "ts"]
    moment = F.unix_micros(F.try_to_timestamp(F.concat(F.lit(LEAP), "stamp"), F.lit("yyyy/MM/dd HH:mm:ss.SSS")))
    first = first_year if isinstance(first_year, Column) else F.lit(first_year)
    rows = parsed.select(
        *kept, first.cast("long").alias("_first_year"), moment.alias("_moment"), floor_div(F.col(order).cast("long"), block).alias("_block")
    )
    inside = W.partitionBy(by, "_block").orderBy(order)
    sofar, before = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    known = F.when(F.col("_moment").isNotNull(), F.struct(F.col("_moment").alias("at"), F.col("stamp").alias("stamp")))
    rows = rows.select("*", F.last(known, True).over(sofar).alias("_own"), F.last("_moment", True).over(before).alias("_before"))
    rows = rows.withColumn("_change", F.when(F.col("_moment").isNotNull() & F.col("_before").isNotNull(), _change(F.col("_before"), F.col("_moment"))).otherwise(0))
    rows = rows.withColumn("_years", F.sum("_change").over(sofar))

    # the same partitioning as the windows: blocks are summed up without another exchange of lines
    blocks = rows.groupBy(by, "_block").agg(
        F.min_by(known, F.when(F.col("_moment").isNotNull(), F.col(order))).alias("first"),
        F.max_by(known, F.when(F.col("_moment").isNotNull(), F.col(order))).alias("last"),
        F.sum("_change").alias("years"),
    )
    chain = W.partitionBy(by).orderBy("_block")
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("*", F.last("last", True).over(earlier).alias("_carried"))
    edge = F.when(F.col("first").isNotNull() & F.col("_carried").isNotNull(), _change(F.col("_carried.at"), F.col("first.at"))).otherwise(0)
    blocks = blocks.withColumn("_edge", edge)
    blocks = blocks.select(
        F.col(by).alias("_by"),
        F.col("_block").alias("_of"),
        "_carried",
        "_edge",
        F.coalesce(F.sum(F.col("_edge") + F.col("years")).over(earlier), F.lit(0)).alias("_years_before"),
        F.first("first", True).over(chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_first"),
    )
    rows = rows.join(blocks, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_of")))
    # the change at the edge of a block counts from its first stamp on
    own = F.col("_own").isNotNull()
    year = F.col("_first_year") + F.col("_years_before") + F.col("_years") + F.when(own, F.col("_edge")).otherwise(0)
    stamp = F.coalesce("_own", "_carried", "_first")["stamp"]
    timed = rows.withColumns({"year": F.when(stamp.isNotNull(), year).cast("int"), "_stamp": stamp})
    ts = F.try_to_timestamp(F.concat(F.col("year").cast("string"), F.lit("/"), "_stamp"), F.lit("yyyy/MM/dd HH:mm:ss.SSS"))
    return timed.select(*kept, ts.alias("ts"), "year", (F.col("_moment").isNull() & F.col("_stamp").isNotNull()).alias("carried"))
