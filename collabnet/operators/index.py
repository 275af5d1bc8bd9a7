"""Dense row numbers and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from collabnet.session import cut_lineage

_OFFSET_BITS = 33  # fixed by monotonically_increasing_id: partition number above, row number below


def dense_index(df: DataFrame, order: list[str], groups: list[str] = (), out: str = "index") -> DataFrame:
    """Add a 0-based dense index by ``order`` within each group.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the number of rows in the partitions before. The only window runs
    over one row per partition.
    """
    groups = list(groups)
    by = groups + list(order)
    placed = cut_lineage(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_mono", _OFFSET_BITS)).withColumn(
        "_row", F.col("_mono").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    # One row per partition of ``placed``, so the broadcast is bounded by their number.
    numbered = placed.join(F.broadcast(shifts), "_part").withColumn("_global", F.col("_row") + F.col("_shift"))
    if not groups:
        return numbered.withColumn(out, F.col("_global")).drop("_mono", "_part", "_row", "_shift", "_global")
    firsts = numbered.groupBy(*groups).agg(F.min("_global").alias("_first"))
    return (
        numbered.join(firsts, groups)
        .withColumn(out, F.col("_global") - F.col("_first"))
        .drop("_mono", "_part", "_row", "_shift", "_global", "_first")
    )


def sums_before(df: DataFrame, order: list[str], groups: list[str], weight: str, out: str = "before") -> DataFrame:
    """Add the sum of ``weight`` over the rows before this one in its group, by ``order``.

    Like ``dense_index``: range-partitioned and sorted, summed inside each partition,
    shifted by the sums of the partitions before, less what the group starts with. So a
    group of any size is dealt to many tasks.
    """
    by = list(groups) + list(order)
    placed = cut_lineage(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_mono", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mono", _OFFSET_BITS))
    inside = Window.partitionBy("_part").orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_part")
        .agg(F.sum(weight).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    running = placed.withColumn("_sum", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    running = running.join(F.broadcast(shifts), "_part").withColumn("_sum", F.col("_sum") + F.col("_shift"))
    firsts = running.groupBy(*groups).agg(F.min("_sum").alias("_first"))
    return (
        running.join(firsts, list(groups))
        .withColumn(out, F.col("_sum") - F.col("_first"))
        .drop("_mono", "_part", "_sum", "_shift", "_first")
    )
