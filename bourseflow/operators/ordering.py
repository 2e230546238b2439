"""Position and successor in one global order, without a global window.

A window over the whole table (or over one hot group) would pull all its rows
into one task. Here the rows are range-partitioned by the order, numbered inside
each range, and only one row per range and group is looked at across ranges.

Sampling the ranges is a pass of its own over the input: pass narrow, stored
rows (see ``cut_lineage``) where the input is costly to compute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourseflow.session import cut_lineage


def _ranges(df: DataFrame, order: Sequence, n_ranges: int | None) -> DataFrame:
    spark = df.sparkSession
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from a sample: both uses of the ranges must see the same ones.
    return cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def with_position(df: DataFrame, order: Sequence, name: str = "position", n_ranges: int | None = None) -> DataFrame:
    """Zero-based position of each row in the order (the order must be total)."""
    placed = _ranges(df, order, n_ranges)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        placed.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.col("_row") - 1)
        .drop("_range", "_row", "_offset")
    )


def with_successor(
    df: DataFrame, group: str, order: Sequence, column: str, name: str, n_ranges: int | None = None
) -> DataFrame:
    """``column`` of the next row of the same group in the order; null on the last row."""
    placed = _ranges(df, [F.col(group), *order], n_ranges)
    inside = Window.partitionBy("_range", group).orderBy(*order)
    numbered = placed.withColumns(
        {"_next": F.lead(F.struct(column)).over(inside), "_row": F.row_number().over(inside)}
    )
    heads = numbered.where(F.col("_row") == 1).select("_range", group, F.col(column).alias("_head"))
    # One row per range and group; the first row of the following range closes the gap.
    following = Window.partitionBy(group).orderBy("_range")
    heads = heads.select("_range", group, F.lead("_head").over(following).alias("_following"))
    return (
        numbered.join(F.broadcast(heads), ["_range", group], "left")
        .withColumn(name, F.when(F.col("_next").isNotNull(), F.col("_next")[column]).otherwise(F.col("_following")))
        .drop("_range", "_row", "_next", "_following")
    )
