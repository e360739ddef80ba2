"""Dense surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmart.sources.tables import materialize

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def assign_ids(df: DataFrame, order_by: Sequence[str | Column], id_col: str = "id") -> DataFrame:
    """Number the rows 1..n in the order of `order_by`, which should be unique.

    The rows are range-partitioned and sorted, so each partition numbers its own; only the
    partitions' row counts are added up in one place. A key shared by many rows is split over
    partitions as long as a later key tells the rows apart.
    """
    keys = list(order_by)
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
    )
    # Range bounds come from a sample: write the placement down so that it is drawn only once.
    placed = materialize(placed, "ids")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    # One row per partition.
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_before") + F.col("_pos") + 1).alias(id_col), *[F.col(c) for c in df.columns])
