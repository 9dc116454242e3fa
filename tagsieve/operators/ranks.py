"""Global row numbers without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.session import stored


def numbered(rows: DataFrame, order: list[str], into: str, parts: int | None = None) -> DataFrame:
    """``rows`` plus ``into``: their place in ``order``, ascending, from 0.

    Rows are dealt by ranges of the order, stored with their part, and numbered inside their part;
    what comes before a part is the sum of the sizes of earlier parts, of which there are as
    many as tasks. Equal rows are numbered in any order. ``parts`` fixes the number of parts; otherwise
    the session's number of shuffle partitions and adaptive execution decide.
    """
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_inside", inside).join(before, F.col("_part") == F.col("_of"))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(into))
