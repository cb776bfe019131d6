"""Consecutive numbers in a global order, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Adds `name`, the place of each row from 1 in the order of the columns; rows that tie in all of them have any order.

    The rows are spread by range and sorted in their parts; a part's numbers begin after those of the parts before it,
    which are one row a part.
    """
    part = F.spark_partition_id()
    # the lower 33 bits count a part's rows in the order in which they are read
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": part, "__place": place}))
    held = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("held"))
    # one row a part
    start = F.coalesce(F.sum("held").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(held.select("__part", start.alias("__start")))
    return placed.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__place") + 1).drop("__part", "__place", "__start")
