"""Finding hot keys, so that groups of any size can be split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many hot keys are sent to the driver and broadcast; more stay a DataFrame and are joined by shuffle.
MOST_HOT = 10_000


def hot_keys(counts: DataFrame, condition) -> DataFrame | None:
    """The rows of `counts` (one per key) that meet the condition: None if there are none, broadcast if at most MOST_HOT.

    `counts` is an aggregate, so the rows were combined before the shuffle. A key is hot by its rows, so there are at
    most (all rows / threshold) of them; their number is checked all the same before anything is broadcast.
    """
    hot = counts.filter(condition)
    rows = hot.limit(MOST_HOT + 1).collect()
    if not rows:
        return None
    if len(rows) > MOST_HOT:
        return hot
    return F.broadcast(counts.sparkSession.createDataFrame(rows, hot.schema))
