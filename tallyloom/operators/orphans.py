"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARENT = "target string, key bigint, born timestamp"


def references(df: DataFrame, table: str, row_id: str, key: str, target: str, at=None) -> DataFrame:
    """(ref_table, row_id, target, key, at) of a table whose column `key` refers to the table `target`; null keys refer to nothing."""
    return df.filter(F.col(key).isNotNull()).select(
        F.lit(table).alias("ref_table"),
        F.col(row_id).cast("bigint").alias("row_id"),
        F.lit(target).alias("target"),
        F.col(key).cast("bigint").alias("key"),
        (F.lit(None) if at is None else at).cast("timestamp").alias("at"),
    )


def lifetimes(parents: DataFrame, purges: DataFrame | None = None) -> DataFrame:
    """One row per parent key: present, born (the earliest row of it), purged_at (the latest purge).

    parents: (target, key, born); purges: (target, key, purged_at). A key that was purged and is in the table again is present.
    """
    alive = parents.select("target", "key", F.lit(1).alias("alive"), "born", F.lit(None).cast("timestamp").alias("purged_at"))
    if purges is not None:
        alive = alive.unionByName(purges.select("target", "key", F.lit(0).alias("alive"), F.lit(None).cast("timestamp").alias("born"), "purged_at"))
    return alive.filter(F.col("key").isNotNull()).groupBy("target", "key").agg(F.max("alive").alias("alive"), F.min("born").alias("born"), F.max("purged_at").alias("purged_at"))


def classified(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """Each reference with a status by its time and its parent's validity.

    A parent that is there is valid from its birth on (always, if that is unknown): the reference is `present`, or `late` if it
    was made before. One that is not there was valid until its purge: the reference is `deleted` if it was made before that
    or at an unknown time, `deleted_before` if it was made when the parent was gone already, and `missing` if the parent was
    never seen. A parent that was purged and came back is there; its birth is that of the row that came back.

    References and parents are partitioned by (target, key), sorted and merged in one pass: a sort-merge join, whose hot
    partitions adaptive execution splits, as the reference side of a left join may be split. Parents are one row per key.

    Edge cases: a null key is no reference; an empty parent table makes every reference missing; copies of a row give
    the same status each and are folded by `broken`; other columns of the inputs are never read.
    """
    joined = refs.join(lives.hint("merge"), ["target", "key"], "left")
    status = (
        F.when(F.col("alive") == 1, F.when(F.col("born") > F.col("at"), "late").otherwise("present"))
        .when(F.col("alive") == 0, F.when(F.col("at") >= F.col("purged_at"), "deleted_before").otherwise("deleted"))
        .otherwise("missing")
    )
    return joined.select("ref_table", "row_id", "target", "key", "at", status.alias("status"))


def broken(found: DataFrame) -> DataFrame:
    """The references that are not present, once per referring row."""
    return found.filter("status != 'present'").dropDuplicates(["ref_table", "row_id", "target"])


def orphans(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The references without a parent, once per referring row: (ref_table, row_id, target, key, at, status). A late parent is there."""
    return broken(classified(refs, lives).filter("status != 'late'"))


def per_period(found: DataFrame) -> DataFrame:
    """References counted per table, target, month and status; `period` is null where the row's time can't be read."""
    return found.groupBy("ref_table", "target", F.date_format("at", "yyyy-MM").alias("period"), "status").agg(F.count(F.lit(1)).alias("rows"))
