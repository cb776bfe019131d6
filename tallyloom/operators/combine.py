"""Merging and comparing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacked(frames: list[DataFrame], mark: str | None = None) -> DataFrame:
    """All rows one after the other, columns by name, missing ones null; `mark` names a column for the number of the table."""
    if mark:
        frames = [f.withColumn(mark, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def joined(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Tables joined one after the other on keys, where null equals null; columns that clash get the number of their table."""
    taken = {*frames[0].columns}
    out = frames[0]
    for i, right in enumerate(frames[1:], 2):
        names = {c: c if c not in taken else f"{c}_{i}" for c in right.columns if c not in keys}
        taken |= {*names.values()}
        r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(n) for c, n in names.items()])
        on = reduce(lambda a, b: a & b, [out[k].eqNullSafe(r[f"__{k}"]) for k in keys])
        both = out.join(r, on, "full" if how == "outer" else how)
        out = both.select(*[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in keys], *[c for c in out.columns if c not in keys], *names.values())
    return out


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b does not have, as text."""
    text = lambda df: df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])
    return text(a).subtract(text(b))


def changed(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(keys, column, before, after) of cells that differ between rows of equal keys; null equals the empty text."""
    columns = columns or [c for c in a.columns if c in b.columns and c not in keys]
    text = lambda df, p: df.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{p}{c}") for c in columns])
    both = text(a, "a_").join(text(b, "b_"), keys)
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in columns]), lambda x: x["before"] != x["after"])
    return both.select(*keys, F.inline(cells))


def change_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(column, changed): how many rows changed in each column."""
    return changed(a, b, keys).groupBy("column").agg(F.count(F.lit(1)).alias("changed"))


def column_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, side) of columns that only one of two tables has; no row is read."""
    rows = [(c, "a") for c in a.columns if c not in b.columns] + [(c, "b") for c in b.columns if c not in a.columns]
    return a.sparkSession.createDataFrame(rows, "column string, side string")


def change_samples(a: DataFrame, b: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first n changed cells of each column, by key, with how many there are."""
    cells = changed(a, b, keys)
    own = Window.partitionBy("column")
    return cells.withColumns({"changed": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy(*keys))}).filter(F.col("place") <= n)
