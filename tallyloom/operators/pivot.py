"""Pivots, group reports and the data of charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of aggregations, English and Chinese.
AGGREGATIONS = {
    "sum": F.sum, "求和": F.sum, "合计": F.sum, "mean": F.avg, "avg": F.avg, "平均": F.avg, "均值": F.avg, "count": F.count, "计数": F.count, "数量": F.count, "min": F.min, "最小": F.min, "max": F.max, "最大": F.max,
    "median": lambda c: F.percentile(c, 0.5), "中位数": lambda c: F.percentile(c, 0.5), "std": F.stddev, "标准差": F.stddev, "nunique": F.countDistinct, "去重计数": F.countDistinct,
}
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")


def parse_aggregations(spec: str) -> dict[str, list[str]]:
    """`amount:sum,fee:mean` as {column: names}; a bare name stands for all columns, as `*`. Unknown names raise."""
    out: dict[str, list[str]] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        column, _, name = part.rpartition(":")
        if name not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation: {name}")
        out.setdefault(column or "*", []).append(name)
    return out


def pivot(df: DataFrame, index: list[str], values: list[str] | None = None, spec: str = "sum", columns: str | None = None, column_values: list | None = None) -> DataFrame:
    """Values aggregated by the index and, if given, spread over a column's values, gaps filled with 0.

    Results are named `value` for one aggregation, `value_agg` for several and `value_columnvalue` when spread. A value that is no number is
    counted where a number is needed. Give `column_values` to spare the pass that finds them.
    """
    kinds = dict(df.dtypes)
    missing = [c for c in [*index, *(values or []), *([columns] if columns else [])] if c not in kinds]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    values = values or [c for c, t in df.dtypes if t.startswith(NUMERIC) and c not in index][:5]
    aggs = parse_aggregations(spec)
    made: list[tuple[str, Column]] = []
    for v in values:
        names = aggs.get(v) or aggs.get("*") or ["sum"]
        for name in names:
            needs = AGGREGATIONS[name] not in (F.count, F.min, F.max, F.countDistinct)
            f = F.count if needs and not kinds[v].startswith(NUMERIC) else AGGREGATIONS[name]
            made.append((v if len(names) == 1 else f"{v}_{name}", f(v)))
    grouped = df.groupBy(*index)
    if columns:
        grouped = grouped.pivot(columns, column_values) if column_values else grouped.pivot(columns)
    out = grouped.agg(*[c.alias(n) for n, c in made])
    if columns:
        if len(made) == 1:
            out = out.toDF(*index, *[f"{made[0][0]}_{c}" for c in out.columns[len(index) :]])
        else:
            # Spark names them columnvalue_aggregate
            names = []
            for c in out.columns[len(index) :]:
                agg = next(n for n in sorted((n for n, _ in made), key=len, reverse=True) if c.endswith(f"_{n}"))
                names.append(f"{agg}_{c[: -len(agg) - 1]}")
            out = out.toDF(*index, *names)
        out = out.fillna(0)
    return out


def group_report(df: DataFrame, by: str, value: str, n: int = 20) -> DataFrame:
    """Sum, mean and count of a value by group, the n greatest sums."""
    return df.groupBy(by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("rows")).orderBy(F.desc("total"), by).limit(n)


def top_with_other(df: DataFrame, by: str, value: str, n: int = 12) -> DataFrame:
    """The n greatest groups and one for all others: (label, total). Ranks are taken over one row a group."""
    groups = df.groupBy(by).agg(F.sum(value).alias("total"))
    # one row a group, of which only the first n keep their names: a top-n, not a global window
    top = groups.orderBy(F.desc("total"), by).limit(n)
    rest = groups.join(top.select(F.col(by).alias("top_key"), F.lit(1).alias("in_top")), F.col(by).eqNullSafe(F.col("top_key")), "left").filter("in_top is null")
    other = rest.agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("k")).filter("k > 0").select(F.concat(F.lit("other ("), F.col("k").cast("string"), F.lit(")")).alias("label"), "total")
    return top.select(F.col(by).cast("string").alias("label"), "total").unionAll(other)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin from 1, rows) over equal widths of the column's range; the greatest value falls into the last bin. Empty bins are left out."""
    edge = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if edge["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, rows bigint")
    width = (edge["hi"] - edge["lo"]) / bins or 1.0
    where = F.least(F.floor((F.col(column) - edge["lo"]) / width) + 1, F.lit(bins)).cast("int")
    return df.filter(F.col(column).isNotNull()).groupBy(where.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def histograms(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(column, bin from 1, rows) of several columns over equal widths of their joint range, so that they can be laid over each other; empty bins are left out."""
    value = F.col("value")
    edge = df.agg(F.least(*[F.min(c).cast("double") for c in columns], F.lit(float("inf"))).alias("lo"), F.greatest(*[F.max(c).cast("double") for c in columns], F.lit(float("-inf"))).alias("hi")).first()
    if edge["lo"] > edge["hi"]:
        return df.sparkSession.createDataFrame([], "column string, bin int, rows bigint")
    width = (edge["hi"] - edge["lo"]) / bins or 1.0
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))).filter("value is not null")
    return each.groupBy("column", F.least(F.floor((value - edge["lo"]) / width) + 1, F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def box(df: DataFrame, by: str, column: str) -> DataFrame:
    """The five numbers of a box plot by group."""
    return df.groupBy(by).agg(F.min(column).alias("low"), *[F.percentile(column, q).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max(column).alias("high"))


def series(df: DataFrame, x: str, value: str, group: str, n: int = 30) -> DataFrame:
    """Totals by x and group for the n values of x with the greatest totals: (x, group, total)."""
    each = df.groupBy(x, group).agg(F.sum(value).alias("total"))
    top = each.groupBy(x).agg(F.sum("total").alias("all")).orderBy(F.desc("all"), x).limit(n).select(x)
    return each.join(top, x, "left_semi")


def ranked(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
