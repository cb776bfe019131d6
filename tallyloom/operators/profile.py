"""Profiles of tables: what columns hold and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.tables import NULL_TOKENS, PLAIN_NUMBER, WIDE, to_number
from tallyloom.session import cut


def _stacked(df: DataFrame, parts: list) -> DataFrame:
    """One row for each struct, all from one aggregation."""
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, part): how often each number of each column occurs, sorted over all parts, written once.

    Columns become rows and equal values are counted before the shuffle; a sort by range spreads them over the parts, so that
    no column is one task's. Numbers are compared as doubles; nulls are left out.
    """
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("e")).select("e.*")
    rows = each.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return cut(rows.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))


def quantiles(rows: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(column, filled, distinct_values, q): the exact quantiles of counted() rows, linear between two values.

    Each part's running counts begin at what the parts before it hold, which is one row a column and part.
    """
    parts = rows.groupBy("column", "part").agg(F.sum("n").alias("held"))
    start = F.coalesce(F.sum("held").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("start", start).withColumn("filled", F.sum("held").over(Window.partitionBy("column"))).drop("held")
    placed = rows.join(parts, ["column", "part"]).withColumn("upto", F.col("start") + F.sum("n").over(Window.partitionBy("column", "part").orderBy("value")))
    rank = lambda p: (F.col("filled") - 1) * p
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    ends = [x.alias(f"{side}{i}") for i, p in enumerate(shares) for side, x in (("lo", at(F.floor(rank(p)))), ("hi", at(F.ceil(rank(p)))))]
    got = placed.groupBy("column").agg(F.max("filled").alias("filled"), F.count(F.lit(1)).alias("distinct_values"), *ends)
    between = lambda i, p: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank(p) - F.floor(rank(p)))
    return got.select("column", "filled", "distinct_values", F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each numeric column: missing, distinct, min, max, mean, median, std, sum, quartiles, skew and outliers beyond the quartile fences.

    Two scans: one plain aggregation for the moments, and one that counts equal values, of which distinct counts, quartiles
    and outliers are taken.
    """
    def stats(c: str):
        n, v = F.count(c), F.col(c).cast("double")
        skew = F.when((n > 2) & (F.stddev(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
        return F.struct(F.lit(c).alias("column"), F.sum(F.col(c).isNull().cast("bigint")).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.sum(v).alias("sum"), skew.alias("skew"))

    rows = counted(df, columns)
    q = quantiles(rows, (0.25, 0.5, 0.75)).select("column", "distinct_values", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    wide = 1.5 * (F.col("q3") - F.col("q1"))
    far = (F.col("value") < F.col("q1") - wide) | (F.col("value") > F.col("q3") + wide)
    found = rows.join(q, "column").groupBy("column").agg(F.sum(F.when(far & (wide > 0), F.col("n")).otherwise(0)).alias("outliers"))
    out = _stacked(df, [stats(c) for c in columns]).join(q, "column", "left").join(found, "column", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("column", "missing", zero("distinct_values"), "min", "max", "mean", "median", "std", "sum", "q1", "q3", "skew", zero("outliers"))


def dates(df: DataFrame, columns: list[str]) -> DataFrame:
    return _stacked(df, [F.struct(F.lit(c).alias("column"), F.min(c).cast("date").alias("first"), F.max(c).cast("date").alias("last"), F.datediff(F.max(c), F.min(c)).alias("span_days")) for c in columns])


def texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each text column: missing, distinct, shortest, longest and mean length, whether it may be an id."""
    return _stacked(df, [
        F.struct(F.lit(c).alias("column"), F.sum(F.col(c).isNull().cast("bigint")).alias("missing"), F.countDistinct(c).alias("distinct_values"), F.min(F.length(c)).alias("shortest"), F.max(F.length(c)).alias("longest"),
                 F.round(F.avg(F.length(c)), 1).alias("mean_length"), ((F.countDistinct(c) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 1)).alias("likely_id")) for c in columns
    ])


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column, the smaller value first among equals."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(n)


def repeated_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat another in all columns."""
    each = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return each.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_rows"))


def issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, issue, rows) of text columns: much missing, constant, all unique, untrimmed, wide digits, null tokens, numbers as text. One aggregation."""
    total = F.count(F.lit(1))
    parts = []
    for c in columns:
        v = F.col(c).cast("string")
        missing, read, n = F.sum(F.col(c).isNull().cast("bigint")), F.count(to_number(v)), F.count(c)
        plain = F.count_if(v.rlike(r"^-?\d+(\.\d+)?$"))
        found = {
            "high_missing": F.when(missing > 0.5 * total, missing), "notable_missing": F.when((missing > 0.3 * total) & (missing <= 0.5 * total), missing),
            "constant": F.when((F.countDistinct(c) == 1) & (total > 1), n), "all_unique": F.when((F.countDistinct(c) == total) & (total > 1), n),
            "untrimmed": F.count_if(v.rlike(r"(?U)^\s|\s$")), "full_width": F.count_if(v.rlike(f"[{WIDE}]")), "null_token": F.count_if(F.lower(F.trim(v)).isin(*NULL_TOKENS)),
            "number_as_text": F.when((n > 0) & (read >= 0.8 * n) & (plain < n), read),
        }
        parts += [F.struct(F.lit(c).alias("column"), F.lit(k).alias("issue"), x.cast("bigint").alias("rows")) for k, x in found.items()]
    return _stacked(df, parts).filter("rows > 0")


def correlations(df: DataFrame, columns: list[str], least: float = 0.5, n: int = 20) -> DataFrame:
    """Pairs of columns with |r| of at least `least`, the strongest n; all pairs from one aggregation."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 3).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return _stacked(df, pairs).filter(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns in both orders and each with itself, for a heat map; one aggregation."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 3).alias("r")) for a in columns for b in columns]
    return _stacked(df, pairs)


def outlier_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, issue, rows) of numeric columns with values beyond the quartile fences."""
    return numbers(df, columns).filter("outliers > 0").select("column", F.lit("outliers").alias("issue"), F.col("outliers").alias("rows"))


def header_row(cells: DataFrame) -> DataFrame:
    """The row of each sheet that is most likely its header: (sheet, row). cells: (sheet, row from 0, text).

    Of the first ten rows the one with the greatest 0.6 * filled + 0.6 * texts - 0.1 * row; the first among equals.
    """
    number = F.regexp_replace("text", "[,%]", "").rlike(PLAIN_NUMBER)
    filled = F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0
    rows = cells.filter("row < 10").groupBy("sheet", "row").agg((0.6 * F.count_if(filled) + 0.6 * F.count_if(filled & ~number) - 0.1 * F.col("row")).alias("score"))
    best = Window.partitionBy("sheet").orderBy(F.desc("score"), "row")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").select("sheet", "row")


def quick_problems(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, problem, rows): missing, mostly_duplicate (over nine in ten rows repeat a value, and there are two), untrimmed, full_width, all_unique. One aggregation."""
    total, parts = F.count(F.lit(1)), []
    for c in columns:
        v, n, distinct = F.col(c).cast("string"), F.count(c), F.countDistinct(c)
        found = {
            "missing": F.sum(F.col(c).isNull().cast("bigint")), "mostly_duplicate": F.when((distinct > 1) & (1 - distinct / n > 0.9), n - distinct),
            "untrimmed": F.count_if(v.rlike(r"(?U)^\s|\s$")), "full_width": F.count_if(v.rlike(f"[{WIDE}]")), "all_unique": F.when((distinct == total) & (total > 1), total),
        }
        parts += [F.struct(F.lit(c).alias("column"), F.lit(k).alias("problem"), x.cast("bigint").alias("rows")) for k, x in found.items()]
    return _stacked(df, parts).filter("rows > 0")


def roles(df: DataFrame) -> DataFrame:
    """(column, role, distinct_values): numeric and datetime by type, text that has at most max(50, half the rows) values is categorical, other text is text."""
    kinds = {"timestamp": "datetime", "date": "datetime", "timestamp_ntz": "datetime"}
    n = F.count(F.lit(1))
    parts = []
    for c, t in df.dtypes:
        distinct = F.countDistinct(F.col(f"`{c}`"))
        numeric = t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
        role = F.lit("numeric") if numeric else F.lit(kinds[t]) if t in kinds else F.when(distinct <= F.greatest(F.lit(50), n / 2), "categorical").otherwise("text")
        parts.append(F.struct(F.lit(c).alias("column"), role.alias("role"), distinct.alias("distinct_values")))
    return _stacked(df, parts)


def chart_choice(df: DataFrame) -> DataFrame:
    """One row (x, y, chart, aggregate): the first datetime column, else the first categorical one, as x; the first numeric column as y; a line
    over time, bars by category, a histogram where there is no x; rows are aggregated unless x is unique in each."""
    found = roles(df).withColumn("place", F.call_function("array_position", F.array(*map(F.lit, df.columns)), F.col("column")))
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("place", "column", "distinct_values")))
    rows = df.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    got = found.agg(first("datetime").alias("t"), first("categorical").alias("c"), first("numeric").alias("y")).withColumn("one", F.lit(1)).join(rows, "one")
    x = F.coalesce("t", "c")
    chart = F.when(F.col("t").isNotNull(), "line").when(F.col("c").isNotNull(), "bar").otherwise("histogram")
    return got.select(x["column"].alias("x"), F.col("y.column").alias("y"), chart.alias("chart"), F.coalesce(x["distinct_values"] < F.col("n"), F.lit(False)).alias("aggregate"))
