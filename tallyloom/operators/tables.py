"""Cleaning of business tables."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts that mean a missing value, in lower case; the wide characters that are brought to narrow ones; signs and names of
# currencies and blanks that a number may hold; what a number is; signs that names of columns keep.
NULL_TOKENS = ("na", "n/a", "nan", "null", "none", "nil", "-", "--", "---", "?", "#n/a", "#null!", "#div/0!", "无", "空", "未知", "缺失", "\\n", "n.a.")
WIDE, NARROW = "０１２３４５６７８９．－＋，％　（）：", "0123456789.-+,% ():"
CURRENCY = r"(?i)[¥$€£￥\s　]|RMB|CNY|USD|EUR|GBP"
PLAIN_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
KEPT = "()./%-"


def tidy_names(names: list[str]) -> list[str]:
    """Column names of letters, digits and the signs in KEPT, anything else between them as one underscore, wide brackets as usual ones; repeated ones numbered `n, n_1, n_2`."""
    taken: Counter[str] = Counter()
    out = []
    for name in names:
        kept = ("(" if c == "（" else ")" if c == "）" else c if c.isalnum() or c in KEPT else " " for c in str(name))
        plain = "_".join("".join(kept).split()) or "column"
        out.append(f"{plain}_{taken[plain]}" if taken[plain] else plain)
        taken[plain] += 1
    return out


def drop_noise_columns(df: DataFrame) -> DataFrame:
    """Without columns that only number rows: unnamed ones, `index`, 序号."""
    return df.drop(*[c for c in df.columns if re.fullmatch(r"(?i)unnamed[:_ ]?\d*|index|序号", c)])


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows and then columns that are null throughout; the columns are found by one aggregation."""
    df = df.dropna(how="all")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first() if df.columns else []
    return df.select(*[f"`{c}`" for c, n in zip(df.columns, counts, strict=True) if n])


def squeezed(c: Column) -> Column:
    """Trimmed, with any run of white space (ideographic spaces too) as one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def without_tokens(c: Column) -> Column:
    return F.when(~F.lower(c).isin(*NULL_TOKENS), c)


def narrow(c: Column) -> Column:
    """Wide digits and nine signs as narrow ones; letters stay."""
    return F.translate(c, WIDE, NARROW)


def to_number(c: Column) -> Column:
    """The number of a messy text: wide digits, currency, thousands commas, a percent sign (12% is 12), brackets for negatives; else null.

    One pattern takes brackets, number and percent sign apart; brackets must stand on both sides or neither.
    """
    whole = r"(?s)^(\(?)(.*?)%?(\)?)$"
    text = F.trim(narrow(c))
    frame = F.regexp_replace(text, whole, "$1$3")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, whole, 2), CURRENCY, ""), r"(?<=\d),(?=\d{3}\b)", "")
    number = F.when(digits.rlike(PLAIN_NUMBER), digits.try_cast("double"))
    return F.when(frame == "", number).when(frame == "()", -F.abs(number))


#: How dates are written with the year first, whole and without a day.
DAY_SHAPE, MONTH_SHAPE = r"^(\d{4})[年./-](\d{1,2})[月./-](\d{1,2})日?$", r"^(\d{4})[年/](\d{1,2})月?$"


def to_date(c: Column) -> Column:
    """The date of 2024-3-1 and its forms with 年月日, points or slashes; a month alone is its first day. Strict, so that decimals stay numbers."""
    s = F.trim(narrow(c))
    s = F.regexp_replace(F.regexp_replace(s, DAY_SHAPE, "$1-$2-$3"), MONTH_SHAPE, "$1-$2-01")
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s.try_cast("date"))


def infer_kinds(df: DataFrame, threshold: float = 0.8) -> dict[str, str]:
    """`date`, `number` or `text` of each string column: dates first, then numbers, each if at least `threshold` of the values can be read. One aggregation over all rows."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return {}
    q = lambda c: F.col(f"`{c}`")
    aggs = [x for i, c in enumerate(texts) for x in (F.count(q(c)).alias(f"n{i}"), F.count(to_date(q(c))).alias(f"d{i}"), F.count(to_number(q(c))).alias(f"m{i}"), F.max(q(c).rlike("[-/年月.]")).alias(f"s{i}"))]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(texts):
        n = r[f"n{i}"]
        out[c] = "text" if not n else "date" if r[f"s{i}"] and r[f"d{i}"] >= threshold * n else "number" if r[f"m{i}"] >= threshold * n else "text"
    return out


def fold_key(c: Column) -> Column:
    """What spellings of one category have in common: lower case without blanks, underscores, hyphens and brackets."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s_\-()（）\[\]]+", ""))


def unify_categories(df: DataFrame, column: str, order: str) -> DataFrame:
    """Each category as it was first spelt, in the order of the column `order`. The spellings are one row a category and join back by key."""
    key = fold_key(F.col(column))
    first = df.filter(F.col(column).isNotNull()).groupBy(key.alias("fold_key")).agg(F.min_by(column, order).alias("fold_first"))
    joined = df.withColumn("fold_key", key).join(first, "fold_key", "left")
    return joined.withColumn(column, F.col("fold_first")).drop("fold_key", "fold_first")


def fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high, usable): the quartile fences of columns and whether there are outliers to speak of (five values, a quartile range)."""
    from tallyloom.operators.profile import counted, quantiles

    q = quantiles(counted(df, columns), (0.25, 0.75)).withColumns({"q1": F.get("q", F.lit(0)), "q3": F.get("q", F.lit(1))})
    r = F.col("q3") - F.col("q1")
    return q.select("column", (F.col("q1") - 1.5 * r).alias("low"), (F.col("q3") + 1.5 * r).alias("high"), ((F.col("distinct_values") >= 5) & (r > 0)).alias("usable"))


def mark_outliers(df: DataFrame, *columns: str, clip: bool = False) -> DataFrame:
    """Adds `<column>_is_outlier` for each column, and brings outliers to the fence if asked to. The fences of all columns come as literals, one row each."""
    found = {r["column"]: r for r in fences(df, list(columns)).filter("usable").collect()}
    for column in columns:
        c, f = F.col(column), found.get(column)
        out = (c < f["low"]) | (c > f["high"]) if f else F.lit(False)
        df = df.withColumn(f"{column}_is_outlier", F.coalesce(out, F.lit(False)))
        if clip and f:
            df = df.withColumn(column, F.when(c < f["low"], F.lit(f["low"])).when(c > f["high"], F.lit(f["high"])).otherwise(c))
    return df


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("keep_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("keep_rank = 1").drop("keep_rank")


def clean(df: DataFrame, order: str | None = None, outliers: str = "flag", rename: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """The whole chain: names, empty rows and columns, row numbers, blanks and null tokens, wide digits, types, categories, outliers, repeated rows, rules.

    `order` names a column that tells which spelling came first; without it categories are left as they are.
    Edge cases: a table without rows or columns passes through; columns of other types than text are only checked for outliers.
    """
    df = drop_noise_columns(drop_empty(df.toDF(*tidy_names(df.columns))))
    texts = [c for c, t in df.dtypes if t == "string"]
    df = df.withColumns({c: narrow(without_tokens(squeezed(F.col(f"`{c}`")))) for c in texts})
    kinds = infer_kinds(df)
    df = df.withColumns({c: to_date(F.col(f"`{c}`")) if k == "date" else to_number(F.col(f"`{c}`")) for c, k in kinds.items() if k != "text"})
    if order:
        left = [c for c, k in kinds.items() if k == "text" and c != order]
        if left:
            # the sketch only says which columns are far from the bound; the others are counted
            rough = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(left)]).first()
            left = [c for c, n in zip(left, rough, strict=True) if n <= 400]
            sizes = df.agg(*[F.countDistinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(left)]).first() if left else []
            for c, n in zip(left, sizes, strict=True):
                if 2 <= n <= 200:
                    df = unify_categories(df, c, order)
    if outliers != "none":
        numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c != order]
        if numbers:
            df = mark_outliers(df, *numbers, clip=outliers == "clip")
    return df.dropDuplicates().withColumnsRenamed(rename or {}).drop(*(drop or []))
