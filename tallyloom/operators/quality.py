"""Checks of a store and the numbering of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = r"^\d{8}-\d{2}$"


def checks(facts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, ok, detail): batch numbers of all tables, statuses and kinds of facts, keys that must be single, pointers that must lead somewhere."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count_if(~F.coalesce(F.col("batch_no").rlike(BATCH), F.lit(True))).alias("bad")).select(F.lit(f"batch_no of {name}").alias("name"), (F.col("bad") == 0).alias("ok"), F.col("bad").alias("detail"))
        out = row if out is None else out.unionAll(row)
    one = facts.dropDuplicates()
    sums = one.agg(
        F.count_if(~F.coalesce(F.col("status").isin("ok", "missing", "suspect"), F.lit(False))).alias("status"), F.count_if(~F.coalesce(F.col("source_kind").isin("source", "computed", "user"), F.lit(False))).alias("source_kind"),
        F.count_if((F.col("source_kind") == "computed") & (F.col("formula").isNull() | F.col("inputs").isNull())).alias("computed without formula"),
    )
    for c in sums.columns:
        out = out.unionAll(sums.select(F.lit(c), F.col(f"`{c}`") == 0, F.col(f"`{c}`")))
    repeated = one.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))
    lost = one.filter("superseded_by is not null").select("superseded_by").join(one.select(F.col("fact_id").alias("superseded_by")).distinct(), "superseded_by", "left_anti").agg(F.count(F.lit(1)).alias("bad"))
    for name, df in (("fact_id single", repeated), ("superseded_by leads to a fact", lost)):
        out = out.unionAll(df.select(F.lit(name), F.col("bad") == 0, F.col("bad")))
    return out


def best_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of (template, field): the most confident, then the lowest id, and the others, which go to review."""
    order = Window.partitionBy("template", "field").orderBy(F.desc_nulls_last("confidence"), "rule_id")
    ranked = rules.withColumn("place", F.row_number().over(order))
    return ranked.filter("place = 1").drop("place"), ranked.filter("place > 1").drop("place")


def active_rules(rules: DataFrame, templates: DataFrame, disabled: DataFrame) -> DataFrame:
    return rules.join(templates, "template").join(disabled.select("rule_id").distinct(), "rule_id", "left_anti")


def next_batch(used: DataFrame, days: DataFrame, most: int = 99) -> DataFrame:
    """(day, batch_no): the first free number of each day, null if all are taken. used: (batch_no), days: (day as yyyyMMdd)."""
    taken = used.filter(F.col("batch_no").rlike(BATCH)).select(F.substring("batch_no", 1, 8).alias("day"), F.substring("batch_no", 10, 2).cast("int").alias("n")).distinct()
    free = days.distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).join(taken, ["day", "n"], "left_anti").groupBy("day").agg(F.min("n").alias("n"))
    return days.distinct().join(free, "day", "left").select("day", F.when(F.col("n").isNotNull(), F.concat("day", F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0"))).alias("batch_no"))


def batch_map(sessions: DataFrame) -> DataFrame:
    """(session, batch_no): names that are batch numbers stay; the others get their day's numbers in order, past those in use; beyond 99 null.

    sessions: (session, day as yyyyMMdd, ord). The k-th newcomer of a day gets the k-th free number, of at most 99 a day.
    """
    keep = sessions.filter(F.col("session").rlike(BATCH)).select("session", F.col("session").alias("batch_no"))
    new = sessions.filter(~F.col("session").rlike(BATCH))
    taken = keep.select(F.substring("batch_no", 1, 8).alias("day"), F.substring("batch_no", 10, 2).cast("int").alias("n")).distinct()
    free = new.select("day").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(99)))).join(taken, ["day", "n"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("n")))
    placed = new.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("ord", "session")))
    named = placed.join(free, ["day", "k"], "left").select("session", F.when(F.col("n").isNotNull(), F.concat("day", F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0"))).alias("batch_no"))
    return keep.unionAll(named)
