"""The full history of attributes that change."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.dates import day, recorded_end
from tallyloom.functions.text import is_blank, same_value


def change_log(df: DataFrame, entity: str, attr, value: str, start: str, end: str, known: str, row_id: str) -> DataFrame:
    """A table of reports as events: (entity_id, attr, form, start, until, value, known, row_id).

    Reports without a readable start, without an entity or with a null or blank value are no events. `form` is the value
    without blanks and in half width; two reports with the same form state the same value.
    """
    began, ended = day(F.col(start)), day(F.col(end))
    return df.filter(~is_blank(F.col(value)) & F.col(entity).isNotNull()).select(
        F.col(entity).alias("entity_id"), attr.alias("attr"), same_value(F.col(value)).alias("form"),
        began.alias("start"), recorded_end(began, ended).alias("until"), F.col(value).alias("value"), F.col(known).alias("known"), F.col(row_id).alias("row_id"),
    ).filter("start is not null and attr is not null and attr != ''")


def versions(events: DataFrame) -> DataFrame:
    """The versions of each attribute: (entity_id, attr, form, value, valid_from, valid_to, version, versions).

    Of the events of one day the latest known, then the largest row id, counts. Consecutive events of one value are one
    version: it starts with the first of them and ends on the earlier of the next version's start and the end its last
    event recorded; null if there is neither.

    Scale: the first aggregation leaves one row per (entity, attribute, day) and is combined before the shuffle, so that
    no later group is larger than the number of days in the calendar, however many reports one entity has.
    Edge cases: copies and ties fold in the first aggregation; an empty table gives no rows.
    """
    daily = events.groupBy("entity_id", "attr", "start").agg(F.max(F.struct("known", "row_id", "form", "until", "value")).alias("e")).select("entity_id", "attr", "start", "e.form", "e.until", "e.value")
    order = Window.partitionBy("entity_id", "attr").orderBy("start")
    marked = daily.withColumn("new", (~F.col("form").eqNullSafe(F.lag("form").over(order))).cast("int")).withColumn("version", F.sum("new").over(order))
    run = marked.groupBy("entity_id", "attr", "version").agg(
        F.min("start").alias("valid_from"), F.max(F.struct("start", "form", "value", "until")).alias("last")
    )
    steps = Window.partitionBy("entity_id", "attr").orderBy("version")
    everything = Window.partitionBy("entity_id", "attr")
    return run.select(
        "entity_id", "attr", F.col("last.form").alias("form"), F.col("last.value").alias("value"), "valid_from",
        F.least(F.lead("valid_from").over(steps), F.col("last.until")).alias("valid_to"), F.col("version").cast("int").alias("version"),
        F.count(F.lit(1)).over(everything).cast("int").alias("versions"),
    )


def combined(history: DataFrame) -> DataFrame:
    """All attributes of an entity side by side: (entity_id, valid_from, valid_to, attrs, state), split wherever one of them changes.

    The boundary dates of all attributes are united, each elementary period gets the values that hold in it, and
    neighbouring periods with the same values are coalesced; periods in which nothing holds are left out. `state` has a
    line `attr=form` for each of the `attrs` attributes, in their order; valid_to is null where it never ends.

    A sweep: starts and ends become one sorted stream, along which what holds is carried, so that the work is that of the
    changes and of writing the states, and memory that of one entity's attributes.
    """
    ends = F.explode(F.array(F.struct(F.col("valid_from").alias("at"), "form"), F.struct(F.col("valid_to").alias("at"), F.lit(None).cast("string").alias("form")))).alias("e")
    events = history.select("entity_id", "attr", ends).filter("e.at is not null").select("entity_id", F.col("e.at").alias("at"), "attr", F.col("e.form").alias("form"))
    # on one day the end of a version comes before the start of the next
    ordered = events.repartition("entity_id").sortWithinPartitions("entity_id", "at", F.col("form").isNotNull(), "attr")
    return ordered.mapInArrow(_sweep, "entity_id bigint, valid_from date, valid_to date, attrs bigint, state string")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Periods of rows (entity, day, attribute, form or null) in order."""
    kinds = [pa.int64(), pa.date32(), pa.date32(), pa.int64(), pa.string()]
    out: list[tuple] = []
    # what holds, since when, as it is now; and the period that is open
    entity, holds, day, period = None, {}, None, None

    def settle(until) -> None:
        nonlocal period
        if day is None or day == until:
            return
        state = "\n".join(f"{a}={holds[a]}" for a in sorted(holds)) if holds else None
        if period is not None and (state != period[3] or period[1] != day):
            out.append((entity, *period))
            period = None
        if state is not None:
            period = (day, until, len(holds), state) if period is None else (period[0], until, *period[2:])

    def emit() -> pa.RecordBatch:
        rows = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, ["entity_id", "valid_from", "valid_to", "attrs", "state"])

    for batch in batches:
        for own, at, attr, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != entity:
                settle(None)
                if period is not None:
                    out.append((entity, *period))
                entity, holds, day, period = own, {}, None, None
            if at != day:
                settle(at)
                day = at
            if form is None:
                holds.pop(attr, None)
            else:
                holds[attr] = form
        if len(out) > 10_000:
            yield emit()
    settle(None)
    if period is not None:
        out.append((entity, *period))
    if out:
        yield emit()
