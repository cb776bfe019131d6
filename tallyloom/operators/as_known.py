"""Attributes as valid and as known at an event's time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.skew import hot_keys

#: Days that stand for "always was" and "never ends".
FIRST, LAST = -(10**6), 10**7
#: A group of more versions or of more events than this is split.
GROUP_ROWS = 200_000


def _insert(node, key, until, pri):
    """The root of a new treap with the key in it; the old one stays whole, as only the path is copied.

    A node is (key, until, largest until below, priority, left, right).
    """
    if node is None:
        return key, until, until, pri, None, None
    k, u, _, p, left, right = node
    if key < k:
        left = _insert(left, key, until, pri)
        if left[3] > p:
            lk, lu, _, lp, ll, lr = left
            return _node(lk, lu, lp, ll, _node(k, u, p, lr, right))
    elif key > k:
        right = _insert(right, key, until, pri)
        if right[3] > p:
            rk, ru, _, rp, rl, rr = right
            return _node(rk, ru, rp, _node(k, u, p, left, rl), rr)
    else:
        return node
    return _node(k, u, p, left, right)


def _node(k, u, p, left, right):
    top = u
    if left is not None and left[2] > top:
        top = left[2]
    if right is not None and right[2] > top:
        top = right[2]
    return k, u, top, p, left, right


def _latest(node, at):
    """The largest key with key[0] <= at < until; subtrees in which everything has ended are skipped."""
    while node is not None and node[2] > at:
        if node[0][0] <= at:
            found = _latest(node[5], at)
            if found is not None:
                return found
            if node[1] > at:
                return node[0]
        node = node[4]
    return None


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of (entity, part, kind, known): versions are put into trees as they become known, then events are answered."""
    now, trees, last = None, {}, None
    for batch in batches:
        events, fields, rows, froms, knowns = [], [], [], [], []
        for entity, part, kind, attr, ident, start, until, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (entity, part):
                now, trees, last = (entity, part), {}, None
            if kind == 0:
                days, roots = trees.setdefault(attr, ([], []))
                root = _insert(roots[-1] if roots else None, (start, known, ident), until, (ident * 0x9E3779B97F4A7C15 ^ known) & 0xFFFFFFFF)
                known_day = known // 86_400_000_000
                if days and days[-1] == known_day:
                    roots[-1] = root
                else:
                    days.append(known_day)
                    roots.append(root)
            elif ident != last:
                last = ident
                for attr, (days, roots) in trees.items():
                    which = bisect_right(days, start) - 1
                    found = _latest(roots[which], start) if which >= 0 else None
                    if found is not None:
                        events.append(ident)
                        fields.append(attr)
                        froms.append(found[0])
                        knowns.append(found[1])
                        rows.append(found[2])
        if events:
            yield pa.RecordBatch.from_arrays([pa.array(events, pa.int64()), pa.array(fields, pa.string()), pa.array(froms, pa.int64()), pa.array(knowns, pa.int64()), pa.array(rows, pa.int64())], ["event_id", "attr", "start", "known", "row_id"])


def as_known(events: DataFrame, versions: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each event and attribute of its entity the version valid and known on the event's day: (event_id, attr, row_id).

    events: (event_id bigint, entity_id bigint, at date). versions: (row_id bigint, entity_id bigint, attr string, start
    date, until date, known timestamp); a null start is the earliest, a null until never ends. Of several versions the one
    with the latest start, then known, then row_id counts. No version that became known on a later day is ever taken.

    Per entity and attribute a path-copied search tree over (start, known, row_id) is built in the order in which versions
    became known; an event picks the root of its own day and searches the valid time in it, in logarithmic time. Both
    tables go through one shuffle by entity and are read as a sorted stream. An entity with more than `group_rows`
    versions is split by row_id, one with more events by event_id, and the best of the parts counts.

    Edge cases: events without entity or day, and versions without entity, attribute or known time, give nothing; copies
    count once; an empty side gives no rows; other columns of the inputs aren't read.
    """
    e = events.filter("event_id is not null and entity_id is not null and at is not null").select("entity_id", "event_id", F.unix_date("at").cast("bigint").alias("day"))
    v = versions.filter("row_id is not null and entity_id is not null and attr is not null and known is not null").select(
        "entity_id", "attr", "row_id", F.coalesce(F.unix_date("start"), F.lit(FIRST)).cast("bigint").alias("start"),
        F.coalesce(F.unix_date("until"), F.lit(LAST)).cast("bigint").alias("until"), F.unix_micros("known").alias("known"),
    )
    counts = e.select("entity_id", F.lit(1).alias("e"), F.lit(0).alias("v")).unionAll(v.select("entity_id", F.lit(0), F.lit(1)))
    counts = counts.groupBy("entity_id").agg(F.ceil(F.sum("v") / group_rows).cast("int").alias("k"), F.ceil(F.sum("e") / group_rows).cast("int").alias("m"))
    hot = hot_keys(counts, "k > 1 or m > 1")
    zero = F.lit(0)
    if hot is None:
        e, v = e.withColumn("part", zero), v.withColumn("part", zero)
    else:
        # A hot entity becomes a grid: its versions in k slices, its events in m; part = slice * m + slice of the events.
        k, m = F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("m", F.lit(1)), F.lit(1))
        e = e.join(hot, "entity_id", "left").withColumn("part", F.explode(F.transform(F.sequence(zero, k - 1), lambda i: i * m + F.pmod(F.xxhash64("event_id"), m).cast("int")))).drop("k", "m")
        v = v.join(hot, "entity_id", "left").withColumn("part", F.explode(F.transform(F.sequence(zero, m - 1), lambda j: F.pmod(F.xxhash64("row_id"), k).cast("int") * m + j))).drop("k", "m")
    none = F.lit(None)
    rows = v.select("entity_id", "part", zero.alias("kind"), "attr", F.col("row_id").alias("ident"), "start", "until", "known").unionAll(
        e.select("entity_id", "part", F.lit(1), none.cast("string"), "event_id", "day", none.cast("bigint"), none.cast("bigint"))
    )
    ordered = rows.repartition("entity_id", "part").sortWithinPartitions("entity_id", "part", "kind", "known", "ident")
    found = ordered.mapInArrow(_search, "event_id bigint, attr string, start bigint, known bigint, row_id bigint")
    if hot is not None:
        found = found.groupBy("event_id", "attr").agg(F.max(F.struct("start", "known", "row_id")).alias("x")).select("event_id", "attr", "x.row_id")
    return found.select("event_id", "attr", "row_id")
