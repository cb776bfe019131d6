"""Streaming forms: the audit chain checked as it grows, and counts by window. An extension; there is no batch twin of the windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.audit import material


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) counted and summed by window and type; later ones than the watermark allows are dropped by it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def chain_breaks(log: DataFrame) -> DataFrame:
    """(batch_no, seq, problem) of rows of an audit log that arrive in order of seq and do not fit the chain so far.

    The state of a batch is its last hash and number. Hashes are recomputed in the JVM before the state is asked.
    """
    ready = log.select("batch_no", "seq", F.coalesce("prev_hash", F.lit("")).alias("prev_hash"), "hash", (F.sha2(material(F.col("prev_hash")), 256) == F.col("hash")).alias("hash_ok"))

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seq = state.get if state.exists else ("", 0)
        bad = []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            if not row.hash_ok:
                bad.append((key[0], row.seq, "hash"))
            if row.prev_hash != last or row.seq != seq + 1:
                bad.append((key[0], row.seq, "link"))
            last, seq = row.hash, int(row.seq)
        state.update((last, seq))
        yield pd.DataFrame(bad, columns=["batch_no", "seq", "problem"])

    return ready.groupBy("batch_no").applyInPandasWithState(follow, "batch_no string, seq bigint, problem string", "last string, seq bigint", "append", GroupStateTimeout.NoTimeout)
