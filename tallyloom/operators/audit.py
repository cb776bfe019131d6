"""The hash-chained audit log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a row's hash covers, in order, joined by MARK.
PARTS = ("prev_hash", "event_type", "payload_hash", "occurred_at", "actor_id", "run_id", "entity_id", "seq")
MARK = "‖"


def material(prev: Column) -> Column:
    return F.concat_ws(MARK, F.coalesce(prev, F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PARTS[1:]])


def verified(log: DataFrame) -> DataFrame:
    """Each row of the log with `link_ok` (it names the hash before it), `hash_ok` (its own hash is right) and `payload_ok` (the payload's is).

    Hashes are recomputed from the stored hash before, so that all rows are checked at once; only the link needs the row
    before, by a window over a batch. That payloads are checked too is an addition. A deleted end of a chain can't be seen.
    """
    order = Window.partitionBy("batch_no").orderBy("seq")
    return log.withColumns({
        "link_ok": F.coalesce("prev_hash", F.lit("")) == F.coalesce(F.lag("hash").over(order), F.lit("")), "hash_ok": F.sha2(material(F.col("prev_hash")), 256) == F.col("hash"),
        "payload_ok": F.sha2(F.coalesce("payload_json", F.lit("")), 256) == F.col("payload_hash"),
    })


def appended(events: DataFrame) -> DataFrame:
    """Events with prev_hash and hash: (batch_no, seq, event_type, payload_json, payload_hash, occurred_at, actor_id, run_id, entity_id, prev_hash, hash).

    A chain is made one row after the other, but each batch has its own: rows are sorted by batch and streamed, so that no
    batch is held in memory. One batch is one task's work by the nature of the chain.
    """
    cols = ["batch_no", "seq", "event_type", "payload_json", "payload_hash", "occurred_at", "actor_id", "run_id", "entity_id"]
    ready = events.withColumn("payload_hash", F.sha2(F.coalesce("payload_json", F.lit("")), 256)).select(*[F.col(c).cast("bigint" if c in ("seq", "entity_id") else "string").alias(c) for c in cols])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, ""
        for batch in batches:
            prevs, hashes = [], []
            for row in batch.to_pylist():
                if row["batch_no"] != now:
                    now, last = row["batch_no"], ""
                prevs.append(last)
                last = hashlib.sha256(MARK.join([last, *("" if row[c] is None else str(row[c]) for c in PARTS[1:])]).encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], [*cols, "prev_hash", "hash"])

    return ready.repartition("batch_no").sortWithinPartitions("batch_no", "seq").mapInArrow(chain, ", ".join(f"{c} {'bigint' if c in ('seq', 'entity_id') else 'string'}" for c in cols) + ", prev_hash string, hash string")
