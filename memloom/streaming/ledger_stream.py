"""The ledger as a stream: current state kept a key, late rows applied in ledger order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.ledger import IDENTITY


def latest_state(events: DataFrame) -> DataFrame:
    """Latest event of each identity: an aggregate whose state is one row a key, whatever order rows arrive in."""
    last = F.max(F.struct("event_seq", "event_id", "is_forget", "kind", "value")).alias("last")
    return events.groupBy(*IDENTITY).agg(last).select(*IDENTITY, "last.*")


def run_available(spark: SparkSession, streamed: DataFrame, checkpoint: str) -> DataFrame:
    """Process what there is as a stream and return the resulting state. ``checkpoint`` holds offsets and state; the sink is a
    table in the warehouse that each batch replaces, so a replayed batch changes nothing."""
    name = f"ledger_{uuid.uuid4().hex}"

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").saveAsTable(name)

    query = latest_state(streamed).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
