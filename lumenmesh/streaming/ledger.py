"""The orphan ledger fed by a stream: each micro-batch advances the kept state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.orphans import Ledger
from ..session import shared_dir


class OrphanLedger(Ledger):
    """`Ledger` over events (kind 'ref' or 'parent', ref_table, ref_key, ref_id, version, alive, t).

    Events without a time t take the number of their batch in seconds: parents of a batch then count as seen
    by its references. A batch that is run again replaces what it added, so repeated deliveries count once.
    """

    def __init__(self, spark: SparkSession, name: str, where: str | None = None):
        super().__init__(spark, f"{where or shared_dir(spark)}/ledger-{name}")
        self.time = "timestamp"

    def apply(self, events: DataFrame, batch: int) -> None:
        """Null keys are ignored; an event of another kind counts for nothing."""
        e = events.where("ref_key is not null and ref_table is not null")
        if "t" not in e.columns:
            e = e.withColumn("t", F.timestamp_seconds(F.lit(batch)))
        self.advance(e.where("kind = 'ref'"), e.where("kind = 'parent'"), batch)

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Feeds a stream of events to the ledger; with once, what is there, then stops."""
        w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(df, n))
        return (w.trigger(availableNow=True) if once else w).start()
