"""A change feed applied as it arrives.

Of each micro-batch the changes that can still matter are written under its batch number, so that a
batch that runs again after a failure replaces itself. The current rows are the replay of all of them,
in whatever order and batch records arrived, and ``compact`` drops what has been superseded since.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import replay


@dataclass(frozen=True)
class FeedTable:
    """A table kept up to date from a feed; ``path`` has to be reachable by all executors."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    seq: str
    op: str
    set_bits: str
    values: Sequence[str]

    @property
    def _names(self) -> tuple[list[str], list[str]]:
        return [f"k__{i}" for i in range(len(self.keys))], [f"v__{i}" for i in range(len(self.values))]

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch to the table; applying a batch number again replaces it."""
        changes = replay.as_changes(batch, self.keys, self.seq, self.op, self.set_bits, self.values)
        self._survivors(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _survivors(self, changes: DataFrame) -> DataFrame:
        keys, values = self._names
        return replay.surviving_changes(changes, keys, "seq__", "op__", "bits__", values)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply a streaming DataFrame; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _changes(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")

    def current(self) -> DataFrame:
        """The rows as of the batches applied so far: key columns, sequence number, values."""
        keys, values = self._names
        states = replay.merge_states(replay.partial_states(self._changes(), keys, "seq__", "op__", "bits__", values), keys, "seq__", values)
        return replay.live_rows(states, self.keys, self.seq, self.values)

    def compact(self, path: str) -> FeedTable:
        """A table at ``path`` that holds what still matters of the batches so far, deletes included."""
        self._survivors(self._changes()).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return FeedTable(self.spark, path, self.keys, self.seq, self.op, self.set_bits, self.values)
