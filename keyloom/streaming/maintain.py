"""A snapshot kept up to date from a stream of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from keyloom.operators import write
from keyloom.operators.query import Table
from keyloom.plans.schema import TableSchema
from keyloom.sources.store import SnapshotStore


def upsert_batch(schema: TableSchema, store: SnapshotStore, order: str, now: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts each batch's last record of a key into a new version of the snapshot.

    The batch number is kept beside the data, so a batch that is delivered again changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        if store.version and (done := store.read("batches").agg(F.max("batch")).first()[0]) is not None and done >= number:
            return
        old = Table(schema, store.read() if store.version else batch.limit(0))
        keys = list(old.compiled.primary_key)
        last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
        store.publish(write.insert(old, last), markers={"batches": batch.sparkSession.createDataFrame([(number,)], "batch bigint")})

    return run


def maintain(stream: DataFrame, schema: TableSchema, store: SnapshotStore, order: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that is there and stops."""
    return stream.writeStream.foreachBatch(upsert_batch(schema, store, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
