"""Order pages that land as files, ingested once each."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartloom import schemas


def ingest_orders(
    spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1000,
    event_time: str | None = None, within: str | None = None,
) -> StreamingQuery:
    """Read new order files, drop ids seen before, append to a parquet table.

    The checkpoint is the progress marker: a restart goes on after the last
    committed batch. The seen ids are keyed state, partitioned by id; sessions
    of ``build_session`` hold it in RocksDB, which spills to executor disk. All
    ids are remembered for ever, since an order may be delivered again any time.

    With ``event_time``, a field of the orders with their time, and ``within``, an
    interval like ``'7 days'``, an id is remembered until the newest order is that
    much later than it, so the state is bounded by the orders of that time. A copy
    that comes later than that is dropped as late, or taken as a new order if its
    time is new too. An order without a time has no place in it and is left out.
    """
    if (event_time is None) != (within is None):
        raise ValueError("event_time and within belong together")
    schema = schemas.ORDER if event_time is None else f"{schemas.ORDER}, `{event_time}` TIMESTAMP"
    found = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
        .where("id IS NOT NULL")
    )
    if event_time is None:
        orders = found.dropDuplicates(["id"])
    else:
        timed = found.where(F.col(event_time).isNotNull())
        orders = timed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["id"])
    return (
        orders.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
