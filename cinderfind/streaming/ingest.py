"""Streaming ingestion: each micro-batch of record rows goes through the batch pipeline, so a replayed one changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cinderfind.operators.ingest import Pipeline
from cinderfind.sources.tables import last_wins


def start(records: DataFrame, pipeline: Pipeline, checkpoint: str, **trigger):
    """Starts a query over streamed records (sources/adapters.RECORD). Of an id's rows in a batch the last to arrive is taken."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            pipeline.ingest(last_wins(batch, ["id"], None))

    writer = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
