"""Documents as a stream. Documents are independent, so a stream is the batch projection without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators.reader import to_hub
from ledgerloom.plans.mapping import Spoke


def read_stream(documents: DataFrame, spoke: Spoke, path: str, checkpoint: str, once: bool = True):
    """Start reading a stream of (doc_id, xml) into Parquet files below path; with `once`, stop when all that is there
    has been read. Backpressure is the source's: maxFilesPerTrigger or maxBytesPerTrigger."""
    writer = to_hub(documents, spoke).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
