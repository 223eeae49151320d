"""Cluster mode on a stream of values: each micro-batch's windows are encoded as they come.

Windows are independent and every value carries its explicit place, so no state is held; a batch that brings part of a window
is encoded as a chunk of its own, which keeps its values' places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from boundwell.config import Config
from boundwell.plans.compress import compress


def compress_stream(stream: DataFrame, cfg: Config, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write chunk tables under path/batch=<n> for a streaming DataFrame (pos, x). A batch that is run again replaces its own."""

    def write(batch: DataFrame, n: int) -> None:
        compress(batch, cfg).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
