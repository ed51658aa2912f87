"""A compiled program on a stream: stateless and row-wise, so the batch plan runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from icspark.operators.program import Program, alerts, rectified


def start(stream: DataFrame, program: Program, path: str, checkpoint: str, mend: bool = False) -> StreamingQuery:
    """Write the stream with an `alert` column, or mended, as Parquet. Exactly once by the checkpoint."""
    out = rectified(stream, program) if mend else alerts(stream, program)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
