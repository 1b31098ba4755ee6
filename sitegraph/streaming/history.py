"""Link history, job status and records as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitegraph.operators.report import fetch_counts
from sitegraph.streaming.keyed import link_state_stream, link_states, read_states, revisit_stream

__all__ = ["link_state_stream", "link_states", "read_states", "revisit_stream", "status_stream", "write_products_stream"]


def status_stream(events: DataFrame, every: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """Starts, successes and failures per window while the job runs."""
    return fetch_counts(events.withWatermark("ts", late), every)


def write_products_stream(products: DataFrame, path: str, checkpoint: str):
    """Append records as JSON lines while the job runs."""
    return products.writeStream.format("json").outputMode("append") \
        .option("path", path).option("checkpointLocation", checkpoint)
