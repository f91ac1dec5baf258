"""Pages as a stream: each micro-batch of requests runs the same plan, since a page holds all that it needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

REQUESTS = "page_id long, engine string, lines array<string>, input_json string, page_width int, page_height int"


def requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON request files of a folder, as they come."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write the responses of each batch under its own folder, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
