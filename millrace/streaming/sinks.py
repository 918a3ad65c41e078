"""Running a stream over all that is there and reading its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from millrace.session import shared_folder


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over its available input into Parquet in the shared folder (spark.checkpoint.dir), and read it."""
    return stream.sparkSession.read.schema(stream.schema).parquet(run_into_folder(stream, mode))


def run_into_folder(stream: DataFrame, mode: str = "append") -> str:
    """As `run_available`, but for the folder of the result, which another stream can read."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    running = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return f"{base}/out"
