"""Files that arrive, taken once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.session import shared_dir
from voxledger.sources.files import parse_segments, stem


def arriving_segments(spark: SparkSession, path: str) -> DataFrame:
    """A stream of segments of CTM files that are put into a folder."""
    lines = spark.readStream.option("pathGlobFilter", "*.ctm").text(path)
    return parse_segments(lines.select(stem(F.input_file_name()).alias("case_id"), F.col("value").alias("line")))


def take_new(stream: DataFrame, target: str, checkpoint: str | None = None) -> None:
    """Everything that arrived since the last call, appended to a Parquet table; each file once, whatever fails in between."""
    place = checkpoint or f"{shared_dir(stream.sparkSession)}/ingest"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", place).trigger(availableNow=True).start(target)
    query.awaitTermination()
