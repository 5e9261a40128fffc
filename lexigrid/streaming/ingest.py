"""Papers that arrive as files: each id once, counted by venue and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landing(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, key: str = "paper_id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once within the time that lateness allows; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, by: str, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by window and group, final once the watermark has passed the window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what there is now to a Parquet folder, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
