"""Row-local transformations over streams of lines.

The functions are stateless, so the batch builders serve streams unchanged; sinks
append and a checkpoint makes a restart go on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(value): stripped lines of text files as they arrive, without blank ones."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(strip(F.col("value")).alias("value")).where("value <> ''")


def corpus_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of CSV files with header as they arrive."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def append_all(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write all that is there now, appended to Parquet; a second call goes on with new files only."""
    rows = transform(stream) if transform else stream
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_distinct(stream: DataFrame, path: str, checkpoint: str, column: str = "value", buckets: int = 64) -> StreamingQuery:
    """Write the values of ``column`` that the sink doesn't have yet, each once, over micro-batches and restarts.

    The sink is the only state, so nothing grows in memory: a micro-batch is made
    distinct and joined with what earlier ones wrote in the buckets that it touches.
    Each batch has folders of its own and looks at earlier batches only, so one that
    fails and runs again replaces what it wrote.
    """
    schema = f"{column} string, bucket int, batch long"

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
        new = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("bucket", bucket)
        spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket", "batch").parquet(path)  # the folder is there from the first batch on
        seen = spark.read.schema(schema).parquet(path).where(F.col("batch") < batch)
        fresh = new.join(seen, ["bucket", column], "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        fresh.select(column, "bucket", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
