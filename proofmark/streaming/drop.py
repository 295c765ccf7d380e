"""Checking texts as they arrive: a stream of recognised texts against a static batch table.

The join is stateless (stream with static side) and every check is a column expression or a
scalar Arrow function, so micro-batches need no state store; late and repeated texts are new
results, kept apart by the sink's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofmark.functions import text
from proofmark.operators import batch


def text_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def check_stream(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Result rows of streamed texts(row_id, file_name, detected_text, processing_time_s): a text
    whose name no expected row has gives none; one that several rows have gives one for each."""
    expected = rows.withColumn("_key", text.clean_cell(F.col("file_name"))).where("_key <> ''").drop("file_name", "row_id")
    side = texts.select(F.col("row_id").alias("text_id"), text.clean_cell(F.col("file_name")).alias("file_name"), "detected_text", "processing_time_s")
    joined = side.join(expected, F.col("file_name") == F.col("_key")).drop("_key").withColumn("outcome", F.lit("matched"))
    return batch.results(joined, ["text_id"])


def start(results: DataFrame, path: str, checkpoint: str) -> object:
    """Append results to a parquet folder, exactly once, processing all there is and stopping."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
