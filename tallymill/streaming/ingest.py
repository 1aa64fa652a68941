"""Result files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from tallymill.schemas import RESULT_DOCUMENT
from tallymill.sources.documents import explode_results


def stream_results(
    spark: SparkSession, path: str, glob: str = "results_*.json.gz", one_per_file: bool = True, files_per_batch: int = 1000
) -> DataFrame:
    """Flat response rows of every result file that appears under ``path``."""
    documents = (
        spark.readStream.schema(RESULT_DOCUMENT)
        .option("multiLine", one_per_file)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    return explode_results(documents)


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last call to a Parquet table, then stop.

    The checkpoint folder remembers the files already taken, so each is read once.
    """
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
