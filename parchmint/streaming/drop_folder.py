"""Files as they arrive in a folder, sniffed like a batch of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchmint.functions.text import safe_display_name
from parchmint.sources.files import accepted, sniff_kind

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """path, name, length, content, kind and error of new files."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    name = safe_display_name(F.regexp_extract("path", r"[^/]*$", 0))
    return accepted(files.select("path", name.alias("name"), "length", "content", sniff_kind(F.col("content")).alias("kind")))


def ingest(files: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table and stop; a restart goes on where it ended."""
    return files.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
