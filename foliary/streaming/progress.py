"""Progress of page processing as a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import clean_ocr
from foliary.operators.routing import enough_text

PAGES = "document_id string, page_number int, total_pages int, text string, error string"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Pages as JSON files arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def progress_events(pages: DataFrame) -> DataFrame:
    """(value): one JSON line per page with type, message, page and what was found; errors are lines of type error."""
    found = F.struct(enough_text(F.col("text")).alias("has_text"), clean_ocr(F.col("text")).alias("text"))
    failed = F.col("error").isNotNull()
    line = F.struct(
        F.when(failed, "error").otherwise("page").alias("type"), F.when(failed, F.col("error")).otherwise(F.format_string("page %d of %d", "page_number", "total_pages")).alias("message"),
        "document_id", F.col("page_number").alias("page"), "total_pages", F.when(~failed, found).alias("data"),
    )
    return pages.select(F.to_json(line).alias("value"))


def write_progress(events: DataFrame, path: str, checkpoint: str):
    """A running query that appends the lines to text files, each once."""
    return events.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
