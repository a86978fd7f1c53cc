"""Sources: files, uploads, JSON payloads; lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import strip
from foliary.schemas import BLOCK_PAYLOAD, valid_block


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(document_id, path, content, error): files that do not begin like a PDF carry an error and no job fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    bad = F.substring("content", 1, 5) != F.lit(b"%PDF-")
    return files.select(F.sha2("path", 256).alias("document_id"), "path", "content", F.when(F.col("length") == 0, "empty").when(bad, "invalid_pdf").alias("error"))


def text_pages(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """(document_id, page_number, text) of documents whose pages' texts are an array; numbers from 1, texts stripped."""
    return documents.select("document_id", F.posexplode(pages).alias("p", "text")).select("document_id", (F.col("p") + 1).alias("page_number"), strip(F.coalesce("text", F.lit(""))).alias("text"))


def upload_error(name: Column, content_type: Column, size: Column, kind: str = "pdf") -> Column:
    """Why an upload is refused, null if it is not: empty, or neither suffix nor type fit."""
    fits = content_type.startswith("image/") if kind == "image" else F.lower(name).endswith(".pdf") | (content_type == "application/pdf")
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(~F.coalesce(fits, F.lit(False)), "unsupported_type")


def quarantined(uploads: DataFrame, kind: str = "pdf") -> tuple[DataFrame, DataFrame]:
    """Uploads that pass, and those refused with their error."""
    marked = uploads.withColumn("error", upload_error(F.col("name"), F.col("content_type"), F.col("size"), kind))
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def parsed_blocks(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """(key, place, block, error) of JSON arrays of blocks; what is no array gives one row with an error."""
    parsed = payloads.select(key, F.col(column).rlike(r"(?s)^\s*\[").alias("listed"), F.from_json(column, BLOCK_PAYLOAD, {"mode": "PERMISSIVE"}).alias("b"))
    each = parsed.select(key, "listed", F.posexplode_outer("b").alias("place", "block"))
    error = F.when(~F.coalesce("listed", F.lit(False)), "not_an_array").when(F.col("block").isNotNull() & ~valid_block(F.col("block")), "invalid_block")
    return each.select(key, "place", "block", error.alias("error"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def lookup(table: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of one id; none if it is not there."""
    return table.where(F.col(column) == F.lit(value))
