"""Sinks: tables by document, JSON, the catalog and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, path: str, document: str = "document_id") -> None:
    """Parquet by document, so that later reads prune to the documents they ask for; the last stage overwrites its documents."""
    pages.repartition(document).write.partitionBy(document).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_pages(spark, path: str) -> DataFrame:
    """Pages with the file each row comes from."""
    return spark.read.parquet(path).withColumn("result_path", F.col("_metadata.file_path"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Semicolon-separated files with a header; csv_text() gives the same as text where line ends matter."""
    catalog.write.mode("overwrite").option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def latest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n last rows by a column: a bounded cache as a query."""
    return rows.orderBy(F.desc(order)).limit(n)
