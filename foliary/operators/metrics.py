"""Summaries and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_summary(pages: DataFrame, key: list[str]) -> DataFrame:
    """pages: has_text, layout_error, content_error (null: fine) and layout_done, content_done per page."""
    n = F.count_if
    return pages.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_pages"), n("has_text").alias("with_text"), n(~F.col("has_text")).alias("for_ocr"), n("layout_done").alias("layout_ok"), n(F.col("layout_error").isNotNull()).alias("layout_error_count"),
        n("content_done").alias("content_ok"), n(F.col("content_error").isNotNull()).alias("content_error_count"),
    )


def average_confidence(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Mean with missing values as 0, three decimals."""
    return blocks.groupBy(*key).agg((F.rint(F.sum(F.coalesce("confidence", F.lit(0.0))) / F.greatest(F.lit(1), F.count(F.lit(1))) * 1000) / 1000).alias("average_confidence"))


def clamped_mean(c: Column) -> Column:
    """Aggregate: the mean within 0 and 1, missing values left out; 0 without any."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.avg(c), F.lit(0.0))))


def quality(rows: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Confusion counts, precision, recall and F1; a ratio without cases is 0."""
    p, a = F.col(predicted), F.col(actual)
    c = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
