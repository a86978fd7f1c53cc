"""Pages to articles: where one starts, by the gap over the first text and the end of the page before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.config import DEFAULT, EngineConfig
from foliary.functions.text import PLACEHOLDER, SENTENCE_END, nonempty, split_lines, strip, sub, text_of
from foliary.operators.pages import block_text, ordered


def page_end(text: Column) -> Column:
    return sub(strip(sub(text_of(text), PLACEHOLDER)), r"(?U)\s+", " ")


def ends_sentence(text: Column) -> Column:
    """Whether a page ends like a sentence or clause; commas and colons count."""
    return page_end(text).rlike(SENTENCE_END)


def page_features(blocks: DataFrame, page_key: list[str]) -> DataFrame:
    """(page_key, page_height, first_text, first_text_y, joined_text) of pages from their blocks."""
    t = block_text(F.col("content"), F.col("latex"))
    row = F.when((F.col("type") == "text") & (t != ""), F.struct("reading_order", F.col("bbox.y1").alias("y"), F.col("bbox.x1").alias("x"), "block_id", t.alias("text")))
    out = blocks.groupBy(*page_key).agg(F.greatest(F.lit(1), F.max("bbox.y2")).alias("page_height"), F.min(row).alias("first"), F.array_join(ordered(t), "\n").alias("joined_text"))
    return out.select(*page_key, "page_height", F.col("first.text").alias("first_text"), F.col("first.y").alias("first_text_y"), "joined_text")


def boundaries(pages: DataFrame, document: str = "document_id", config: EngineConfig = DEFAULT) -> DataFrame:
    """pages (document, page_number, page_content_id, page_text, page_height, first_text, first_text_y) with what decides.

    One window over a document's pages in order; missing page numbers come last. The page before is the one before in the
    table, not page_number - 1.
    """
    w = Window.partitionBy(document).orderBy(F.coalesce("page_number", F.lit(1_000_000_000)), "page_content_id")
    ratio = F.coalesce(F.col("first_text_y") / F.greatest(F.lit(1), F.col("page_height")), F.lit(0.0))
    out = pages.withColumn("n", F.row_number().over(w)).withColumn("prev_text", F.lag("page_text").over(w)).withColumn("ratio", ratio)
    first, gap = F.col("n") == 1, F.col("ratio") >= config.top_gap_ratio
    out = out.withColumn("first_text_has_top_gap", gap).withColumn("previous_page_end_punctuation", ~first & F.coalesce(ends_sentence(F.col("prev_text")), F.lit(False)))
    punct = F.col("previous_page_end_punctuation")
    start = first | (F.col("first_text").isNotNull() & gap)
    review = ~first & (start != punct)
    decision = F.when(start & ~review, "article_start").when(start, "article_start_review").when(review, "review_boundary").otherwise("continue_article")
    score = F.when(first, 1.0).otherwise(F.when(gap, 0.75).otherwise(0.0) + F.when(punct, 0.25).otherwise(0.0))
    out = out.withColumn("is_article_start", start).withColumn("boundary_review", review).withColumn("decision", decision).withColumn("score", score).withColumn("first_text_top_gap_ratio", F.bround("ratio", 3))
    return out.drop("prev_text", "ratio")


def numbered(bounds: DataFrame, document: str = "document_id") -> DataFrame:
    """boundaries() with article_index and article_id, and the start page's title for all pages of the article."""
    w = Window.partitionBy(document).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = bounds.withColumn("article_index", F.sum(F.col("is_article_start").cast("int")).over(w))
    title = F.substring(F.coalesce(F.nullif("first_text", F.lit("")), F.get(nonempty(split_lines(F.col("page_text"))), F.lit(0)), F.lit("")), 1, 240)
    of = Window.partitionBy(document, "article_index").orderBy("n")
    return out.withColumn("article_id", F.format_string("article_%03d", "article_index")).withColumn("article_title", F.first(title).over(of))


def articles(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """One row per article: its pages, text (pages joined by blank lines) and the boundary that started it."""
    row = F.struct("n", "page_number", strip(F.col("page_text")).alias("text"))
    rows = F.array_sort(F.collect_list(row))
    g = pages.groupBy(document, "article_index", "article_id").agg(
        rows.alias("rows"), F.min_by("article_title", "n").alias("title_preview"), F.min_by("boundary_review", "n").alias("boundary_review"), F.min_by("score", "n").alias("boundary_confidence"), F.min_by("decision", "n").alias("decision")
    )
    numbers = F.filter(F.transform("rows", lambda r: r["page_number"]), lambda x: x.isNotNull())
    texts = F.filter(F.transform("rows", lambda r: r["text"]), lambda t: t != "")
    return g.select(
        document, "article_index", "article_id", F.coalesce(F.get(numbers, F.lit(0)), "article_index").alias("start_page"), F.coalesce(F.try_element_at(numbers, F.lit(-1)), "article_index").alias("end_page"),
        numbers.alias("page_numbers"), "title_preview", "boundary_review", "boundary_confidence", "decision", strip(F.array_join(texts, "\n\n")).alias("article_text"),
    )


def segmentation_summary(pages: DataFrame, document: str = "document_id") -> DataFrame:
    return pages.groupBy(document).agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("is_article_start").alias("article_count"), F.count_if("boundary_review").alias("needs_review_count"))
