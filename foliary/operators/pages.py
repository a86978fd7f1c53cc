"""Content of pages: their text, readable text, LaTeX and review counts from blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.config import DEFAULT, TEXT_ROUTE_TYPES, TEXTUAL_TYPES, EngineConfig
from foliary.functions.latex import clean_latex, compare_key, latex_document, preview_text, text_to_latex
from foliary.functions.text import first_of, strip, text_of

#: The order of blocks on a page.
ORDER = ["reading_order", "bbox.y1", "bbox.x1", "block_id"]


def ordered(part: Column) -> Column:
    """Aggregate: non-empty parts of a group's blocks, in their order."""
    row = F.when(text_of(part) != "", F.struct(F.col("reading_order"), F.col("bbox.y1").alias("y"), F.col("bbox.x1").alias("x"), F.col("block_id"), part.alias("part")))
    return F.transform(F.array_sort(F.collect_list(row)), lambda r: r["part"])


def block_text(content: Column, latex: Column) -> Column:
    return strip(first_of(content, latex))


def text_part(config: EngineConfig = DEFAULT) -> Column:
    return F.when((F.col("route_to") == "text_pipeline") & (text_of(F.col("content")) != ""), F.col("content")).when(F.col("type") == "formula", F.lit(config.formula_placeholder))


def readable_part(config: EngineConfig = DEFAULT) -> Column:
    return (
        F.when(F.col("type").isin(TEXT_ROUTE_TYPES) & (text_of(F.col("content")) != ""), F.col("content"))
        .when(F.col("type") == "formula", F.lit(config.formula_placeholder))
        .when(F.col("type") == "table", F.lit("[TABLE]"))
        .when(F.col("type") == "image", F.lit("[IMAGE]"))
    )


def latex_part(skip_texts: Column | None = None) -> Column:
    """A block in LaTeX; comments stand for tables, images and formulas without latex."""
    textual = F.col("type").isin(TEXTUAL_TYPES) & (text_of(F.col("content")) != "")
    formula = clean_latex(first_of(F.col("latex"), F.col("formula_latex")))
    todo = lambda kind: F.concat(F.lit(f"% TODO: {kind} "), F.col("block_id"))
    body = text_to_latex(F.col("content"))
    if skip_texts is not None:
        body = F.when(F.array_contains(skip_texts, compare_key(F.col("content"))), F.lit("")).otherwise(body)
    return (
        F.when(textual, body)
        .when(F.col("type") == "formula", F.when(formula != "", F.concat(F.lit("\\[\n"), formula, F.lit("\n\\]"))).otherwise(todo("FORMULA")))
        .when(F.col("type") == "table", todo("TABLE"))
        .when(F.col("type") == "image", todo("IMAGE"))
    )


def latex_review() -> Column:
    """A block's own flag, or a formula without latex."""
    missing = (F.col("type") == "formula") & (clean_latex(first_of(F.col("latex"), F.col("formula_latex"))) == "")
    return F.col("needs_review") | missing


def page_contents(blocks: DataFrame, page_key: list[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """One aggregation of a page's blocks to page_text, readable_text, latex_body, latex_document and review counts."""
    if "formula_latex" not in blocks.columns:
        blocks = blocks.withColumn("formula_latex", F.lit(None).cast("string"))
    out = blocks.groupBy(*page_key).agg(
        strip(F.array_join(ordered(text_part(config)), "\n")).alias("page_text"),
        preview_text(F.array_join(ordered(readable_part(config)), "\n\n")).alias("readable_text"),
        strip(F.array_join(ordered(latex_part()), "\n\n")).alias("latex_body"),
        F.count_if("needs_review").alias("needs_review_count"),
        F.bool_or(latex_review()).alias("latex_needs_review"),
        F.greatest(F.lit(1), F.max("bbox.y2")).alias("page_height"),
        F.count(F.lit(1)).alias("n_blocks"),
    )
    return out.withColumn("latex_document", latex_document(F.col("latex_body")))


def page_text_of(page_text: Column, readable: Column, joined: Column) -> Column:
    """Which text stands for a page: its own, the readable one, or its blocks'."""
    return first_of(page_text, readable, joined)


def readable_text_of(page_text: Column, readable: Column, joined: Column) -> Column:
    """The text to read: the readable one where there is one."""
    return strip(first_of(readable, page_text_of(page_text, readable, joined)))


def shown_text_of(page_text: Column, readable: Column, embedded: Column) -> Column:
    """The text that a reader is shown, down to what the file itself holds."""
    return strip(first_of(readable, page_text, embedded))
