"""From layout blocks to processed blocks: labels, routes, review flags, formula results and the choice among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.config import DEFAULT, TEXT_ROUTE_TYPES, EngineConfig
from foliary.functions.geometry import crop_box
from foliary.functions.text import clean_ocr, strip, text_of, visible_length

# Labels of the layout model, by the block type they stand for.
LABELS = {
    "text": ["Text", "Caption", "List-item", "Table-of-contents", "Handwriting"],
    "footer": ["Footnote", "Page-footer"],
    "header": ["Page-header"],
    "formula": ["Formula", "Equation", "Text-inline-math"],
    "image": ["Picture", "Figure"],
    "title": ["Section-header", "Title"],
    "table": ["Table", "Form"],
}
# Fixed value: what a bare page number looks like.
PAGE_NUMBER = r"(?U)^[\[\(\-–—]?\s*\d{1,4}\s*[\]\)\-–—]?$"


def block_type(label: Column) -> Column:
    """Labels, also as enumeration members like Kind.PAGE_HEADER's Page_header, to types; unknown and missing ones are text."""
    known = F.create_map(*[F.lit(x) for kind, names in LABELS.items() for name in names for x in (name, kind)])
    member = F.replace(F.substring_index(label, ".", -1), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(known, label), F.try_element_at(known, member), F.lit("text"))


def route_of(kind: Column) -> Column:
    return F.when(kind.isin(TEXT_ROUTE_TYPES), "text_pipeline").when(kind == "formula", "formula_pipeline").when(kind == "table", "table_pipeline").otherwise("image_pipeline")


def enough_text(text: Column, threshold: int | None = None, config: EngineConfig = DEFAULT) -> Column:
    """Whether a page's own text will do; a threshold of 0 or none is the default one."""
    return visible_length(text) >= (threshold or config.text_threshold)


def meaningful(text: Column, threshold: int | None = None, config: EngineConfig = DEFAULT) -> Column:
    return visible_length(text) >= max(config.min_text_length, threshold or 20)


def needs_review(content: Column, confidence: Column, backend: Column | None = None, config: EngineConfig = DEFAULT) -> Column:
    """Blank, short or doubtful content; also content of another than the usual engine, where that is given."""
    t = strip(text_of(content))
    out = (t == "") | confidence.isNull() | (confidence < config.review_confidence) | (F.length(t) < config.min_text_length)
    return F.coalesce(out, F.lit(True)) | (backend != "paddleocr" if backend is not None else F.lit(False))


def page_number_text(text: Column) -> Column:
    """One to four digits with at most one bracket or dash on either side."""
    return strip(text_of(text)).rlike(PAGE_NUMBER)


def block_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s_block_%03d", prefix, number)


def routed(layout: DataFrame, page_key: list[str], prefix: Column) -> DataFrame:
    """Layout blocks numbered in reading order, with ids, routes and what layout has read of them as seeds."""
    w = Window.partitionBy(*page_key).orderBy("reading_order", "bbox.y1", "bbox.x1")
    out = layout.withColumn("n", F.row_number().over(w))
    return out.withColumn("block_id", block_id(prefix, F.col("n"))).withColumn("route_to", route_of(F.col("type"))).withColumnsRenamed({"text": "seed_text", "latex": "seed_latex"}).drop("n")


def defaulted(blocks: DataFrame, page_key: list[str], place: str) -> DataFrame:
    """Blocks of clients: missing ids by their place in what the client sent, missing routes by type."""
    n = F.row_number().over(Window.partitionBy(*page_key).orderBy(place))
    return blocks.withColumn("block_id", F.coalesce(F.nullif("block_id", F.lit("")), F.format_string("block_%03d", n))).withColumn("route_to", F.coalesce(F.nullif("route_to", F.lit("")), route_of(F.col("type"))))


def processed(blocks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Text-route blocks get content from recognition or, where that has failed (ocr_text is null), from their seeds, and
    a review flag; others pass on."""
    text, read = F.col("route_to") == "text_pipeline", F.col("ocr_text").isNotNull()
    content = F.nullif(clean_ocr(F.when(read, F.col("ocr_text")).otherwise(text_of(F.col("seed_text")))), F.lit(""))
    sure = F.when(read, F.col("ocr_confidence")).otherwise(F.coalesce("seed_confidence", F.lit(0.0)))
    backend = F.when(read, "paddleocr").otherwise("surya_seed")
    return blocks.select(
        *[c for c in blocks.columns if c not in ("content", "confidence", "needs_review", "latex", "ocr_backend")],
        F.when(text, content).alias("content"),
        F.when(text, sure).alias("confidence"),
        F.when(text, backend).otherwise("none").alias("ocr_backend"),
        F.when(text, needs_review(content, sure, backend, config)).otherwise(F.lit(False)).alias("needs_review"),
        F.when(~text, F.col("seed_latex")).alias("latex"),
    )


def embedded_block(text: Column, page_number: Column) -> Column:
    """The one block of a page with embedded text."""
    return F.struct(
        F.format_string("page_%d_embedded_text", page_number).alias("block_id"), F.lit("text").alias("type"), F.lit(1).alias("reading_order"),
        F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 0), ("y1", 0), ("x2", 1), ("y2", 1))]).alias("bbox"),
        F.lit("text_pipeline").alias("route_to"), F.nullif(clean_ocr(text), F.lit("")).alias("content"), F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_review"), F.lit("pdf_text").alias("ocr_backend"),
    )


def crop_of(config: EngineConfig, width: int, height: int) -> Column:
    """What of the page a block's model sees: formulas with a margin, texts as they are."""
    formula = (F.col("route_to") == "formula_pipeline") | (F.col("type") == "formula")
    return crop_box(F.col("bbox"), F.when(formula, config.crop_padding).otherwise(0), F.lit(width), F.lit(height))


def formula_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("route_to") == "formula_pipeline") | (F.col("type") == "formula"))


def chosen_formula(config: EngineConfig = DEFAULT) -> Column:
    """(latex, confidence, backend): a seed first, then the first engine if it is sure enough, then the second, else none."""
    seed = (F.col("seed_latex"), F.col("seed_confidence"), F.lit("surya"))
    first = (F.col("first_latex"), F.col("first_confidence"), F.lit("surya"))
    second = (F.col("second_latex"), F.lit(None).cast("double"), F.lit("pix2tex"))
    as_struct = lambda t: F.struct(*[c.alias(n) for c, n in zip(t, ("latex", "confidence", "backend"), strict=True)])
    sure = F.col("first_confidence").isNull() | (F.col("first_confidence") >= config.formula_confidence)
    none = as_struct((F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit("none")))
    return F.when(text_of(F.col("seed_latex")) != "", as_struct(seed)).when((text_of(F.col("first_latex")) != "") & sure, as_struct(first)).when(text_of(F.col("second_latex")) != "", as_struct(second)).otherwise(none)


def with_formulas(blocks: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Blocks with the last result of each id; results without latex ask for review."""
    last = results.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("attempt")))).where("n = 1")
    last = last.select(*key, F.lit(True).alias("has"), F.col("latex").alias("new_latex"), F.col("confidence").alias("new_confidence"))
    out = blocks.join(last, key, "left")
    has = F.coalesce("has", F.lit(False))
    return out.select(
        *[c for c in blocks.columns if c not in ("latex", "confidence", "needs_review")],
        F.when(has, F.col("new_latex")).otherwise(F.col("latex")).alias("latex"),
        F.coalesce("new_confidence", "confidence").alias("confidence"),
        (F.col("needs_review") | (has & F.col("new_latex").isNull())).alias("needs_review"),
    )


def best_candidate(candidates: DataFrame, key: list[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """Of each page's texts the one with most visible characters, then confidence, then priority; meaningful ones first."""
    size = visible_length(F.col("text"))
    rank = F.struct(meaningful(F.col("text"), config=config), size, F.coalesce("confidence", F.lit(0.0)), -F.col("priority"))
    return candidates.groupBy(*key).agg(F.max_by(F.struct("backend", "text", "confidence"), rank).alias("best")).select(*key, "best.*")
