"""Layout of a page: lines to blocks, small blocks out, page numbers, merging, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import geometry as g
from foliary.operators.routing import page_number_text

MERGEABLE = ["text", "title", "header", "footer"]
SMALL_TYPES = ["formula", "page_number"]
# Shares of the page.
LEAST_AREA, LEAST_SMALL_AREA = 0.00045, 0.00018
TOP_EDGE, BOTTOM_EDGE = 0.14, 0.86
MERGE_OVERLAP, MERGE_GAP, MERGE_GAP_SHARE = 0.55, 18, 0.012


def lines_to_blocks(blocks: DataFrame, lines: DataFrame, page_key: list[str], block_key: str) -> DataFrame:
    """Each block with the text of its lines by place, null without any: (page_key, block_key, n_lines, text).

    A line belongs to a block if its centre lies inside, or half of its area. The pages' keys make it a hash join with
    the geometry as a residual condition; a line may belong to several blocks.
    """
    a, b = blocks.select(*page_key, block_key, "bbox").alias("a"), lines.select(*page_key, "line_no", F.col("text").alias("line"), F.col("bbox").alias("line_box")).alias("b")
    box, line = F.col("bbox"), F.col("line_box")
    inside = g.center_inside(line, box) | (g.intersection(line, box) >= 0.5 * g.area(line))
    on = inside
    for k in page_key:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    joined = a.join(b, on, "left").select(*[F.col(f"a.{k}").alias(k) for k in page_key], block_key, "line_box", "line_no", "line")
    row = F.when(F.col("line").isNotNull(), F.struct(F.col("line_box.y1").alias("y"), F.col("line_box.x1").alias("x"), "line_no", "line"))
    found = joined.groupBy(*page_key, block_key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return found.select(*page_key, block_key, F.size("rows").cast("long").alias("n_lines"), text.alias("text"))


def visible_lines(lines: DataFrame) -> DataFrame:
    return lines.where((F.trim("text") != "") & (g.area(F.col("bbox")) > 0))


def large_enough(kind: Column, bbox: Column, width: int, height: int) -> Column:
    page = width * height
    return g.area(bbox) >= F.when(kind.isin(SMALL_TYPES), int(page * LEAST_SMALL_AREA)).otherwise(int(page * LEAST_AREA))


def with_page_numbers(kind: Column, text: Column, bbox: Column, height: int) -> Column:
    """The type, page_number for a bare number near the upper or lower edge."""
    edge = (bbox["y2"] < int(height * TOP_EDGE)) | (bbox["y1"] > int(height * BOTTOM_EDGE))
    return F.when(page_number_text(text) & edge, F.lit("page_number")).otherwise(kind)


def position(given: Column, place: Column) -> Column:
    """The model's position from 1 on, or the place in its list: 0 counts as none."""
    return F.greatest(F.lit(1), F.coalesce(F.nullif(given, F.lit(0)), place))


def renumbered(blocks: DataFrame, page_key: list[str], tie: str) -> DataFrame:
    """reading_order 1, 2, ... by order, place and, last, the tie column; a missing order comes last."""
    w = Window.partitionBy(*page_key).orderBy(F.coalesce("reading_order", F.lit(1_000_000_000)), "bbox.y1", "bbox.x1", tie)
    return blocks.withColumn("reading_order", F.row_number().over(w))


def _joined(a: Column, b: Column) -> Column:
    return F.nullif(F.concat_ws("\n", F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))), F.lit(""))


def merged(blocks: DataFrame, page_key: list[str], height: int) -> DataFrame:
    """Pages' blocks (an array `blocks`) after merging neighbours in reading order.

    A block joins the last merged one if both are of one mergeable type, overlap horizontally and lie close; it is compared
    with the union so far, so this is a fold over the page and not a comparison of neighbours.
    """
    gap = max(MERGE_GAP, int(height * MERGE_GAP_SHARE))
    row = F.struct("reading_order", F.col("bbox.y1").alias("y"), F.col("bbox.x1").alias("x"), "block_id", "type", "bbox", "confidence", "text", "latex")
    kind = "array<struct<type:string,bbox:struct<x1:int,y1:int,x2:int,y2:int>,confidence:double,reading_order:int,text:string,latex:string>>"

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (last["type"] == b["type"]) & b["type"].isin(MERGEABLE) & (g.horizontal_overlap(last["bbox"], b["bbox"]) >= MERGE_OVERLAP) & (g.vertical_gap(last["bbox"], b["bbox"]) <= gap)
        both = F.struct(
            last["type"].alias("type"), g.union(last["bbox"], b["bbox"]).alias("bbox"), F.greatest(last["confidence"], b["confidence"]).alias("confidence"),
            F.least(last["reading_order"], b["reading_order"]).alias("reading_order"), _joined(last["text"], b["text"]).alias("text"), _joined(last["latex"], b["latex"]).alias("latex"),
        )
        own = F.struct(*[b[c].alias(c) for c in ("type", "bbox", "confidence", "reading_order", "text", "latex")])
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(own))).cast(kind)

    pages = blocks.groupBy(*page_key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return pages.select(*page_key, F.aggregate("rows", F.array().cast(kind), step).alias("blocks"))


def postprocessed(blocks: DataFrame, page_key: list[str], width: int, height: int) -> DataFrame:
    """The whole of it: small blocks out, page numbers marked, neighbours merged, order renumbered."""
    kept = blocks.where(large_enough(F.col("type"), F.col("bbox"), width, height)).withColumn("type", with_page_numbers(F.col("type"), F.col("text"), F.col("bbox"), height))
    pages = merged(kept, page_key, height)
    return renumbered(pages.select(*page_key, F.posexplode("blocks").alias("place", "b")).select(*page_key, "place", "b.*"), page_key, "place")
