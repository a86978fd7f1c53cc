"""Page and block tables derived from the driver's test tables; integer arithmetic, so every engine derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.operators.routing import route_of
from foliary.schemas import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a document; its rows by doc_id are the pages."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"), number.alias("page_number"), F.col("doc_id").cast("string").alias("page_content_id"), "text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per line of a page of 1000 x 1400, with type, box and confidence from its place."""
    lines = doc_pages(spark, sf_dir).select("doc_id", "document_id", "page_number", "page_content_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    d, p = F.col("doc_id"), F.col("pos")
    m = (d * 31 + p * 7) % 20
    kind = F.when(m == 0, "formula").when(m == 1, "table").when(m == 2, "image").when(m == 3, "header").when(m == 4, "footer").when(m == 5, "title").otherwise("text")
    y1 = 40 + (d % 5) * 45 + p * 60
    bbox = box(50 + (p % 2) * 20, y1, 950 - (p % 3) * 30, y1 + 40)
    out = lines.withColumn("type", kind).withColumn("bbox", bbox).withColumn("confidence", ((d * 37 + p * 11) % 101) / 100.0)
    out = out.withColumn("reading_order", p + 1).withColumn("block_id", F.format_string("page_%d_block_%03d", "page_number", p + 1))
    return out.withColumn("route_to", route_of(F.col("type")))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two half-width lines per block; the second hangs lower, so some lie outside."""
    b = blocks(spark, sf_dir)
    x1, y1, x2, y2 = (F.col(f"bbox.{c}") for c in ("x1", "y1", "x2", "y2"))
    mid, drop = F.floor((x1 + x2) / 2), (F.col("doc_id") % 4) * 15
    halves = F.array(F.struct(F.lit(0).alias("half"), box(x1, y1, mid, y2).alias("box")), F.struct(F.lit(1).alias("half"), box(mid, y1 + drop, x2, y2 + drop).alias("box")))
    one = b.select("document_id", "page_number", (F.col("pos") * 2).alias("l0"), F.explode(halves).alias("h"))
    no = F.col("l0") + F.col("h.half")
    return one.select("document_id", "page_number", no.alias("line_no"), F.concat(F.lit("line "), no.cast("string")).alias("text"), F.col("h.box").alias("bbox"))


def formula_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per formula block, and a second, later one for every seventh page."""
    b = blocks(spark, sf_dir).where("type = 'formula'")
    latex = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("x_{"), F.col("pos").cast("string"), F.lit("}")))
    one = b.select("document_id", "block_id", "doc_id", latex.alias("latex"), (((F.col("doc_id") + F.col("pos")) % 10) / 10.0).alias("confidence"), F.lit(0).alias("attempt"))
    again = one.where("doc_id % 7 = 0").withColumn("latex", F.lit("y")).withColumn("attempt", F.lit(1))
    return one.unionByName(again).drop("doc_id")


def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates per page: a cut-off block text, the page, and the cleaned page, in order of priority."""
    from foliary.functions.text import clean_ocr

    p = doc_pages(spark, sf_dir)
    score = lambda k: ((F.col("doc_id") * k) % 101) / 100.0
    found = F.array(
        F.struct(F.lit(1).alias("priority"), F.lit("primary").alias("backend"), F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 60).cast("int")).alias("text"), score(7).alias("confidence")),
        F.struct(F.lit(2).alias("priority"), F.lit("page").alias("backend"), F.col("text").alias("text"), score(11).alias("confidence")),
        F.struct(F.lit(3).alias("priority"), F.lit("embedded").alias("backend"), clean_ocr(F.col("text")).alias("text"), F.lit(1.0).alias("confidence")),
    )
    return p.select("document_id", "page_number", F.explode(found).alias("c")).select("document_id", "page_number", "c.*")
