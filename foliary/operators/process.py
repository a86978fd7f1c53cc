"""From pages to content and articles in one of the processing modes, with recognition behind backends.

The mode is known when the plan is built, so a plan holds only what its mode needs: text_only never looks at layout and
gives no articles; full and no_preprocessing recognise layout, and give the same content, because preprocessing is for
display. What fails on a page is an error in its row of contents, and other pages go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.backends import Backend, built, identity, once, text_only_pages
from foliary.config import DEFAULT, PROCESSING_MODES, EngineConfig
from foliary.functions.geometry import clamp
from foliary.operators import layout, pages, routing, segment
from foliary.schemas import box

KEY = ["document_id", "page_number"]
FOUND = "document_id string, page_number int, place int, label string, x1 int, y1 int, x2 int, y2 int, confidence double, text string, latex string, error string"


class LayoutBackend(Protocol):
    def blocks(self, image: bytes) -> list[dict]:
        """Blocks of a page image: label, box of four numbers, confidence, text, latex."""

    def crop(self, image: bytes, box: tuple[int, int, int, int]) -> bytes:
        """The part of a page image within a box."""


class LineLayout:
    """A deterministic stand-in: every line of the text that the image column holds is a text block; the first a title."""

    def blocks(self, image: bytes) -> list[dict]:
        lines = image.decode("utf-8").split("\n")
        return [{"label": "Text" if i else "Title", "box": (50, 40 + 60 * i, 950, 80 + 60 * i), "confidence": 0.9, "text": x, "latex": None} for i, x in enumerate(lines)]

    def crop(self, image: bytes, box: tuple[int, int, int, int]) -> bytes:
        first, last = (box[1] - 40) // 60, (box[3] - 80) // 60
        return "\n".join(image.decode("utf-8").split("\n")[first : last + 1]).encode()


def found_blocks(images: DataFrame, make: Callable[[], LayoutBackend]) -> DataFrame:
    """FOUND of images (document_id, page_number, image). A page that fails is one row with its error."""
    of = identity(make)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = built(make, of)
        names = [c.split()[0] for c in FOUND.split(", ")]
        for b in batches:
            rows = []
            for d, n, image in zip(b["document_id"], b["page_number"], b["image"], strict=True):
                try:
                    rows += [(d, n, i, x["label"], *x["box"], x["confidence"], x["text"], x["latex"], None) for i, x in enumerate(backend.blocks(bytes(image)), 1)]
                except Exception as e:  # recorded on the page, like any failure of a model
                    rows.append((d, n, 0, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("place", "x1", "y1", "x2", "y2")})

    return images.select(*KEY, "image").mapInPandas(run, FOUND)


def read_blocks(blocks: DataFrame, images: DataFrame, layouts: Callable[[], LayoutBackend], ocr: Callable[[], Backend]) -> DataFrame:
    """(document_id, page_number, block_id, text, confidence) of blocks, whose parts of the page image the model reads.
    A page image meets the boxes of its page once; where the model fails on a page, text is null."""
    boxes = blocks.groupBy(*KEY).agg(F.collect_list(F.struct("block_id", "bbox.*")).alias("boxes"))
    cutter, reader = identity(layouts), identity(ocr)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crop, model = built(layouts, cutter).crop, built(ocr, reader)
        for b in batches:
            for d, n, image, found in zip(b["document_id"], b["page_number"], b["image"], b["boxes"], strict=True):
                out = pd.DataFrame({"document_id": d, "page_number": n, "block_id": [x["block_id"] for x in found]})
                try:
                    parts = pd.DataFrame({"image": [crop(bytes(image), (x["x1"], x["y1"], x["x2"], x["y2"])) for x in found]})
                    yield out.join(model.predict(parts).reset_index(drop=True))
                except Exception:  # seeds stand in, and the block asks for review
                    yield out.assign(text=None, confidence=None).astype({"confidence": "float64"})

    return images.select(*KEY, "image").join(boxes, KEY).mapInPandas(run, "document_id string, page_number int, block_id string, text string, confidence double")


def layout_content(found: DataFrame, images: DataFrame, layouts: Callable[[], LayoutBackend], ocr: Callable[[], Backend], width: int, height: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """Processed blocks of found_blocks(): cleaned up, routed, the text blocks read by the model, with review flags."""
    b = found.where("error IS NULL").withColumn("bbox", clamp(box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), F.lit(width), F.lit(height))).withColumn("type", routing.block_type(F.col("label")))
    b = b.withColumn("reading_order", layout.position(F.col("place"), F.col("place"))).withColumn("block_id", F.format_string("%06d", "place"))
    done = layout.postprocessed(b, KEY, width, height)
    ids = routing.routed(done.drop("place"), KEY, F.format_string("page_%d", "page_number")).withColumn("seed_confidence", F.col("confidence"))
    ids = ids.withColumn("bbox", routing.crop_of(config, width, height))
    read = once(read_blocks(ids.where("route_to = 'text_pipeline'"), images, layouts, ocr)).withColumnsRenamed({"text": "ocr_text", "confidence": "ocr_confidence"})
    return routing.processed(ids.drop("confidence").join(read, [*KEY, "block_id"], "left"), config)


def process(source: DataFrame, mode: str, ocr: Callable[[], Backend], layouts: Callable[[], LayoutBackend], width: int = 1000, height: int = 1400, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame | None]:
    """(contents, articles) of pages (document_id, page_number, text, image); no articles in text_only mode.

    With layout, contents has a row for a page that failed, too, with nothing but its error.
    """
    if mode not in PROCESSING_MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "text_only":
        read = text_only_pages(source, ocr, KEY, config)
        return read.select(*KEY, F.col("text").alias("page_text"), routing.needs_review(F.col("text"), F.col("confidence"), config=config).alias("needs_review")), None
    found = once(found_blocks(source, layouts))
    blocks = layout_content(found, source, layouts, ocr, width, height, config)
    contents = pages.page_contents(blocks, KEY, config)
    failed = found.where("error IS NOT NULL").select(*KEY, "error")
    features = segment.page_features(blocks, KEY).join(contents.select(*KEY, "page_text"), KEY).withColumn("page_content_id", F.sha2(F.concat_ws("/", *KEY), 256))
    articles = segment.articles(segment.numbered(segment.boundaries(features, config=config)))
    return contents.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True), articles
