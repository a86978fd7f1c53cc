"""Spark types of the document model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BBOX = "struct<x1:int,y1:int,x2:int,y2:int>"
LAYOUT_BLOCK = f"struct<type:string,bbox:{BBOX},confidence:double,reading_order:int,text:string,latex:string>"
ROUTED_BLOCK = f"struct<block_id:string,type:string,reading_order:int,bbox:{BBOX},route_to:string,seed_text:string,seed_confidence:double,seed_latex:string>"
FORMULA_RESULT = "struct<latex:string,confidence:double>"
PROCESSED_BLOCK = (
    f"struct<block_id:string,type:string,reading_order:int,bbox:{BBOX},route_to:string,content:string,confidence:double,"
    f"needs_review:boolean,latex:string,formula_result:{FORMULA_RESULT},formula_backend:string,ocr_backend:string>"
)
BOUNDARY = (
    "struct<page_number:int,is_article_start:boolean,score:double,needs_review:boolean,debug_info:struct<first_text_has_top_gap:boolean,"
    "first_text_top_gap_ratio:double,previous_page_end_punctuation:boolean,decision:string,final_score:double>>"
)
REFERENCE = "struct<raw_text:string,authors:array<string>,title:string,year:int>"
METADATA = (
    "struct<title:string,authors:array<string>,language:string,year:int,abstract:string,keywords:array<string>,"
    f"references:array<{REFERENCE}>,needs_review:boolean,field_sources:map<string,string>,confidence:map<string,double>>"
)
CONTENT_BLOCKS = f"array<struct<block_id:string,type:string,reading_order:int,bbox:{BBOX},content:string,latex:string>>"
_LATEX_METADATA = "struct<title:string,author:string,documentclass:string>"
#: An article as a client sends it, with what its pages, blocks and metadata hold.
ARTICLE_CONTENT = (
    f"struct<title:string,author:string,article_text:string,structured_content:{CONTENT_BLOCKS},blocks:{CONTENT_BLOCKS},"
    f"pages:array<struct<page_number:int,page_content_id:string,page_text:string,readable_text:string,blocks:{CONTENT_BLOCKS}>>,"
    f"metadata:{_LATEX_METADATA},request:{_LATEX_METADATA},article_metadata:struct<title:string,authors:array<string>>>"
)
#: Blocks as a client sends them: bbox is an array of four numbers.
BLOCK_PAYLOAD = "array<struct<block_id:string,type:string,reading_order:int,bbox:array<int>,route_to:string,content:string,latex:string,confidence:double>>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def valid_block(block: Column) -> Column:
    """Whether a block payload keeps the model's constraints: known type, order from 1 on, four coordinates, confidence in [0, 1]."""
    from foliary.config import BLOCK_TYPES

    known = block["type"].isin(BLOCK_TYPES) & (block["reading_order"] >= 1) & (F.size(block["bbox"]) == 4)
    return F.coalesce(known, F.lit(False)) & F.coalesce(block["confidence"].between(0, 1), F.lit(True))
