"""What recognition models answer, as JSON of their result objects, turned into text and confidence.

A backend whose model speaks one of these shapes writes the answer down as it is; the rules stay in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.geometry import area, clamp, from_points
from foliary.functions.text import filled, first_of, let, strip, text_of

POINTS = "array<array<double>>"
_LINE = "struct<text:string,confidence:double,score:double,bbox:string,polygon:string>"
RESULT = f"struct<rec_texts:array<string>,rec_scores:array<double>,text_lines:array<{_LINE}>,lines:array<{_LINE}>,text:string,confidence:double,score:double,avg_score:double,avg_prob:double>"
#: The older shape of a text model: a list of [box, [text, score]], or a list holding that list.
PAIRS = "array<array<string>>"
READING = "struct<text:string,confidence:double>"


def within_unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def mean(scores: Column) -> Column:
    """Mean of an array without its nulls; null without any."""
    return let(F.array_compact(scores), lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


def reading(texts: Column, scores: Column) -> Column:
    """(text, confidence): texts that are not blank, a line each; of the scores as many as there are such texts count."""
    kept = F.filter(F.transform(texts, lambda x: strip(text_of(x))), lambda x: x != "")
    score = lambda k: within_unit(F.coalesce(mean(F.slice(F.coalesce(scores, F.array().cast("array<double>")), 1, F.size(k))), F.lit(0.0)))
    return let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), score(k).alias("confidence")))


def text_reading(answer: Column) -> Column:
    """READING of a text model's answer in either shape; empty with confidence 0 if it has neither."""
    new = F.from_json(answer, RESULT)
    outer = F.from_json(answer, PAIRS)
    nested = F.from_json(F.get(F.from_json(answer, "array<string>"), F.lit(0)), PAIRS)
    pairs_of = lambda rows: F.filter(F.transform(rows, lambda r: F.from_json(F.get(r, F.lit(1)), "array<string>")), lambda p: p.isNotNull() & (F.size(p) >= 2))
    inner = pairs_of(nested)
    pairs = F.when(F.size(inner) > 0, inner).otherwise(F.coalesce(pairs_of(outer), F.array().cast("array<array<string>>")))
    old = let(pairs, lambda p: reading(F.transform(p, lambda x: x[0]), F.transform(p, lambda x: F.coalesce(x[1].try_cast("double"), F.lit(0.0)))))
    known = new["rec_texts"].isNotNull()
    return F.when(known, reading(new["rec_texts"], F.transform(new["rec_scores"], lambda x: F.coalesce(x, F.lit(0.0))))).otherwise(old)


def lines_of(answer: Column) -> Column:
    found = F.from_json(answer, RESULT)
    return F.coalesce(found["text_lines"], found["lines"], F.array().cast(f"array<{_LINE}>"))


def page_lines(answer: Column, width: int, height: int) -> Column:
    """Array of (text, bbox, confidence) of a page model's lines; blank ones are left out, boxes are within the page."""
    flat = lambda x: F.coalesce(F.from_json(x, POINTS), F.array(F.from_json(x, "array<double>")))
    bbox = lambda x: clamp(from_points(flat(F.coalesce(x["bbox"], x["polygon"]))), F.lit(width), F.lit(height))
    made = F.transform(lines_of(answer), lambda x: F.struct(strip(text_of(x["text"])).alias("text"), bbox(x).alias("bbox"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence")))
    return F.filter(made, lambda x: (x["text"] != "") & (area(x["bbox"]) > 0))


def page_reading(answer: Column, width: int, height: int) -> Column:
    """READING of a whole page: its lines from top to bottom and left to right, and their mean confidence."""
    rank = F.transform(page_lines(answer, width, height), lambda x, i: F.struct(x["bbox"]["y1"].alias("y"), x["bbox"]["x1"].alias("x"), i.alias("i"), x.alias("line")))
    lines = F.transform(F.array_sort(rank), lambda r: r["line"])
    score = lambda v: within_unit(F.coalesce(mean(F.transform(v, lambda x: x["confidence"])), F.lit(0.0)))
    return let(lines, lambda v: F.struct(strip(F.array_join(F.transform(v, lambda x: x["text"]), "\n")).alias("text"), score(v).alias("confidence")))


def formula_reading(answer: Column) -> Column:
    """READING of a formula: its lines, else its text; its own confidence, else the mean of its lines', else null."""
    found, lines = F.from_json(answer, RESULT), lines_of(answer)
    joined = F.array_join(F.filter(F.transform(lines, lambda x: strip(text_of(x["text"]))), lambda x: x != ""), "\n")
    text = F.when(F.size(lines) > 0, joined).otherwise(strip(first_of(found["text"])))
    direct = F.coalesce(found["confidence"], found["score"], found["avg_score"], found["avg_prob"])
    sure = F.coalesce(direct, mean(F.transform(lines, lambda x: F.coalesce(x["confidence"], x["score"]))))
    return F.struct(filled(text).alias("text"), F.when(sure.isNotNull(), within_unit(sure)).alias("confidence"))
