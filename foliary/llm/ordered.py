"""Documents in ascending doc_id order, in ranges that fit one task each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of a range, and the most ranges; beyond, ranges grow and stream through their task.
ROWS, MOST = 1024, 20_000


def split_points(ids: DataFrame, rows: int = ROWS, most: int = MOST) -> list[int]:
    """Values of doc_id that cut it into ranges of near equal counts; at most `most` numbers reach the driver."""
    n = ids.count()
    k = min(most, -(-n // rows))
    if k < 2:
        return []
    at = F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k)
    return sorted({x for x in ids.agg(at.alias("p")).first().p or [] if x is not None})


def constant(values: list, kind: str) -> Column:
    """An array as one literal of the plan, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def range_of(points: list[int], doc_id: Column) -> Column:
    """0 for null and what lies below the first point, else the number of points at or below doc_id, by binary search."""
    if not points:
        return F.lit(0)
    known = constant(points, "bigint")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(points).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda acc, step: F.when(F.get(known, acc + step - 1) <= doc_id, acc + step).otherwise(acc))
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(at).cast("int")
