"""Connected components by alternating large-star and small-star steps in joins and aggregations; few edges by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import cut

#: Edges, of 16 bytes, that one task connects by itself: a round of joins costs a task per partition and exchange, however few
#: the edges are. More edges are connected by joins.
ALONE = 1 << 18


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) to (u, v): each vertex but the smallest of a component, with that smallest."""
    below: dict[int, int] = {}

    def least(x: int) -> int:
        while (y := below.get(x, x)) != x:
            below[x] = x = below.get(y, y)
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            u, v = least(u), least(v)
            if u != v:
                below[max(u, v)] = min(u, v)
    yield pd.DataFrame({"u": list(below), "v": [least(x) for x in list(below)]}, dtype="int64")


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """Edges (a, b) of long vertices to (u, v): each vertex that has an edge to another one, except the smallest of
    its component, with that smallest vertex.

    Self-loops, repeated edges and an empty table are allowed; a null end makes an edge void. The number of rounds
    grows with the logarithm of the longest path; every round is cut through the shared folder. At most `alone` distinct
    edges are connected by one task.
    """
    e = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _state(e)
    if before[0] <= alone:
        return cut(e.coalesce(1).mapInPandas(_union_find, "u long, v long"))
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
        now = _state(e)
        if now == before:
            return e
        before = now
