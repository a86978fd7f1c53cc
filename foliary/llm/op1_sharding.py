"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every key goes to the shard that owns the first virtual node clockwise of it. A shard takes no more rows than its
bound: the keys of its own arcs come first, and those beyond the bound continue clockwise to the next shard with room.
With slack 0 the bounds add up to the number of rows, so all counts are at most one apart (law `rows`), and only the
surplus over the bound leaves its own shard.

The ring has shards x vnodes arcs, whatever the data; how many rows lie on each arc is all that reaches the driver.
Ranks within an arc come from offsets of sub-buckets of about BUCKET rows and a window within each.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm.common import copies, crc32_text, cut, in_values, md5_int, table

SHARDS = 40
VNODES = 64
BUCKET = 4096
#: Positions are below 2^60; arcs are found by their first 12 bits.
SPAN, CELL = 1 << 60, 1 << 48


def position(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    return sorted((position(f"shard {s} node {v}"), s) for s in range(shards) for v in range(vnodes))


def arc_cells(nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, lo, hi, arc): positions lo <= p <= hi of a cell belong to the arc, numbered by the node at its end."""
    out, lo = [], 0
    for arc, (at, _) in [*enumerate(nodes), (0, (SPAN - 1, 0))]:
        for cell in range(lo // CELL, at // CELL + 1) if lo <= at else ():
            out.append((cell, max(lo, cell * CELL), min(at, (cell + 1) * CELL - 1), arc))
        lo = max(lo, at + 1)
    return out


def place(counts: dict[int, int], nodes: list[tuple[int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rows of each arc to shards: (arc, first rank, rank after the last, shard, first slot)."""
    room, used, out, begun = list(bounds), [0] * len(bounds), [], dict.fromkeys(counts, 0)

    def take(arc: int, shard: int) -> None:
        n = min(counts[arc] - begun[arc], room[shard])
        if n:
            out.append((arc, begun[arc], begun[arc] + n, shard, used[shard]))
            begun[arc] += n
            used[shard] += n
            room[shard] -= n

    for arc in sorted(counts):
        take(arc, nodes[arc][1])
    for arc in sorted(counts):
        step = 1
        while begun[arc] < counts[arc]:
            take(arc, nodes[(arc + step) % len(nodes)][1])
            step += 1
    return out


def bounds_of(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def ring_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs.

    size is the UTF-8 length plus 16; a null text counts as none (CRC of nothing: 0). A null doc_id is a key of its
    own. Repeated rows each get a slot: equal keys are counted before the shuffle, so a key of any weight is one row
    until its slots are dealt out, in chunks. Texts of any length count by their bytes alone. Ties on the ring are ordered by doc_id, size and CRC. An empty table gives an empty
    result; other columns are not read.
    """
    spark, nodes = docs.sparkSession, ring(shards, vnodes)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        crc32_text(F.col(text_col)).alias("text_crc32"),
    )
    keyed = cut(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    subs = max(1, -(-total[1] // (len(nodes) * BUCKET)))
    at = keyed.withColumn("p", md5_int(F.concat(F.lit("key "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))))
    cells = F.broadcast(in_values(spark, arc_cells(nodes), "cell long, lo long, hi long, arc int"))
    on = (F.floor(F.col("p") / F.lit(CELL)).cast("long") == F.col("cell")) & (F.col("p") >= F.col("lo")) & (F.col("p") <= F.col("hi"))
    at = at.join(cells, on).drop("cell", "lo", "hi").withColumn("sub", F.pmod(F.col("p"), F.lit(subs)).cast("int"))
    sums = cut(at.groupBy("arc", "sub").agg(F.sum("n").alias("rows")))
    counts = {r.arc: r["rows"] for r in sums.groupBy("arc").agg(F.sum("rows").alias("rows")).collect()}
    dealt = F.broadcast(in_values(spark, place(counts, nodes, bounds_of(total[0], shards, slack)), "arc int, first long, after long, shard int, slot0 long"))
    before = Window.partitionBy("arc").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    within = Window.partitionBy("arc", "sub").orderBy("p", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = at.withColumn("k", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["arc", "sub"])
    each = copies(ranked, "n", "copy", "p", total[2]).withColumn("k", F.col("offset") + F.col("k") + F.col("copy"))
    out = each.join(dealt, "arc").where((F.col("k") >= F.col("first")) & (F.col("k") < F.col("after")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("k") - F.col("first")).alias("slot"))


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ring_shards() over all documents by the law `rows`; null texts have size 16, an empty table gives no row."""
    out = ring_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
