"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

The documents of a source, in seeded order, are one stream of words, cut into blocks of BLOCK words. Blocks are
allotted to sources by the highest quotients target / (2 k + 1); the allotment is continued shard by shard, so every
shard has integer quotas and the quotas of all shards add up to the apportionment of the whole mix. The p-th pick of a
source with n blocks is the block that a seeded permutation of 0 .. n-1 puts at p mod n. No block is picked more than
REPEATS times, so no document is.

What reaches the driver is one row per source. The stream positions come from sums of sub-buckets of about BUCKET
documents and a window within each, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import heapq
import json
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm.common import copies, cut, md5_int, table

BLOCK = 16
SHARDS = 8
SEED = 7
REPEATS = 3
WEIGHTS = (1, 2, 3)
BUCKET = 1024
#: The plan of so many sources is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of all sizes by weight; what exceeds repeats x size is shared again among the others."""
    rest, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] > repeats * sizes[i] * w}
        for i in over or open_:
            out[i] = float(repeats * sizes[i]) if over else rest * weights[i] / w
        rest -= sum(repeats * sizes[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def sainte_lague(target: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients target / (2 k + 1), ties to the earlier source; source i gets most[i] at most."""
    total = sum(target)
    got = [min(m, int(t * seats / total + 0.5)) if total else 0 for t, m in zip(target, most, strict=True)]
    more = [(-t / (2 * g + 1), i) for i, (t, g, m) in enumerate(zip(target, got, most, strict=True)) if t and g < m]
    heapq.heapify(more)
    have = sum(got)
    while have < seats and more:
        i = heapq.heappop(more)[1]
        got[i] += 1
        have += 1
        if got[i] < most[i]:
            heapq.heappush(more, (-target[i] / (2 * got[i] + 1), i))
    less = [(target[i] / (2 * g - 1), -i) for i, g in enumerate(got) if g]
    heapq.heapify(less)
    while have > seats:
        i = -heapq.heappop(less)[1]
        got[i] -= 1
        have -= 1
        if got[i]:
            heapq.heappush(less, (target[i] / (2 * got[i] - 1), -i))
    return got


def plan(sizes: dict[str | None, int], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[dict]:
    """One row per source: target, number of blocks, cumulative quotas by shard, and its permutation a * j + b mod n."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    size = [sizes[s] for s in names]
    target = targets(size, [weights[i % len(weights)] for i in range(len(names))], repeats)
    blocks = [-(-s // block) for s in size]
    seats = (sum(size) + block // 2) // block
    quotas = [sainte_lague(target, seats * (j + 1) // shards, [repeats * n for n in blocks]) for j in range(shards)]
    out = []
    for i, s in enumerate(names):
        n = max(1, blocks[i])
        a = (seed * 7919 + 104729 * (i + 1)) % min(n, 1 << 23) + 1
        while gcd(a, n) > 1:
            a += 1
        out.append({"source": s, "source_size": size[i], "target": target[i], "blocks": n, "a": a, "b": (seed * 15485863 + 32452843 * i) % n, "quota": [q[i] for q in quotas]})
    return out


PLAN_SCHEMA = "array<struct<source:string,source_size:bigint,target:double,blocks:bigint,a:bigint,b:bigint,quota:array<bigint>>>"


def streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, **how) -> DataFrame:
    """Every document with its size, its first word's place in its source's stream, and its source's plan."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    keyed = cut(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    count, most = keyed.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    subs = max(1, -(-count // BUCKET))
    h = md5_int(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    keyed = keyed.withColumn("h", h).withColumn("sub", F.pmod("h", F.lit(subs)).cast("int"))
    sums = cut(keyed.groupBy("source", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("words")))
    sizes = {r.source: r.words for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    planned = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan(sizes, seed=seed, **how))), PLAN_SCHEMA)).alias("p")).select(F.col("p.source").alias("of"), "p.*").drop("source")
    before = Window.partitionBy("source").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("sub").alias("t"), "offset")
    within = Window.partitionBy("source", "sub").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = keyed.withColumn("o", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    at = at.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("sub") == F.col("t")))
    each = copies(at, "n", "copy", "h", most).withColumn("o", F.col("offset") + F.col("o") + F.col("copy") * F.col("size"))
    side = F.broadcast(planned) if len(sizes) <= BROADCAST_SOURCES else planned.hint("merge")
    return each.join(side, F.col("source").eqNullSafe(F.col("of"))).drop("of", "s", "t", "sub", "h", "n", "copy", "offset")


def _blocks(block: int) -> Column:
    """The blocks that a document has words of, with how many, and the place of the block in the permutation."""
    first, last = F.floor(F.col("o") / block), F.floor((F.col("o") + F.col("size") - 1) / block)
    spans = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(
        spans,
        lambda j: F.struct(
            j.alias("block"),
            (F.least(F.col("o") + F.col("size"), (j + 1) * block) - F.greatest(F.col("o"), j * block)).alias("words"),
            F.pmod(F.col("a") * j + F.col("b"), F.col("blocks")).alias("place"),
        ),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, **how) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): taken counts the words that the mix has of the document.

    Null sources are one source, after all others; null and blank texts have no words and are not taken. Rows of one
    doc_id each count; equal rows share what their stream places take. Reruns agree: the order within a source is that of
    a seeded hash of doc_id, then doc_id and size. An empty table gives an empty result; other columns are not read.
    """
    at = streams(docs, id_col, text_col, source_col, seed, block=block, **how)
    q = F.element_at("quota", -1)
    times = lambda x: F.when(q > x["place"], F.floor((q - x["place"] + F.col("blocks") - 1) / F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    taken = F.aggregate(_blocks(block), F.lit(0).cast("long"), lambda acc, x: acc + x["words"] * times(x))
    return at.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"))


def mix_picks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, repeats: int = REPEATS, **how) -> DataFrame:
    """The mix itself: (shard, source, pick, block, doc_id, words), one row per document in each picked block."""
    at = streams(docs, id_col, text_col, source_col, seed, block=block, repeats=repeats, **how)
    one = at.select("doc_id", "source", "quota", "blocks", F.explode(_blocks(block)).alias("x"))
    one = one.withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("pick", F.col("x.place") + F.col("again") * F.col("blocks"))
    one = one.where(F.col("pick") < F.element_at("quota", -1))
    shard = F.size(F.filter("quota", lambda c: c <= F.col("pick")))
    return one.select(shard.alias("shard"), "source", "pick", F.col("x.block").alias("block"), "doc_id", F.col("x.words").alias("words"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, repeats: int = REPEATS, **how) -> DataFrame:
    """The mix in whole documents, all columns kept: each row of docs as often as its source's quota of words takes it.

    A source gives its quota to within half of one document: all its documents as often as the quota holds the source as
    a whole, and once more those from the beginning of its stream whose middle lies within the rest of the quota.
    Documents without words are not taken.
    """
    at = streams(docs, id_col, text_col, source_col, seed, block=block, repeats=repeats, **how).where("size > 0")
    q = F.least(F.element_at("quota", -1) * block, F.col("source_size") * repeats)
    whole = F.floor(q / F.col("source_size"))
    more = (2 * F.col("o") + F.col("size") <= 2 * (q - whole * F.col("source_size"))).cast("long")
    times = at.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "o", (whole + more).alias("times"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("__i"), F.col(source_col).alias("__s"), words(F.col(text_col)).alias("__z"))
    on = F.col("__i").eqNullSafe(F.col("i")) & F.col("__s").eqNullSafe(F.col("s")) & (F.col("__z") == F.col("z"))
    if not times.groupBy("i", "s", "z").count().where("count > 1").isEmpty():  # rows that only their place tells apart
        times = times.withColumn("k", F.row_number().over(Window.partitionBy("i", "s", "z").orderBy("o")))
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__i", "__s", "__z").orderBy(F.col("doc")[text_col])))
        on = on & (F.col("__k") == F.col("k"))
    each = rows.join(times.where("times > 0"), on).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__n"))
    return each.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() over all documents; null and blank texts have size 0 and nothing taken, an empty table gives no row."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
t AS (SELECT sum(size)::BIGINT AS total FROM d),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][i % {len(WEIGHTS)} + 1] AS w, {REPEATS} * size AS cap FROM s),
o AS (SELECT *, row_number() OVER p AS r, CAST(sum(cap) OVER p - cap AS BIGINT) AS c0, CAST(sum(w) OVER p - w AS BIGINT) AS w0 FROM w WINDOW p AS (ORDER BY cap::DOUBLE / w, i ROWS UNBOUNDED PRECEDING)),
k AS (SELECT o.*, total - c0 AS rest, CAST((SELECT sum(w) FROM w) - w0 AS BIGINT) AS open FROM o, t),
f AS (SELECT arg_min(r, r) AS r, arg_min(rest, r) AS rest, arg_min(open, r) AS open FROM k WHERE NOT cap * open < rest * w),
g AS (SELECT k.source, k.size, k.i, CASE WHEN f.r IS NULL OR k.r < f.r THEN cap::DOUBLE ELSE (f.rest * w)::DOUBLE / f.open::DOUBLE END AS target, (k.size + {BLOCK - 1}) // {BLOCK} AS blocks FROM k, f),
q AS (SELECT i, unnest(range(0, {REPEATS} * blocks)) AS n, target FROM g),
z AS (SELECT i, row_number() OVER (ORDER BY target / (2 * n + 1) DESC, i, n) AS place FROM q WHERE target > 0),
y AS (SELECT i, count(*) AS quota FROM z, t WHERE place <= (total + {BLOCK // 2}) // {BLOCK} GROUP BY i),
x AS (SELECT g.*, greatest(1, blocks) AS n, coalesce(quota, 0) AS quota, ({SEED} * 7919 + 104729 * (g.i + 1)) % least(greatest(1, blocks), 8388608) + 1 AS a0, ({SEED} * 15485863 + 32452843 * g.i) % greatest(1, blocks) AS b FROM g LEFT JOIN y ON g.i = y.i),
v AS (SELECT *, list_filter(range(a0, a0 + 1000), lambda a: gcd(a, n) = 1)[1] AS a FROM x),
h AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'none')), 1, 15))::BIGINT AS h FROM d),
b AS (SELECT *, h % (SELECT greatest(1, (count(*) + {BUCKET - 1}) // {BUCKET}) FROM (SELECT DISTINCT doc_id, source, size FROM d)) AS sub FROM h),
e AS (SELECT b.*, CAST(sum(b.size) OVER (PARTITION BY source ORDER BY sub, h, doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size AS BIGINT) AS o FROM b)
SELECT e.doc_id, e.size, v.size AS source_size, v.target, CAST(coalesce(list_sum(list_transform(range(o // {BLOCK}, CASE WHEN e.size > 0 THEN (o + e.size - 1) // {BLOCK} + 1 ELSE o // {BLOCK} END),
  lambda j: (least(o + e.size, (j + 1) * {BLOCK}) - greatest(o, j * {BLOCK})) * CASE WHEN quota > (a * j + v.b) % n THEN (quota - (a * j + v.b) % n + n - 1) // n ELSE 0 END)), 0) AS BIGINT) AS taken
FROM e JOIN v ON e.source IS NOT DISTINCT FROM v.source
"""
