"""Exact top-k search by inner product with cover trees over queries and data.

Vectors are dealt by a hash of their id to data blocks, and so are the queries to query blocks; each pair of blocks is
one task group with a tree of either side and gives k rows per query, which a window merges. Queries are a stated set
(a share of all rows), so every pair of a query and a row is covered by blocks, and none is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm.common import cut, table
from foliary.llm.cover_tree import search

K, QUERY_MOD, SCALE = 5, 50, 256
#: Rows of a data block: from the first on, growing until there are MOST_BLOCKS, but never over the second.
BLOCK_ROWS, MOST_BLOCKS = (2048, 65_536), 512
QUERY_ROWS = 8192


def quantized(v: Column) -> Column:
    """floor(SCALE x) of every component as long; null unless all components are there and finite."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(v.isNotNull() & whole, F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_mod: int = QUERY_MOD) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query, a row whose id is divisible by query_mod, the k rows with the
    highest integer inner products, equal scores by smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows of null id. Vectors of unequal
    lengths are compared as if the shorter one went on with zeros. Rows of the query's own id are left out; a repeated
    query is one query (of unequal vectors the smallest), repeated data rows each count. Scores must fit a long; they are exact below 2^53. An empty table
    gives an empty result; other columns are not read.
    """
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL"))
    n = rows.count()
    blocks = max(1, min(-(-n // BLOCK_ROWS[0]), MOST_BLOCKS), -(-n // BLOCK_ROWS[1]))
    asked = rows.where(F.pmod("id", F.lit(query_mod)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    query_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    deal = lambda count: F.pmod(F.xxhash64("id", F.lit(count)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = rows.withColumn("block", deal(blocks)).withColumn("part", every(query_blocks))
    asked = asked.withColumn("part", deal(query_blocks)).withColumn("block", every(blocks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dim = max([1, *map(len, left["v"]), *map(len, right["v"])])
        q, r = _matrix(right["v"], dim), _matrix(left["v"], dim)
        ids = right["id"].to_numpy("i8")
        best = search(q, ids, r, left["id"].to_numpy("i8"), k)
        some = ~np.isneginf(best.score)
        at = np.nonzero(some)
        return pd.DataFrame({"query_id": ids[at[0]], "vec_id": best.id[some], "score": best.score[some].astype("i8")})

    found = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() of every vec_id divisible by 50 over all embeddings; an empty table gives no row."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % {QUERY_MOD} = 0 AND q.vec_id <> r.vec_id
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {K}
"""
