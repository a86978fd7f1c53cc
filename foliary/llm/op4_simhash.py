"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints of 64 bits link at a few differing bits. Bits that go together are grouped into partitions; each
partition i gets an own threshold t_i >= -1 with sum(t_i + 1) = distance + 1, so any two fingerprints within the
distance differ by at most t_i bits in some partition i. The thresholds come from dynamic programming on candidate
counts, which are taken from the histograms of all fingerprints. Each fingerprint goes to the bucket of its own value
in every partition used, and to those within t_i bits of it; candidates of a bucket are verified by XOR and bit count.

Skew: equal fingerprints are one vertex from the start; a bucket of more than BLOCK vertices is cut into blocks and
verified by pairs of blocks; a bucket gives the edges of a spanning forest, never all of its pairs. Components follow
by joins, cut through the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import cut, small_batches, table
from foliary.llm.components import components

DISTANCE = 4
WORDS = 4
#: Vertices of one block of a bucket.
BLOCK = 1024


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for null, empty or blank texts."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), 42)
    joined, ends, at = b" ".join(w), [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *[x + 1 for x in ends]]
    view = memoryview(joined)
    return majority(np.fromiter((digest(view[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)), "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes (u8); 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, h, fp): fp is the fingerprint as a signed long, h a hash of the text. Null texts have the fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(x if isinstance(x, str) else None, words) for x in b["text"]], "u8")
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "fp": fp.view("i8")})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, h long, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set. Each task sums up its own; 4,096 numbers reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy("i8").astype("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
            total += x.T @ x
        i, j = np.indices((64, 64))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total.ravel().astype("i8")})

    out = np.zeros((64, 64))
    for r in fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def partitions(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m partitions of near equal width: each is filled with the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(own[0])
        while len(own) < width:
            nxt = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(nxt)
            left.remove(nxt)
        out.append(sorted(own))
    return out


def masks_within(bits: list[int], t: int) -> list[int]:
    """Non-empty sets of at most t of the bits, as masks."""
    from itertools import combinations

    return [sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(bits, r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probe_costs(bits: list[int], keys: np.ndarray, n: np.ndarray, most: int) -> list[float]:
    """Estimated work of a partition by its threshold from -1 to most: candidate pairs, and probes at 20 pairs each."""
    packed = np.zeros(len(keys), np.int64)
    for k, b in enumerate(bits):
        packed |= ((keys >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    dense = np.zeros(1 << len(bits))
    dense[packed] = n
    near, row, probes = np.zeros_like(n), [0.0], 0
    for t in range(most + 1):
        for mask in [0] if t == 0 else [x for x in masks_within(list(range(len(bits))), t) if x.bit_count() == t]:
            near += dense[packed ^ mask]
            probes += 1
        row.append(float((n * near).sum()) / 2 + 20.0 * float(n.sum()) * probes)
    return row


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds by dynamic programming on the costs of each partition by threshold from -1 on."""
    need = distance - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, cost in enumerate(row, -1):
                if s + t not in nxt or c + cost < nxt[s + t][0]:
                    nxt[s + t] = (c + cost, [*ts, t])
        best = nxt
    return best[need][1]


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints (u8) that are linked directly."""
    out, rest = [], fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def links(vertices: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that connect exactly what is linked within the distance."""
    n = vertices.count()
    m = min(distance + 1, max(3, round(64 / max(np.log2(max(n, 2)), 12))))
    parts = partitions(bit_counts(vertices), n, m)
    full = [signed(sum(1 << b for b in p)) for p in parts]
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for i, x in enumerate(full)]))
    counts = cut(vertices.select(own.alias("o")).groupBy("o.i", "o.key").agg(F.count(F.lit(1)).alias("n")))
    costs = []
    for i, bits in enumerate(parts):  # at most 2^22 values of one partition are on the driver at a time, as arrays
        rows = counts.where(F.col("i") == i).select("key", "n").toArrow()
        costs.append(probe_costs(bits, rows.column("key").to_numpy().view("u8"), rows.column("n").to_numpy().astype("f8"), min(distance, 2)))
    ts = allocate(costs, distance)
    buckets = []
    for i, t in enumerate(ts):
        if t >= 0:
            key = F.col("fp").bitwiseAND(F.lit(full[i]))
            probes = [key] + [key.bitwiseXOR(F.lit(signed(x))) for x in masks_within(parts[i], t)]
            buckets.append(F.transform(F.array(*probes), lambda k, i=i: F.struct(F.lit(i).alias("i"), k.alias("key"))))
    rows = vertices.select("fp", F.explode(F.concat(*buckets)).alias("o")).select("fp", "o.i", "o.key")
    sizes = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = rows.join(sizes, ["i", "key"]).withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    spread = spread.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pairs = spread.select("fp", "i", "key", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    groups = pairs.groupBy("i", "key", F.least("b", "j").alias("p"), F.greatest("b", "j").alias("q")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[tuple[int, int]] = []
            lists = [np.unique(np.asarray(x, "i8")).view("u8") for x in b["fps"]]
            large = [x for x in lists if len(x) > 48]
            lists = [x for x in lists if 1 < len(x) <= 48]
            if lists:
                flat, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                for s in range(1, max(map(len, lists))):
                    hit = (of[s:] == of[:-s]) & (np.bitwise_count(flat[s:] ^ flat[:-s]) <= distance)
                    found += zip(flat[:-s][hit].tolist(), flat[s:][hit].tolist(), strict=True)
            for x in large:
                found += forest(x, distance)
            if found:
                e = np.array(found, "u8").view("i8")
                yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    return groups.where(F.size("fps") > 1).select("fps").mapInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long, component_id): documents linked, directly or in steps, at `distance` or fewer differing bits.

    Null, empty and blank texts have the fingerprint zero and link with each other and with whatever is near zero.
    Rows of one doc_id each stay; a null doc_id stays null and never names a component, except one of nulls only (null).
    An empty table gives an empty result; further columns of the input are not read.
    """
    fps, named = _grouped(docs, id_col, text_col, distance, words)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and (fp, root, component_id) of each distinct one."""
    fps = cut(fingerprints(docs, id_col, text_col, words))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(cut(links(reps.select("fp"), distance)))
    of = reps.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps, cut(of.join(ids, "root").select("fp", "root", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """One row of docs of each component: that of the smallest doc_id (null last), of several the one whose text has the
    smallest hash. All columns are kept."""
    fps, named = _grouped(docs, id_col, text_col, distance, words)
    first = fps.join(named, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("w"))
    won = cut(first.select(F.col("w.doc_id").alias("__id"), F.col("w.h").alias("__h")))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("__i"), F.xxhash64(text_col).alias("__t"))
    kept = rows.join(won, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")), "left_semi")
    if not fps.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__i", "__t"])  # repeated rows
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups() over all documents; null, empty and blank texts have the fingerprint zero, an empty table no row."""
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
