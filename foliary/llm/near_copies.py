"""Near-copies of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from op4 first: SimHash fingerprints of the shingle sets, linked by the generalised pigeonhole principle at
DISTANCE bits; each group so linked is a bucket. Texts near 0.8 differ in more bits than a pigeonhole search can afford, so
the rest of the candidates share a bucket of MinHash: of BANDS bands of ROWS minima each, a pair of similarity s has one in common with
probability 1 - (1 - s^ROWS)^BANDS, which misses fewer than one pair in 20 million at 0.8 and fewer above. Candidates are
verified on their whole shingle sets in integers, so no pair below 0.8 links.

Skew: texts of equal shingle sets are one vertex from the start, buckets of equal members are verified once, a bucket of
more than SHARE shingles is cut into blocks and verified by pairs of blocks, and a block gives only edges that connect what
was not connected, never all of its pairs. Groups of fingerprints, then bands are taken in rounds, so large groups are
verified in the first few alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import cut, discard, small_batches, staged
from foliary.llm.components import components
from foliary.llm.op4_simhash import links, majority

WORDS = 5
#: Jaccard similarity of near-copies, as a fraction.
NEAR, OF = 4, 5
BANDS, ROWS = 32, 4
#: Differing bits at which fingerprints link.
DISTANCE = 6
#: Bands up to which a round goes, groups of fingerprints being band -1: these and few bands connect most copies, and the
#: others then have little left to verify.
ROUNDS = (0, 2, BANDS)
#: Shingles of one block of a bucket.
SHARE = 1 << 20
#: Shingles taken at once, which bounds the memory of very long texts.
TERMS = 2048
_SEEDS = np.array([xxhash.xxh64_intdigest(f"band {k}".encode()) for k in range(BANDS * ROWS)], "u8")[:, None]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of the distinct word shingles, ascending; of the whole sequence of fewer words, none of blank texts."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, "u8")
    digest, joined = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return np.array([digest(joined)], "u8")
    ends = (np.cumsum(np.fromiter(map(len, w), np.int64) + 1) - 1).tolist()
    view = memoryview(joined)
    return np.unique(np.fromiter((digest(view[a:b]) for a, b in zip([0, *[e + 1 for e in ends]], ends[words - 1 :], strict=False)), "u8"))


def band_keys(terms: np.ndarray) -> np.ndarray:
    """One bucket per band, as signed longs."""
    least = np.full(len(_SEEDS), ~np.uint64(0))
    for i in range(0, len(terms), TERMS):
        x = terms[None, i : i + TERMS] ^ _SEEDS
        x *= _M1
        x ^= x >> np.uint64(32)
        x *= _M2
        np.minimum(least, x.min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], "u8").view("i8")


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, v, size, fp, keys): h is a hash of the text, v one of its set of shingles, of which there are `size`; fp
    is their fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(x if isinstance(x, str) else None) for x in b["text"]]
            v = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "u8").view("i8")
            fp = np.array(list(map(majority, sets)), "u8").view("i8")
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "v": v, "size": list(map(len, sets)), "fp": fp, "keys": [band_keys(s) for s in sets]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, h long, v long, size long, fp long, keys array<long>")


def forest(v: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect, with what the roots say is connected, all near-copies among vertices v with their shingles."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(int(flat.max()) + 1, bool)
    label = np.unique(np.asarray(roots), return_inverse=True)[1]
    out, left, queue = [], np.ones(len(v), bool), []
    for first in range(len(v)):
        queue.append(first)
        while queue:
            x = queue.pop()
            if not left[x]:
                continue
            left[x] = False
            # of a + b shingles, i in both: i / (a + b - i) >= NEAR / OF
            fits = np.flatnonzero(left & (label != label[x]) & (OF * size >= NEAR * size[x]) & (OF * size[x] >= NEAR * size))
            if not len(fits):
                continue
            own = flat[starts[x] : starts[x] + size[x]]
            has[own] = True
            if len(fits) > 500:
                sums = np.concatenate([[0], np.cumsum(has[flat])])
                both = sums[starts[fits] + size[fits]] - sums[starts[fits]]
            else:
                both = np.fromiter((np.count_nonzero(has[flat[starts[y] : starts[y] + size[y]]]) for y in fits), np.int64, len(fits))
            has[own] = False
            found = fits[(OF + NEAR) * both >= NEAR * (size[fits] + size[x])]
            out += [(v[x], v[y]) for y in found]
            label[np.isin(label, label[found])] = label[x]
            queue += found.tolist()
    return out


def linked_fingerprints(vertices: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(v, size, band -1, key): the group of linked fingerprints that each vertex with shingles lies in."""
    rows = vertices.where("size > 0").select("v", "size", "fp")
    roots = components(links(cut(rows.select("fp").distinct()), distance))
    key = F.coalesce("root", "fp").alias("key")
    return rows.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("v", "size", F.lit(-1).alias("band"), key)


def groups_of(vertices: DataFrame, docs: DataFrame, id_col: str, text_col: str, share: int = SHARE, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(u, v): each vertex that near-copies connect with another one, except the smallest of a group, with that smallest.

    vertices: (v, size, fp, keys, doc_id, h: a row of docs with that set). Groups of fingerprints and bands are taken in
    rounds; a later round looks only at buckets whose members are not all connected yet.
    """
    rows = linked_fingerprints(vertices).unionAll(vertices.where("size > 0").select("v", "size", F.posexplode("keys").alias("band", "key")))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rows = cut(rows.join(several, "key"))
    needed = vertices.join(rows.select("v").distinct(), "v", "left_semi").select("v", F.col("doc_id").alias("i"), F.col("h").alias("t"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    texts = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t")))
    texts = staged(texts.groupBy("v").agg(F.min("text").alias("text")))
    known, begin = None, -1
    for end in rounds:
        some = rows.where((F.col("band") >= begin) & (F.col("band") < end)).drop("band")
        some = some.withColumn("root", F.col("v")) if known is None else some.join(known.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").withColumn("root", F.coalesce("root", "v"))
        sizes = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("v")).alias("x"), F.min("root").alias("least"), F.max("root").alias("most"))
        once = sizes.where("least <> most").groupBy("n", "total", "x").agg(F.min("key").alias("key"))
        spread = some.join(once.select("key", F.ceil(F.col("total") / share).cast("int").alias("k")), "key")
        spread = spread.select("v", "root", "key", "k", F.pmod(F.xxhash64("v"), F.col("k")).cast("int").alias("b"))
        pairs = spread.select("v", "root", "key", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
        groups = pairs.select("v", "root", "key", F.least("b", "j").alias("p"), F.greatest("b", "j").alias("q")).join(texts, "v")
        found = verified(groups.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "v"))
        known = components(found if known is None else found.unionAll(known.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        begin = end
    discard(texts)
    return known


def verified(groups: DataFrame) -> DataFrame:
    """Edges (a, b) of the members (v, root, text) of each block (key, p, q), whose rows come one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, v, roots, sets = None, [], [], []
        for b in batches:
            found = []
            for key, p, q, x, root, text in zip(b["key"], b["p"], b["q"], b["v"], b["root"], b["text"], strict=True):
                if (key, p, q) != at:
                    found += forest(v, roots, sets) if len(v) > 1 else []
                    at, v, roots, sets = (key, p, q), [], [], []
                v.append(x)
                roots.append(root)
                sets.append(shingles(text))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
        if len(v) > 1 and (found := forest(v, roots, sets)):
            yield pd.DataFrame(found, columns=["a", "b"])

    return groups.mapInPandas(run, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """One row of docs of each group of near-copies, linked directly or in steps: that of the smallest doc_id (null last),
    of several the one whose text has the smallest hash. Null, empty and blank texts are one group. All columns are kept."""
    marks = cut(marked(docs, id_col, text_col))
    vertices = marks.groupBy("v").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("w"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    vertices = cut(vertices.select("v", "w", "w.doc_id", "w.h", "size", "fp", "keys"))
    roots = groups_of(vertices, docs, id_col, text_col, share)
    of = vertices.select("v", "w").join(roots.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left")
    first = of.groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("w").alias("w"))
    won = cut(first.select(F.col("w.doc_id").alias("__id"), F.col("w.h").alias("__h")))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("__i"), F.xxhash64(text_col).alias("__t"))
    kept = rows.join(won, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")), "left_semi")
    if not marks.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__i", "__t"])  # repeated rows
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
