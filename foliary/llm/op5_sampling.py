"""Document fingerprints by consistent weighted sampling.

The terms of a text are its five-word shingles (fewer words: the whole sequence), weighted by how often they occur. For
each of SAMPLES seeds, every term draws two Gamma(2, 1) values r and c and a uniform b from a keyed hash; with its
weight w: t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)). The term with the least a is the sample, as
the pair (term, t). Two texts agree in a sample with a probability equal to their generalised Jaccard similarity.

The neighbours in doc_id order are found in ranges of doc_id, one shuffle of the texts; the first document of a range is
also sent to the range before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import small_batches, table
from foliary.llm.ordered import constant, range_of, split_points

SAMPLES = 64
WORDS = 5
#: Terms taken at once, which bounds the memory of very long texts.
TERMS = 4096
NOTHING = "0" * (4 * SAMPLES)


def _gamma2(bits: int = 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2^bits equal parts of (0, 1), by Newton steps on 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_R = _gamma2().astype("f4")
_LOG_C = np.log(_gamma2()).astype("f4")
_SEEDS = np.array([xxhash.xxh64_intdigest(f"sample {k}".encode()) for k in range(SAMPLES)], "u8")[:, None]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of every seed (rows) and term (columns)."""
    x = terms[None, :] ^ _SEEDS
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(29)
    part = x.view("<u2").reshape(SAMPLES, len(terms), 4)
    return _R[part[:, :, 0]], _LOG_C[part[:, :, 1]], (part[:, :, 2] + np.float32(0.5)) * np.float32(2.0**-16)


def term_hashes(words: list[bytes], begin: int = 0) -> list[int]:
    """XXH64 of the shingles that start at word `begin` or later."""
    if not words:
        return []
    joined, digest = memoryview(b" ".join(words[begin:])), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return [digest(b" ".join(words))] if begin == 0 else []
    sizes = np.fromiter(map(len, words[begin:]), np.int64)
    ends = (np.cumsum(sizes + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends]]
    return [digest(joined[a:b]) for a, b in zip(starts, ends[WORDS - 1 :], strict=False)]


def sample(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least ln a, and its term and t, of each seed; terms may repeat. Of equal least values the smaller hash is taken."""
    u, w = np.unique(terms, return_counts=True)
    best, of, t = np.full(SAMPLES, np.inf, "f4"), np.zeros(SAMPLES, "u8"), np.zeros(SAMPLES, np.int64)
    for i in range(0, len(u), TERMS):
        uu, log_w = u[i : i + TERMS], np.log(w[i : i + TERMS]).astype("f4")
        r, c, b = draws(uu)
        heavy = np.flatnonzero(log_w)
        a = c - r * (1 - b)  # t = 0 at weight 1
        if len(heavy):
            th = np.floor(log_w[heavy] / r[:, heavy] + b[:, heavy])
            a[:, heavy] = c[:, heavy] - r[:, heavy] * (th - b[:, heavy] + 1)
        at = a.argmin(1)
        least = a[np.arange(SAMPLES), at]
        hit = least < best
        rows = np.flatnonzero(hit)
        best[rows], of[rows] = least[rows], uu[at[rows]]
        t[rows] = np.floor(log_w[at[rows]] / r[rows, at[rows]] + b[rows, at[rows]]).astype(np.int64)
    return best, of, t


def signature(terms: np.ndarray) -> np.ndarray:
    """16 bits of each sample; all zero without terms."""
    if not len(terms):
        return np.zeros(SAMPLES, "u2")
    _, of, t = sample(terms)
    x = (of ^ (t.astype("u8") * _M2)) * _M1
    return (x >> np.uint64(48)).astype("u2")


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def edited(text: str, nxt: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + nxt[:q]


class Document:
    """A text with the terms and the signature that its own and its predecessor's rows need."""

    def __init__(self, doc_id, text: str | None):
        self.id, self.text = doc_id, text if isinstance(text, str) else ""
        self.words = words_of(self.text)
        self.terms = np.array(term_hashes(self.words), "u8")
        self.signature = signature(self.terms)

    def row(self, nxt: Document) -> tuple:
        new = edited(self.text, nxt.text)
        kept = self.text[: len(self.text) - len(self.text) // 4]
        same = max(0, len(words_of(kept)) - WORDS)  # shingles that lie wholly in words the edit leaves alone
        words = words_of(new)
        if same and len(words) > WORDS and len(self.words) > WORDS:
            terms = np.concatenate([self.terms[:same], np.array(term_hashes(words, same), "u8")])
        else:
            terms = np.array(term_hashes(words), "u8")
        sig = signature(terms)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return self.id, len(self.text), sha, shown(self.signature), shown(sig), likeness(self.signature, sig), likeness(self.signature, nxt.signature)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, as SCHEMA.

    Null texts are empty; a text without words has the fingerprint of zeros and is like another such text only. Next is
    ascending by doc_id, null first, rows of one doc_id by text; after the last the first; of a single row itself. An
    empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    points = split_points(ids)
    cut_ids = ids.withColumn("b", range_of(points, F.col("doc_id")))
    firsts = sorted((r.b, r.nulls, r.first) for r in cut_ids.groupBy("b").agg(F.max(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("first")).collect())
    used = [b for b, _, _ in firsts]
    rows = rows.withColumn("b", range_of(points, F.col("doc_id")))
    pairs = {b: (None if nulls else first, used[i - 1]) for i, (b, nulls, first) in enumerate(firsts)}
    first_of, to = (constant([pairs.get(b, (None, None))[i] for b in range(len(points) + 1)], "bigint") for i in (0, 1))
    is_first = F.col("doc_id").eqNullSafe(F.get(first_of, F.col("b")))
    homes = F.when(is_first, F.array(F.struct(F.col("b").alias("r"), F.lit(False).alias("donor")), F.struct(F.get(to, F.col("b")).cast("int").alias("r"), F.lit(True).alias("donor")))).otherwise(
        F.array(F.struct(F.col("b").alias("r"), F.lit(False).alias("donor")))
    )
    dealt = rows.select("doc_id", "text", F.explode(homes).alias("h")).select("doc_id", "text", "h.r", "h.donor")
    dealt = dealt.repartitionById(len(points) + 1, F.col("r")).sortWithinPartitions("r", "donor", "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: Document | None = None
        at, done = None, False
        for b in batches:
            out = []
            for r, doc_id, text, donor in zip(b["r"], b["doc_id"], b["text"], b["donor"], strict=True):
                if r != at:
                    at, last, done = r, None, False
                if done:
                    continue  # further rows of the first doc_id of the next range
                now = Document(None if pd.isna(doc_id) else int(doc_id), text)
                if last is not None:
                    out.append(last.row(now))
                last, done = now, bool(donor)
            if out:
                made = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

    return dealt.mapInPandas(run, SCHEMA)


def op5_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints() over all documents; null texts are empty, an empty table gives no row."""
    return fingerprints(table(spark, sf_dir, "documents"))
