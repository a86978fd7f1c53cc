"""Canonical length-limited Huffman codes over integers, with block-wise table-driven coding in NumPy."""

from __future__ import annotations

import struct

import numpy as np

#: Longest code, one bit more than its ids need for larger vocabularies; a decoding table has two to the longest entries.
LIMIT = 16
#: A checkpoint holds the bit offset of every STRIDE-th id of a block.
STRIDE = 256
MAGIC = b"HID1"


def lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    limit = limit or max(LIMIT, len(ids).bit_length() + 1)
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    if len(ids) < 2:
        out[ids] = 1
        return out
    order = ids[np.lexsort((ids, counts[ids]))]
    weight = counts[order].astype("f8")
    leaves = np.arange(len(order))
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    w, kind = weight, leaves
    for _ in range(limit - 1):
        levels.append((w, kind))
        m = len(w) // 2
        packed = w[: 2 * m].reshape(m, 2).sum(1)
        both = np.concatenate([weight, packed])
        at = np.argsort(both, kind="stable")
        w, kind = both[at], np.where(at < len(order), at, -1)
    levels.append((w, kind))
    take, n = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for _, kind in reversed(levels):
        head = kind[:take]
        n[head[head >= 0]] += 1
        take = 2 * int((head < 0).sum())
    out[order] = n
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """Canonical codes: in order of length, then id."""
    out = np.zeros(len(length), np.uint32)
    code, before = 0, 0
    used = np.flatnonzero(length)
    for i in used[np.lexsort((used, length[used]))]:
        code <<= int(length[i]) - before
        before = int(length[i])
        out[i] = code
        code += 1
    return out


def table(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the next bits, as many as the longest code has: the id, and the length of its code."""
    limit = max(LIMIT, int(length.max(initial=0)))
    symbol, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    code = codes(length)
    for i in np.flatnonzero(length):
        n = int(length[i])
        a = int(code[i]) << (limit - n)
        symbol[a : a + (1 << (limit - n))] = i
        size[a : a + (1 << (limit - n))] = n
    return symbol, size


def packed(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from the top bit of a 64-bit word on, and their lengths, for encode()."""
    return codes(length).astype(np.uint64) << (64 - length.astype(np.uint64)) % 64, length


def encode(ids: np.ndarray, packed: tuple[np.ndarray, np.ndarray], first: int) -> bytes:
    """A block: magic, first global position, number of ids, checkpoints, bits (most significant first)."""
    n = packed[1][ids]
    if n.size and n.min() == 0:
        raise ValueError("an id without a code")
    starts = np.empty(len(ids) + 1, np.int64)
    starts[0] = 0
    np.cumsum(n, out=starts[1:], dtype=np.int64)
    words = np.zeros(int(starts[-1]) // 64 + 3, np.uint64)
    if n.size:
        bit = (starts[:-1] & 63).astype(np.uint8)
        code = packed[0][ids]
        heads = np.flatnonzero(bit < np.r_[np.uint8(64), bit[:-1]])  # the first code that begins in a word
        at = starts[heads] >> 6
        words[at] = np.bitwise_or.reduceat(code >> bit, heads)
        over = np.flatnonzero(bit + n > 64)  # a code that goes on in the next word
        words[(starts[over] >> 6) + 1] |= code[over] << (64 - bit[over]).astype(np.uint64)
    marks = starts[:-1:STRIDE].astype("<u8")
    return MAGIC + struct.pack("<QII", first, len(ids), len(words)) + marks.tobytes() + words.astype(">u8").tobytes()


def decode(block: bytes, symbol: np.ndarray, size: np.ndarray) -> tuple[int, np.ndarray]:
    """(first global position, ids). All checkpoints of the block advance together, one id each a step."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of ids")
    limit = len(symbol).bit_length() - 1
    first, n, words = struct.unpack_from("<QII", block, 4)
    k = -(-n // STRIDE)
    at = np.frombuffer(block, "<u8", k, 20).astype(np.int64)
    bits = np.frombuffer(block, ">u8", words, 20 + 8 * k).astype(np.uint64)
    out = np.zeros((STRIDE, k), np.uint32)
    last = n - STRIDE * (k - 1)
    top, one, most = np.uint64(64 - limit), np.uint64(1), np.uint64(63)
    for step in range(STRIDE if k > 1 else n):
        p = at if step < last else at[: k - 1]
        w, b = p >> 6, (p & 63).astype(np.uint64)
        seen = ((bits[w] << b) | (bits[w + 1] >> one >> (most - b))) >> top
        out[step, : len(p)] = symbol[seen]
        p += size[seen]
    return first, out.T.ravel()[:n] if k else out.ravel()[:0]
