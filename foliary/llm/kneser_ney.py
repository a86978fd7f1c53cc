"""Interpolated Kneser-Ney character models of several languages in one set of sorted hash arrays."""

from __future__ import annotations

import numpy as np

ORDER = 5
START, STOP = "\x02", "\x03"
#: A model may be held in parts, by the two characters before the one predicted: their bucket, of so many.
BUCKETS = 4096
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of a code point array that begin at each place with n points left."""
    h = np.full(max(len(points) - n + 1, 0), n, np.uint64)
    for k in range(n):
        h = (h ^ points[k : k + len(h)]) * _MUL
        h ^= h >> np.uint64(29)
    return h * _MIX


def gram_hashes(grams: np.ndarray) -> np.ndarray:
    """The same for a (count, n) array of code points."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = (h ^ grams[:, k].astype(np.uint64)) * _MUL
        h ^= h >> np.uint64(29)
    return h * _MIX


def find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 where absent."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the padded words one after another, the place of each character predicted (the end of a word is
    one, too), and the number of those of each word."""
    text = "".join(START * (ORDER - 1) + w + STOP for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    return points, np.arange(ends[-1] if len(words) else 0) + np.repeat((ORDER - 1) * np.arange(1, len(words) + 1), size), size


def gram_sums(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the highest order of words with counts, and their counts."""
    points, ends, size = windows(list(words))
    if not len(ends):
        return np.zeros(0, f"<U{ORDER}"), np.zeros(0, np.int64)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, ORDER)[ends - (ORDER - 1)])
    grams, at = np.unique(rows.view(f"<U{ORDER}").ravel(), return_inverse=True)
    n = np.zeros(len(grams), np.int64)
    np.add.at(n, at, np.repeat(np.fromiter(words.values(), np.int64, len(words)), size))
    return grams, n


#: Of an order's n-grams: code points (count, order), number of the language, count (below the highest order: of distinct
#: characters before it).
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def levels_of(counts: list[dict[str, int]]) -> list[Level]:
    """The n-grams of every order, the lowest first, from the counts of the highest by language."""
    points = np.concatenate([np.array(list(c), f"<U{ORDER}").view("<u4").reshape(-1, ORDER) for c in counts])
    out = [(points, np.repeat(np.arange(len(counts)), [len(c) for c in counts]), np.concatenate([np.fromiter(c.values(), "f8", len(c)) for c in counts]))]
    for k in range(ORDER - 1, 0, -1):
        g, l, _ = out[0]
        u, n = np.unique(np.column_stack([g[:, 1:], l]).astype("u4"), axis=0, return_counts=True)
        out.insert(0, (u[:, :k], u[:, k].astype(int), n.astype("f8")))
    return out


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))


class Model:
    """For order n: sorted hashes of all n-grams of any language with the log probability of their last character in
    each language, and of their contexts with the log weight that backing off costs in each language.

    discounts are by order and language. With `buckets`, the levels hold, of orders from 3 on, only n-grams of these
    buckets, and words() scores only characters of these.
    """

    def __init__(self, langs: list[str], levels: list[Level], discounts: list[list[float]], alphabet: int, buckets: np.ndarray | None = None):
        self.langs, self.own = langs, buckets
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = -np.log(alphabet)
        lower = (np.zeros(0, np.uint64), np.zeros((0, len(langs))))
        for k, (g, l, c) in enumerate(levels, 1):
            h = gram_hashes(g)
            keys = np.unique(h)
            row = np.searchsorted(keys, h)
            first = np.zeros(len(keys), int)
            first[row] = np.arange(len(h))
            g1 = g[first]
            ch = gram_hashes(g1[:, :-1]) if k > 1 else np.zeros(len(g1), np.uint64)
            ckeys, crow = np.unique(ch, return_inverse=True)
            back = find(lower[0], gram_hashes(g1[:, 1:])) if k > 1 else np.zeros(len(g1), int)
            base = np.exp(lower[1][back]) if k > 1 else np.full((len(keys), len(langs)), 1 / alphabet)
            prob, weight = base.copy(), np.zeros((len(ckeys), len(langs)))
            for i in range(len(langs)):
                own = l == i
                count = np.zeros(len(keys))
                count[row[own]] = c[own]
                d = discounts[k - 1][i]
                total = np.bincount(crow, count, len(ckeys))
                types = np.bincount(crow, count > 0, len(ckeys))
                seen = total > 0
                gamma = np.where(seen, d * types / np.maximum(total, 1), 1.0)
                prob[:, i] = np.maximum(count - d, 0) / np.maximum(total, 1)[crow] + gamma[crow] * base[:, i]
                weight[:, i] = np.log(gamma)
            lower = (keys, np.log(prob))
            self.grams.append((keys, lower[1].astype("f4")))
            self.contexts.append((ckeys, weight.astype("f4")))

    @classmethod
    def of_counts(cls, langs: list[str], counts: list[dict[str, int]]) -> Model:
        levels = levels_of(counts)
        of = lambda l, c, i, n: int(((l == i) & (c == n)).sum())
        discounts = [[discount(of(l, c, i, 1), of(l, c, i, 2)) for i in range(len(langs))] for _, l, c in levels]
        return cls(langs, levels, discounts, len(np.unique(levels[0][0])) + 1)

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each non-empty word, with its end, in each language."""
        if not words:
            return np.zeros((0, len(self.langs)), "f4")
        points, ends, size = windows(words)
        points = points.astype(np.uint64)
        out = np.zeros((len(ends), len(self.langs)), "f4")
        left = np.arange(len(ends))
        if self.own is not None:
            left = left[self.own[bucket(points[ends - 2], points[ends - 1])]]
        for k in range(ORDER, 0, -1):
            keys, prob = self.grams[k - 1]
            at = find(keys, hashes(points, k)[ends[left] - k + 1])
            hit = at >= 0
            out[left[hit]] += prob[at[hit]]
            left = left[~hit]
            if not len(left):
                break
            ckeys, weight = self.contexts[k - 1]
            c = find(ckeys, hashes(points, k - 1)[ends[left] - k + 1] if k > 1 else np.zeros(len(left), np.uint64))
            out[left[c >= 0]] += weight[c[c >= 0]]
        out[left] += np.float32(self.floor)
        return np.add.reduceat(out, np.cumsum(size) - size, axis=0)


def bucket(before, last):
    """The bucket of the two characters before the one predicted, as code points: numbers, arrays or columns."""
    return (before * 8191 + last) % BUCKETS
