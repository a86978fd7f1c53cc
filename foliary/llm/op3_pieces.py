"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is encoded as by the library's BPE models: spaces become the word mark, the pair of neighbours that makes the
best-scored piece is merged, again and again. An agenda gives the next candidate merge: the best-scored one, of equal ones
the leftmost. With dropout, each candidate is skipped at the rate given, by a hash keyed by seed, document, place of the
chunk in the document and number of the candidate; a skipped pair may come up again with other neighbours. What the
vocabulary lacks becomes byte pieces, as does the word mark itself where a text has it, so decoding gives back every text
exactly.

No piece goes on after its first word mark run, nor over a line feed, so the text falls into chunks (a run of word marks
and what follows). The agendas of many chunks of like length are processed side by side as the rows of arrays, one
candidate of each row a step; longer chunks have a heap each. Nothing is kept from one text to the next.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from foliary.llm.common import small_batches, table, with_made

SEED, RATE = 11, 0.1
#: Lengths of chunks whose agendas are processed side by side (each up to the next one); longer ones have a heap.
LENGTHS = [*range(2, 17), 20, 24, 32, 48]
#: Characters whose chunks are processed at once.
SLICE = 1 << 19
MARK = "▁"
#: Among pieces: what a merge has used up, and the ends of a row. A character that is no piece is OTHER less its code point.
GONE, EDGE, OTHER = -1, -2, -3
#: No candidate.
NEVER = np.int32(2**31 - 1)
_GOLDEN, _M1, _M2, _MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


class Vocabulary:
    """Pieces, and the pairs of pieces or characters that make one, in an open hash table."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        scored: list[tuple[float, int, str]] = []
        self.byte = np.zeros(256, np.int32)
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                scored.append((-sp.get_score(i), i, piece))
                self.text.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) or "\n" in p for _, _, p in scored):
            raise ValueError("a piece of this model goes on after a word mark or a line feed")
        self.ids = {piece: i for _, i, piece in scored}
        scored = [x for x in scored if len(x[2]) > 1]
        ranks: dict[float, int] = {s: k for k, s in enumerate(sorted({s for s, _, _ in scored}))}
        #: The piece of each place among all scores, the best first; GONE where several pieces share a score.
        self.made = np.full(len(ranks) + 1, GONE, np.int32)
        shared = {s for s, n in Counter(s for s, _, _ in scored).items() if n > 1}
        self.ties = bool(shared)
        for s, i, _ in scored:
            self.made[ranks[s]] = GONE if s in shared else i
        #: By code point: the piece of a character. Characters that only occur in pieces are pieces beyond the vocabulary.
        self.char = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.beyond: dict[int, str] = {}
        for _, _, p in scored:
            for c in p:
                if c not in self.char:
                    self.char[c] = len(self.text) + len(self.beyond)
                    self.beyond[self.char[c]] = c
        pairs = {}
        for s, i, p in scored:
            for k in range(1, len(p)):
                x, y = (self.char.get(h) if len(h) == 1 else self.ids.get(h) for h in (p[:k], p[k:]))
                if x is not None and y is not None:
                    pairs[x << 32 | y] = (ranks[s], i)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        #: Rank and piece by slot; the last slot stands for pairs that make no piece.
        self.rank, self.piece = np.full((1 << self.bits) + 1, NEVER), np.full((1 << self.bits) + 1, GONE, np.int32)
        keys, of = np.fromiter(pairs, np.int64, len(pairs)), np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        at = self._slot(keys)
        while len(keys):  # of those for one free slot the first takes it, the others go on
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.rank[at[first]], self.piece[at[first]] = keys[first], of[first, 0], of[first, 1]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, of, at = keys[left], of[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.of_point = np.full(max(map(ord, self.char), default=0) + 1, GONE, np.int32)
        for c, i in self.char.items():
            self.of_point[ord(c)] = i
        self.width = "H" if sp.get_piece_size() <= 1 << 16 else "I"

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_GOLDEN)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The slots of pairs of neighbours."""
        key = (x.astype(np.int64) << 32) | y
        at = self._slot(key)
        held = self.keys[at]
        open_ = np.flatnonzero(held != key)
        held = held[open_]
        while len(open_):
            none = held == -1
            at[open_[none]] = 1 << self.bits
            open_ = open_[~none]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            off = held != key[open_]
            open_, held = open_[off], held[off]
        return at

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of what two neighbours would make among all scores; NEVER if they make no piece."""
        return self.rank[self.find(x, y)]

    def pieces(self, points: np.ndarray) -> np.ndarray:
        """The pieces of code points: spaces become the word mark, a word mark of the text is no piece."""
        points = np.where(points == 32, ord(MARK), np.where(points == ord(MARK), 0x110000, points)).astype(np.int64)
        out = np.where(points < len(self.of_point), self.of_point[np.minimum(points, len(self.of_point) - 1)], GONE)
        points = np.where(points == 0x110000, ord(MARK), points)
        return np.where(out == GONE, OTHER - points, out).astype(np.int32)

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the vocabulary for ids, with byte pieces for what it lacks, and how many there are for each."""
        many = np.ones(len(ids), np.int64)
        odd = np.flatnonzero((ids <= OTHER) | (ids >= len(self.text)))
        if not len(odd):
            return ids, many
        shown = [(self.beyond.get(i) or chr(OTHER - i)).encode("utf-8", "surrogatepass") for i in ids[odd].tolist()]
        many[odd] = [len(x) for x in shown]
        out = np.repeat(ids, many)
        at = np.cumsum(many)[odd] - many[odd]
        out[np.repeat(at - (np.cumsum(many[odd]) - many[odd]), many[odd]) + np.arange(many[odd].sum())] = self.byte[np.frombuffer(b"".join(shown), np.uint8)]
        return out, many


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    x = ((x ^ (x >> 30)) * _M1) & _MASK
    x = ((x ^ (x >> 27)) * _M2) & _MASK
    return x ^ (x >> 31)


class Segmenter:
    """Texts to packed ids."""

    def __init__(self, path: str, seed: int, rate: float):
        self.v, self.seed = Vocabulary(path), seed
        #: A candidate is skipped if its hash is smaller.
        self.below = min(max(int(rate * 2.0**64), 0), 1 << 64)

    def side_by_side(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """Agendas of chunks as rows between two EDGEs; rows become pieces in place. keys are those of their draws."""
        ranks, n, w = self.v.ranks, *rows.shape
        p = rows.ravel()
        after = np.tile(np.arange(1, w + 1, dtype=np.int16), n)
        before = np.tile(np.arange(-1, w - 1, dtype=np.int16), n)
        agenda = np.full((n, w), NEVER)
        agenda[:, 1 : w - 2] = ranks(rows[:, 1 : w - 2].ravel(), rows[:, 2 : w - 1].ravel()).reshape(n, w - 3)
        base, met = np.arange(n, dtype=np.int64) * w, 0
        while True:
            i = agenda.argmin(1)
            best = agenda[np.arange(len(agenda)), i]
            live = best != NEVER
            if not live.all():
                agenda, i, best, base, keys = agenda[live], i[live], best[live], base[live], keys[live]
                if not len(agenda):
                    return
            own = np.arange(len(agenda)) * w
            flat = agenda.ravel()
            if self.below:
                draw = mixed(keys + np.uint64(met * _GOLDEN & _MASK))
                skip = draw < np.uint64(self.below) if self.below <= _MASK else np.ones(len(draw), bool)
                flat[(own + i)[skip]] = NEVER
                go = np.flatnonzero(~skip)
                at, i, own, best = base[go], i[go], own[go], best[go]
            else:
                at = base
            met += 1
            f = at + i
            j = after[f]
            k = after[at + j]
            h = before[f]
            piece = self.v.made[best]
            if self.v.ties and (piece == GONE).any():
                tied = np.flatnonzero(piece == GONE)
                piece[tied] = self.v.piece[self.v.find(p[f[tied]], p[at[tied] + j[tied]])]
            p[f], p[at + j] = piece, GONE
            after[f], before[at + k] = k, i
            new = ranks(np.concatenate([piece, p[at + h]]), np.concatenate([p[at + k], piece]))
            flat[own + j] = NEVER
            flat[own + i], flat[own + h] = new[: len(f)], new[len(f) :]

    def one(self, piece: list[int], key: int) -> list[int]:
        """The same for one chunk, by a heap. An entry is rank << 32 | place; pair[i] is the rank of what piece i and the
        next one would make, so an entry whose pair has changed since is known as outdated."""
        n = len(piece)
        rank = lambda x, y: int(self.v.ranks(np.array([x]), np.array([y]))[0])
        after, before, met = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        pair = [*self.v.ranks(np.array(piece[:-1], np.int64), np.array(piece[1:], np.int64)).tolist(), int(NEVER)]
        agenda = [r << 32 | i for i, r in enumerate(pair) if r != NEVER]
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue  # a neighbour has been merged since
            met += 1
            if mixed_one((key + (met - 1) * _GOLDEN) & _MASK) < self.below:
                pair[i] = int(NEVER)
                continue
            j = after[i]
            k = after[i] = after[j]
            made = int(self.v.piece[self.v.find(np.array([piece[i]]), np.array([piece[j]]))[0]])
            piece[i], piece[j], pair[j], pair[i] = made, GONE, int(NEVER), int(NEVER)
            if k < n:
                before[k] = i
                pair[i] = rank(piece[i], piece[k])
            h = before[i]
            if h >= 0:
                pair[h] = rank(piece[h], piece[i])
            agenda_of = [i] if h < 0 else [i, h]
            for x in agenda_of:
                if pair[x] != NEVER:
                    heapq.heappush(agenda, pair[x] << 32 | x)
        return piece

    def chunks(self, p: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> None:
        """Merge what is next to each other in chunks that begin at `starts`, in place; keys are those of their draws."""
        size = np.diff(starts, append=len(p))
        least = 1
        for most in LENGTHS:
            own = np.flatnonzero((size > least) & (size <= most))
            least = most
            if len(own):
                rows = np.full((len(own), most + 2), EDGE, np.int32)
                at = starts[own][:, None] + np.arange(most)
                if most == 2 or most - 1 in LENGTHS:
                    rows[:, 1:-1] = p[at]
                    self.side_by_side(rows, keys[own])
                    p[at] = rows[:, 1:-1]
                else:
                    inside = np.arange(most) < size[own][:, None]
                    mid = rows[:, 1:-1]
                    mid[inside] = p[at[inside]]
                    self.side_by_side(rows, keys[own])
                    p[at[inside]] = mid[inside]
        for c in np.flatnonzero(size > LENGTHS[-1]).tolist():
            a, b = int(starts[c]), int(starts[c] + size[c])
            p[a:b] = self.one(p[a:b].tolist(), int(keys[c]))

    def encode_all(self, texts: list[str], doc_ids: list, dropout: bool = True) -> list[np.ndarray]:
        """Ids of whole texts. Every chunk of every document has draws of its own; rows of one doc_id have the same."""
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        first = np.cumsum(sizes) - sizes
        alone = (points == 10) | (points == ord(MARK))
        begins = alone.copy()
        begins[1:] |= alone[:-1] | ((points[1:] == 32) & (points[:-1] != 32))
        begins[first[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        p = self.v.pieces(points)
        keep = self.below
        if dropout:
            seeds = np.array([xxhash.xxh64_intdigest(f"{self.seed}|{d}") for d in doc_ids], np.uint64)
            number = np.cumsum(begins)[np.minimum(first, len(points) - 1)]  # chunks up to the document's first one
            of = np.searchsorted(first[sizes > 0], starts, "right") - 1
            place = (np.arange(1, len(starts) + 1) - number[sizes > 0][of]).astype(np.uint64)
            keys = mixed(seeds[sizes > 0][of] + (place + np.uint64(1)) * np.uint64(_GOLDEN))
        else:
            self.below, keys = 0, np.zeros(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # slices of whole chunks
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
            a, b = int(starts[at]), int(starts[to]) if to < len(starts) else len(points)
            self.chunks(p[a:b], starts[at:to] - a, keys[at:to])
            at = to
        self.below = keep
        left = p != GONE
        ends = np.cumsum(left)
        ids, many = self.v.spelled(p[left])
        ends = np.concatenate([[0], np.cumsum(many)])[ends]
        out, before = [], 0
        for a, n in zip(first.tolist(), sizes.tolist(), strict=True):
            to = int(ends[a + n - 1]) if n else before
            out.append(ids[before:to])
            before = to
        return out

    def encode(self, text: str, doc_id=None, dropout: bool = True) -> bytes:
        """Packed ids of a whole text."""
        return self.packed(self.encode_all([text], [doc_id], dropout)[0])

    def packed(self, ids: np.ndarray) -> bytes:
        return ids.astype("u2" if self.v.width == "H" else "u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: the pieces' texts joined, without the space that encoding puts before a text."""
        text = self.v.text
        return b"".join([text[i] for i in array(self.v.width, ids)])[1:].decode("utf-8", "surrogatepass")


_segmenters: dict[tuple, Segmenter] = {}


def segmenter(*how) -> Segmenter:
    """One per worker process and setting."""
    if how not in _segmenters:
        _segmenters[how] = Segmenter(*how)
    return _segmenters[how]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """docs with n_pieces, pieces (the ids) and decoded (the text that they decode to), which replace columns of
    the same names.

    Null and empty texts have no pieces and decode to the empty text. Rows of one doc_id draw alike, and null ids do,
    too, so equal rows have equal pieces. Every row of docs gives one row.
    """
    small_batches(docs.sparkSession, 500)
    path = path or default_path()

    def maker():
        s = segmenter(path, seed, rate)

        def make(ids: list, texts: list[str | None]) -> list[list]:
            arrays = s.encode_all([t or "" for t in texts], ids)
            return [list(map(len, arrays)), arrays, [s.decode(s.packed(x)) for x in arrays]]

        return make

    return with_made(docs, [id_col, text_col], "n_pieces long, pieces array<int>, decoded string", maker)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """As encode(), with digests in place of ids and texts: docs with n_pieces, ids_crc32 (of the ids as little-
    endian uint32) and lossless (whether the ids decode to the text, null being empty)."""
    small_batches(docs.sparkSession, 500)
    path = path or default_path()

    def maker():
        s = segmenter(path, seed, rate)

        def make(ids: list, texts: list[str | None]) -> list[list]:
            arrays = s.encode_all([t or "" for t in texts], ids)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in arrays]
            same = [s.decode(s.packed(x)) == (t or "") for x, t in zip(arrays, texts, strict=True)]
            return [list(map(len, arrays)), crc, same]

        return make

    return with_made(docs, [id_col, text_col], "n_pieces long, ids_crc32 long, lossless boolean", maker)


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless) of every document."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
