"""Token ids of whole texts, written as Huffman-coded blocks and read back.

File format: a table of blocks in the shared folder, one row a block, written by Spark's committer so that lost
executors leave no partial files. A block is independent: magic, global position of its first id, number of ids, bit
offsets of every STRIDE-th id, code bits; beside it stand the ids and lengths of its documents. The codes are canonical,
of limited length and follow from the counts of all ids, so the header of the file is one length per id.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import huffman
from foliary.llm.common import discard, small_batches, staged, table
from foliary.llm.ordered import range_of, split_points

END = 0
#: A block takes whole documents until it has this many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 19
#: Documents of a range of doc_id, which is one task of the writer.
ROWS = 4096
#: Documents of a batch of the tokenizer: the more, the fewer times a word is looked up.
BATCH = 2048
#: Words of one generation of a worker's cache, after a space and without one. When it is full, what the last generation has used is kept.
CACHE, LINES = 800_000, 200_000
#: ASCII characters that are no letter, digit or white space; a run of them after a letter or digit is cut off by the vocabulary's pattern.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that white space other than single spaces and line feeds has left: nothing, a line feed alone, any with such a character.
ODD = "^\n?$|[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def byte_characters() -> dict[int, int]:
    """How byte-level vocabularies show bytes: printable Latin-1 characters as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(rest)}


class _Words(dict):
    """Encoded words, each met for the first time by `encode`."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.old.pop(word, None) or self.encode(word)
        return out

    def of(self, words: pa.Array) -> pa.Array:
        """What they are encoded to; an empty one is nothing."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        known = words.dictionary_encode()
        found = [self[x] if x else b"" for x in known.dictionary.to_numpy(zero_copy_only=False).tolist()]
        return pa.DictionaryArray.from_arrays(known.indices, pa.array(found, pa.large_binary())).dictionary_decode()


class Encoder:
    """The tokenizers library on whole texts, as packed ids.

    The vocabulary's own pattern never joins across a single space or line feed between two other characters, nor from
    a letter or digit to a punctuation mark, so a text is cut there and each distinct piece is encoded once per worker.
    Arrow cuts all texts of a batch, numbers their distinct words, and puts the ids in the words' places.
    A text with any other white space, or with an added token's content, goes to the library as a whole. Either way the
    ids are those of the library on the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: What the library takes as one id wherever a text has it.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.model, self.shown = self.library.model, byte_characters()
        self.space = chr(self.shown[32])
        self.feed = self.ids("\n")
        self.line, self.word = (_Words(partial(self.piece, before), most) for before, most in (("", LINES), (" ", CACHE)))

    def ids(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, before: str, word: str) -> bytes:
        """Ids of a word with what stands before it; one of letters is one piece of the pattern, straight from the library's model."""
        if not word.isalpha():
            return self.ids(before + word)
        if word.isascii():
            shown = self.space + word if before else word
        else:
            shown = (before + word).encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def words(self, words: pa.Array, first: pa.Array) -> pa.Array:
        """Ids of words that may have a line feed before or else follow a space, unless they are the first of a text."""
        trimmed = pc.ascii_rtrim(words, MARKS)
        cut = pc.match_substring_regex(trimmed, "[\\pL\\pN]$")
        marks = pc.if_else(cut, pc.replace_substring_regex(words, "(?s)^.*[^!-/:-@\\[-`{-~]", ""), "")
        bare, fed = pc.ascii_ltrim(pc.if_else(cut, trimmed, words), "\n"), pc.starts_with(words, "\n")
        after = pc.or_(fed, first)
        feed = pc.if_else(fed, pa.scalar(self.feed, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        parts = self.word.of(pc.if_else(after, "", bare)), self.line.of(pc.if_else(after, bare, "")), self.line.of(marks)
        return pc.binary_join_element_wise(feed, *parts, pa.scalar(b"", pa.large_binary()))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END behind; how many of them each text has). A null text has END alone."""
        texts = texts.cast(pa.large_string())
        # A word has its line feed before it; "" and a lone line feed stand beside other white space.
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.cumsum(n)
        known = words.flatten().dictionary_encode()
        at, names = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary
        whole = np.zeros(len(n), bool)
        odd = pc.match_substring_regex(names, ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            whole[np.repeat(np.arange(len(n)), n)[odd[at]]] = True
        for x in self.added:
            whole |= pc.match_substring(texts, x).fill_null(False).to_numpy(zero_copy_only=False)
        begin = (stop - n)[(n > 0) & ~whole]
        lead, k = np.unique(at[begin], return_inverse=True)
        at[begin] = len(names) + k
        end = len(names) + len(lead)
        at[np.repeat(whole, n)] = end + 1
        names = pa.concat_arrays([pc.if_else(pa.array(np.bincount(at, minlength=end)[: len(names)] > 0), names, ""), names.take(pa.array(lead))])
        pieces = [array(self.code, [END]).tobytes(), b""]
        for i in np.flatnonzero(whole).tolist():
            at[stop[i] - n[i]] = end + len(pieces)
            pieces.append(self.ids(texts[i].as_py()))
        pieces = pa.concat_arrays([self.words(names, pa.array(np.arange(end) >= end - len(lead))), pa.array(pieces, pa.large_binary())])
        placed = pa.DictionaryArray.from_arrays(np.insert(at, stop, end), pieces).dictionary_decode()
        _, offsets, data = placed.buffers()
        to = np.frombuffer(offsets, np.int64, len(placed) + 1)[np.r_[0, stop + np.arange(1, len(n) + 1)]] // self.width
        return np.frombuffer(data, f"u{self.width}", to[-1]), np.diff(to)

    def __call__(self, text: str) -> bytes:
        return self.texts(pa.array([text]))[0][:-1].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, id_col: str, text_col: str, path: str, points: list[int]) -> DataFrame:
    """(bucket, doc_id, n, ids, counts): each document's packed ids, and per task one row with only counts: the n ids that
    the task has met, as uint32, and how often, as int64."""
    small_batches(docs.sparkSession, BATCH)

    def row_batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["bucket", "doc_id", "n", "ids", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(path), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = encode.texts(b.column("text"))
            c = np.bincount(ids, minlength=len(counts))
            c[: len(counts)] += counts
            counts = c
            offsets = np.r_[0, np.cumsum(n)] * encode.width
            found = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
            yield row_batch(b.column("bucket"), b.column("doc_id"), pa.array(n, pa.int64()), found, pa.nulls(len(n), pa.binary()))
        at = np.flatnonzero(counts).astype("<u4")
        met = at.tobytes() + counts[at].astype("<i8").tobytes()
        yield row_batch(pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([len(at)], pa.int64()), pa.nulls(1, pa.binary()), pa.array([met], pa.binary()))

    rows = docs.select(range_of(points, F.col(id_col).cast("long")).alias("bucket"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "bucket int, doc_id long, n long, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids; the driver gets one row per id of the vocabulary, summed up by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, x in zip(b["n"], b["counts"], strict=True):
                yield pd.DataFrame({"id": np.frombuffer(x, "<u4", n).astype("i8"), "n": np.frombuffer(x, "<i8", n, 4 * n)})

    rows = tokens.where("counts IS NOT NULL").select("n", "counts").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([END, *(r.id for r in rows)]) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """The file: (blocks, code lengths). blocks has first, doc_ids, sizes and the block's bytes, in ascending doc_id order.

    Null texts are empty: they have the end id alone. A null doc_id comes first; rows of one doc_id follow each other in
    the order of their ids. An empty table gives a file without blocks. Other columns are not read.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    points = split_points(ids, ROWS)
    tokens = staged(tokenize(docs, id_col, text_col, path or default_path(), points))
    small_batches(docs.sparkSession)
    length = huffman.lengths(id_counts(tokens))
    per = tokens.where("counts IS NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    firsts, at = {}, 0
    for r in sorted(per):
        firsts[r.bucket], at = at, at + r.n
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((firsts, huffman.packed(length)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, packed = known.value
        _encoders.clear()  # this worker may hold words of the first stage
        bucket, at, have, doc_ids, sizes, held = None, 0, 0, [], [], []

        def block() -> pd.DataFrame:
            out = huffman.encode(np.concatenate(held), packed, at)
            return pd.DataFrame({"first": [at], "doc_ids": [doc_ids], "sizes": [sizes], "block": [out]})

        for b in batches:
            for k, d, n, x in zip(b["bucket"], b["doc_id"], b["n"], b["ids"], strict=True):
                if held and (k != bucket or have + n > BLOCK_IDS):
                    yield block()
                    at, have, doc_ids, sizes, held = at + have, 0, [], [], []
                if k != bucket:
                    bucket, at = k, firsts[k]
                doc_ids.append(None if pd.isna(d) else int(d))
                sizes.append(int(n))
                held.append(np.frombuffer(x, f"u{len(x) // n}"))
                have += n
        if held:
            yield block()

    rows = tokens.where("counts IS NULL").drop("counts").repartitionById(max(1, len(points) + 1), F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    blocks = rows.mapInPandas(run, "first long, doc_ids array<long>, sizes array<long>, block binary")
    file = staged(blocks, "none")
    discard(tokens)
    return file, length


def read_ids(blocks: DataFrame, length: np.ndarray, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the file, and its ids as an array unless left out."""
    known = blocks.sparkSession.sparkContext.broadcast(huffman.table(length))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, size = known.value
        _encoders.clear()
        for b in batches:
            for doc_ids, sizes, block in zip(b["doc_ids"], b["sizes"], b["block"], strict=True):
                at, ids = huffman.decode(block, symbol, size)
                ids, sizes = ids.astype("<u4"), np.asarray(sizes, np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                made = {"doc_id": pd.array(doc_ids, "Int64"), "start": at + ends - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(x) for x in parts]}
                yield pd.DataFrame(made | ({"ids": [x.astype("i4") for x in parts]} if with_ids else {}))

    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write_ids() and read_ids() over all documents; null texts have the end id alone, an empty table gives no row."""
    blocks, length = write_ids(table(spark, sf_dir, "documents"))
    return read_ids(blocks, length, with_ids=False)
