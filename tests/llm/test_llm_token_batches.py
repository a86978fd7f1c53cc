"""Ids of whole batches of texts: those of the library, with each distinct word looked up once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliary.llm import op10_token_ids

WORDS = ["it's", "don't,", "x", "Éa.", "été...", "日本", "12.5", "(a)", "a-b", "--", "²½!", "à\u0300,", "<|endoftext|>", "\u00a0", "a\tb", "", "\n"]


@pytest.fixture(scope="module")
def encode():
    return op10_token_ids.Encoder(op10_token_ids.default_path())


def test_a_batch_as_the_library(encode):
    rng = np.random.default_rng(5)
    texts = ["".join(x + rng.choice([" ", " ", " ", "\n"]) for x in rng.choice(WORDS[: rng.integers(12, 18)], rng.integers(1, 9))).rstrip(rng.choice(["", " \n"])) for _ in range(3000)]
    texts = ["", None, *texts, None, "\na", " a", "a ", "a\n", "end"]
    ids, n = encode.texts(pa.array(texts))
    want = [[*(encode.library.encode(x, add_special_tokens=False).ids if x else []), op10_token_ids.END] for x in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    ids, n = encode.texts(pa.array([None], pa.string()))
    assert (n.tolist(), ids.tolist()) == ([1], [op10_token_ids.END])


def test_white_space_and_marks_of_any_text(encode):
    letters = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(letters[i : i + 7]) + "!" for i in range(0, len(letters), 7)] + [f"{c}!. a{c}, b\n{c}-" for c in letters[::5]]
    ids, _ = encode.texts(pa.array(texts))
    assert ids.tolist() == [i for x in encode.library.encode_batch(texts, add_special_tokens=False) for i in [*x.ids, op10_token_ids.END]]


def test_words_are_looked_up_once(encode):
    met = []

    class Counted(op10_token_ids._Words):
        def __getitem__(self, word):
            met.append(word)
            return super().__getitem__(word)

    before = encode.line.__class__
    encode.line.__class__ = encode.word.__class__ = Counted
    try:
        text = "beta " + "alpha beta, gamma.\n" * 500 + "end"
        assert encode(text) == encode.ids(text)
    finally:
        encode.line.__class__ = encode.word.__class__ = before
    assert 0 < len(met) <= 10


def test_counts_and_ids_of_several_batches(spark, encode):
    docs = spark.createDataFrame([(i, f"word{i} the end,\nof {i % 7}") for i in range(9000)] + [(9000, None)], "doc_id long, text string").repartition(3)
    tokens = op10_token_ids.tokenize(docs, "doc_id", "text", op10_token_ids.default_path(), [4500]).cache()
    got = {r.doc_id: (r.bucket, r.n, bytes(r.ids)) for r in tokens.where("counts IS NULL").collect()}
    end = np.array([op10_token_ids.END], "<u2").tobytes()
    assert len(got) == 9001 and got[9000] == (1, 1, end)
    for i in range(0, 9000, 250):
        ids = encode.ids(f"word{i} the end,\nof {i % 7}") + end
        assert got[i] == (i >= 4500, len(ids) // 2, ids)
    assert op10_token_ids.id_counts(tokens).sum() == tokens.where("counts IS NULL").agg(F.sum("n")).first()[0]
