"""Ids of added tokens as a freshly loaded tokenizer gives them."""

import zlib

import numpy as np

from foliary.llm import op10_token_ids

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_added_tokens_as_a_fresh_tokenizer(spark):
    from tokenizers import Tokenizer

    fresh, e = Tokenizer.from_file(op10_token_ids.default_path()), op10_token_ids.Encoder(op10_token_ids.default_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "plain words here", "<|endoftext", "a\t<|endoftext|>"]
    want = [fresh.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(e(x), "<u2").tolist() for x in texts] == want and 50256 in want[0]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], SCHEMA)
    blocks, length = op10_token_ids.write_ids(docs)
    got = sorted(op10_token_ids.read_ids(blocks, length, with_ids=False).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for w in want]
