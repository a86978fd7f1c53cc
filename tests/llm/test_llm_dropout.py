"""Merge-dropout against a plain loop, with draws for every place of every document."""

import re
from collections import Counter

import numpy as np
import xxhash
from sentencepiece import SentencePieceProcessor

from foliary.llm import op3_pieces as m

MASK = (1 << 64) - 1
TEXTS = [
    "unbelievable, internationalisation; (constitutional) reorganisation " * 3, "a  b   c      d", "▁ naïve ▁▁ 日本語 😀\r\n\x00", "x" * 90 + " " + "ab" * 40, "\n\n \n", "one\ntwo  three", "é" * 60, " ", "end ",
]


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain(sp, text, doc_id, seed, rate):
    """All neighbours looked at again for every candidate, on strings."""
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    out, place = [], 0
    for part in re.findall("▁|\n| +[^ \n▁]*|[^ \n▁]+", " " + text if text else ""):
        place += 1
        key = mix((xxhash.xxh64_intdigest(f"{seed}|{doc_id}") + place * 0x9E3779B97F4A7C15) & MASK)
        pieces = ["own"] if part == "▁" else list(part.replace(" ", "▁"))
        out_of, met = [False] * len(pieces), 0  # whether the pair that begins here has been skipped
        while True:
            some = [(-score[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in score and not out_of[i]]
            if not some:
                break
            i = min(some)[1]
            skip = mix((key + met * 0x9E3779B97F4A7C15) & MASK) < int(rate * 2.0**64)
            met += 1
            if skip:
                out_of[i] = True
                continue
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            out_of[i : i + 2] = [False]
            if i:
                out_of[i - 1] = False
        for x in pieces:
            out += [sp.piece_to_id(x)] if x in score and part != "▁" else [sp.piece_to_id(f"<0x{b:02X}>") for b in (part if part == "▁" else x).encode()]
    return out


def test_dropout_against_a_plain_loop(monkeypatch):
    sp = SentencePieceProcessor(model_file=m.default_path())
    for rate in (0.0, 0.1, 0.4, 1.0):
        s = m.Segmenter(m.default_path(), 11, rate)
        got = s.encode_all(TEXTS, list(range(len(TEXTS))))
        for i, t in enumerate(TEXTS):
            assert got[i].tolist() == plain(sp, t, i, 11, rate), (rate, t)
            assert s.decode(s.packed(got[i])) == t
    want = [x.tolist() for x in got]
    monkeypatch.setattr(m, "SLICE", 40)
    assert [x.tolist() for x in s.encode_all(TEXTS, list(range(len(TEXTS))))] == want
    assert [s.encode_all([t], [i])[0].tolist() for i, t in enumerate(TEXTS)] == want


def test_dropout_has_draws_of_its_own_at_every_place():
    s = m.Segmenter(m.default_path(), 11, 0.1)
    among = Counter(s.encode("international", i) for i in range(400))
    assert {s.decode(x) for x in among} == {"international"}
    plain_ids = s.encode("international", dropout=False)
    assert len(among) > 4 and 0.2 < among[plain_ids] / 400 < 0.9
    within = s.encode(" ".join(["international"] * 400), 1)
    assert len(within) > len(plain_ids) * 400 and s.decode(within) == " ".join(["international"] * 400)
    assert np.frombuffer(within, s.v.width).tolist() == np.frombuffer(m.Segmenter(m.default_path(), 11, 0.1).encode(" ".join(["international"] * 400), 1), s.v.width).tolist()
