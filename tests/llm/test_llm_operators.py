"""Each operator against brute force on small tables, and on awkward ones."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from foliary.llm import common, components, cover_tree, huffman, op1_sharding, op2_language, op3_pieces, op4_simhash, op5_sampling, op6_mix, op7_licenses, op8_topk, op9_pii, op10_token_ids
from foliary.llm.kneser_ney import ORDER, START, STOP, Model
from foliary.llm.ordered import split_points

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "the cat sat on the mat today", "en", "a", 28), (1, "the cat sat on the mat today", "en", "a", 28), (2, None, None, None, None), (None, "der hund und die katze", "de", "b", 22), (3, "", "en", "", 0),
    (4, "  \n\t ", None, "a", 5), (5, "x " * 30_000, "en", "a", 60_000), (6, "▁ naïve ▁▁ 日本語 😀\r\n\x00", "fr", "c", 20), (7, "one", "en", "b", 3), (8, "a" * 5000, "de", None, 5000), (9, "12 34 !!", "en", "c", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("shard", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("score", F.lit("z")).withColumn("b", F.lit(0)).withColumn("pieces", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r for r in docs.orderBy("doc_id").collect()}


# 1: shards


def test_ring_against_a_walk(docs, texts):
    got = {r.doc_id: r for r in op1_sharding.ring_shards(docs).collect()}
    nodes = op1_sharding.ring(40, op1_sharding.VNODES)
    room = op1_sharding.bounds_of(len(texts), 40, 0)
    keys = sorted((op1_sharding.position(f"key {i}"), i) for i in texts)
    arc = {i: next((k for k, (at, _) in enumerate(nodes) if at >= p), 0) for p, i in keys}
    wrapped = sorted(keys, key=lambda k: (arc[k[1]], k[0]))  # as the operator counts: by arc, then position
    shard, left = {}, []
    for _, i in wrapped:
        s = nodes[arc[i]][1]
        if room[s]:
            room[s] -= 1
            shard[i] = s
        else:
            left.append(i)
    for i in left:
        k = arc[i]
        while not room[nodes[k % len(nodes)][1]]:
            k += 1
        room[nodes[k % len(nodes)][1]] -= 1
        shard[i] = nodes[k % len(nodes)][1]
    assert {i: r.shard for i, r in got.items()} == shard
    n = Counter(shard.values())
    assert max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(n[s]))
    for i, r in got.items():
        t = (texts[i].text or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))


def test_ring_moves_little_when_it_grows(docs):
    at = lambda n: {r.doc_id: r.shard for r in op1_sharding.ring_shards(docs, shards=n, slack=0.25).collect()}
    a, b = at(8), at(9)
    assert sum(a[i] != b[i] for i in a) < 0.4 * len(a)


def test_arc_cells_cover_the_ring():
    cells = sorted(op1_sharding.arc_cells(op1_sharding.ring(5, 7)), key=lambda c: c[1])
    assert cells[0][1] == 0 and cells[-1][2] == op1_sharding.SPAN - 1
    assert all(a[2] + 1 == b[1] for a, b in zip(cells, cells[1:]))


def test_ring_on_odd_rows(odd, empty):
    r = op1_sharding.ring_shards(odd, shards=3).collect()
    n = Counter(x.shard for x in r)
    assert len(r) == len(ODD) and max(n.values()) - min(n.values()) <= 1
    assert len({(x.shard, x.slot) for x in r}) == len(r)
    assert op1_sharding.ring_shards(empty).count() == 0


# 2: languages


def brute_kn(counts, word, alphabet):
    """ln P of a word under interpolated Kneser-Ney, straight from its definition."""
    top = Counter(counts)
    level = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])

    def p(ctx, c):
        n = len(ctx) + 1
        lower = p(ctx[1:], c) if ctx else 1 / alphabet
        own = {g: k for g, k in level[n].items() if g[:-1] == ctx}
        if not own:
            return lower
        ones, twos = sum(k == 1 for k in level[n].values()), sum(k == 2 for k in level[n].values())
        d = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
        return max(own.get(ctx + c, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * lower

    text = START * (ORDER - 1) + word + STOP
    return sum(np.log(p(text[i : i + ORDER - 1], text[i + ORDER - 1])) for i in range(len(word) + 1))


def grams(words):
    out = Counter()
    for w in words:
        t = START * (ORDER - 1) + w + STOP
        out.update(t[i : i + ORDER] for i in range(len(w) + 1))
    return out


def test_kneser_ney_against_its_definition():
    a, b = grams(["the", "then", "there", "cat", "that"]), grams(["der", "die", "das", "dem", "den"])
    m = Model.of_counts(["en", "de"], [dict(a), dict(b)])
    alphabet = len({g[-1] for g in [*a, *b]}) + 1
    words = ["the", "that", "den", "zzz", "thdas", "e"]
    got = m.words(words)
    for w, row in zip(words, got):
        assert np.allclose(row, [brute_kn(a, w, alphabet), brute_kn(b, w, alphabet)], atol=1e-3)


def test_languages_of_held_out_documents(docs, texts):
    r = op2_language.identify(docs).collect()
    held = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)
    assert np.mean([x.lang_pred == texts[x.doc_id].lang for x in held]) >= 0.97
    assert not any(x.rejected for x in r if regex.search(r"\p{L}", texts[x.doc_id].text or ""))


def test_counts_models_and_predictions_against_plain_loops(spark, docs, texts):
    some = docs.where("length(text) < 400 AND lang IN ('de', 'fr')")
    rows = [r for r in some.collect()]
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 not in (0, 4)]
    split = lambda t: regex.findall(r"\p{L}{1,32}", t.lower())
    want = {lang: grams(w for r in learned if r.lang == lang for w in split(r.text)) for lang in ("de", "fr")}
    train = some.where("crc32(cast(cast(doc_id as string) as binary)) % 5 NOT IN (0, 4)")
    got = {(r.lang, r.gram): r.n for r in op2_language.gram_counts(train, counted_words=50).collect()}
    assert got == {(lang, g): n for lang, c in want.items() for g, n in c.items()}
    alphabet = len({g[-1] for c in want.values() for g in c}) + 1
    pred = {r.doc_id: r for r in op2_language.identify(some).collect()}
    for r in [r for r in rows if len(r.text) < 120][:12]:
        words = split(r.text)
        if words:
            n = sum(map(len, words)) + len(words)
            ce = {lang: -sum(brute_kn(c, w, alphabet) for w in words) / n for lang, c in want.items()}
            assert pred[r.doc_id].lang_pred == min(ce, key=ce.get)
            assert pred[r.doc_id].cross_entropy == pytest.approx(min(ce.values()), abs=1e-3)


def test_models_in_parts_are_the_whole_model(docs, odd):
    for df in (docs, odd):
        whole = op2_language.identify(df)
        parts = op2_language.identify(df, model_bytes=1 << 20)
        key = lambda r: (str(r.doc_id), r.lang_pred, r.cross_entropy or 0)
        for a, b in zip(sorted(whole.collect(), key=key), sorted(parts.collect(), key=key), strict=True):
            assert (a.doc_id, a.held_out, a.lang_pred, a.rejected) == (b.doc_id, b.held_out, b.lang_pred, b.rejected)
            assert (a.score, a.cross_entropy or 0) == pytest.approx((b.score, b.cross_entropy or 0), abs=1e-3)
    rows = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    trained = op2_language.train(rows, 1 << 20)
    assert len(trained.parts) > 1 and sorted(b for p in trained.parts for b in p) == list(range(op2_language.BUCKETS))


def test_calibration_takes_every_document_set_aside(spark, docs):
    some = {lang: [r.text[:90] for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(60).collect()] for lang in ("de", "fr")}
    rows = [(i, some[lang][i // 2 % len(some[lang])], lang) for i in range(21_000) for lang in [("de", "fr")[i % 2]]]
    trained = op2_language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    aside = [(text, trained.langs.index(lang)) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 5 == op2_language.SET_ASIDE]
    assert len(aside) > 4100
    found = [(*x, i) for x, (_, i) in zip(op2_language.Scorer(trained.whole)([t for t, _ in aside]), aside, strict=True) if x[1]]
    for i, lang in enumerate(trained.langs):
        p, n = np.array([(p[i], n) for p, n, own in found if own == i]).T
        mean = -p.sum() / n.sum()
        assert trained.known["mean"][lang] == pytest.approx(mean, abs=1e-8)
        assert trained.known["spread"][lang] == pytest.approx(np.sqrt((n * (-p / n - mean) ** 2).mean()), abs=1e-6)
    loss = lambda k: sum(np.log(np.exp(k * (p - p[i]) / np.sqrt(n)).sum()) for p, n, i in found)
    assert trained.known["scale"] == min((2.0**k for k in range(-4, 5)), key=loss)


def test_gibberish_is_rejected(spark, docs):
    trained = op2_language.fit(docs)
    rows = spark.createDataFrame([(1, "xqzj vwkx qqzz jxkv zzqx " * 20), (2, "!!! 123"), (3, None)], "doc_id int, text string")
    r = {x.doc_id: x for x in op2_language.predict(rows, trained).collect()}
    assert r[1].rejected and r[2].lang_pred == "und" and r[3].score == 0


def test_languages_on_odd_rows(odd, empty, docs):
    r = op2_language.identify(odd).collect()
    assert len(r) == len(ODD) and all(0 <= x.score <= 1 for x in r)
    none = {i for i, t, *_ in ODD if not regex.search(r"\p{L}", t or "")}
    assert {x.doc_id for x in r if x.lang_pred == "und"} == none
    assert op2_language.identify(empty).count() == 0
    assert all(x.rejected for x in op2_language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect())
    kept = op2_language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


# 3: pieces


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=op3_pieces.default_path())


def test_without_dropout_as_the_library(texts):
    s, sp = op3_pieces.Segmenter(op3_pieces.default_path(), 11, 0.1), library()
    for x in [*(r.text for r in list(texts.values())[:60]), "a  b", " x ", "x\ny\n\n", "", " ", "ﬁ ①\t", "<s> é"]:
        assert np.frombuffer(s.encode(x, dropout=False), s.v.width).tolist() == sp.encode(x)
        assert s.decode(s.encode(x, dropout=False)) == x


def test_dropout_varies_and_decodes(odd, docs):
    s, sp = op3_pieces.Segmenter(op3_pieces.default_path(), 11, 0.1), library()
    text = "several segmentations of these perfectly ordinary words are expected here\n" * 8
    some = {s.encode(text, i) for i in range(20)}
    assert len(some) > 10 and all(s.decode(x) == text for x in some)
    assert all(sp.decode(np.frombuffer(x, s.v.width).tolist()) == text for x in some)
    assert s.encode(text, 3) == op3_pieces.Segmenter(op3_pieces.default_path(), 11, 0.1).encode(text, 3)
    for df in (odd, docs):
        r = op3_pieces.encode(df).select("text", "decoded", "n_pieces", F.size("pieces").alias("k")).collect()
        assert all(x.decoded == (x.text or "") and x.n_pieces == x.k for x in r)


def test_pieces_of_empty_tables(empty, docs):
    assert op3_pieces.encode(empty).count() == 0
    assert op3_pieces.digests(docs).where("lossless").count() == docs.count()


# 4: near-duplicates


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_groups(fps, distance=4):
    ids, root = list(fps), {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition(texts):
    for r in [*list(texts.values())[:25]]:
        assert op4_simhash.fingerprint(r.text) == brute_fp(r.text)
    for x in (None, "", " \n", "One", "a b c d", "ÄB äb É x y Z"):
        assert op4_simhash.fingerprint(x) == brute_fp(x)


def test_groups_against_all_pairs(docs, texts):
    got = {r.doc_id: r.component_id for r in op4_simhash.simhash_groups(docs).collect()}
    assert got == brute_groups({i: brute_fp(r.text) for i, r in texts.items()})


def test_links_in_dense_balls(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 700:
        x = centre
        for b in rng.choice(64, rng.integers(1, 9), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 400)}
    df = spark.createDataFrame([(op4_simhash.signed(x),) for x in fps], "fp bigint")
    made = components.components(op4_simhash.links(df, block=64))
    root = {r.u: r.v for r in made.collect()}
    groups = brute_groups({op4_simhash.signed(x): x for x in sorted(fps, key=op4_simhash.signed)})
    assert {i: root.get(i, i) for i in groups} == groups


def test_components_of_a_long_path(spark):
    n = 300
    e = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)] + [(1000, 1001), (5, 5), (None, 3)], "a bigint, b bigint")
    r = {x.u: x.v for x in components.components(e).collect()}
    assert all(r.get(i, i) == 0 for i in range(n)) and r[1001] == 1000


def test_threshold_allocation_is_complete():
    for m in (3, 4, 5):
        parts = op4_simhash.partitions(np.eye(64), 1, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
    costs = [op4_simhash.probe_costs(p, np.array([0, 1 << p[0]], "u8"), np.array([5.0, 2.0]), 2) for p in op4_simhash.partitions(np.eye(64), 1, 4)]
    assert costs[0][1] == (25 + 4) / 2 + 20 * 7 and costs[0][2] == (5 * 7 + 2 * 7) / 2 + 20 * 7 * 17
    ts = op4_simhash.allocate(costs, 4)
    assert sum(t + 1 for t in ts) == 5


def test_near_duplicates_on_odd_rows(spark, odd, empty, docs):
    r = op4_simhash.simhash_groups(odd).collect()
    assert len(r) == len(ODD) and {x.component_id for x in r if x.doc_id in (2, 3, 4)} == {2}
    assert op4_simhash.simhash_groups(empty).count() == 0
    kept = op4_simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({x.component_id for x in r})
    assert op4_simhash.keep_one(docs).count() == op4_simhash.simhash_groups(docs).select("component_id").distinct().count()


# 5: weighted sampling


def shingles(text):
    w = text.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_samples_estimate_generalised_jaccard(docs, texts):
    rows = [(i, r.text) for i, r in texts.items()]
    got = {r.doc_id: r for r in op5_sampling.fingerprints(docs).collect()}
    off = []
    for k, (i, x) in enumerate(rows):
        y = rows[(k + 1) % len(rows)][1]
        q = len(x) // 4
        e = x[: len(x) - q] + y[:q]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        assert g.edited_fingerprint == op5_sampling.shown(op5_sampling.Document(0, e).signature)
        off += [g.near_edited - jaccard(shingles(x), shingles(e)), g.near_next - jaccard(shingles(x), shingles(y))]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.07


def test_weights_count():
    a, b = np.array([1] * 9 + [2], "u8"), np.array([1] + [2], "u8")
    sigs = [(op5_sampling.signature(a * np.uint64(k)), op5_sampling.signature(b * np.uint64(k))) for k in range(1, 2000, 2)]
    assert abs(np.mean([op5_sampling.likeness(x, y) for x, y in sigs]) - 2 / 10) < 0.02


def test_quantiles_of_the_draws():
    g = op5_sampling._gamma2()
    assert np.all(np.diff(g) > 0) and abs(g.mean() - 2) < 0.01 and abs(g.var() - 2) < 0.05


def test_sampling_on_odd_rows(odd, empty):
    r = op5_sampling.fingerprints(odd).collect()
    assert len(r) == len(ODD) and all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in r)
    same = [x.fingerprint for x in r if x.doc_id == 1]
    assert same[0] == same[1] and op5_sampling.fingerprints(empty).count() == 0
    one = op5_sampling.fingerprints(odd.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_ranges_of_any_size_agree(spark, docs):
    import foliary.llm.op5_sampling as m

    want = {r.doc_id: r.edited_sha256 for r in m.fingerprints(docs).collect()}
    keep, m.split_points = m.split_points, lambda ids: split_points(ids, 17)
    try:
        assert {r.doc_id: r.edited_sha256 for r in m.fingerprints(docs).collect()} == want
    finally:
        m.split_points = keep


# 6: mixing


def test_quotas_by_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = rng.integers(1, 1000, rng.integers(1, 9)).tolist()
        seats, most = int(rng.integers(0, 60)), [100] * len(t)
        want = [0] * len(t)
        for _ in range(seats):
            i = max(range(len(t)), key=lambda i: (Fraction(int(t[i]), 2 * want[i] + 1), -i))
            want[i] += 1
        assert op6_mix.sainte_lague([float(x) for x in t], seats, most) == want


def test_targets_stop_and_are_shared_again():
    t = op6_mix.targets([100, 1, 100], [1, 2, 3])
    assert t[1] == 3.0 and abs(sum(t) - 201) < 1e-9 and abs(t[2] / t[0] - 3) < 1e-9
    assert op6_mix.targets([0, 0], [1, 2]) == [0.0, 0.0] and op6_mix.targets([], []) == []


def test_mix_against_its_picks(docs, texts):
    r = op6_mix.mix(docs).collect()
    words = lambda t: len(regex.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(x["size"] == words(texts[x.doc_id].text) and 0 <= x.taken <= 3 * x["size"] for x in r)
    by = {}
    for x in r:
        s = by.setdefault(x.source, [x.target, 0])
        s[1] += x.taken
    assert all(abs(taken - target) <= 3 * op6_mix.BLOCK for target, taken in by.values())
    picks = op6_mix.mix_picks(docs).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()
    assert {x.doc_id: x.n for x in picks} == {x.doc_id: x.taken for x in r if x.taken}
    assert sorted(map(tuple, r), key=str) == sorted(map(tuple, op6_mix.mix(docs.repartition(7)).collect()), key=str)


def test_shards_of_the_mix_are_even(docs):
    n = op6_mix.mix_picks(docs).select("shard", "source", "pick").distinct().groupBy("shard").count().collect()
    assert len(n) == op6_mix.SHARDS and max(x["count"] for x in n) - min(x["count"] for x in n) <= 1


def test_mix_on_odd_rows(odd, empty):
    r = op6_mix.mix(odd).collect()
    assert len(r) == len(ODD) and sum(x.taken for x in r) > 0
    assert op6_mix.mix(empty).count() == 0 and op6_mix.mixed_rows(empty).count() == 0
    assert op6_mix.mixed_rows(odd).columns == odd.columns
    assert max(x["count"] for x in op6_mix.mixed_rows(odd.where("doc_id > 1")).groupBy("doc_id").count().collect()) <= 3


# 7: licences


def plain_matches(text):
    """All runs from hit to hit, by loops."""
    w = op7_licenses.words_of(text or "")
    g, out = [f"{a} {b}" for a, b in zip(w, w[1:])], []
    for n, (name, template) in enumerate(op7_licenses.TEMPLATES):
        b = op7_licenses.bigrams_of(template)
        most = int(1.5 * len(b))  # 2 |B| / (|A| + |B|) >= 0.8
        hits = [i for i, x in enumerate(g) if x in b]
        for i in hits:
            some = []
            for cap in (len(b), most):
                j = max(h for h in hits if i <= h < i + cap)
                a = set(g[i : j + 1])
                some.append((2 * len(a & b) / (len(a) + len(b)), -(j - i + 1)))
            dice, less = max(some)
            if dice >= 0.8:
                out.append((dice, -n, -i, -less, name))
    apart = lambda x, y: -x[2] + x[3] < -y[2] or -y[2] + y[3] < -x[2]
    return sorted((-x[2], x[4], x[3] + 1, x[0]) for x in out if all(apart(x, y) or y[:3] <= x[:3] for y in out))


def licences(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    return {r.doc_id: [(u.start, u.name, u.words, u.dice) for u in r.found] for r in op7_licenses.license_matches(df).collect()}


def test_licences_by_definition(spark, odd, empty, texts):
    full = {m: x for m, x in op7_licenses.TEMPLATES}
    wrap = lambda x: "\n".join(regex.findall(r".{1,60}(?:\s|$)", x))
    code = "\n".join(f"x{i} = call(y{i}, z) # of the software and the use of it" for i in range(200))
    lines = [
        "Released under the MIT License.", "RELEASED!! under the MIT*** license", "Released under the License", "no licence here at all", "x\nLicensed under CC BY-NC 4.0.\ny",
        "All of it is released under the MIT License unless said otherwise in a file", f"{code}\n{wrap(full['MIT'])}\n{code}", f"{wrap(full['BSD-3-Clause'])}\n{code}", "# " + wrap(full["GPL-3.0"]).replace("\n", "\n# ") + code,
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", None, "", "license " * 500, "of the " * 200, full["BSD-2-Clause"] + " " + full["Zlib"],
        *(r.text for r in texts.values() if "icense" in (r.text or "")),
    ]
    got = licences(spark, lines)
    for i, text in enumerate(lines):
        want = plain_matches(text)
        assert [x[:3] for x in got[i]] == [x[:3] for x in want] and [x[3] for x in got[i]] == pytest.approx([x[3] for x in want]), text
    name = lambda i: [x[1] for x in got[i]]
    assert name(0) == name(1) == name(5) == name(6) == ["MIT"] and name(2) == name(3) == [] and name(4) == ["CC-BY-NC-4.0"] and name(7) == ["BSD-3-Clause"] and name(8) == ["GPL-3.0"]
    assert name(9) == ["MIT", "Apache-2.0", "MIT"] and name(14) == ["BSD-2-Clause", "Zlib"]
    r = op7_licenses.license_matches(odd).collect()
    assert len(r) == len(ODD) and not any(x.found for x in r) and op7_licenses.license_matches(empty).count() == 0


def test_every_template_finds_itself(spark):
    got = licences(spark, [x for _, x in op7_licenses.TEMPLATES])
    assert all(name in [x[1] for x in got[i]] and max(x[3] for x in got[i]) == 1 for i, (name, _) in enumerate(op7_licenses.TEMPLATES))


# 8: top k


def brute_topk(q, qi, r, ri, k):
    out = []
    for v, i in zip(q, qi):
        rank = sorted((-int(v @ w), int(j)) for w, j in zip(r, ri) if j != i)[:k]
        out.append([(-s, j) for s, j in rank])
    return out


@pytest.mark.parametrize("spread", [1, 40, 4000])
def test_dual_trees_against_brute_force(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (12, 6))
    r = (centres[rng.integers(0, 12, 900)] + rng.integers(-1, 2, (900, 6))).astype("f8")
    ids = rng.permutation(900) * 5
    q, qi = r[:80], ids[:80]
    b = cover_tree.search(q, qi, r, ids, 5)
    assert [[(int(s), int(i)) for s, i in zip(x, y)] for x, y in zip(b.score, b.id)] == brute_topk(q, qi, r, ids, 5)


def test_tree_invariants():
    x = np.random.default_rng(2).integers(-50, 50, (500, 4)).astype("f8")
    t = cover_tree.Tree(x, 8)
    for n in range(len(t.radius)):
        d = np.sqrt(((x[t.under(n)] - t.center[n]) ** 2).sum(1))
        assert d.max() <= t.radius[n]
        kids = t.below(np.array([n]))
        if len(kids):
            assert (t.center[kids[0]] == t.center[n]).all()
            gaps = np.sqrt(((t.center[kids][:, None] - t.center[kids][None]) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
            assert gaps.min() > d.max() / cover_tree.BASE
    assert sorted(t.under(0).tolist()) == list(range(500))


def test_unusual_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.5]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (50, [-0.001, 0.0]), (50, [-0.001, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    r = op8_topk.top_k(df).orderBy("query_id", "rank").collect()
    assert [(x["rank"], x.vec_id, x.score) for x in r if x.query_id == 0] == [(1, 1, 65536), (2, 2, 65536), (3, 7, 32768), (4, 8, 0), (5, 50, -128)]
    assert [x.vec_id for x in r if x.query_id == 50] == [8, 0, 1, 2, 7]
    assert op8_topk.top_k(df.where("vec_id > 900")).count() == 0


def test_blocks_of_any_size_agree(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = sorted(map(tuple, op8_topk.top_k(v).collect()))
    keep = op8_topk.BLOCK_ROWS, op8_topk.QUERY_ROWS
    op8_topk.BLOCK_ROWS, op8_topk.QUERY_ROWS = (37, 64), 3
    try:
        assert sorted(map(tuple, op8_topk.top_k(v).collect())) == want
    finally:
        op8_topk.BLOCK_ROWS, op8_topk.QUERY_ROWS = keep


# 9: personal data

PII = [
    (1, "Mail jörg.99@mail7.example.com or +1 (743) 555-3824, card 4111111111111111!"), (2, "MAIL JOHN@EXAMPLE.ORG from 10.0.0.1 and 152.143.123.131###"), (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 078-05-1120'),
    (4, "Mrs. Anna Schmidt met Dr Weber; Mrs. Anna Schmidt and Herr Weber left. г-н Петров"), (5, "again jörg.99@mail7.example.com"), (6, "nothing private, version 2.0, 1924, 3.14"), (7, None), (8, ""), (9, "DE89370400440532013000 4111-1111-1111-1111"),
]


def test_surrogates(spark):
    df = spark.createDataFrame(PII, "doc_id int, text string").withColumn("t", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("k", F.lit(2))
    r = {x.doc_id: x for x in op9_pii.pseudonymize(df, "key", count_col="found").collect()}
    assert r[6].text == PII[5][1] and r[7].text is None and r[8].text == "" and r[6].found == 0 and r[1].t == "clash"
    for i, secret in ((1, "jörg.99@mail7"), (1, "743) 555-3824"), (1, "4111111111111111"), (2, "JOHN@EXAMPLE.ORG"), (2, "152.143.123.131"), (3, "04dbebab"), (3, "078-05-1120"), (4, "Anna"), (4, "Schmidt"), (4, "Weber"), (4, "Петров"), (9, "DE8937040044"), (9, "4111-1111")):
        assert secret not in r[i].text
    mail = regex.search(r"Mail (\S+) or \+1 \((\d{3})\) (\d{3}-\d{4}), card (\d{16})!", r[1].text)
    assert mail and r[5].text == f"again {mail[1]}"
    digits = [int(c) for c in mail[4]][::-1]
    assert sum(digits[0::2]) % 10 == (10 - sum((2 * d - 9 if d > 4 else 2 * d) for d in digits[1::2]) % 10) % 10
    assert regex.search(r"^MAIL [A-Z]{4}@[A-Z]{7}\.EXAMPLE from 10\.\d+\.\d+\.\d+ and 10\.\d+\.\d+\.\d+###$", r[2].text)
    assert regex.search(r'^token = "[0-9a-f]{40}" 9\d\d-\d\d-\d{4}$', r[3].text)
    m = regex.search(r"^Mrs\. (\w+) (\w+) met Dr (\w+); Mrs\. (\w+) (\w+) and Herr (\w+) left\. г-н ([А-Яа-я]+)$", r[4].text)
    assert m and m[1] == m[4] and m[2] == m[5] and m[3] == m[6] and m[1].endswith(tuple(op9_pii.ENDS["latin", "given_f"]))
    assert m[7].endswith(tuple(op9_pii.ENDS["cyrillic", "surname_inflected"]))
    m = regex.search(r"^DE([0-9]{20}) \d{4}-\d{4}-\d{4}-\d{4}$", r[9].text)
    assert m and int(f"{m[1][2:]}1314{m[1][:2]}") % 97 == 1
    assert r[4].found == 7


NAMES = [
    (1, "Mrs. Anna Schmidt met Dr Weber. Herr Weber left; Weber was late, Webern too. Herr Schmidt called. Anna and Schmidt's dog"),
    (2, "Dr Anna Weber and Herr Kim Weber. Prof. Kim stayed"), (3, "Anna, Weber and Schmidt are not known here"), (4, "г-н Иван Петров, г-жа Петрова, Петрова и Петров; г-жа Коваленко"),
    (5, "a@mail.example.com b@mail.example.com B@MAIL.EXAMPLE.COM"), (6, "fe80:0:0:0:0:0:0:1 and 2001:db8::ff00:42 at 12:30:45"), (7, "no card 4111111111111112, no IBAN DE00370400440532013000"), (8, "x\ufdd0 Herr Weber 10.0.0.1\ufdd0"),
]


def test_names_of_one_person_and_other_mentions(spark):
    r = {x.doc_id: x for x in op9_pii.pseudonymize(spark.createDataFrame(NAMES, "doc_id int, text string"), "key", count_col="n").collect()}
    w = r"([\p{L}]+)"
    a = regex.fullmatch(rf"Mrs\. {w} {w} met Dr {w}\. Herr {w} left; {w} was late, Webern too\. Herr {w} called\. {w} and {w}'s dog", r[1].text)
    anna, schmidt, weber = a[1], a[2], a[3]
    assert a[4] == a[5] == weber and a[6] == a[8] == schmidt and a[7] == anna and r[1].n == 8
    assert len({anna, schmidt, weber, "Anna", "Schmidt", "Weber"}) == 6 and anna.endswith(tuple(op9_pii.ENDS["latin", "given_f"]))
    b = regex.fullmatch(rf"Dr {w} {w} and Herr {w} {w}\. Prof\. {w} stayed", r[2].text)
    assert b[1] == anna and b[2] == b[4] == weber and b[3].endswith(tuple(op9_pii.ENDS["latin", "given_m"])) and b[5] != "Kim"
    assert r[3].text == NAMES[2][1] and r[3].n == 0 and r[7].text == NAMES[6][1] and r[7].n == 0
    c = regex.fullmatch(rf"г-н {w} {w}, г-жа {w}, {w} и {w}; г-жа {w}", r[4].text)
    assert c[3] == c[4] == c[2] + "а" and c[5] == c[2] and c[2] != "Петров" and c[6].endswith(tuple(op9_pii.ENDS["cyrillic", "surname"]))
    hosts = [x.split("@") for x in r[5].text.split()]
    assert hosts[0][1] == hosts[1][1] == hosts[2][1].lower() and hosts[0][0] != hosts[1][0] and hosts[2][1].isupper()
    assert regex.fullmatch(r"fd00(:\d){7} and fd00:[0-9a-f]{2}\d::[a-f]{2}\d\d:\d\d at 12:30:45", r[6].text)
    assert regex.fullmatch(rf"x\ufdd0 Herr {weber} 10\.\d+\.\d+\.\d+\ufdd0", r[8].text)


def test_thousands_of_names_stay_names(spark):
    rows = [(f"given_{'mf'[i % 2]}", f"N{i}") for i in range(2500)] + [("surname", f"S{i}") for i in range(2500)]
    r = op9_pii.assign(spark.createDataFrame(rows, "kind string, value string"), "key").collect()
    assert len({x.s for x in r}) == 5000 and all(x.s.endswith(tuple(op9_pii.ENDS["latin", x.kind])) and x.s.istitle() for x in r)


def test_text_outside_of_entities_stays(docs, texts):
    """Every text against its entities' places, found by the patterns in Python."""
    find = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in op9_pii.PATTERNS.items()))
    luhn = lambda v: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(regex.sub("[ -]", "", v)[::-1])) % 10 == 0
    got, given = {r.doc_id: r for r in op9_pii.pseudonymize(docs, "key", count_col="n").collect()}, {}
    for i, row in texts.items():
        spans = [m for m in find.finditer(row.text or "") if m.lastgroup != "card" or luhn(m[0])]
        assert got[i].n == len(spans)
        gaps = [(row.text or "")[a:b] for a, b in zip([0, *[m.end() for m in spans]], [*[m.start() for m in spans], None])]
        m = regex.fullmatch("(.+?)".join(map(regex.escape, gaps)), got[i].text or "", regex.S)
        assert m
        for old, new in zip(spans, m.groups()):
            assert given.setdefault(old[0], new) == new and len(new) in (len(old[0]), *range(8 if old.lastgroup == "ip" else 0, 16), len(old[0]) + 4)
    assert len(set(given.values())) == len(given) and not set(given.values()) & given.keys()


def test_distinct_entities_stay_distinct(spark):
    rows = [("ip", f"1.2.{i // 256}.{i % 256}") for i in range(600)] + [("surname", w) for w in {"Q" + "".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(300)} | {"Berger"}]
    r = op9_pii.assign(spark.createDataFrame(rows, "kind string, value string"), "key").collect()
    assert len(r) == len(rows) and len({x.s for x in r}) == len(rows)
    assert not {x.s for x in r} & {v for _, v in rows}
    again = op9_pii.assign(spark.createDataFrame(rows[::-1], "kind string, value string").repartition(5), "key").collect()
    assert {(x.kind, x.value, x.s) for x in again} == {(x.kind, x.value, x.s) for x in r}


def test_all_of_the_documents_entities_go(docs, texts):
    find = regex.compile(r"[\p{L}\p{N}._%+-]+@[\w.-]+\.\p{L}+|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) 555-\d{4}|\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b")
    n = 0
    for r in op9_pii.pseudonymize(docs, "key").collect():
        for e in find.findall(texts[r.doc_id].text):
            n += 1
            other = regex.fullmatch(r"\d{16}", e) and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(e[::-1])) % 10
            assert (e in r.text) == bool(other)  # numbers that no card has stay
    assert n


def test_private_data_in_empty_tables(empty, odd):
    assert op9_pii.pseudonymize(empty, "key").count() == 0
    r = op9_pii.pseudonymize(odd, "key")
    assert r.columns == odd.columns and r.count() == len(ODD)


# 10: token ids


def brute_length(counts, limit):
    """Cost of the best code of at most `limit` bits, by dynamic programming over the levels of a tree."""
    w = sorted((c for c in counts if c), reverse=True)
    n = len(w)
    if n == 1:
        return w[0]
    best = {(0, 1): 0}  # (leaves placed, open nodes at this level) -> cost
    total = sum(w)
    done = None
    for _ in range(limit):
        nxt = {}
        for (placed, open_), cost in best.items():
            rest = sum(w[placed:])
            for leaves in range(0, min(2 * open_, n - placed) + 1):
                key, c = (placed + leaves, 2 * open_ - leaves), cost + rest
                if key[0] == n and key[1] == 0:
                    done = c if done is None else min(done, c)
                elif key[1] <= n - key[0] and (key not in nxt or c < nxt[key]):
                    nxt[key] = c
        best = nxt
    assert total >= 0
    return done


def test_code_lengths_are_the_best():
    rng = np.random.default_rng(3)
    for limit in (3, 4, 6):
        for _ in range(15):
            c = rng.integers(1, 200, rng.integers(2, 9)) ** 2
            n = huffman.lengths(c, limit)
            assert n.max() <= limit and sum(2.0 ** -int(x) for x in n) <= 1
            assert int((n * c).sum()) == brute_length(c.tolist(), limit)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_blocks_decode(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(1, n) * 3).astype("u2") % 3000
    length = huffman.lengths(np.bincount(ids, minlength=1)) if n else huffman.lengths(np.array([1]))
    block = huffman.encode(ids, huffman.packed(length), 77)
    first, out = huffman.decode(block, *huffman.table(length))
    assert first == 77 and (out == ids).all() and len(out) == n


def test_ids_as_the_library(docs, texts):
    e = op10_token_ids.Encoder(op10_token_ids.default_path())
    for x in ["", " ", "a  b", "\na", "a \nb", "it's ok, don't.", "x—, y", "a\tb c", "²½ Ⅷ.", "''s s's", "<|endoftext|> x", "日本 語　 x", *(r.text for r in list(texts.values())[:40])]:
        assert e(x) == e.ids(x) == np.array(e.library.encode(x, add_special_tokens=False).ids, "<u2").tobytes()
    at = 0
    for r in read(docs):
        ids = e.library.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def read(docs):
    blocks, length = op10_token_ids.write_ids(docs)
    return sorted(op10_token_ids.read_ids(blocks, length, with_ids=False).collect(), key=lambda r: r.start)


def test_id_files_of_odd_rows(odd, empty):
    r = read(odd)
    assert len(r) == len(ODD) and [x.doc_id for x in r] == sorted((i for i, *_ in ODD), key=lambda i: (i is not None, i))
    assert all(x.n_tokens == 1 for x in r if x.doc_id in (2, 3)) and read(empty) == []


# common helpers


def test_made_columns_keep_the_others(spark):
    df = spark.createDataFrame([(1, "x", [1.5], {"a": 1}), (None, None, None, None)], "doc_id bigint, text string, v array<double>, m map<string,int>").withColumn("n", F.lit("old"))
    r = common.with_made(df, ["text"], "n long", lambda: lambda t: [[len(x or "") for x in t]]).collect()
    assert [(x.doc_id, x.v, x.m, x.n) for x in r] == [(1, [1.5], {"a": 1}, 1), (None, None, None, 0)]


def test_split_points_bound_the_ranges(spark):
    ids = spark.range(10_000).withColumnRenamed("id", "doc_id")
    p = split_points(ids, 1000)
    assert 5 <= len(p) <= 10 and split_points(ids.limit(0)) == []
    n = pd.Series(np.searchsorted(p, np.arange(10_000), "right")).value_counts()
    assert n.max() < 2000


def test_copies_in_chunks(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (None, 12)], "id bigint, n bigint")
    for most in (12, 2):
        r = common.copies(df, "n", "i", "id", most, chunk=4).collect()
        assert sorted((str(x.id), x.i) for x in r) == sorted((str(i), k) for i, n in ((1, 5), (2, 1), (None, 12)) for k in range(n))


def test_vocabularies_of_any_size():
    counts = np.arange(1, 70_001)
    length = huffman.lengths(counts)
    ids = np.random.default_rng(1).integers(0, 70_000, 3000)
    assert length.max() <= 18 and (huffman.decode(huffman.encode(ids, huffman.packed(length), 0), *huffman.table(length))[1] == ids).all()
