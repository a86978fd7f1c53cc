"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from foliary.llm import near_copies, op4_simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def brute(texts):
    """The smallest doc_id of each group, and the number of pairs of different texts at 0.8 or more."""
    sets, root, pairs = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += texts[i] != texts[j]
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in texts}, pairs


@pytest.fixture(scope="module")
def edited():
    """Texts with copies whose words differ in places, so that pairs lie on both sides of 0.8."""
    rng, out = random.Random(5), {}
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, 60, 200, 400]))]
        for c in range(4):
            w = list(base)
            for at in rng.sample(range(len(w)), min(len(w), c * max(1, len(w) // 90))):
                w[at] = f"x{rng.randrange(10**6)}"
            out[len(out)] = " ".join(w)
    return out


def test_stage_removes_near_copies_at_four_fifths(spark, sf_dir, edited):
    want, pairs = brute(edited)
    assert pairs > 40
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in edited.items()], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, sf_dir).collect()} == want
    assert {r.doc_id for r in near_copies.keep_one(rows, share=300).collect()} == want


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == want


def test_fingerprints_alone_give_all_near_copies_that_they_link(spark, edited):
    """Without MinHash: near-copies among texts that fingerprints link, directly or in steps, against all pairs."""
    sets = {i: near_copies.shingles(t) for i, t in edited.items()}
    fp = {i: op4_simhash.majority(s) for i, s in sets.items()}
    assert all(f == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in sets[i]) > len(sets[i])) for i, f in list(fp.items())[::9])

    def closure(near):
        root = {i: i for i in sets}
        for i in sets:
            for j in sets:
                if i < j and root[i] != root[j] and near(i, j):
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if r == b else r for k, r in root.items()}
        return root

    linked = closure(lambda i, j: (fp[i] ^ fp[j]).bit_count() <= near_copies.DISTANCE)
    want = closure(lambda i, j: linked[i] == linked[j] and 9 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 4 * (len(sets[i]) + len(sets[j])))
    assert len(set(want.values())) < len(want) - 10
    docs = spark.createDataFrame(list(edited.items()), "doc_id bigint, text string")
    marks = near_copies.marked(docs, "doc_id", "text").localCheckpoint()
    ids = {}
    for r in sorted(marks.collect(), key=lambda r: r.doc_id):
        ids.setdefault(r.v, r.doc_id)
    vertices = marks.where(marks.doc_id.isin(list(ids.values())))
    root = {r.u: r.v for r in near_copies.groups_of(vertices, docs, "doc_id", "text", rounds=(0,)).collect()}
    groups = lambda of: sorted(sorted(i for i in ids.values() if of(i) == g) for g in {of(i) for i in ids.values()})
    at = {i: v for v, i in ids.items()}
    assert groups(lambda i: root.get(at[i], at[i])) == groups(lambda i: want[i])


def test_stage_links_fingerprints_by_the_pigeonhole_search(spark, sf_dir, edited, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "links", lambda fps, distance: asked.append((fps.columns, distance)) or op4_simhash.links(fps, distance))
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in edited.items()], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, sf_dir).collect()} == brute(edited)[0]
    assert asked == [(["fp"], near_copies.DISTANCE)]


def test_stage_on_odd_rows(spark, sf_dir):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "A  b\nc", "en", "s", 6), (None, "d e", "en", "s", 3), (3, None, None, None, None), (4, " \n", None, None, 2), (5, "d e", "en", "s", 3)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5]
