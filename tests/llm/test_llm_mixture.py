"""The mixture stage against the quotas of its sources."""

from collections import Counter

import corpus_pipeline
from foliary.llm import op6_mix

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_mixture_gives_each_source_its_quota(spark, sf_dir):
    rows = [(i, "w " * n, "en", s, 2 * n) for i, (s, n) in enumerate([("a", 20_000), *[("a", 40)] * 50, *[("b", 300)] * 60, *[("c", 7)] * 900, *[("d", 2000)] * 3])]
    rows += [(5000, "x y z " * 20, "en", "b", 120)] * 30
    docs = spark.createDataFrame(rows, SCHEMA)
    quota = {r["source"]: (r["quota"][-1], r["source_size"]) for r in op6_mix.plan({s: sum(len(t.split()) for _, t, _, x, _ in rows if x == s) for s in "abcd"})}
    got, times = Counter(), Counter()
    for r in corpus_pipeline.mixture(spark, docs, sf_dir).collect():
        got[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    for s, (q, size) in quota.items():
        longest = max(len(t.split()) for _, t, _, x, _ in rows if x == s)
        assert abs(got[s] - min(q * op6_mix.BLOCK, 3 * size)) <= longest / 2 + 1, s
    assert max(n for i, n in times.items() if i != 5000) <= 3 and times[5000] <= 90


def test_mixture_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = op6_mix.words(docs.text)
    size = {r[0]: (r[1], r[2]) for r in docs.groupBy("source").agg({"doc_id": "count"}).select("source").join(docs.withColumn("w", words).groupBy("source").agg({"w": "sum"}).toDF("source", "n"), "source").join(docs.withColumn("w", words).groupBy("source").agg({"w": "max"}).toDF("source", "m"), "source").collect()}
    out = op6_mix.mixed_rows(docs)
    got = {r[0]: r[1] for r in out.withColumn("w", op6_mix.words(out.text)).groupBy("source").agg({"w": "sum"}).collect()}
    for r in op6_mix.plan({s: n for s, (n, _) in size.items()}):
        assert abs(got.get(r["source"], 0) - r["target"]) <= size[r["source"]][1] / 2 + 3 * op6_mix.BLOCK
