import __spark_entry__ as entry


def test_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "pieces"]
    kept = docs
    for name, stage in p.STAGES:
        out = stage(spark, kept, sf_dir).cache()
        if name != "pieces":
            assert out.columns == docs.columns, name
        if name == "language":
            assert out.count() == docs.where(docs.text.rlike(r"\p{L}")).count()
        if name == "near_duplicates":
            assert 0 < out.count() < kept.count() and out.select("doc_id").distinct().count() == out.count()
        if name == "personal_data":
            assert out.count() == kept.count() and out.where("text rlike '@mail[0-9]'").count() == 0
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "mixture":
            assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3
        if name == "pieces":
            assert out.count() == kept.count() and out.where("n_pieces <> size(pieces)").count() == 0
            assert out.select("doc_id", "text").exceptAll(kept.select("doc_id", "text")).count() == 0
        kept = out


def test_stages_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert {"op7_license_scan", "op8_topk"} <= set(entry.oracle_sql())
