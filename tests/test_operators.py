from pyspark.sql import functions as F

from foliary.functions.text import split_lines
from foliary.operators import articles, export, layout, metadata, routing, segment
from foliary.plans.catalog import QUERIES
from foliary.plans.fixtures import fixture

BLOCK = "document_id string, page_number int, page_content_id string, block_id string, type string, reading_order int, bbox struct<x1:int,y1:int,x2:int,y2:int>, content string, latex string, needs_review boolean, route_to string"


def block(page, n, kind, text, y1=40, y2=120, latex=None):
    return ("d", page, f"p{page}", f"p{page}_b{n}", kind, n, (80, y1, 820, y2), text, latex, False, "text_pipeline")


def pages(spark, *rows):
    b = spark.createDataFrame(list(rows), BLOCK)
    key = ["document_id", "page_number"]
    f = segment.page_features(b, key)
    return b, f.withColumn("page_content_id", F.lit("x")).withColumn("page_text", F.col("joined_text"))


def decisions(spark, *rows):
    _, p = pages(spark, *rows)
    return [(r.page_number, r.is_article_start, r.score, r.decision) for r in segment.boundaries(p).orderBy("page_number").collect()]


def test_first_page_starts(spark):
    assert decisions(spark, block(1, 1, "text", "Title"))[0] == (1, True, 1.0, "article_start")


def test_gap_and_sentence_end_start_an_article(spark):
    rows = [block(1, 1, "text", "Ends here."), block(2, 1, "text", "New", 200, 240), block(2, 2, "text", "rest", 300, 620)]
    assert decisions(spark, *rows)[1] == (2, True, 1.0, "article_start")


def test_gap_without_sentence_end_asks_for_review(spark):
    rows = [block(1, 1, "text", "goes on"), block(2, 1, "text", "New", 200, 620)]
    assert decisions(spark, *rows)[1] == (2, True, 0.75, "article_start_review")


def test_sentence_end_without_gap_asks_for_review(spark):
    rows = [block(1, 1, "text", "Ends here;"), block(2, 1, "text", "next", 10, 620)]
    assert decisions(spark, *rows)[1] == (2, False, 0.25, "review_boundary")


def test_articles_partition_the_pages(spark, sf_dir):
    a = QUERIES["article_segments"](spark, sf_dir).select("document_id", F.explode("page_numbers").alias("n"))
    assert a.count() == a.distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_merge_compares_with_the_union(spark):
    rows = [("d", 1, "a", "text", (0, 0, 100, 20), 0.5, 1, "one", None), ("d", 1, "b", "text", (0, 30, 100, 50), 0.9, 2, "two", None), ("d", 1, "c", "text", (200, 60, 300, 80), 0.9, 3, "far", None), ("d", 1, "e", "table", (0, 60, 100, 90), 0.9, 4, "t", None)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, block_id string, type string, bbox struct<x1:int,y1:int,x2:int,y2:int>, confidence double, reading_order int, text string, latex string")
    out = layout.merged(df, ["document_id", "page_number"], 1400).first().blocks
    assert [(b.type, b.text, b.confidence) for b in out] == [("text", "one\ntwo", 0.9), ("text", "far", 0.9), ("table", "t", 0.9)]


def test_merge_against_a_loop(spark, sf_dir):
    from foliary.plans.catalog import _layout_blocks

    rows = _layout_blocks(spark, sf_dir).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.document_id, r.page_number, r.reading_order, r.bbox.y1, r.bbox.x1, r.block_id)):
        page = want.setdefault((r.document_id, r.page_number), [])
        b, last = r.bbox, page[-1] if page else None
        if last and last[0] == r.type and r.type in layout.MERGEABLE:
            wide = max(0, min(last[3], b.x2) - max(last[1], b.x1)) / max(1, min(last[3] - last[1], b.x2 - b.x1))
            gap = max(b.y1 - last[4], last[2] - b.y2, 0)
            if wide >= 0.55 and gap <= max(18, int(2000 * 0.012)):
                page[-1] = [r.type, min(last[1], b.x1), min(last[2], b.y1), max(last[3], b.x2), max(last[4], b.y2)]
                continue
        page.append([r.type, b.x1, b.y1, b.x2, b.y2])
    got = QUERIES["merge_blocks_fold"](spark, sf_dir).collect()
    assert len(got) < len(rows)
    assert sorted((r.document_id, r.page_number, r.place, r.type, r.x1, r.y1, r.x2, r.y2) for r in got) == sorted((*k, i, *b) for k, page in want.items() for i, b in enumerate(page))


def test_article_fields(spark):
    r = {x.id: x for x in QUERIES["article_fields"](spark, "").collect()}
    assert (r[1].title, r[1].authors, r[1].year, r[1].n_references) == ("О сходимости рядов", "А. И. Иванов", 1910, 2)
    assert r[1].keywords == "ряды|сходимость|анализ" and r[1].abstract.startswith("В работе")
    assert (r[2].title, r[2].authors, r[2].year) == ("On the Theory of Series", "J. Smith", 1924)
    assert r[2].abstract == "We show that series converge under mild conditions."
    assert r[4].keywords == "alpha|beta|Gamma"
    assert r[5].title is None and r[6].authors == ""


def test_references(spark):
    r = {x.id: x for x in QUERIES["reference_parse"](spark, "").collect()}
    assert (r[2].authors, r[2].title, r[2].year) == ("Smith J", "On numbers", 1910)
    assert (r[4].authors, r[4].title) == ("Petrov P., Sidorov S", "Ряды")
    lines = [x.raw_text for x in QUERIES["references_split"](spark, "").where("id = 7").collect()]
    assert lines == ["Smith J. Old paper. 1899 with a second line", "Brown B. New paper. 1901"]


def test_authors_split(spark):
    r = {x.id: x.authors for x in QUERIES["authors_split"](spark, "").collect()}
    assert r[1] == "A. B. Smith|C. Jones" and r[2] == "John Smith|Mary Jones" and r[4] == "Ivanov I. I."


def test_keywords_against_a_loop(spark, sf_dir):
    scores = metadata.keyword_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20), ["doc_id"], F.substring("text", 1, 60), F.substring("text", 1, 1200))
    want = {}
    for r in sorted(scores.collect(), key=lambda r: (r.doc_id, -r.score, r.first_seen)):
        want.setdefault(r.doc_id, []).append(r.phrase)
    for k, ps in want.items():
        kept = []
        for p in ps[:20]:
            if len(kept) < 5 and not any(p in o or o in p for o in kept):
                kept.append(p)
        want[k] = kept
    assert {r.doc_id: r.keywords for r in metadata.chosen_keywords(scores, ["doc_id"]).collect()} == want


def test_article_latex_leaves_the_head_out(spark):
    b = spark.createDataFrame([block(1, 1, "title", "On Sets"), block(1, 2, "text", "A. B. Author"), block(1, 3, "text", "Body & more"), block(1, 4, "formula", None, latex="$x$"), block(1, 5, "table", None), block(2, 1, "text", "On  sets"), block(2, 2, "page_number", "7")], BLOCK)
    a = spark.createDataFrame([("d", "article_001", None, None, "")], "document_id string, article_id string, title string, author string, article_text string")
    r = articles.latex_articles(a, b.withColumn("article_id", F.lit("article_001")), ["document_id", "article_id"]).first()
    assert (r.title, r.author) == ("On Sets", "A. B. Author")
    assert r.body == "Body \\& more\n\n\\[\nx\n\\]\n\n% TODO: TABLE p1_b5"
    assert not r.needs_review and r.latex_preview.startswith("\\title{On Sets}\n\n\\author{A. B. Author}\n\n\\maketitle\n\nBody")


def test_spelling(spark):
    r = {x.token: x for x in QUERIES["spell_candidates"](spark, "").collect()}
    assert r["теорня"].best == "теория" and r["интегралл"].best == "интеграл" and "абракадабра" not in r
    p = {x.id: x for x in QUERIES["text_postprocess"](spark, "").collect()}
    assert p[4].cleaned_text == "теоремы и доказательство" and p[12].cleaned_text == "$x - y$ and <<FORMULA_1>> stay, here"


def test_archives_hold_every_file(spark, sf_dir):
    import io
    import zipfile

    from foliary.plans.catalog import _export_articles

    f = export.archive_files(_export_articles(spark, sf_dir), ["document_id"])
    z = export.archives(f, "document_id").limit(1).first()
    names = zipfile.ZipFile(io.BytesIO(bytes(z.archive))).namelist()
    assert f"{z.document_id}/manifest.json" in names and len(names) == f.where(F.col("document_id") == z.document_id).count()


def test_payloads(spark):
    r = [(x.id, x.block_id, x.error) for x in QUERIES["payload_parse"](spark, "").orderBy("id", "place").collect()]
    assert r == [(1, "a", None), (2, None, "not_an_array"), (3, "b", "invalid_block"), (4, "c", "invalid_block"), (4, "d", "invalid_block"), (5, None, None)]


def test_seeds_and_fallback_models(spark, sf_dir):
    r = QUERIES["formula_backends"](spark, sf_dir).groupBy("backend").count().collect()
    assert {x.backend for x in r} == {"surya", "pix2tex"}


def test_no_python_in_the_plans(spark, sf_dir):
    free = {"text_only_mode", "formula_backends", "spell_candidates", "spell_edit_candidates", "text_postprocess", "archive_files"}
    for name in ("article_segments", "article_boundaries", "page_contents", "line_block_spatial_join", "keyword_topk", "article_fields", "merge_blocks_fold"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert name in free or not any(x in plan for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct")), name


def test_one_exchange_for_the_windows(spark, sf_dir):
    p = spark.createDataFrame([("d", 1, "a", "t", 10, "t", 1)], "document_id string, page_number int, page_content_id string, page_text string, page_height int, first_text string, first_text_y int")
    plan = segment.numbered(segment.boundaries(p))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_progress_stream(spark, tmp_path):
    from foliary.streaming import progress

    src = tmp_path / "in"
    spark.createDataFrame([("d", 1, 2, "x" * 50, None), ("d", 2, 2, None, "unreadable")], progress.PAGES).write.json(str(src))
    q = progress.write_progress(progress.progress_events(progress.page_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert len(lines) == 2 and '"type":"error"' in lines[0] + lines[1]


def test_empty_tables(spark):
    b = spark.createDataFrame([], BLOCK)
    assert segment.page_features(b, ["document_id", "page_number"]).count() == 0
    assert routing.formula_blocks(b).count() == 0
    assert split_lines is not None and fixture(spark, "lists").count() == 4
