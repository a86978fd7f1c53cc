import pytest
from pyspark.sql import functions as F

from foliary.backends import EchoOcr
from foliary.operators import process as p
from foliary.operators.metrics import document_summary

ROWS = [("d", 1, "A long enough embedded text of the first page, ended.", "Title one\nBody of the first page is here."), ("d", 2, "", "short recognised text, yes"), ("d", 3, "tiny", "x")]


def failing():
    class Failing:  # of this function, so that workers get it by value
        def blocks(self, image):
            if b"yes" in image:
                raise ValueError("no layout")
            return p.LineLayout().blocks(image)

        def crop(self, image, box):
            return p.LineLayout().crop(image, box)

    return Failing()


def local(f):
    """A copy of a function that is pickled by value: workers cannot import tests."""
    import types

    return types.FunctionType(f.__code__, {"p": p, "__name__": "__main__", "ValueError": ValueError}, f.__name__)


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(ROWS, "document_id string, page_number int, text string, image string").withColumn("image", F.col("image").cast("binary"))


def test_text_only_reads_what_lacks_text(source):
    contents, articles = p.process(source, "text_only", EchoOcr, p.LineLayout)
    r = {x.page_number: x for x in contents.collect()}
    assert articles is None and r[1].page_text == ROWS[0][2] and r[2].page_text == ROWS[1][3] and r[3].page_text == "tiny"
    assert not r[2].needs_review and r[3].needs_review


def test_layout_modes_agree(source):
    a, x = p.process(source, "full", EchoOcr, p.LineLayout)
    b, y = p.process(source, "no_preprocessing", EchoOcr, p.LineLayout)
    assert a.exceptAll(b).isEmpty() and x.exceptAll(y).isEmpty()
    assert {r.page_number: r.page_text for r in a.collect()}[1] == "Title one\nBody of the first page is here."
    assert sorted(n for r in x.collect() for n in r.page_numbers) == [1, 2, 3]


def test_a_failing_page_leaves_the_others(source):
    found = p.found_blocks(source, local(failing))
    assert [r.error for r in found.where("page_number = 2").collect()] == ["ValueError: no layout"]
    contents, articles = p.process(source, "full", EchoOcr, local(failing))
    assert {r.page_number: r.error for r in contents.collect()} == {1: None, 2: "ValueError: no layout", 3: None}
    done = source.join(found.groupBy("document_id", "page_number").agg(F.first("error", True).alias("layout_error")), ["document_id", "page_number"])
    s = document_summary(done.select("document_id", (F.length("text") > 40).alias("has_text"), "layout_error", F.lit(None).cast("string").alias("content_error"), F.col("layout_error").isNull().alias("layout_done"), F.lit(True).alias("content_done")), ["document_id"]).first()
    assert (s.total_pages, s.with_text, s.layout_ok, s.layout_error_count) == (3, 1, 2, 1)


def broken():
    class Broken:
        def predict(self, batch):
            raise ValueError("no model")

    return Broken()


def test_seeds_stand_in_for_a_failing_model(source):
    contents, _ = p.process(source, "full", local(broken), p.LineLayout)
    r = {x.page_number: x for x in contents.collect()}
    assert r[1].page_text == ROWS[0][3] and r[1].needs_review_count == 2


def test_text_only_takes_the_best_candidate(spark):
    from foliary import backends

    rows = [("d", 1, "", "x"), ("d", 2, "some embedded words", "words"), ("d", 3, None, "a meaningful recognised text"), ("d", 4, None, "")]
    s = spark.createDataFrame(rows, "document_id string, page_number int, text string, image string").withColumn("image", F.col("image").cast("binary"))
    out = backends.text_only_pages(s, EchoOcr, p.KEY, second=EchoOcr)
    assert {r.page_number: (r.backend, r.text) for r in out.collect()} == {1: ("paddleocr", "x"), 2: ("pdf_text", "some embedded words"), 3: ("paddleocr", rows[2][3]), 4: ("paddleocr", "")}


def test_unknown_modes_are_refused(source):
    with pytest.raises(ValueError):
        p.process(source, "fast", EchoOcr, p.LineLayout)


def test_binary_files(spark, tmp_path):
    from foliary.sources.ingest import binary_documents, quarantined, text_pages

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing of the kind")
    assert sorted(str(r.error) for r in binary_documents(spark, str(tmp_path)).collect()) == ["None", "invalid_pdf"]
    good, bad = quarantined(spark.createDataFrame([("a.pdf", "x/y", 3), ("b", "x/y", 3)], "name string, content_type string, size int"))
    assert good.count() == 1 and bad.first().error == "unsupported_type"
    pages = text_pages(spark.createDataFrame([("d", [" one ", None])], "document_id string, pages array<string>")).collect()
    assert [(r.page_number, r.text) for r in pages] == [(1, "one"), (2, "")]


def test_tables_and_catalog_files(spark, tmp_path):
    from foliary.sources import sinks
    from foliary.sources.ingest import json_records, lookup

    rows = spark.createDataFrame([("d1", 1, "x"), ("d2", 1, "y")], "document_id string, page_number int, page_text string")
    sinks.write_pages(rows, str(tmp_path / "p"))
    sinks.write_pages(rows.where("document_id = 'd1'").withColumn("page_text", F.lit("z")), str(tmp_path / "p"))
    back = sinks.read_pages(spark, str(tmp_path / "p"))
    assert {(r.document_id, r.page_text) for r in back.collect()} == {("d1", "z"), ("d2", "y")} and back.where("result_path IS NULL").isEmpty()
    assert lookup(back, "document_id", "d2").count() == 1 and lookup(back, "document_id", "no").isEmpty()
    sinks.write_json(rows, str(tmp_path / "j"))
    assert json_records(spark, str(tmp_path / "j"), rows.schema.simpleString().removeprefix("struct<")[:-1].replace(":", " ")).count() == 2
    sinks.write_catalog(rows, str(tmp_path / "c"))
    assert "document_id;page_number;page_text" in {r.value for r in spark.read.text(str(tmp_path / "c")).collect()}
    assert [r.document_id for r in sinks.latest(rows, "document_id", 1).collect()] == ["d2"]
