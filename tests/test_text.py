from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliary.functions import geometry as g
from foliary.functions import latex as lx
from foliary.functions import text as t
from foliary.schemas import box


def one(spark, column_of, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column_of(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_hyphenated_words_join_over_lines(spark):
    assert one(spark, t.clean_ocr, "теоре-\n ма") == "теорема"
    assert one(spark, t.clean_ocr, "a  ( b ) , c\nd") == "a (b), c d"


def test_unicode_white_space(spark):
    assert one(spark, t.clean_ocr, " x , y ") == "x, y"
    assert one(spark, t.strip, "  \n x ") == "x"


def test_escape_at_once(spark):
    assert one(spark, lx.escape_latex, "\\{}") == "\\textbackslash{}\\{\\}"


def test_inline_math(spark):
    assert one(spark, lx.text_to_latex, "is <math>E=mc^2</math> & so") == "is $E=mc^2$ \\& so"
    assert one(spark, lx.clean_latex, "$$ \\( x \\) $$") == "x"


def test_document_shell(spark):
    out = one(spark, lambda a, b: lx.latex_document(a, b), "Body", "A & B")
    assert out.startswith("\\documentclass{article}\n") and "\\title{A \\& B}" in out and out.endswith("\\begin{document}\n\n\\maketitle\n\nBody\n\n\\end{document}")
    assert "\\maketitle" not in one(spark, lambda a: lx.latex_document(a), "Body")


def test_protected_spans_come_back(spark):
    text = "keep $a - b$ and <<TABLE_1>> , then $$x <<IMAGE_2>>$$"
    assert one(spark, lambda c: t.restore(t.protect(c), t.protected_spans(c)), text) == text


def test_file_names(spark):
    name = lambda c: t.with_suffix(t.sanitized_stem(c, F.lit("x")), ".zip")
    assert one(spark, name, 'a/b:"c"') == "a_b_c.zip"
    assert one(spark, name, " ._ ") == "x.zip"
    assert one(spark, name, "A.ZIP") == "A.ZIP"


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(["A,", "a", "ß", "SS", " "],)], "v array<string>")
    assert df.select(t.dedupe(F.col("v")).alias("x")).first().x == ["A", "ß"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(b=st.tuples(*[st.integers(-3000, 3000)] * 4))
def test_clamped_boxes_lie_inside(spark, b):
    df = spark.createDataFrame([b], "a int, b int, c int, d int").select(g.clamp(box(*map(F.col, "abcd")), F.lit(1000), F.lit(1400)).alias("x"))
    x = df.first().x
    assert 0 <= x.x1 < x.x2 <= 1000 and 0 <= x.y1 < x.y2 <= 1400


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(s=st.text(alphabet="ab -\n.,()[]\t", max_size=40))
def test_cleaner_is_stable(spark, s):
    once = one(spark, t.clean_ocr, s)
    assert one(spark, lambda c: t.clean_ocr(t.clean_ocr(c)), once) == one(spark, t.clean_ocr, once)
